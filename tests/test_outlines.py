"""Outlines from two sides and pins beside known pins."""

import math

from pyspark.sql import functions as F

from tracewright.functions import outlines
from tracewright.operators import packages, selecting

VIA = "center struct<x:double,y:double>, radius double, {} array<struct<x:double,y:double>>"


def _pairs(spark, rows, name, more=""):
    kind = VIA.format(name) + more
    return spark.createDataFrame(rows, f"id int, a struct<{kind.replace(' ', ':').replace(',:', ',')}>, b struct<{kind.replace(' ', ':').replace(',:', ',')}>")


def test_confirmed_outline(spark):
    square = [(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)]
    speck = [(0.1, 0.0), (0.0, 0.1), (-0.1, 0.0)]
    rows = [
        (1, ((0.0, 0.0), 9.0, square), ((0.0, 0.0), 1.0, square)),
        (2, ((0.0, 0.0), 2.0, square), ((0.0, 0.0), 1.0, None)),
        (3, ((0.0, 0.0), 3.0, square[:2]), ((2.0, 0.0), 1.0, [])),
        (4, ((0.0, 0.0), 3.0, speck), ((0.0, 0.0), 1.0, speck)),
        (5, ((0.0, 0.0), 3.0, None), ((0.0, 0.0), 1.0, speck)),
    ]
    out = _pairs(spark, rows, "pad_boundary").select("id", outlines.confirmed_outline(F.col("a"), F.col("b")).alias("o"))
    got = {r.id: r.o for r in out.collect()}
    want = {1: (0, 0.95 * math.hypot(2, 2)), 2: (0, 2.0), 3: (1, 2.0), 4: (0, 2.0), 5: (0, 0.095)}
    for i, (x, radius) in want.items():
        assert len(got[i]) == 32 and math.isclose(got[i][0].x, x + radius) and abs(got[i][0].y) < 1e-12


def test_merged_boundary(spark):
    rows = [
        (1, ((0.0, 0.0), 1.0, [(0.0, 0.0), (4.0, 0.0), (2.0, 1.0)], False), ((0.0, 0.0), 1.0, [(4.0, 4.0), (0.0, 4.0)], False)),
        (2, ((7.0, 0.0), 1.0, [(0.0, 0.0)], True), ((8.0, 0.0), 2.0, [(1.0, 1.0)], False)),
        (3, ((7.0, 0.0), 2.0, [(0.0, 0.0)], True), ((8.0, 0.0), 0.0, None, False)),
        (4, ((0.0, 0.0), 1.0, [(0.0, 0.0), (1.0, 0.0)], False), ((0.0, 0.0), 1.0, [(5.0, 0.0)], False)),
        (5, ((1.0, 1.0), 3.0, [], True), ((0.0, 0.0), 0.0, [], False)),
    ]
    out = _pairs(spark, rows, "boundary", ", is_circle boolean").select("id", outlines.merged_boundary(F.col("a"), F.col("b")).alias("m"))
    got = {r.id: r.m for r in out.collect()}
    assert {tuple(p) for p in got[1].boundary} == {(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)}
    assert tuple(got[1].center) == (2.0, 1.8) and math.isclose(got[1].radius, math.hypot(2, 2.2)) and not got[1].is_circle
    assert (got[2].center.x, got[2].radius, len(got[2].boundary), got[2].is_circle) == (8.0, 2.0, 1, False)
    assert (got[3].center.x, got[3].radius, got[3].is_circle) == (7.0, 2.0, True)
    assert got[4].is_circle and len(got[4].boundary) == 64 and got[4].center.x == 2.0 and got[4].radius == 3.0
    assert len(got[5].boundary) == 32 and math.isclose(got[5].radius, 3.0) and not got[5].is_circle


def test_pins_by_neighbours(spark):
    rows = [
        ("u1", "a", "3", 0.0, 0.0), ("u1", "b", "5", 20.0, 0.0), ("u1", "c", "", -10.0, 0.0), ("u1", "d", "", 30.0, 1.0), ("u1", "e", "", -40.0, 0.0),
        ("u2", "a", "2", 0.0, 0.0), ("u2", "b", "", 30.0, 0.0), ("u2", "c", "", 4.0, 0.0), ("u2", "d", "x", 1.0, 0.0),
        ("u3", "a", "", 0.0, 0.0),
    ]
    vias = spark.createDataFrame(rows, "component string, id string, pin string, x double, y double")
    got = {(r.component, r.id): r.pin for r in packages.pin_by_neighbours(vias, 100.0).collect()}
    assert got == {("u1", "c"): 2, ("u1", "d"): 6, ("u1", "e"): 7, ("u2", "b"): 5}


def test_spec_names(spark):
    specs = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "name string")
    assert [r.name for r in selecting.spec_names(specs).collect()] == ["a", "b"]
