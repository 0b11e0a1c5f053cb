"""Alignment, grids, pixels, packages, exports and feature records on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import geometry, polygons
from tracewright.operators import alignment, exports, features, grids, packages, pixels
from tracewright.sources.documents import save_text


def pair_rows(n, a=0.9, b=-0.2, tx=5.0, c=0.2, d=0.9, ty=-3.0, bad=()):
    rows = []
    for i in range(n):
        x, y = float(i * 7 % 50), float(i * i % 41)
        off = 100.0 * (i + 1) if i in bad else 0.0
        rows.append((1, i, x, y, a * x + b * y + tx + off, c * x + d * y + ty - off))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "board int, ord long, x1 double, y1 double, x2 double, y2 double")


def test_affine_fit_and_error(spark):
    pairs = frame(spark, pair_rows(12))
    fit = alignment.affine_fit(pairs, ["board"])
    r = fit.first()
    assert (r.a, r.b, r.tx, r.c, r.d, r.ty) == pytest.approx((0.9, -0.2, 5.0, 0.2, 0.9, -3.0))
    assert alignment.alignment_error(pairs, fit, ["board"]).first().error == pytest.approx(0, abs=1e-9)
    line = frame(spark, [(1, i, float(i), float(2 * i), 0.0, 0.0) for i in range(5)])
    assert alignment.affine_fit(line, ["board"]).first().a is None


def test_sampled_affine_finds_the_inliers(spark):
    r = alignment.sampled_affine(frame(spark, pair_rows(30, bad={2, 5, 11, 17})).repartition(3), "board", 40, 1.0).first()
    assert r.inliers == 26 and (r.a, r.ty) == pytest.approx((0.9, -3.0))


def test_rigid_fit(spark):
    t = math.radians(30)
    rows = [(1, i, float(i), float(i * i % 7), i * math.cos(t) - (i * i % 7) * math.sin(t) + 4, i * math.sin(t) + (i * i % 7) * math.cos(t) - 1) for i in range(8)]
    r = alignment.rigid_fit(frame(spark, rows), ["board"]).first()
    assert (math.degrees(r.angle), r.tx, r.ty) == pytest.approx((30, 4, -1))


def test_sampled_rigid_leaves_out_strays_and_degenerate_draws(spark):
    t = math.radians(-40)
    turn = lambda x, y: (x * math.cos(t) - y * math.sin(t) + 9, x * math.sin(t) + y * math.cos(t) + 2)
    rows = [(1, i, float(i * 7 % 31), float(i * i % 17), *turn(i * 7 % 31, i * i % 17)) for i in range(24)]
    rows = [(*r[:4], r[4] + (60 + r[1] if r[1] % 3 == 0 else 0), r[5]) for r in rows]
    rows += [(2, 0, 1.0, 1.0, 5.0, 5.0), (2, 1, 1.0, 1.0, 9.0, 9.0), (3, 0, 1.0, 1.0, 5.0, 5.0)]  # no direction; too few
    got = [alignment.sampled_rigid(frame(spark, rows).repartition(n), "board", 60, 0.5).collect() for n in (1, 5)]
    assert [[(r.board, r.inliers) for r in g] for g in got] == [[(1, 16)]] * 2
    assert all((math.degrees(g[0].angle), g[0].tx, g[0].ty) == pytest.approx((-40, 9, 2)) for g in got)


def test_contact_scale_needs_ten(spark):
    rows = [(1, i * 75.0 + (300 if i > 6 else 0)) for i in range(12)] + [(2, i * 75.0) for i in range(9)]
    got = {r.board: r.dpi for r in alignment.contact_scale(spark.createDataFrame(rows, "board int, x double"), 0.125).collect()}
    assert got == {1: pytest.approx(600.0), 2: 0.0}


def test_pitch(spark):
    gaps = spark.createDataFrame([(1, g) for g in (10.0, 10.2, 20.0, 30.1, 9.9)], "board int, gap double")
    assert alignment.interval_pitch(gaps).first().pitch == pytest.approx((10.0 + 10.2 + 9.9) / 3)
    at = spark.createDataFrame([(1, i, x) for i, x in enumerate((0.0, 20.4, 40.8, 102.0))], "board int, ord int, x double")
    assert alignment.pitch_votes(at, 15.0).first().bin == 20
    assert alignment.anchor(at, spark.createDataFrame([(1, 20.4)], "board int, pitch double")).first().ord == 0


def test_grid_names(spark):
    rows = [(1, f"{chr(65 + r)}{c * 2 + 1}", c * 100.0, r * 80.0) for r in range(4) for c in range(4) if (r, c) != (1, 1)]
    known = spark.createDataFrame(rows, "board int, id string, x double, y double")
    assert tuple(grids.grid_axes(known).first())[1:] == ("Y", "X", "LN")
    places = spark.createDataFrame([(1, 1, 100.0, 80.0), (1, 2, 150.0, 240.0), (1, 3, -900.0, 80.0), (1, 4, -900.0, -900.0)], "board int, place int, x double, y double")
    got = {r.place: r.name for r in grids.suggested(places, known, 20.0).collect()}
    assert got == {1: "B3", 2: "D4", 3: "B?", 4: None}
    board = known.withColumn("key", F.col("id")).unionByName(spark.createDataFrame([(1, "NEW1", 100.0, 80.0, "k")], "board int, id string, x double, y double, key string"))
    assert {r.key: r.id for r in grids.propagated(board, 20.0).collect()}["k"] == "B3"


def test_grid_axes_of_one_kind_and_ties(spark):
    one = spark.createDataFrame([(1, "A1", 0.0, 0.0), (1, "A2", 0.0, 50.0), (2, "A1", 0.0, 0.0)], "board int, id string, x double, y double")
    got = {r.board: (r.letter_axis, r.number_axis) for r in grids.grid_axes(one).collect()}
    assert got == {1: ("X", "Y"), 2: ("Y", "X")}


def test_pixels(spark):
    px = spark.createDataFrame([("i", x, y, 0, 0, 200 if 4 <= x < 8 and y < 8 else 10) for x in range(16) for y in range(16)], "img_id string, x int, y int, h int, s int, v int")
    cells = pixels.matching_cells(px, 4, F.col("v") > 100)
    assert {(r.cx, r.cy) for r in cells.collect()} == {(1, 0), (1, 1)}
    assert [tuple(r)[2:] for r in pixels.regions(cells).collect()] == [(1, 0, 1, 1, 2)]
    assert pixels.opened(cells).count() == 0
    r = pixels.value_peaks(px).first()
    assert (r.background, r.marking) == (8.0, 200.0)
    assert pixels.brightest_threshold(px, 10.0, 50).first().threshold == 200
    assert pixels.border_color(px).first().v == (10 * 60 + 200 * 4) // 64
    stats = pixels.class_statistics(px.withColumn("class", F.when(F.col("v") > 100, "on").otherwise("off")))
    assert {r.v: round(r.score, 3) for r in pixels.on_score(px, stats).collect()} == {10: 0.0, 200: 1.0}


def test_packages(spark):
    c = spark.createDataFrame([("U1", "DIP-14", 0.0, 0.0, 80.0, 200.0, 0.0), ("U2", "QFP", 0.0, 0.0, 1.0, 1.0, 0.0)], "id string, package string, bx double, by double, bw double, bh double, rotation double")
    pins = packages.pin_places(c, 254.0)
    at = {r.pin: (round(r.x, 3), round(r.y, 3), r.row) for r in pins.collect()}
    assert len(at) == 14 and at[1] == (1.9, 23.8, 1) and at[14] == (78.1, 23.8, 2) and at[8] == (78.1, 176.2, 2)
    found = packages.renumbered(pins.select(F.col("id").alias("component"), F.concat(F.lit("v"), "pin").alias("id"), "x", "y"))
    assert all(r.id == f"v{r.pin}" for r in found.collect())
    turned = packages.started_at(found, spark.createDataFrame([("U1", "v3", 1)], "component string, id string, pin int"))
    assert {r.id: r.pin for r in turned.collect()}["v1"] == 13
    row = spark.createDataFrame([("S", str(i), i * 10.0, 0.5 * (i % 2)) for i in range(5)], "component string, id string, x double, y double")
    assert all(int(r.id) + 1 == r.pin for r in packages.renumbered(row).collect())


def test_features(spark):
    vias = spark.createDataFrame([("v1", (0.0, 0.0), 2.0, None, 0), ("v2", (10.0, 0.0), 1.0, [(9.0, -1.0), (11.0, -1.0), (11.0, 1.0), (9.0, 1.0)], 1)], "id string, center struct<x:double,y:double>, radius double, pad_boundary array<struct<x:double,y:double>>, ord int")
    tracks = spark.createDataFrame([("t1", "front", [(0.0, 0.0), (20.0, 0.0)], 2.0, 0)], "id string, side string, points array<struct<x:double,y:double>>, width double, ord int")
    assert features.first_hit(features.hits(vias, tracks, 10.5, 0.5)).first().id == "v2"
    assert features.first_hit(features.hits(vias, tracks, 5.0, 1.0)).first().id == "t1"
    assert features.hits(vias, tracks, 5.0, 1.01).count() == 0
    flat = spark.createDataFrame([("v1", 0.0, 0.0, "front", 2.0, 0.5, True), ("v2", 20.0, 5.0, "back", 2.0, 0.9, False)], "id string, x double, y double, side string, radius double, confidence double, both_sides_confirmed boolean")
    assert [tuple(r) for r in features.tracks_at(tracks, flat, 5.0).orderBy("via_id").collect()] == [("v1", "t1"), ("v2", "t1")]
    assert [tuple(r) for r in features.tracks_at(tracks, flat, 5.0, same_side=True).collect()] == [("v1", "t1")]
    assert tuple(features.side_counts(flat).first()) == (1, 1)
    assert features.boosted(flat, 0.5).where("id = 'v1'").first().confidence == 0.75
    near = spark.createDataFrame([("n1", 3.0, 0.0, 1.5), ("n2", 100.0, 0.0, 1.0)], "id string, x double, y double, radius double")
    assert [r.id for r in features.overlapping(near, flat, 10.0).collect()] == ["n2"]
    assert features.next_number(spark.createDataFrame([("cvia-007",), ("via-F-001",)], "id string"), "cvia-").first().number == 8
    bus = spark.createDataFrame([("v1", "b", "red"), ("v2", None, None)], "id string, bus string, color string")
    assert {r.id: r.bus for r in features.assigned(bus, bus.where("id = 'v2'"), "a", "blue").collect()} == {"v1": "b", "v2": "a"}


def test_function_pins_and_power(spark):
    fn = spark.createDataFrame([("7400", "DIP-14", "A", [1, 2], [3], [2], None)], "part_number string, package string, name string, inputs array<int>, outputs array<int>, enables array<int>, clocks array<int>")
    assert {(r.pin_number, r.role, r.place) for r in features.function_pins(fn).collect()} == {(1, "input", 1), (2, "input", 2), (3, "output", 3)}
    pins = spark.createDataFrame([("7400", "DIP-14", n) for n in (1, 2, 3, 7)], "part_number string, package string, pin_number int")
    assert [r.pin_number for r in features.power_pins(pins, fn).collect()] == [7]


def test_exports(spark, tmp_path):
    comps = spark.createDataFrame([("U1", "7400", "DIP-14"), ("U2", "", "")], "id string, part_number string, package string")
    nets = spark.createDataFrame([("B",), ("A",)], "name string")
    conns = spark.createDataFrame([("A", "U1", 3, 1), ("A", "U2", 1, 0)], "name string, component string, pin int, ord int")
    lines = [r.line for r in exports.kicad_netlist("demo", comps, nets, conns).orderBy("part", "seq").collect() if r.part in (1, 3)]
    assert lines == ['    (comp (ref "U1")', '      (value "7400")', '      (footprint "DIP-14")', "    )", '    (comp (ref "U2")', "    )", '    (net (code "1") (name "A")', '      (node (ref "U2") (pin "1"))', '      (node (ref "U1") (pin "3"))', "    )", '    (net (code "2") (name "B")', "    )"]
    spice = exports.spice_netlist("demo", comps, nets, conns)
    assert [r.line for r in spice.orderBy("part", "seq").collect()] == ["* demo", "* Generated by tracewright", "", "* Components:", "* U1: 7400 (DIP-14)", "* U2:  ()", "", "* Nets:", "* A: U2.1 U1.3", "* B:", "", ".END"]
    save_text(spice, ["part", "seq"], str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[0] == "* demo" and text.splitlines()[-1] == ".END"


def test_logic_lines(spark):
    pins = spark.createDataFrame([("U1", "7400", "D", p, f"pin {p}") for p in ("1", "2", "3", "14")], "component string, part_number string, package string, pin string, text string")
    parts = spark.createDataFrame([("7400", "D", "quad gate")], "part_number string, package string, description string")
    fn = spark.createDataFrame([("7400", "D", 0, "A", "NAND", [1], [3], [2], [], "1*2"), ("7400", "D", 1, "B", "NAND", [1], [9], [2], [], None)], "part_number string, package string, ord int, name string, type string, inputs array<int>, outputs array<int>, enables array<int>, clocks array<int>, expr string")
    got = [r.line for r in exports.logic_lines(pins, parts, fn).orderBy("component", "rank", "fn", "role", "place").collect()]
    assert got == ["=== U1 (7400 - quad gate) ===", "  Gate A (NAND): 1*2", "    pin 1", "    pin 2", "    pin 3", "  Gate B (NAND)", "    pin 1", "  Power:", "    pin 14"]


def test_polygons(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert polygons.hull([*square, (1.0, 1.0), (1.0, 0.0)]) == square
    assert polygons.clipped([(-1.0, 0.5), (1.0, 0.5), (1.0, 1.5), (-1.0, 1.5)], square) == [(0.0, 0.5), (1.0, 0.5), (1.0, 1.5), (0.0, 1.5)]
    assert polygons.simplified([(0.0, 0.0), (1.0, 0.05), (2.0, 0.0), (3.0, 2.0)], 0.1) == [(0.0, 0.0), (2.0, 0.0), (3.0, 2.0)]
    assert polygons.straightened([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0)]) == [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)]
    df = spark.createDataFrame([(square,), (None,)], "p array<struct<x:double,y:double>>")
    rows = df.select(polygons.convex_hull("p").alias("h"), polygons.is_convex(F.col("p")).alias("c"), polygons.simplify("p", F.lit(0.1)).alias("s"), geometry.centroid(F.col("p")).alias("m")).collect()
    assert [tuple(x) for x in rows[0].h] == square and rows[0].c and tuple(rows[0].m) == (1.0, 1.0)
    assert rows[1].h is None and len(rows[0].s) == 4
