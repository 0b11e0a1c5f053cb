"""Training samples, contacts and logic names."""

from pyspark.sql import functions as F

from tracewright.operators import alignment, near, nets, training
from tracewright.sources.documents import SCHEMAS


def sample(score, **params):
    base = dict(brightest_pct=0.0, min_threshold=0, fixed_threshold=0, clahe_clip=0.0, clahe_tile=0, min_scale_dim=0, invert=False, use_otsu=False, use_adaptive=False, adaptive_block=0, adaptive_c=0, dilate=0, erode=0, psm_mode=6)
    return ("T", "T", score, "N", tuple({**base, **params}.values()), 1, 1, False, "", "", 0)


def test_recommended(spark):
    rows = [sample(0.9, fixed_threshold=120, psm_mode=7), sample(0.8, fixed_threshold=110, psm_mode=7), sample(0.8, fixed_threshold=110), sample(0.75, use_otsu=True, clahe_clip=2.0, clahe_tile=8, invert=True), sample(0.1, use_adaptive=True)]
    df = spark.createDataFrame(rows, SCHEMAS["ocr_samples"])
    assert tuple(training.recommended(df).first()) == ("fixed", 110, 2.0, 8, 150, False, 7)
    assert training.recommended(df.limit(4)).count() == 0


def test_color_profiles_depend_on_order_only(spark):
    rows = [(1, i, v, s) for i, (v, s) in enumerate([(30.0, 40.0), (45.0, 90.0), (55.0, 10.0), (20.0, 200.0), (36.0, 50.0)])]
    got = sorted(tuple(r) for r in training.color_profiles(spark.createDataFrame(rows, "board int, ord int, value double, sat double").repartition(3)).collect())
    assert got == [(1, 1, 22.0, 53.0, 110.0, 3), (1, 2, 47.0, 63.0, 80.0, 1), (1, 3, 12.0, 28.0, 200.0, 1)]


def test_same_boxes_are_thinned(spark):
    rows = [(1, 1, 10.0, 10.0, 5.0, 5.0), (1, 2, 10.9, 10.2, 5.0, 5.0), (1, 3, 11.5, 10.0, 5.0, 5.0), (1, 4, 10.0, 10.0, 6.0, 5.0)]
    df = spark.createDataFrame(rows, "board int, id int, x double, y double, width double, height double")
    assert sorted(r.id for r in near.thinned(df, training.same_box(df), "id").collect()) == [1, 3, 4]


def test_loosely_contains(spark):
    df = spark.createDataFrame([("MADE IN J4PAN",), ("JAPXN",), ("XXPAN",), ("JA",)], "t string")
    assert [r.v for r in df.select(training.loosely_contains(F.col("t"), "JAPAN", 1).alias("v")).collect()] == [True, True, False, False]


def test_outliers(spark):
    rows = [(1, i, i * 10.0, 100.0 + (i % 2), 8, 20) for i in range(10)] + [(1, 10, 55.0, 160.0, 8, 20), (1, 11, 65.0, 100.0, 30, 20), (2, 1, 0.0, 0.0, 1, 1), (2, 2, 5.0, 900.0, 9, 9)]
    got = alignment.without_outliers(spark.createDataFrame(rows, "board int, id int, x double, y double, width int, height int"), 0.3)
    assert sorted(r.id for r in got.where("board = 1").collect()) == list(range(10))
    assert got.where("board = 2").count() == 2


def test_grid_run(spark):
    rows = [(1, f"c{i}", 100.0 + i * 20 + (1 if i % 3 else 0)) for i in range(8)] + [(1, "odd", 109.0)]
    got = alignment.grid_run(spark.createDataFrame(rows, "board int, id string, x double"), 20.0, 8).collect()
    assert {r.place: r.id for r in got} == {i: f"c{i}" for i in range(8)}


def test_coarse_pairs(spark):
    f = spark.createDataFrame([(1, f"f{i}", i * 50.0) for i in range(5)], "board int, id string, x double")
    b = spark.createDataFrame([(1, f"b{i}", 700.0 + i * 50.0 + i % 2) for i in range(5)], "board int, id string, x double")
    got = near.greedy_match(alignment.coarse_pairs(f, b, 8.0)).collect()
    assert {(r.left_id, r.right_id) for r in got} == {(f"f{i}", f"b{i}") for i in range(5)}


def test_logic_names_pass_through_a_chain(spark):
    fn = spark.createDataFrame([("7404", "D", "NOT", [1], [2]), ("7404", "D", "NOT", [3], [4]), ("7400", "D", "NAND", [1, 2], [3])], "part_number string, package string, type string, inputs array<int>, outputs array<int>")
    comps = spark.createDataFrame([("U1", "7404", "D"), ("U2", "7400", "D")], "component string, part_number string, package string")
    pins = spark.createDataFrame([("n1", "U1", "1"), ("n2", "U1", "2"), ("n2", "U1", "3"), ("n3", "U1", "4"), ("n4", "U2", "3")], "net_id string, component string, pin string")
    named = spark.createDataFrame([("n1", "FOO", False), ("n2", "net-002", False), ("n3", "U1.4", False), ("n4", "net-004", False)], "net_id string, name string, manual boolean")
    links = nets.gate_links(fn, comps, pins)
    once = {r.net_id: r.name for r in nets.logic_names(named, links, 1).collect()}
    full = {r.net_id: r.name for r in nets.logic_names(named, links).collect()}
    assert once == {"n1": "FOO", "n2": "/FOO", "n3": "U1.4", "n4": "net-004"}
    assert full == {"n1": "FOO", "n2": "/FOO", "n3": "FOO", "n4": "net-004"}
    fixed = named.withColumn("manual", F.col("net_id") == "n2")
    assert {r.net_id: r.name for r in nets.logic_names(fixed, links).collect()}["n2"] == "net-002"
