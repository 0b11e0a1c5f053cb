"""Steps that once shuffled their rows more often than the result needs."""

from pyspark.sql import functions as F

from tracewright.operators import drawing, features, loop
from tracewright.plans import drawings


def _joins(df):
    return sum("Join [" in line or "Join LeftAnti" in line for line in df._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_tracks_at_vias_by_one_join(spark):
    vias = spark.createDataFrame([(1, "front", 0.0, 0.0), (2, "back", 0.0, 0.0), (3, "front", 9.0, 9.0)], "id int, side string, x double, y double")
    tracks = spark.sql("SELECT 7 AS id, 'front' AS side, array(named_struct('x', 0.5D, 'y', 0D), named_struct('x', 5D, 'y', 0D), named_struct('x', 0D, 'y', 0.5D)) AS points UNION ALL SELECT 8, 'back', array(named_struct('x', 9D, 'y', 9D), named_struct('x', 0D, 'y', 0D))")
    got = features.tracks_at(tracks, vias, 1.0, same_side=True)
    assert _joins(got) == 1 and sorted(map(tuple, got.collect())) == [(1, 7), (2, 8)]
    assert sorted(map(tuple, features.tracks_at(tracks, vias.drop("side"), 1.0).collect())) == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 8)]


def test_sheet_connectors_by_two_joins(spark):
    symbols = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 2, 2), (1, "c", 3, 3), (2, "a", 1, 1)], "doc int, id string, ord int, sheet int")
    rows = [(1, "a", 1, "output", "n", "", 300.0, 300.0), (1, "a", 2, "input", "n", "A", 0.0, 0.0), (1, "b", 1, "input", "n", "B", 500.0, 20.0), (1, "c", 1, "input", "n", "", 10.0, 200.0), (1, "a", 3, "input", "p", "GND", 1.0, 1.0), (1, "b", 3, "input", "p", "GND", 1.0, 1.0), (1, "c", 4, "input", None, "", 1.0, 1.0), (2, "a", 1, "input", "n", "", 1.0, 1.0)]
    pins = spark.createDataFrame(rows, "doc int, symbol_id string, ord int, direction string, net_id string, net_name string, x double, y double")
    got = drawing.off_sheet(symbols, pins, spark.createDataFrame([(1, "p")], "doc int, net_id string"))
    assert _joins(got) == 2  # symbols, power nets
    at = {1: (360.0, 290.0, "output"), 2: (360.0, 100.0, "input"), 3: (100.0, 190.0, "input")}
    assert sorted(map(tuple, got.collect())) == sorted((1, s, "n", "B", t, *at[s]) for s in at for t in at if s != t)


def test_pins_are_dealt_by_their_number(spark, monkeypatch):
    """Partitions of a fixed number hold more rows, and take more memory to sort, the larger the tables are."""
    plain = drawings.drawn_pins(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(loop, "ROWS", 500, raising=False)
    got = drawings.drawn_pins(spark, "/root/testdata/sf0.001")
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2000 and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_nets_are_shuffled_and_parts_broadcast(spark):
    """Nets look small behind an explode, and were broadcast; few parts that many components have were hot keys of a shuffle."""
    plan = drawings.drawn_pins(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("Join [")[1].split("]")[0] for line in plan.split("\n") if "BroadcastHashJoin [" in line]
    assert not [k for k in keys if k.startswith(("doc", "l_orderkey"))] and "SortMergeJoin [found_part" not in plan
