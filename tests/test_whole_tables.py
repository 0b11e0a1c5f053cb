"""Queries without a fixed share of rows in their SQL read whole tables."""

from tracewright.plans import layout, records


def test_trees_cover_all_customers(spark, tmp_path):
    d = str(tmp_path)
    spark.range(1, 502).selectExpr("id AS c_custkey", "CAST(id % 2 AS INT) AS c_nationkey").write.parquet(f"{d}/customer.parquet")
    trees = records.net_trees(spark, d).collect()
    assert len(trees) == 499 and {n for r in trees for n in (r.a, r.b)} == {*range(1, 502)}


def test_names_cover_all_parts(spark, tmp_path):
    d = str(tmp_path)
    spark.range(1, 1001).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{d}/part.parquet")
    assert {r.place for r in layout.grid_names(spark, d).collect()} == {*range(5, 1001, 5)}
    axes = {tuple(r) for r in layout.name_axes(spark, d).collect()}
    assert axes == {(b, "Y", "X", "LN") for b in range(3)}
