"""Board-like inputs projected from the driver's tables; these projections are ours, the operators are general."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, label): a point for each vector, 100 times its first two components, to six digits."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double") * 100, 6)
    return e.select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), F.col("label"))


#: The same for DuckDB, as a common table expression.
POINTS = "points AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 100, 6) AS x, round(embedding[2]::DOUBLE * 100, 6) AS y, label FROM embeddings)"
SIDES = POINTS + ", f AS (SELECT * FROM points WHERE label % 2 = 0), b AS (SELECT * FROM points WHERE label % 2 = 1)"
DIST = "sqrt((f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y))"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p.where("label % 2 = 0"), p.where("label % 2 = 1")


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): part and supplier of all lines, apart for each year of shipping: p1.1994 and s1.1994."""
    lines = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    return lines.select(F.concat_ws(".", F.concat(F.lit("p"), "l_partkey"), year).alias("a"), F.concat_ws(".", F.concat(F.lit("s"), "l_suppkey"), year).alias("b"))


def numbered_edges(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """part_supplier_edges with numbers for names, see node_name; None where a key or a year is missing or too large for that."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"))
    fits = F.col("l_partkey").between(0, 2**47) & F.col("l_suppkey").between(0, 2**47) & F.col("year").between(1, 9999)
    if not lines.where(~F.coalesce(fits, F.lit(False))).isEmpty():
        return None
    number = lambda key, side: (F.col(key).cast("long") * 32768 + F.col("year") * 2 + side)
    return lines.select(number("l_partkey", 0).alias("a"), number("l_suppkey", 1).alias("b"))


def node_name(node: Column) -> Column:
    """The name of a node of numbered_edges: p1.1994 or s1.1994."""
    key, year, side = F.shiftright(node, 15), F.shiftright(node.bitwiseAND(32767), 1), node.bitwiseAND(1)
    return F.concat_ws(".", F.concat(F.when(side == 1, "s").otherwise("p"), key), year)


EDGES = "edges AS (SELECT DISTINCT 'p' || l_partkey || '.' || year(l_shipdate) AS a, 's' || l_suppkey || '.' || year(l_shipdate) AS b FROM lineitem)"
