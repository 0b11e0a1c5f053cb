"""Distance joins over a grid of cells, one-to-one matching, nearest rows and greedy thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.loop import settled


def _cells(df: DataFrame, x: str, y: str, size: float, around: bool) -> DataFrame:
    """df with its grid cell (cx, cy), or with one row for each of the nine cells around."""
    base = df.withColumn("cx", F.floor(F.col(x) / size)).withColumn("cy", F.floor(F.col(y) / size))
    if not around:
        return base
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    return base.withColumn("near", near).withColumn("cx", F.col("cx") + F.col("near.dx")).withColumn("cy", F.col("cy") + F.col("near.dy")).drop("near")


def near_join(left: DataFrame, right: DataFrame, tolerance: float, strict: bool = False) -> DataFrame:
    """(left_id, right_id, dist) of rows (id, x, y) within the tolerance; an equi-join on grid cells, then the distance.

    A crowded cell is a skewed key of a plain join, which adaptive execution splits.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")
    a = _cells(left.select(F.col("id").alias("left_id"), F.col("x").alias("lx"), F.col("y").alias("ly")), "lx", "ly", tolerance, False)
    b = _cells(right.select(F.col("id").alias("right_id"), F.col("x").alias("rx"), F.col("y").alias("ry")), "rx", "ry", tolerance, True)
    dist = F.sqrt((F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry")))
    pairs = a.join(b, ["cx", "cy"]).withColumn("dist", dist)
    return pairs.where(F.col("dist") < tolerance if strict else F.col("dist") <= tolerance).select("left_id", "right_id", "dist")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one choice from (left_id, right_id, dist): ascending distance, then ids, each row used once.

    Each round takes the pairs that come first for both of their rows, which is what the sequential choice does.
    """
    rest, taken = settled(pairs), None
    while True:
        order = [F.col("dist"), F.col("left_id"), F.col("right_id")]
        key = F.struct(*order)
        best_left = rest.groupBy("left_id").agg(F.min(key).alias("bl"))
        best_right = rest.groupBy("right_id").agg(F.min(key).alias("br"))
        won = settled(rest.join(best_left, "left_id").join(best_right, "right_id").where((key == F.col("bl")) & (key == F.col("br"))).select("left_id", "right_id", "dist"))
        if won.isEmpty():
            return taken if taken is not None else won
        taken = won if taken is None else taken.unionByName(won)
        rest = settled(rest.join(won.select("left_id"), "left_id", "left_anti").join(won.select("right_id"), "right_id", "left_anti"))


def nearest(left: DataFrame, right: DataFrame, limit: float) -> DataFrame:
    """(left_id, right_id, dist): for each row its nearest row within the limit, ties to the smaller id."""
    best = near_join(left, right, limit).groupBy("left_id").agg(F.min(F.struct("dist", "right_id")).alias("best"))
    return best.select("left_id", F.col("best.right_id").alias("right_id"), F.col("best.dist").alias("dist"))


def dense_filter(points: DataFrame, tolerance: float, most: int) -> DataFrame:
    """The rows with at most so many other rows within the tolerance."""
    crowd = near_join(points, points, tolerance).where("left_id <> right_id").groupBy(F.col("left_id").alias("id")).agg(F.count("*").alias("others"))
    return points.join(crowd, "id", "left").where(F.coalesce("others", F.lit(0)) <= most).drop("others")


def thinned(points: DataFrame, pairs: DataFrame, rank: str) -> DataFrame:
    """Rows kept when taken by rank, each unless a kept one before is its partner in pairs (left_id, right_id).

    Rounds keep the undecided rows without an undecided partner before them, and drop these rows' later partners.
    """
    ranked = points.select("id", F.col(rank).alias("rank"))
    a, b = ranked.select(F.col("id").alias("left_id"), F.col("rank").alias("lr")), ranked.select(F.col("id").alias("right_id"), F.col("rank").alias("rr"))
    edges = settled(pairs.where("left_id <> right_id").select("left_id", "right_id").join(a, "left_id").join(b, "right_id").where(F.struct("lr", "left_id") < F.struct("rr", "right_id")).select("left_id", "right_id"))
    open_, kept = settled(ranked.select("id")), None
    while True:
        blocked = edges.select(F.col("right_id").alias("id")).distinct()
        won = settled(open_.join(blocked, "id", "left_anti"))
        if won.isEmpty():
            return points.join(kept if kept is not None else won, "id", "left_semi")
        kept = won if kept is None else kept.unionByName(won)
        lost = edges.join(won.select(F.col("id").alias("left_id")), "left_id", "left_semi").select(F.col("right_id").alias("id")).distinct()
        open_ = settled(open_.join(won, "id", "left_anti").join(lost, "id", "left_anti"))
        gone = won.unionByName(lost)
        edges = settled(edges.join(gone.select(F.col("id").alias("left_id")), "left_id", "left_anti").join(lost.select(F.col("id").alias("right_id")), "right_id", "left_anti"))


def unmatched(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def nearest_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest partners of each left row."""
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("left_id").orderBy("dist", "right_id"))).where(F.col("rank") <= k)


def vote_peak(offsets: DataFrame, bin_size: float = 5.0, least: int = 3, limit: float | None = None) -> DataFrame:
    """The offset bin (bx, by, score) whose nine bins hold most of the offsets (dx, dy); ties to the one nearest 0.

    No row if the score is under least or the bin's centre lies beyond the limit.
    """
    counts = offsets.groupBy(F.floor(F.col("dx") / bin_size).alias("bx"), F.floor(F.col("dy") / bin_size).alias("by")).agg(F.count("*").alias("n"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = counts.select("bx", "by", "n", around.alias("d")).groupBy((F.col("bx") + F.col("d.i")).alias("bx"), (F.col("by") + F.col("d.j")).alias("by")).agg(F.sum("n").alias("score"))
    scored = spread.join(counts.select("bx", "by"), ["bx", "by"], "left_semi")
    d2 = (F.col("bx") + 0.5) * (F.col("bx") + 0.5) + (F.col("by") + 0.5) * (F.col("by") + 0.5)
    best = scored.withColumn("d2", d2).orderBy(F.desc("score"), "d2", "bx", "by").limit(1)
    fits = F.col("score") >= least
    if limit is not None:
        fits = fits & (F.sqrt("d2") * bin_size <= limit)
    return best.where(fits).select("bx", "by", "score")
