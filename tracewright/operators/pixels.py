"""Pixel tables (img_id, x, y, h, s, v): cell figures, histograms, regions and colour classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.records import bucket
from tracewright.operators.graph import components


def cell_variance(pixels: DataFrame, size: int) -> DataFrame:
    """(img_id, cx, cy, variance): population variances of saturation and value, added, by cell."""
    return pixels.groupBy("img_id", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg((F.var_pop("s") + F.var_pop("v")).alias("variance"))


def matching_cells(pixels: DataFrame, size: int, match: Column, least: float = 0.4) -> DataFrame:
    """(img_id, cx, cy) of cells of which more than least of the pixels match."""
    return pixels.groupBy("img_id", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.avg(match.cast("double")).alias("share")).where(F.col("share") > least).select("img_id", "cx", "cy")


def _beside(cells: DataFrame) -> DataFrame:
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    return cells.select("img_id", "cx", "cy", step.alias("d")).select("img_id", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))


def opened(cells: DataFrame) -> DataFrame:
    """Cells left by an erosion to those with three set neighbours or more, then a dilation."""
    n = _beside(cells).groupBy("img_id", "cx", "cy").agg(F.count("*").alias("n")).where("n >= 3")
    core = cells.join(n, ["img_id", "cx", "cy"], "left_semi")
    return core.unionByName(_beside(core)).distinct()


def regions(cells: DataFrame) -> DataFrame:
    """(img_id, region, x1, y1, x2, y2, cells): boxes of the 4-connected regions of set cells."""
    key = F.concat_ws(":", "img_id", F.lpad(F.col("cy").cast("string"), 8, "0"), F.lpad(F.col("cx").cast("string"), 8, "0"))
    named = cells.withColumn("node", key)
    right = named.select("img_id", (F.col("cx") + 1).alias("cx"), "cy", F.col("node").alias("a"))
    below = named.select("img_id", "cx", (F.col("cy") + 1).alias("cy"), F.col("node").alias("a"))
    edges = right.unionByName(below).join(named, ["img_id", "cx", "cy"]).select("a", F.col("node").alias("b"))
    roots = named.join(components(edges), "node", "left").withColumn("region", F.coalesce("root", "node"))
    return roots.groupBy("img_id", "region").agg(F.min("cx").alias("x1"), F.min("cy").alias("y1"), F.max("cx").alias("x2"), F.max("cy").alias("y2"), F.count("*").alias("cells"))


def value_peaks(pixels: DataFrame) -> DataFrame:
    """(img_id, background, background_pct, marking, marking_pct): of 16 value bins the fullest, the lowest on ties, and
    the brightest one above it with more than a hundredth of the pixels, else the same; values are bin centres."""
    bins = pixels.groupBy("img_id", F.floor(F.col("v") / 16).alias("bin")).agg(F.count("*").alias("n"))
    total = bins.groupBy("img_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", -F.col("bin"), "bin")).alias("top"))
    joined = bins.join(total, "img_id")
    bright = joined.where((F.col("bin") > F.col("top.bin")) & (F.col("n") > F.floor(F.col("total") / 100))).groupBy("img_id").agg(F.max(F.struct("bin", "n")).alias("mark"))
    share = lambda n: 100.0 * n / F.col("total")
    centre = lambda b: b * 16 + 8.0
    mark_bin, mark_n = F.coalesce("mark.bin", "top.bin"), F.coalesce("mark.n", "top.n")
    return total.join(bright, "img_id", "left").select("img_id", centre(F.col("top.bin")).alias("background"), share(F.col("top.n")).alias("background_pct"), centre(mark_bin).alias("marking"), share(mark_n).alias("marking_pct"))


def brightest_threshold(pixels: DataFrame, percent: float, least: int) -> DataFrame:
    """(img_id, threshold): the value from which the brightest percent of pixels begin, at least least."""
    bins = pixels.groupBy("img_id", "v").agg(F.count("*").alias("n"))
    w = W.partitionBy("img_id")
    cum = bins.withColumn("upto", F.sum("n").over(w.orderBy(F.desc("v")))).withColumn("target", (F.sum("n").over(w) * percent / 100).cast("int"))
    return cum.where("upto >= target").groupBy("img_id").agg(F.greatest(F.max("v"), F.lit(least)).alias("threshold"))


def class_statistics(samples: DataFrame, key: str = "class") -> DataFrame:
    """(class, h_mean, h_std, ...): mean and population deviation of hue, saturation and value."""
    return samples.groupBy(key).agg(*(f(c).alias(f"{c}_{n}") for c in ("h", "s", "v") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def on_score(pixels: DataFrame, statistics: DataFrame) -> DataFrame:
    """pixels with score: how much closer to class on than to off; 0.5 where both distances are 0 or a class is missing.

    The statistics are two rows, a broadcast of a fixed size.
    """
    row = statistics.groupBy().pivot("class", ["on", "off"]).agg(*(F.first(c).alias(c) for c in statistics.columns if c != "class"))

    def away(kind: str) -> Column:
        part = lambda c, weight: weight * F.pow((F.col(c) - F.col(f"{kind}_{c}_mean")) / (F.col(f"{kind}_{c}_std") + 1), F.lit(2))
        return F.sqrt(part("h", 1.0) + part("s", 1.5) + part("v", 1.5))

    on, off = away("on"), away("off")
    return pixels.crossJoin(F.broadcast(row)).select(*pixels.columns, F.coalesce(F.try_divide(off, on + off), F.lit(0.5)).alias("score"))


def border_color(pixels: DataFrame) -> DataFrame:
    """(img_id, h, s, v): whole means of the border pixels; the corners count twice."""
    size = pixels.groupBy("img_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    on_x = (F.col("x") == 0).cast("int") + (F.col("x") == F.col("mx")).cast("int")
    on_y = (F.col("y") == 0).cast("int") + (F.col("y") == F.col("my")).cast("int")
    edge = pixels.join(size, "img_id").withColumn("times", on_x + on_y).where("times > 0")
    return edge.groupBy("img_id").agg(*(F.floor(F.sum(F.col(c) * F.col("times")) / F.sum("times")).alias(c) for c in ("h", "s", "v")))


def dense_bounds(cells: DataFrame, columns: int, rows: int, least: float = 0.5) -> DataFrame:
    """(img_id, x1, y1, x2, y2): the span of columns and rows of which at least that share of cells is set."""
    xs = cells.groupBy("img_id", "cx").agg(F.count("*").alias("n")).where(F.col("n") >= least * rows).groupBy("img_id").agg(F.min("cx").alias("x1"), F.max("cx").alias("x2"))
    ys = cells.groupBy("img_id", "cy").agg(F.count("*").alias("n")).where(F.col("n") >= least * columns).groupBy("img_id").agg(F.min("cy").alias("y1"), F.max("cy").alias("y2"))
    whole = cells.groupBy("img_id").agg(F.min("cx").alias("a"), F.min("cy").alias("b"), F.max("cx").alias("c"), F.max("cy").alias("d"))
    out = whole.join(xs, "img_id", "left").join(ys, "img_id", "left")
    return out.select("img_id", *(F.coalesce(n, o).alias(n) for n, o in (("x1", "a"), ("y1", "b"), ("x2", "c"), ("y2", "d"))))


def color_histogram(pixels: DataFrame, key: str = "img_id") -> DataFrame:
    """(key, channel, bucket, percent) of pixels (key, h, s, v): sixteen buckets a channel, those with pixels."""
    channels = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), bucket(F.col(c), w).alias("bucket")) for c, w in (("h", 11), ("s", 16), ("v", 16)))))
    counted = pixels.select(key, channels.alias("c")).groupBy(key, "c.channel", "c.bucket").agg(F.count("*").alias("n"))
    total = counted.where("channel = 'v'").groupBy(key).agg(F.sum("n").alias("total"))
    return counted.join(total, key).select(key, "channel", "bucket", (F.col("n") * 100 / F.col("total")).alias("percent"))


def white_share(pixels: DataFrame, least: int = 180, key: str = "img_id") -> DataFrame:
    """(key, percent) of pixels brighter than least."""
    return pixels.groupBy(key).agg((F.avg((F.col("v") > least).cast("double")) * 100).alias("percent"))


def box_figures(pixels: DataFrame, x1: int, y1: int, x2: int, y2: int, key: str = "img_id") -> DataFrame:
    """Mean and population deviation of h, s and v over the pixels of a closed box."""
    inside = pixels.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))
    return inside.groupBy(key).agg(*(f(c).alias(f"{c}_{n}") for c in "hsv" for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def feature_figures(samples: DataFrame, features: list[str], by: str = "is_via") -> DataFrame:
    """Mean and population deviation of each feature by class, which is what a classifier of samples learns."""
    return samples.groupBy(by).agg(*(f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def colors_around(pixels: DataFrame, centres: DataFrame, reach: int, key: str = "img_id") -> DataFrame:
    """(key, h, s, v): the mean colour of the pixels within reach, level and upright, of a centre (key, x, y); a pixel
    counts for each centre. An equi-join on the pixel."""
    span = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    at = centres.select(key, "x", "y", span.alias("i")).select(key, (F.col("x") + F.col("i")).alias("x"), "y", span.alias("j")).select(key, "x", (F.col("y") + F.col("j")).alias("y"))
    return pixels.join(at, [key, "x", "y"]).groupBy(key).agg(*(F.avg(c).alias(c) for c in "hsv"))
