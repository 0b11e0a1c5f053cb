"""Statistics over samples and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median: the value at place n div 2, from 0, of each group's sorted values.

    Values are counted first, so a group costs a row for each distinct value, not for each row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    placed = counted.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    return placed.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def spread(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation of each value by group."""
    return df.groupBy(*keys).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def group_variance(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row, variance: the mean of the population variances of groups of two rows or more; null for none."""
    return df.groupBy(key).agg(F.var_pop(value).alias("v"), F.count(value).alias("n")).where("n >= 2").agg(F.avg("v").alias("variance"))


def longest_run(df: DataFrame, order: str, hit: Column) -> DataFrame:
    """(first, last, length) of the longest run of neighbouring integer places for which hit holds; the first on ties."""
    hits = df.where(hit).select(F.col(order).alias("place")).distinct()
    bucket = hits.withColumn("part", F.floor(F.col("place") / 4096))
    own = bucket.withColumn("island", F.col("place") - F.row_number().over(W.partitionBy("part").orderBy("place")))
    runs = own.groupBy("part", "island").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    # only runs that reach an end of their part may go on in another: two a part at most meet in one window
    opened = (F.pmod("first", F.lit(4096)) == 0) | (F.pmod("last", F.lit(4096)) == 4095)
    w = W.orderBy("first")
    joined = runs.where(opened).withColumn("new", F.coalesce((F.col("first") != F.lag("last").over(w) + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    whole = joined.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
    whole = whole.unionByName(runs.where(~opened).select("first", "last"))
    return whole.withColumn("length", F.col("last") - F.col("first") + 1).orderBy(F.desc("length"), "first").limit(1).select("first", "last", "length")


def line_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and its angle in degrees by group; 0 where x does not vary."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"))
    return fit.select(*keys, F.coalesce("slope", F.lit(0.0)).alias("slope"), F.degrees(F.atan(F.coalesce("slope", F.lit(0.0)))).alias("angle"))


def best_by_group(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each group by the order."""
    return df.withColumn("rank_", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("rank_ = 1").drop("rank_")


def score_bands(df: DataFrame, score: Column, bounds: tuple[float, ...] = (0.95, 0.7, 0.5)) -> DataFrame:
    """One row with the number of rows in each band from the top, and of those below all."""
    upper, columns = None, []
    for i, b in enumerate(bounds, 1):
        fits = score >= b if upper is None else (score >= b) & (score < upper)
        columns.append(F.count_if(fits).alias(f"band{i}"))
        upper = b
    return df.agg(*columns, F.count_if(score < bounds[-1]).alias("rest"))


def size_templates(df: DataFrame, width: str = "width_mm", height: str = "height_mm") -> DataFrame:
    """Groups of parts by package: wide or not, and pins along the longer side; means and accepted limits."""
    short, long = F.least(width, height), F.greatest(width, height)
    unit = F.round(long / 2.54)
    out = df.withColumn("short", short).withColumn("long", long).groupBy((short > 11).alias("wide"), unit.cast("int").alias("units")).agg(F.avg("short").alias("mean_width"), F.avg("long").alias("mean_height"), F.min("short").alias("least_width"), F.max("short").alias("most_width"), F.count("*").alias("n"))
    return out.withColumn("width_low", F.greatest(F.col("least_width") - 1.5, F.lit(1.0))).withColumn("width_high", F.col("most_width") + 1.5).withColumn("height_low", F.greatest((F.col("units") - 0.75) * 2.54, F.lit(1.0))).withColumn("height_high", (F.col("units") + 0.75) * 2.54)


def otsu(df: DataFrame, value: str) -> DataFrame:
    """One row, threshold: the value of 0 to 255 that separates best, by between-class variance; the first on ties."""
    hist = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    bins = hist.sparkSession.range(256).select(F.col("id").cast("int").alias("v")).join(hist, "v", "left").fillna(0, ["n"])
    upto = W.orderBy("v")  # 256 rows
    every = W.partitionBy()
    cum = bins.select("v", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("v")).over(every).alias("s"))
    between = F.try_divide(F.pow(F.col("s0") * F.col("w") - F.col("s") * F.col("w0"), F.lit(2)), F.col("w0") * (F.col("w") - F.col("w0")))
    return cum.withColumn("between", F.coalesce(between, F.lit(0.0))).orderBy(F.desc("between"), "v").limit(1).select(F.col("v").alias("threshold"))


def ocr_method(params: Column) -> Column:
    """Which method a sample's settings stand for."""
    return F.when(params["use_adaptive"], "adaptive").when(params["use_otsu"], "otsu").when(params["fixed_threshold"] > 0, "fixed").when(params["brightest_pct"] > 0, "histogram")


def ocr_statistics(samples: DataFrame, least: float = 0.7) -> dict[str, DataFrame]:
    """Counts and scores of samples from least on, by orientation, method, and setting."""
    good = samples.where(F.col("score") >= least)
    method = ocr_method(F.col("params"))
    return {
        "orientation": good.groupBy("orientation").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("best")),
        "method": good.where(method.isNotNull()).groupBy(method.alias("method")).agg(F.avg("score").alias("mean"), F.count("*").alias("n")),
        "thresholds": good.where("params.fixed_threshold > 0").groupBy("params.fixed_threshold").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "fixed_threshold").limit(5),
        "psm": good.groupBy("params.psm_mode").agg(F.avg("score").alias("mean")),
        "invert": good.groupBy("params.invert").agg(F.avg("score").alias("mean")),
    }
