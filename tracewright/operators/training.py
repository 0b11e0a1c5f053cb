"""Training samples: recommended reading settings, colour clusters, first-come thinning, loose text search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.stats import ocr_method

# Characters that label readers confuse.
CONFUSED = ("0O", "0D", "OD", "1I", "1L", "IL", "5S", "4A", "8B", "6G", "2Z")


def _best_setting(good: DataFrame, where: Column, setting: Column, name: str) -> DataFrame:
    """One row: the setting with the highest summed score; the smallest on ties, null if none."""
    totals = good.where(where).groupBy(setting.alias("k")).agg(F.sum("score").alias("t"))
    return totals.agg(F.max_by("k", F.struct("t", -F.col("k"))).alias(name))


def recommended(samples: DataFrame, least_score: float = 0.7, least_samples: int = 5) -> DataFrame:
    """One row of settings from ocr_samples; none if there are fewer samples.

    The method is the best mean of otsu, fixed and adaptive, in this order on ties; inverted if that scores no worse;
    the page mode is the one of the best mean, the smallest on ties, 6 for none.
    """
    p = F.col("params")
    good = samples.where(F.col("score") >= least_score).withColumn("method", ocr_method(p))
    mean = lambda m: F.coalesce(F.avg(F.when(F.col("method") == m, F.col("score"))), F.lit(0.0))
    inverted = lambda yes: F.coalesce(F.avg(F.when(p["invert"] == yes, F.col("score"))), F.lit(0.0))
    rates = good.agg(mean("otsu").alias("otsu"), mean("fixed").alias("fixed"), mean("adaptive").alias("adaptive"), (inverted(True) >= inverted(False)).alias("invert"))
    clip = _best_setting(good, p["clahe_clip"] > 0, p["clahe_clip"], "clahe_clip")
    tile = _best_setting(good, p["clahe_clip"] > 0, p["clahe_tile"], "clahe_tile")
    scale = _best_setting(good, p["min_scale_dim"] > 0, p["min_scale_dim"], "min_scale_dim")
    fixed = _best_setting(good, F.col("method") == "fixed", p["fixed_threshold"], "fixed_threshold")
    modes = good.groupBy(p["psm_mode"].alias("k")).agg(F.avg("score").alias("m")).agg(F.max_by("k", F.struct("m", -F.col("k"))).alias("psm_mode"))
    row = rates
    for one in (clip, tile, scale, fixed, modes, samples.agg(F.count("*").alias("n"))):
        row = row.crossJoin(one)  # one row each
    method = F.when((F.col("adaptive") > F.col("otsu")) & (F.col("adaptive") > F.col("fixed")), "adaptive").when(F.col("fixed") > F.col("otsu"), "fixed").otherwise("otsu")
    return row.where(F.col("n") >= least_samples).select(
        method.alias("method"),
        F.when(method == "fixed", F.coalesce("fixed_threshold", F.lit(130))).otherwise(0).alias("fixed_threshold"),
        F.coalesce("clahe_clip", F.lit(0.0)).alias("clahe_clip"), F.coalesce("clahe_tile", F.lit(0)).alias("clahe_tile"),
        F.coalesce("min_scale_dim", F.lit(150)).alias("min_scale_dim"), "invert", F.coalesce("psm_mode", F.lit(6)).alias("psm_mode"),
    )


def color_profiles(samples: DataFrame, key: str = "board", diameter: float = 20.0) -> DataFrame:
    """(key, profile, value_min, value_max, sat_max, n): samples (key, ord, value, sat) taken in order; each opens a
    cluster and takes the later ones that keep its values within the diameter. The order makes it sequential, so a
    board's training samples, some dozens, are one group."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        rest, rows = list(pdf.sort_values("ord")[["value", "sat"]].itertuples(index=False, name=None)), []
        while rest:
            low = high = rest[0][0]
            own, later = [], []
            for v, s in rest:
                if max(high, v) - min(low, v) <= diameter:
                    low, high = min(low, v), max(high, v)
                    own.append(s)
                else:
                    later.append((v, s))
            rows.append((pdf[key].iloc[0], len(rows) + 1, max(low - 8.0, 0.0), min(high + 8.0, 120.0), min(max(max(own) + 20.0, 80.0), 200.0), len(own)))
            rest = later
        return pd.DataFrame(rows, columns=[key, "profile", "value_min", "value_max", "sat_max", "n"])

    return samples.groupBy(key).applyInPandas(cluster, f"{key} {dict(samples.dtypes)[key]}, profile int, value_min double, value_max double, sat_max double, n int")


def apart(boxes: DataFrame, key: str = "board") -> DataFrame:
    """(key, id, x, y, width, height) of boxes, of equal ones that of the least id. thinned() by id keeps none of the
    others, as what drops the first of them drops all; so their pairs, which grow with their square, need not be made."""
    numbers = ["x", "y", "width", "height"]
    whole = F.col(key).isNotNull()
    for c in numbers:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    first = boxes.where(whole).groupBy(key, *numbers).agg(F.min("id").alias("id"))
    return first.unionByName(boxes.where(~whole).select(first.columns))


def same_box(boxes: DataFrame, key: str = "board") -> DataFrame:
    """(left_id, right_id) of boxes (key, id, x, y, width, height) whose four numbers differ by less than 1; the pairs
    that thinned() takes. An equi-join on the cell of the corner."""
    at = boxes.select(key, "id", "x", "y", "width", "height", F.floor("x").alias("cx"), F.floor("y").alias("cy"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    other = at.select(key, F.col("id").alias("right_id"), *(F.col(c).alias(f"{c}2") for c in ("x", "y", "width", "height")), "cx", "cy", near.alias("d"))
    other = other.withColumn("cx", F.col("cx") + F.col("d.i")).withColumn("cy", F.col("cy") + F.col("d.j"))
    close = lambda c: F.abs(F.col(c) - F.col(f"{c}2")) < 1
    return at.join(other, [key, "cx", "cy"]).where(close("x") & close("y") & close("width") & close("height") & (F.col("id") != F.col("right_id"))).select(F.col("id").alias("left_id"), "right_id")


def loosely_contains(text: Column, wanted: str, errors: int) -> Column:
    """Whether some place of the text holds wanted with so many wrong characters at most; confused ones are right."""
    if not wanted:
        return F.lit(True)
    like = [sorted({w, *(p[1 - p.index(w)] for p in CONFUSED if w in p)}) for w in wanted]
    wrong = lambda i: sum((F.when(F.substr(text, i + j, F.lit(1)).isin(c), 0).otherwise(1) for j, c in enumerate(like)), F.lit(0))
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - len(wanted) + 1, F.lit(1)))
    return (F.length(text) >= len(wanted)) & F.exists(places, lambda i: wrong(i) <= errors)


def score_report(results: DataFrame, k: int = 10) -> DataFrame:
    """(component, place, score, params): each component's k best results, ties by their order."""
    rank = F.row_number().over(W.partitionBy("component").orderBy(F.desc("score"), "ord"))
    return results.withColumn("place", rank).where(F.col("place") <= k).select("component", "place", "score", "params")
