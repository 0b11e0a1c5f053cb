"""Part lookups in tiers: the first tier with a match decides, and within it the library's order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.names import normal_part


def library_order(parts: DataFrame) -> DataFrame:
    """parts with key, the order of ties: part and package, lower-cased."""
    return parts.withColumn("key", F.lower(F.concat_ws(" / ", "part_number", "package")))


def tiered_lookup(wanted: DataFrame, parts: DataFrame, aliases: DataFrame, by_package: bool = True) -> DataFrame:
    """wanted(id, part_number, package) with found_part, found_package and tier (null if none).

    Tiers: 1 exact; 2 alias and package; 3 normal form and package; 4 alias; 5 normal form. Without by_package:
    exact, alias and normal form, whatever the package. All but the first ignore case. Equi-joins only; the smallest
    (tier, key) of a wanted row is a pre-aggregated minimum, so a part that very many rows want does not gather them.
    """
    lib = library_order(parts).select(F.col("part_number").alias("found_part"), F.col("package").alias("found_package"), "key", F.lower(normal_part(F.upper("part_number"))).alias("norm"))
    named = aliases.select(F.col("part_number").alias("found_part"), F.col("package").alias("found_package"), F.lower("alias").alias("alias"))
    lib_alias = lib.join(named, ["found_part", "found_package"])
    w = wanted.select("id", F.col("part_number").alias("want"), F.col("package").alias("want_package"), F.lower("part_number").alias("low"), F.lower(normal_part(F.upper("part_number"))).alias("want_norm"))
    same_package = F.lower("want_package") == F.lower("found_package")
    exact = F.col("want") == F.col("found_part")
    tiers = [
        (lib, exact & (F.col("want_package") == F.col("found_package")) if by_package else exact),
        *([(lib_alias, (F.col("low") == F.col("alias")) & same_package), (lib, (F.col("want_norm") == F.col("norm")) & same_package)] if by_package else []),
        (lib_alias, F.col("low") == F.col("alias")),
        (lib, F.col("want_norm") == F.col("norm")),
    ]
    found = None
    for tier, (side, on) in enumerate(tiers, 1):
        part = w.join(side, on).select("id", F.struct(F.lit(tier).alias("tier"), "key", "found_part", "found_package").alias("hit"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id").agg(F.min("hit").alias("hit"))
    return wanted.join(best, "id", "left").select(*(wanted[c] for c in wanted.columns), F.col("hit.found_part").alias("found_part"), F.col("hit.found_package").alias("found_package"), F.col("hit.tier").alias("tier"))
