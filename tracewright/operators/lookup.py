"""Joins on keys of which some may be hot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.loop import settled

#: A table of up to SMALL rows is broadcast whole. Of a larger one, the rows of hot keys are; a key is hot if it holds more
#: than one in HOT of the rows that look it up, so there are fewer than HOT hot keys.
SMALL, HOT = 200_000, 2_000
Keep = Callable[[DataFrame], DataFrame]


def hot_keys(rows: DataFrame, key: str, keep: Keep = settled) -> DataFrame:
    """The keys that hold more than one in HOT of the rows: (key)."""
    total = rows.count()
    return keep(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > total / HOT).select(key))


def looked_up(rows: DataFrame, key: str, table: DataFrame, how: str = "inner", hot: DataFrame | None = None, keep: Keep = settled) -> DataFrame:
    """rows joined (inner or left) with table, which has one row a key and is cheap to read, without a task for a hot key.

    keep cuts lineage; it computes the hot keys where they are not given.
    """
    if table.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(table), key, how)
    hot = hot_keys(rows, key, keep) if hot is None else hot
    warm = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, how)
    return warm.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))
