"""Numbering rows in a global order, over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.loop import settled


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with name, the row's place from 1 by the order: range-partitioned, each task counting its own rows.

    Only the tasks' sizes, a row each, are summed in one place. Rows that tie are numbered as they come.
    """
    keys = [f"order_{i}" for i in range(len(order))]
    keyed = df.select("*", *(o.alias(k) for o, k in zip(order, keys, strict=True)))
    placed = settled(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("place_", F.monotonically_increasing_id()))
    task = F.shiftright("place_", 33)
    sizes = placed.groupBy(task.alias("task_")).agg(F.count("*").alias("n_"))
    before = sizes.select("task_", (F.sum("n_").over(W.orderBy("task_")) - F.col("n_")).alias("before_"))
    own = F.col("place_").bitwiseAND(F.lit(2**33 - 1)) + 1
    return placed.withColumn("task_", task).join(F.broadcast(before), "task_").withColumn(name, (F.col("before_") + own).cast("int")).drop("task_", "place_", "before_")
