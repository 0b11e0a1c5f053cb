"""Cutting lineage in loops: a checkpoint in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The checkpoint folder; where none is set, as in tests, below the warehouse."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(base or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tracewright-scratch")
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed and kept in the checkpoint folder."""
    _folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed and kept in the checkpoint folder as compressed columns, which take a fraction of a checkpoint's rows."""
    path = f"{_folder(df)}/{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions, for work by groups that takes long over few bytes: a plain shuffle of
    few bytes is drawn together into a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that a task sorts for a join or a group.
ROWS = 250_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks so many rows take, ROWS each; the shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by keys over so many tasks if a plain shuffle has fewer: its partitions grow with the rows, these do not."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
