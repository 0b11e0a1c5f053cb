"""What the operators of this subpackage share: reading, null rules, shared storage, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step of a Python operator works on.
STEP_BYTES = 4 << 20
#: (session, path or table) of what forget_scratch() deletes.
_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; in tests, where that is unset, below one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tracewright-scratch"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tw-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read back, so that no lost executor takes it along."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_table(spark: SparkSession, kind: str) -> str:
    """A new table name; the table goes to the shared warehouse."""
    name = f"tracewright_{kind}_{uuid.uuid4().hex}"
    _MADE.append((spark, name))
    return name


def scratch_made() -> int:
    """How many folders and tables this process has made so far."""
    return len(_MADE)


def forget_scratch(since: int = 0, keep: int = 0) -> None:
    """Deletes the folders and tables that this process has made in the shared folder and the warehouse.

    Those made before since, a figure of scratch_made(), and the last keep ones stay. Results not written yet still read
    them, so call it when these have been written.
    """
    gone = _MADE[since : len(_MADE) - keep]
    _MADE[since : len(_MADE) - keep] = []
    for spark, name in gone:
        if "/" in name:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def fresh(taken: Iterable[str], wanted: str) -> str:
    """wanted, with underscores added until no column of the input has that name."""
    names = {n.lower() for n in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def schema_with(schema: T.StructType, added: list[tuple[str, T.DataType]]) -> T.StructType:
    """schema with columns added at its end; an input column of the same name gives way."""
    names = {n.lower() for n, _ in added}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + [T.StructField(n, t) for n, t in added])


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    names = {n.lower() for n in added}
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in names]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(added.values()), names=[n for n, _ in kept] + list(added))


def slices(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about step bytes of text, so that memory follows the piece, not the batch."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + step, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts; null is empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each start and length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return values[np.arange(total) + shift]


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose items are consecutive runs of counts values each."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(np.asarray(counts) * values.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
