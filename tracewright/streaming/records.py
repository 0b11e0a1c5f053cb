"""Record folders as streams: an extra, the same schemas read by Structured Streaming. The batch operators apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.documents import SCHEMAS


def stream_records(spark: SparkSession, path: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files_per_trigger).json(path, multiLine=True)


def samples_by_label(samples: DataFrame, late: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """Counts of via samples by label and time window; what comes later than the watermark is left out."""
    return samples.withWatermark("timestamp", late).groupBy(F.window("timestamp", every), "is_via").agg(F.count("*").alias("n"))
