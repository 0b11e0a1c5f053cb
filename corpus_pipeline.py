"""From raw documents to packed training sequences: the stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it back as the next stage's docs. All stages but the last return the columns of documents; those that change a text
set n_chars to its new length. A null text is an empty one, repeated rows and null ids are documents of their own, and
other columns come through as they are, whatever their names and types. No documents: no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import crc_bucket, forget_scratch, scratch_made, stored, table
from tracewright.llm.line_dedup import drop_frequent_lines
from tracewright.llm.near_dedup import near_duplicates
from tracewright.llm.packing import pack_documents
from tracewright.llm.pii import find_pii
from tracewright.llm.quality_model import score_quality, train

MIN_LINE_DOCS, SHINGLE_WORDS, SIMILAR_PERCENT, SEQUENCE_TOKENS = 10, 5, 80, 2048
#: A character that is not ASCII white space.
_WORD = r"[^\x09-\x0D\x20]"


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The documents' columns with another text and its length."""
    new = {"text": F.col(text).alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return docs.select(*(new.get(c, F.col(f"`{c}`")) for c in columns))


def _apart(stage):
    """The stage on documents whose other columns have names that no operator gives to its own; they get theirs back."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in ("doc_id", "text", "n_chars") else f"documents_column_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), sf_dir)
        return out.select(*(F.col(n).alias(c) for c, n in names.items()))

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality model predicts to be bad; it learns from four fifths of the labelled ids."""
    model = train(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    return score_quality(docs, model).where("predicted = 1").select(docs.columns)


@_apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that MIN_LINE_DOCS documents or more hold.

    Of the rows that this leaves without a word, one of each text comes back, in the order of the ids and with the lines
    that no row before it brought back; the others drop out. So no text is lost with all its copies.
    """
    out = drop_frequent_lines(docs, min_docs=MIN_LINE_DOCS)
    emptied = (F.col("n_dropped") > 0) & ~F.col("kept_text").rlike(_WORD)
    rest = [c for c in docs.columns if c != "text"]
    firsts = out.where(emptied).groupBy("text").agg(F.min_by(F.struct(*rest), F.struct("doc_id", F.to_json(F.struct(*rest)))).alias("first"))
    firsts = stored(firsts.select("text", "first.*").select(docs.columns))
    kept = _with_text(out.where(~emptied), docs.columns, "kept_text")
    if firsts.isEmpty():
        return kept
    back = drop_frequent_lines(firsts.orderBy("doc_id", "text"), min_docs=2, keep_first=True)
    return kept.unionByName(_with_text(back.where(F.col("kept_text").rlike(_WORD)), docs.columns, "kept_text"))


@_apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the first row with the smallest id."""
    return near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT).where("is_first").select(docs.columns)


@_apart
def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return _with_text(find_pii(docs), docs.columns, "masked_text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row a piece."""
    out = pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), capacity=SEQUENCE_TOKENS)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mask_pii", mask_pii), ("packing", packing)]

#: SQL cannot express the model, the CRF and the tokenizer; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    docs, since = table(spark, sf_dir, "documents"), scratch_made()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        forget_scratch(since, keep=1)  # what the stage made, and its input; its output stays
    return STAGES[-1][1](spark, docs, sf_dir)
