"""Quality classifier by Bradley-Terry pairwise ranking.

Features come from the whole text alone. Each pair of a good and a bad labelled document says that the good one wins;
the weights minimise the logistic loss on the difference of their features. The cut is the quantile of the training
scores that the share of bad documents names; scores are scaled so that the cut lies at CUT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import crc_bucket, fresh, schema_with, slices, texts, with_columns

CUT = 0.3
#: Labelled rows that a model is fitted on, at most, chosen by a hash of the id; and pairs drawn from them.
MAX_TRAINING_ROWS, PAIRS = 20_000, 100_000
_BYTE_CLASS = np.zeros(256, np.uint8)
for _c, _members in enumerate((b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"\n", b" \t\r\x0b\x0c"), start=1):
    _BYTE_CLASS[list(_members)] = _c
SHARES = ("symbols", "upper", "digits", "stops", "exclaims", "line_feeds", "spaces")
#: (share, bounds above which a feature is on)
STEPS = {"symbols": (0.01, 0.05), "upper": (0.1, 0.3), "exclaims": (0.02,), "distinct": (0.15, 0.3, 0.5), "again": (0.05, 0.2), "dup_lines": (0.2, 0.5)}


def features(batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    """One row of figures for each text: (n, figures)."""
    docs = texts(batch, text_col)
    counts = np.stack([np.bincount(_BYTE_CLASS[np.frombuffer(d, np.uint8)], minlength=8) for d in docs]).astype(float)
    size = np.maximum(counts.sum(axis=1), 1)
    shares = dict(zip(SHARES, counts[:, 1:].T / size, strict=True))
    split = pc.ascii_split_whitespace(pc.fill_null(batch.column(text_col), ""))
    words = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(docs)), n)
    seen = np.unique((doc << 32) | words) >> 32
    shares["distinct"] = 1 - np.bincount(seen, minlength=len(docs)) / np.maximum(n, 1)
    same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]) if len(words) else np.zeros(0, bool)
    shares["again"] = np.bincount(doc[1:][same] if len(words) else doc, minlength=len(docs)) / np.maximum(n, 1)
    lines = [[x for x in d.split(b"\n") if x.strip()] for d in docs]
    shares["dup_lines"] = np.array([1 - len({*x}) / len(x) if x else 0.0 for x in lines])
    steps = [np.asarray(shares[k] > b, float) for k, bounds in STEPS.items() for b in bounds]
    smooth = [np.sqrt(v) for v in shares.values()]
    return np.stack([np.log1p(n), np.minimum((size - counts[:, 7] - counts[:, 6]) / np.maximum(n, 1), 40), *smooth, *steps], axis=1)


class Ranker:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.mean, self.spread, self.weights, self.cut, self.slope = mean, spread, weights, cut, slope

    def score(self, figures: np.ndarray) -> np.ndarray:
        raw = ((figures - self.mean) / self.spread) @ self.weights
        z = np.clip(self.slope * (raw - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(figures: np.ndarray, good: np.ndarray, rounds: int = 400, rate: float = 0.05, penalty: float = 1e-3, seed: int = 5) -> Ranker:
    """The ranking model; without both labels every document gets the score of the only one."""
    mean, spread = figures.mean(axis=0) if len(figures) else np.zeros(figures.shape[1]), figures.std(axis=0) if len(figures) else np.ones(figures.shape[1])
    spread[spread < 1e-9] = 1
    x, w = (figures - mean) / spread, np.zeros(figures.shape[1])
    if good.all() or not good.any():
        return Ranker(mean, spread, w, -1e3 if good.all() else 1e3, 1.0)
    rng = np.random.default_rng(seed)
    win, lose = rng.choice(np.flatnonzero(good), PAIRS), rng.choice(np.flatnonzero(~good), PAIRS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, rounds + 1):
        part = slice((turn * 5000) % PAIRS, (turn * 5000) % PAIRS + 5000)
        diff = x[win[part]] - x[lose[part]]
        g = diff.T @ (1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))) / len(diff) - penalty * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w = w + rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    raw = x @ w
    cut = float(np.quantile(raw, (~good).mean()))
    slope, best = 1.0, np.inf
    for k in np.geomspace(0.05, 1, 40) * min(20, 25 / max(np.abs(raw - cut).max(), 1e-9)):  # the scale of the likeliest scores
        z = np.clip(k * (raw - cut) + np.log(CUT / (1 - CUT)), -30, 30)
        loss = np.mean(np.logaddexp(0, np.where(good, -z, z)))
        if loss < best:
            slope, best = float(k), loss
    return Ranker(mean, spread, w, cut, slope)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Ranker:
    """Fits a ranker on the labelled ids for which learn holds: at most max_rows of them, by a hash of the id.

    Of the rows of an id, the one whose text has the smallest hash counts. Without a row of each label the ranker gives
    every document one score: near 1 without labels or with good ones only, near 0 with bad ones only.
    """
    key, label = fresh([text_col], "label_id"), fresh([text_col], "label_good")
    chosen = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(F.max(label_col).alias(label))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(max_rows)
    rows = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), F.col(id_col) == F.col(key)).select(key, text_col, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            flat = features(batch, text_col)
            yield pa.RecordBatch.from_arrays([pa.array(list(flat), pa.list_(pa.float64())), batch.column(label).cast(pa.int64()), batch.column(key), pa.array(map(xxhash.xxh3_64_intdigest, texts(batch, text_col)), pa.uint64()).view(pa.int64())], names=schema.names)

    schema = T.StructType([T.StructField("figures", T.ArrayType(T.DoubleType())), T.StructField("good", T.LongType()), T.StructField("of", rows.schema[key].dataType), T.StructField("hash", T.LongType())])
    # at most max_rows rows of some two dozen numbers: one row an id
    single = rows.mapInArrow(run, schema).groupBy("of").agg(F.min(F.struct("hash", "figures", "good")).alias("row"))
    got = single.select("row.figures", "row.good").toPandas()
    width = 2 + len(SHARES) + 3 + sum(map(len, STEPS.values()))
    got = got.iloc[np.lexsort(np.stack(got["figures"]).T)] if len(got) else got  # the same order in every run
    figures = np.stack(got["figures"]) if len(got) else np.zeros((0, width))
    return fit(figures, got["good"].to_numpy() > 0)


def score_quality(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int: 1 from CUT on).

    A null text counts as empty; empty texts get the score of their figures. Rows stand alone, so repeated rows, ties
    and an empty table need no rule. Input columns named like an added one give way to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            score = model.score(features(batch, text_col))
            yield with_columns(batch, {"score": pa.array(score), "predicted": pa.array((score >= CUT).astype(np.int32))})

    return docs.mapInArrow(run, schema_with(docs.schema, [("score", T.DoubleType()), ("predicted", T.IntegerType())]))


def op3_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, crc_bucket("doc_id", 5) != 0)
    out = score_quality(docs, model)
    return out.select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
