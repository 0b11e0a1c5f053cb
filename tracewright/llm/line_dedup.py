"""Line dedup with two Bloom filters, for key hashes seen once and seen twice.

1. Tasks send the 64-bit hashes of their lines' keys, each once a batch, to buckets of hashes. A bucket has a pair of
   filters of its own, sized to its keys, so their fill does not grow with the input: a hash that the once-filter has
   goes to the twice-filter. What the twice-filter has is suspected. Lines and texts are not shuffled here.
2. Only suspected keys are counted exactly, by a 128-bit digest, once per document and pre-aggregated in each task, so
   that a line in a third of all documents costs one row a task. Up to BROADCAST_HASHES suspected hashes go to the tasks
   as they are; beyond that the tasks' digests are joined with them by a shuffle.
3. Keys in min_docs documents or more are dropped, all their lines or all but the first. Up to broadcast_keys such
   keys go to the tasks as they are; beyond that, and where the first line stays, the documents are joined with them by
   a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import fresh, schema_with, slices, stored, texts, with_columns

#: Bits of a filter for each of its keys, at least, and bits set for a key.
BITS_PER_KEY, PROBES = 16, 4
#: Hashes that a task gathers before it sends them; hashes of a bucket, about; digests counted in a task at a time.
HELD_HASHES, BUCKET_KEYS, HELD_KEYS = 1 << 20, 1 << 20, 1 << 18
#: Suspected hashes, 8 bytes each, that are broadcast.
BROADCAST_HASHES = 4_000_000
_DIGEST = T.StructType([T.StructField("hash", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType())])
_SENT = "bucket long, hashes binary, again binary"


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """The lines, and for each its key: stripped of ASCII white space, A-Z lower-cased; too short a key is empty."""
    lines = text.split(b"\n")
    keys = [x.strip().lower() for x in lines]
    if min_chars > 1:
        keys = [k if len(k.decode()) >= min_chars else b"" for k in keys]
    return lines, keys


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class BloomPair:
    """Filters for hashes seen once and seen twice, sized to a number of keys."""

    def __init__(self, keys: int):
        self.bits = max(10, int(BITS_PER_KEY * keys - 1).bit_length())
        self.once, self.twice = np.zeros(1 << self.bits, bool), np.zeros(1 << self.bits, bool)

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) & np.uint64((1 << self.bits) - 1) for i in range(PROBES)])

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """Distinct hashes, and which of them are known to occur again."""
        at = self._at(hashes)
        self.twice[at[:, again | self.once[at].all(axis=0)]] = True
        self.once[at] = True

    def suspected(self, hashes: np.ndarray) -> np.ndarray:
        return self.twice[self._at(hashes)].all(axis=0)


def _keys_of(batch: pa.RecordBatch, text_col: str, min_chars: int) -> list[bytes]:
    """The keys of the batch's lines, each once a document."""
    return [k for t in texts(batch, text_col) for k in {*line_keys(t, min_chars)[1]} if k]


def suspected_hashes(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(hashes): the key hashes that two documents or more seem to hold, in binary pieces."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # decides on the number of buckets only
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = int(np.clip(max((parts - 1).bit_length(), int(size / 32 / BUCKET_KEYS).bit_length()), 0, 30))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            top = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
            buckets, starts = np.unique(top, return_index=True)
            split = lambda x: pa.array([y.tobytes() for y in np.split(x, starts[1:])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(buckets), split(found), split((n > 1).astype(np.uint8))], names=["bucket", "hashes", "again"])

        for batch in slices(batches, text_col):
            held.append(_hashes(_keys_of(batch, text_col, min_chars)))
            if sum(map(len, held)) > HELD_HASHES:
                yield flush()
        if held:
            yield flush()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            parts = [(np.frombuffer(h, np.uint64), np.frombuffer(a, np.uint8).astype(bool)) for h, a in rows]
            pair = BloomPair(sum(len(h) for h, _ in parts))
            for hashes, again in parts:
                pair.add(hashes, again)
            found = np.unique(np.concatenate([h[pair.suspected(h)] for h, _ in parts]))
            return pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["hashes"])

        for batch in batches:
            for bucket, hashes, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and rows:
                    yield done()
                    rows = []
                now = bucket
                rows.append((hashes, again))
        if rows:
            yield done()

    sent = docs.select(text_col).mapInArrow(send, _SENT)
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(sift, "hashes binary")


def frequent_keys(docs: DataFrame, text_col: str, min_docs: int, min_chars: int, broadcast_hashes: int | None = None) -> DataFrame:
    """The digests of the keys that min_docs rows or more hold: (digest)."""
    pieces = stored(suspected_hashes(docs, text_col, min_chars))
    n = pieces.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    few = n // 8 <= (BROADCAST_HASHES if broadcast_hashes is None else broadcast_hashes)
    known = None
    if few:  # at most BROADCAST_HASHES of 8 bytes
        got = [np.frombuffer(bytes(r.hashes), np.uint64) for r in pieces.toLocalIterator()]
        known = docs.sparkSession.sparkContext.broadcast(np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.int64()), pa.array([d for _, d in held], pa.binary()), pa.array(held.values(), pa.int64())], names=_DIGEST.names)
            held.clear()
            return out

        for batch in slices(batches, text_col):
            keys = _keys_of(batch, text_col, min_chars)
            hashes = _hashes(keys)
            which = range(len(keys))
            if known is not None:
                at = np.searchsorted(known.value, hashes)
                which = np.flatnonzero(known.value[np.minimum(at, len(known.value) - 1)] == hashes) if len(known.value) else ()
            for i, h in zip(which, hashes[which].view(np.int64).tolist() if known is not None and len(which) else hashes.view(np.int64).tolist()):
                own = (h, _digest(keys[i]))
                held[own] = held.get(own, 0) + 1
            if len(held) > HELD_KEYS:
                yield flush()
        yield flush()

    counted = docs.select(text_col).mapInArrow(count, _DIGEST)
    if not few:
        counted = counted.groupBy("hash", "digest").agg(F.sum("n").alias("n"))  # so no hash of a line is hot in the join
        apart = pieces.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64))], names=["hash"]) for b in batches for h in b.column(0).to_pylist()), "hash long")
        counted = counted.join(apart, "hash", "left_semi")
    return counted.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("digest")


def drop_frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = 1_000_000, keep_first: bool = False, broadcast_hashes: int | None = None) -> DataFrame:
    """docs with the lines dropped whose key min_docs rows or more hold; adds kept_text, n_lines and n_dropped.

    With keep_first the first line of each such key stays: of the rows in their order as read, the first that holds it.

    A null text counts as empty and a text always has one line more than it has line feeds. Repeated rows count as
    rows of their own. A key of fewer than min_chars code points never goes. Input columns named like an added one
    give way to it. No rows: no rows.
    """
    keys = stored(frequent_keys(docs, text_col, min_docs, min_chars, broadcast_hashes))
    added = [("kept_text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]

    def result(batch: pa.RecordBatch, gone: list, firsts: list) -> pa.RecordBatch:
        kept, n_lines, n_dropped = [], [], []
        for text, drop, first in zip(texts(batch, text_col), gone, firsts, strict=True):
            lines, own = line_keys(text, min_chars)
            stay, open_ = lines, set(first)
            if drop:
                stay = []
                for x, k in zip(lines, own, strict=True):
                    d = _digest(k) if k else b""
                    if d not in drop or d in open_:
                        stay.append(x)
                        open_.discard(d)
            kept.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return with_columns(batch, {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    if not keep_first and keys.count() <= broadcast_keys:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.digest) for r in keys.toLocalIterator()))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                yield result(batch, [shared.value] * batch.num_rows, [()] * batch.num_rows)

        return docs.mapInArrow(drop, schema_with(docs.schema, added))

    row, gone, first = (fresh(docs.columns, f"line_dedup_{x}") for x in ("row", "gone", "first"))
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            own = [(i, _digest(k)) for i, t in zip(batch.column(row).to_pylist(), texts(batch, text_col), strict=True) for k in {*line_keys(t, min_chars)[1]} if k]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([d for _, d in own], pa.binary())], names=[row, "digest"])

    held = numbered.select(row, text_col).mapInArrow(explode, f"`{row}` long, digest binary").join(keys, "digest", "left_semi")
    marked = numbered.join(held.groupBy(row).agg(F.collect_list("digest").alias(gone)), row, "left")
    if keep_first:
        lead = held.groupBy("digest").agg(F.min(row).alias(row)).groupBy(row).agg(F.collect_list("digest").alias(first))
        marked = marked.join(lead, row, "left")
    else:
        marked = marked.withColumn(first, F.array().cast("array<binary>"))

    def drop_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            sets = ([frozenset(x or ()) for x in batch.column(c).to_pylist()] for c in (gone, first))
            yield result(batch.drop_columns([row, gone, first]), *sets)

    return marked.mapInArrow(drop_own, schema_with(docs.schema, added))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_frequent_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL_OP9 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT keyed.*, hot.key IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.key = hot.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
