"""Removal of byte strings that occur more than once, after blockwise suffix sorting with a difference cover.

Only whether two suffixes agree on min_bytes bytes matters, so suffixes are ordered by hashes of their prefixes and a
rank is "occurs again" or not. Texts lie in blocks of a bucketed table; a position is a suffix of its document.

1. Ranks of the cover sample. Of positions p, those with p mod v in a difference cover D are sampled; for any two
   positions some shift below v brings both into the sample. The sample's prefixes of min_bytes - v + 1 bytes are
   sorted, one suffix bucket at a time. A suffix is settled, its own prefix occurs once, unless less than v on there is
   a sample position of a prefix that occurs again.
2. Long ties. The prefixes of min_bytes + v - 1 bytes of the sample positions that remain are sorted the same way;
   where one occurs again, the v suffixes from there on tie with the other's. One block speaks for each such string.
   All suffixes of a repeat but those within v of its ends are in long ties.
3. Suffixes neither settled nor in a long tie ask, by the sample's hashes, which suffixes in long ties may equal them.
4. Those that ask, and of those in long ties the ones asked for in the block that speaks, are sorted by their own
   prefixes.

A block sends each bucket its distinct hashes in order, delta-coded, without positions; what comes back is a bitmap in
that order, which the block lines up with the hashes that it computes anew. So a bucket gets at most one entry from a
block for a string, however often it occurs there, and a bucket's size is bounded. In steps 2 and 4 strings of 96-bit
hashes that agree count as equal.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import fresh, schema_with, scratch_table, slices, stored, texts

#: Difference sets, by modulus; every residue is a difference of two members.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)}
BLOCK_BYTES = 2 << 20
#: Hashes of a bucket, at most about; there are at least as many buckets as shuffle partitions.
BUCKET_KEYS = 1_000_000
#: Bits of the hashes by which the cover sample is sorted; clashes only leave more suffixes to sort.
SAMPLE_BITS = 44
_BLOCK = "block_id long, n_bytes long, text binary, ends binary, rest binary"
_SENT = "bucket long, block_id long, keys binary"
_FLAGS = "block_id long, step int, bucket long, n long, bits binary, more binary"


def cover(min_bytes: int) -> tuple[int, tuple[int, ...]]:
    """The difference cover for strings of min_bytes: the largest of up to a third of them."""
    v = max(m for m in COVERS if 3 * m <= min_bytes or m == 1)
    return v, COVERS[v]


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _expand(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, the planes that are all zero left out at the top."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    parts = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + parts.tobytes()


def _unplanes(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    width = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n, 1).reshape(width, n).T
    return out.view("<u8").ravel(), data[1 + width * n :]


def packed_keys(high: np.ndarray, low: np.ndarray | None, asks: np.ndarray | None) -> bytes:
    """Sorted hashes as deltas; the rest of their bits, and which of them ask, as they are."""
    parts = [_planes(np.diff(high, prepend=np.uint64(0))), b"" if low is None else low.astype("<u4").tobytes(), b"" if asks is None else np.packbits(asks).tobytes()]
    return _squeeze(len(high).to_bytes(8, "little") + b"".join(parts))


def unpacked_keys(data: bytes, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, and their low bits (steps 2 and 4), or which of them ask (step 3), or zeros."""
    raw = _expand(data)
    n = int.from_bytes(raw[:8], "little")
    deltas, rest = _unplanes(raw[8:], n)
    if step == 3:
        more = np.unpackbits(np.frombuffer(rest, np.uint8), count=n)
    else:
        more = np.frombuffer(rest, "<u4") if step != 1 else np.zeros(n, np.uint8)
    return np.cumsum(deltas, dtype=np.uint64), more


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Bytes that a hash's running sums cover at a time: what a processor cache holds.
PIECE = 1 << 16


class Rolling:
    """Hashes of substrings of one length, from sums of byte values times powers of an odd base modulo 2**64."""

    def __init__(self, which: int, length: int):
        base, self.length = int(_BASES[which]), length
        self.values = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93 + 2 * which))
        powers = lambda b: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(PIECE + length - 1, np.uint64(b)))))
        self.power, self.inverse = powers(base), powers(pow(base, -1, 2**64))

    def at(self, data: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The hashes of the substrings that begin at the positions, which ascend."""
        out = np.empty(len(positions), np.uint64)
        sums = np.zeros(PIECE + self.length + 1, np.uint64)
        bounds = np.searchsorted(positions, np.arange(0, len(data) + PIECE, PIECE))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                piece = data[i * PIECE : (i + 1) * PIECE + self.length]
                np.cumsum(self.values[piece] * self.power[: len(piece)], out=sums[1 : len(piece) + 1])
                own = positions[a:b] - i * PIECE
                out[a:b] = (sums[own + self.length] - sums[own]) * self.inverse[own]
        return _mixed(out)


class Keys:
    """The distinct hashes of some positions in order, and which positions have them."""

    def __init__(self, positions: np.ndarray, high: np.ndarray, low: np.ndarray | None = None, asks: np.ndarray | None = None):
        self.positions = positions
        order = np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))
        high, low = high[order], None if low is None else low[order]
        new = np.ones(len(high), bool)
        if len(high):
            new[1:] = (high[1:] != high[:-1]) | (False if low is None else low[1:] != low[:-1])
        self.which = np.empty(len(high), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.high, self.low = high[new], None if low is None else low[new]
        self.here_again = np.bincount(self.which, minlength=len(self.high)) > 1
        self.asks = None if asks is None else np.bincount(self.which[asks], minlength=len(self.high)) > 0

    def sent(self, block: int, bits: int, width: int) -> list[tuple[int, int, bytes]]:
        """(bucket, block, packed keys) for each bucket with keys; a bucket is the top bits of a hash of width bits."""
        top = self.high >> np.uint64(width - bits) if bits else np.zeros(len(self.high), np.uint64)
        bounds = np.searchsorted(top, np.arange((1 << bits) + 1, dtype=np.uint64))
        part = lambda x, b: None if x is None else x[bounds[b] : bounds[b + 1]]
        return [(int(b), block, packed_keys(part(self.high, b), part(self.low, b), part(self.asks, b))) for b in np.flatnonzero(np.diff(bounds))]

    def with_(self, chosen: np.ndarray) -> np.ndarray:
        """The positions of the chosen keys."""
        return self.positions[chosen[self.which]]


def _bits(flags: list[tuple[int, int, bytes, bytes]], field: int = 2) -> np.ndarray:
    """The bitmaps (bucket, number of keys, bits, more bits) of all buckets in a row."""
    found = [np.unpackbits(np.frombuffer(_expand(f[field]), np.uint8), count=f[1]) for f in sorted(flags) if f[0] >= 0]
    return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)


def _around(n: int, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which of n positions lie from at - before up to, not including, at + after for some at; at ascends."""
    if not len(at):
        return np.zeros(n, bool)
    apart = np.flatnonzero(at[1:] - at[:-1] > before + after)
    starts = np.maximum(at[np.concatenate(([0], apart + 1))] - before, 0)
    stops = np.minimum(at[np.append(apart, len(at) - 1)] + after, n)
    edges = np.concatenate(([0], np.stack((starts, stops), axis=1).ravel(), [n]))
    return np.repeat(np.arange(len(edges) - 1) % 2 == 1, np.diff(edges))


class Block:
    """A block's part in the steps. A step's state, arrays that the next one needs, comes back with its flags."""

    def __init__(self, block_id: int, text: bytes, ends: np.ndarray, min_bytes: int):
        self.id, self.data, self.ends, self.min_bytes = block_id, np.frombuffer(text, np.uint8), ends, min_bytes
        self.v, members = cover(min_bytes)
        self.members = np.array(members)
        self.sizes = np.diff(ends, prepend=0)

    def _sample(self) -> np.ndarray:
        """The sampled positions with min_bytes - v + 1 bytes to their document's end."""
        at = (np.arange(0, len(self.data), self.v)[:, None] + self.members).ravel()
        at = at[at < len(self.data)]
        return at[np.repeat(self.ends, self.sizes)[at] - at > self.min_bytes - self.v]

    def _keys(self, at: np.ndarray, length: int) -> Keys:
        return Keys(at, Rolling(0, length).at(self.data, at), (Rolling(1, length).at(self.data, at) >> np.uint64(32)).astype(np.uint32))

    def _ties(self, common: np.ndarray) -> Keys:
        length = self.min_bytes + self.v - 1
        return self._keys(common[np.repeat(self.ends, self.sizes)[common] - common >= length], length)

    def _asking(self, masks: dict[str, np.ndarray]) -> Keys:
        """The sample hashes of suffixes that ask or may be asked for."""
        common = np.flatnonzero(masks["common"])
        asks = _around(len(self.data), np.flatnonzero(masks["single"]), 0, self.v)[common]
        near = asks | _around(len(self.data), np.flatnonzero(masks["spoken_for"]), 0, self.v)[common]
        return Keys(common[near], self._sample_hashes(common[near]), asks=asks[near])

    def _sample_hashes(self, at: np.ndarray) -> np.ndarray:
        return Rolling(0, self.min_bytes - self.v + 1).at(self.data, at) >> np.uint64(64 - SAMPLE_BITS)

    def keys(self, step: int, flags: dict[int, list]) -> tuple[Keys, dict[str, np.ndarray]]:
        """The keys that this block sends in a step, and its state, by the flags and state of the step before."""
        n, v, least = len(self.data), self.v, self.min_bytes
        last = flags.get(step - 1, [])
        if step <= 2:
            at = self._sample()
            first = Keys(at, self._sample_hashes(at))
            if step == 1:
                return first, {}
            common = first.with_(first.here_again | _bits(last))
            return self._ties(common), {"common": _mask(n, common)}
        masks = _state(last, n)
        if step == 3:
            common = np.flatnonzero(masks["common"])
            ties = self._ties(common)
            again = ties.here_again | _bits(last)
            tied = _around(n, ties.with_(again), 0, v)
            fits = np.stack((np.maximum(self.sizes - least + 1, 0), np.minimum(self.sizes, least - 1)), axis=1).ravel()
            single = np.repeat(np.arange(len(fits)) % 2 == 0, fits) & _around(n, common, v - 1, 1) & ~tied
            masks |= {"tied": tied, "spoken_for": _around(n, ties.with_(again & _bits(last, 3)), 0, v), "single": single}
            return self._asking(masks), masks
        asked = _around(n, self._asking(masks).with_(_bits(last)), v - 1, 1)
        rest = masks["single"] | (masks["spoken_for"] & asked)
        return self._keys(np.flatnonzero(rest), least), {"tied": masks["tied"], "rest": rest}

    def repeated(self, flags: dict[int, list]) -> np.ndarray:
        """The suffixes whose prefix of min_bytes occurs again, by the flags and state of the last step."""
        last = flags.get(4, [])
        masks = _state(last, len(self.data))
        rest = self._keys(np.flatnonzero(masks["rest"]), self.min_bytes)
        return masks["tied"] | _mask(len(self.data), rest.with_(rest.here_again | _bits(last)))


def _mask(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _pack_state(masks: dict[str, np.ndarray]) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, **{k: np.packbits(x) for k, x in masks.items()})
    return _squeeze(sink.getvalue())


def _state(flags: list[tuple], n: int) -> dict[str, np.ndarray]:
    """The masks over a block's n positions among a step's flags: they have a bucket below 0."""
    found = np.load(io.BytesIO(_expand(next(f[2] for f in flags if f[0] < 0))))
    return {k: np.unpackbits(found[k], count=n).astype(bool) for k in found.files}


def _blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, text_col, block_bytes):
            docs_here = texts(batch, text_col)
            rest = batch.drop_columns([text_col])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_batch(rest)
            text = b"".join(docs_here)
            ends = np.cumsum([len(d) for d in docs_here], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(text)], pa.int64()), *(pa.array([_squeeze(x)], pa.binary()) for x in (text, ends.tobytes(), sink.getvalue().to_pybytes()))], names=["block_id", "n_bytes", "text", "ends", "rest"])
            number += 1

    spark = docs.sparkSession
    name = scratch_table(spark, "blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.mapInArrow(run, _BLOCK).repartition(parts, "block_id").write.bucketBy(parts, "block_id").option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name)


def _block_of(rows: pa.Table, row: int, min_bytes: int) -> Block:
    text, ends = (_expand(rows.column(c)[row].as_py()) for c in ("text", "ends"))
    return Block(rows.column("block_id")[row].as_py(), text, np.frombuffer(ends, np.int64), min_bytes)


def _flags_of(rows: pa.Table) -> dict[int, list]:
    out: dict[int, list] = {}
    for step, *flags in zip(*(rows.column(c).to_pylist() for c in ("step", "bucket", "n", "bits", "more")), strict=True):
        out.setdefault(step, []).append(tuple(flags))
    return out


def _sent_table(block: Block, step: int, flags: dict[int, list], bits: int) -> pa.Table:
    keys, state = block.keys(step, flags)
    rows = keys.sent(block.id, bits, SAMPLE_BITS if step in (1, 3) else 64)
    if state:
        rows.append((-1 - block.id, block.id, _pack_state(state)))
    buckets, ids, keys = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table([pa.array(buckets, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["bucket", "block_id", "keys"])


def _sorted_buckets(sent: DataFrame, step: int) -> DataFrame:
    """The flags of a step. Steps 1, 2 and 4: which keys other blocks have too, and for which the block is the first;
    step 3: which keys any block asks for."""

    def sort_bucket(key: tuple, rows: pa.Table) -> pa.Table:
        ids, bucket = rows.column("block_id").to_pylist(), key[0].as_py()
        if bucket < 0:  # a block's state passes through
            return pa.table([pa.array(ids, pa.int64()), pa.array([step], pa.int32()), pa.array([bucket], pa.int64()), pa.array([0], pa.int64()), rows.column("keys"), pa.array([None], pa.binary())], names=["block_id", "step", "bucket", "n", "bits", "more"])
        parts = [unpacked_keys(k, step) for k in rows.column("keys").to_pylist()]
        sizes = np.array([len(h) for h, _ in parts])
        high, more = np.concatenate([h for h, _ in parts]), np.concatenate([m for _, m in parts])
        order = np.argsort(high, kind="stable") if step in (1, 3) else np.lexsort((more, high))
        new = np.ones(len(high), bool)
        new[1:] = high[order[1:]] != high[order[:-1]]
        if step in (2, 4):
            new[1:] |= more[order[1:]] != more[order[:-1]]
        group = np.cumsum(new) - 1
        bits, first = np.empty(len(high), bool), np.empty(len(high), bool)
        bits[order] = (np.bincount(group, weights=more[order] if step == 3 else None) > (step != 3))[group]
        first[order] = new
        split = lambda x: [_squeeze(np.packbits(y).tobytes()) for y in np.split(x, np.cumsum(sizes)[:-1])]
        n = len(ids)
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array([step] * n, pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array(sizes, pa.int64()), pa.array(split(bits), pa.binary()), pa.array(split(first) if step == 2 else [None] * n, pa.binary())],
            names=["block_id", "step", "bucket", "n", "bits", "more"],
        )

    return stored(sent.groupBy("bucket").applyInArrow(sort_bucket, _FLAGS))


def remove_repeats(docs: DataFrame, text_col: str = "text", min_bytes: int = 200, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the text, with n_bytes, n_removed and n_spans (long) and kept (binary: the bytes left).

    Each byte goes that is covered by a string of min_bytes bytes of one text that starts anywhere else too, in this or
    another text or row; all is judged on the input. A null text is empty. Repeated rows repeat each other's strings.
    A block holds at least one whole text. Input columns named like an added one give way to it. No rows: no rows.
    """
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())]
    names = {n for n, _ in added}
    others = [c for c in docs.columns if c != text_col and c.lower() not in names]
    text = fresh(others, "suffix_text")
    source = docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text_col}`").alias(text))
    result_schema = schema_with(source.drop(text).schema, added)
    blocks = _blocks(source, text, block_bytes)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    v, members = cover(min_bytes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(parts.bit_length(), int(total * len(members) / v / BUCKET_KEYS).bit_length())

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for i in range(rows.num_rows):
                yield from _sent_table(_block_of(rows, i, min_bytes), 1, {}, bits).to_batches()

    def by_block(flags: DataFrame, work: Callable[[Block, dict, pa.Table], pa.Table], schema) -> DataFrame:
        def run(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
            return work(_block_of(rows, 0, min_bytes), _flags_of(own), rows)

        return blocks.groupBy("block_id").cogroup(flags.groupBy("block_id")).applyInArrow(run, schema)

    def next_keys(step: int) -> Callable[[Block, dict, pa.Table], pa.Table]:
        return lambda block, flags, rows: _sent_table(block, step, flags, bits)

    def cut(block: Block, flags: dict, rows: pa.Table) -> pa.Table:
        gone = _around(len(block.data), np.flatnonzero(block.repeated(flags)), 0, min_bytes)
        starts = np.concatenate(([0], block.ends[:-1])) if len(block.ends) else block.ends
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inside = starts[starts < len(gone)]
        first[inside] = gone[inside]
        per_doc = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], block.ends))])
        kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(starts, block.ends, strict=True)]
        other = pa.ipc.open_stream(_expand(rows.column("rest")[0].as_py())).read_all()
        columns = [pa.array(block.ends - starts, pa.int64()), pa.array(per_doc(gone), pa.int64()), pa.array(per_doc(first), pa.int64()), pa.array(kept, pa.binary())]
        return pa.table([*other.columns, *columns], names=result_schema.names)

    flags = _sorted_buckets(blocks.mapInArrow(sample, _SENT), 1)
    for step in (2, 3, 4):
        flags = _sorted_buckets(by_block(flags, next_keys(step), _SENT), step)
    return by_block(flags, cut, result_schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL_OP1 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n FROM d),
w AS (SELECT rid, b, unnest(range(1, n - 198)) AS i FROM n WHERE n >= 200),
x AS (SELECT rid, i, md5(b[i:i + 199]) AS h FROM w),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM x) WHERE c > 1),
g AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM g),
s AS (SELECT rid, min(i) AS a, max(i) + 199 AS z FROM k GROUP BY rid, run),
p AS (
  SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM s
  UNION ALL SELECT n.rid, coalesce(max(s.z), 0) + 1, any_value(n.n) FROM n LEFT JOIN s ON s.rid = n.rid GROUP BY n.rid),
t AS (SELECT p.rid, string_agg(CASE WHEN p.z >= p.a THEN hex(b[p.a:p.z]) ELSE '' END, '' ORDER BY p.a) AS kept FROM p JOIN n ON n.rid = p.rid GROUP BY p.rid),
c AS (SELECT rid, sum(z - a + 1) AS removed, count(*) AS spans FROM s GROUP BY rid)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans, sha256(unhex(t.kept)) AS kept_sha256
FROM n JOIN t ON t.rid = n.rid LEFT JOIN c ON c.rid = n.rid
"""
