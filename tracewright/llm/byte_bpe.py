"""Byte-level BPE in numpy: encoding by rounds over padded matrices of pieces, decoding by table.

A text is cut by the tokenizer's pattern. The distinct pieces of a batch that are not known yet go into matrices of
token ids, one for each range of lengths. In each round every row merges its leftmost pair of minimum rank, found in
a hashed pair table; finished rows leave the matrix. Pieces longer than LONG bytes are merged one by one with a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import binaries, ragged, schema_with, slices, strings, with_columns

NONE = np.int32(2**31 - 1)
LONG = 256
HELD_PIECES, HELD_BYTES = 250_000, 32 << 20
#: Cells of one matrix, about.
CELLS = 1 << 21


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.bits = max(10, int(4 * len(pairs) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        left, right, rank = np.array(pairs, np.int64).T if pairs else np.zeros((3, 0), np.int64)
        self._fill((left << 32) | right, rank.astype(np.int32))
        lengths = np.array([len(t) for t in self.token], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] < 0]
            self.keys[at[free]] = keys[free]  # of keys with the same slot the last one stays
            won = rest[self.keys[at[rest]] == keys[rest]]
            self.ranks[at[won]] = ranks[won]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or NONE; an id of -1 is in no pair."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        at = self._slot(flat)
        here = self.keys[at]
        out = np.where(here == flat, self.ranks[at], NONE)
        rest = np.flatnonzero((here != flat) & (here >= 0) & (flat >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            here = self.keys[at[rest]]
            hit = here == flat[rest]
            out[rest[hit]] = self.ranks[at[rest[hit]]]
            rest = rest[~hit & (here >= 0)]
        return out.reshape(keys.shape)

    def merge_rounds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges all rows of a matrix of ids, padded with -1: the merged matrix and the rows' lengths."""
        done, rows = np.full_like(ids, -1), np.arange(len(ids))
        width = ids.shape[1]
        if width == 1:
            return ids, (ids >= 0).sum(axis=1)
        ids, ranks = ids.copy(), self.pair_ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            over = best == NONE
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                stay = ~over
                rows, ids, ranks, at, best = rows[stay], ids[stay], ranks[stay], at[stay], best[stay]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            ids[every, at] = best
            source = columns[None, : ids.shape[1] - 1] + (columns[None, : ids.shape[1] - 1] > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)  # every live row is one token shorter
            if ids.shape[1] == 1:
                done[rows, :1] = ids
                break
            ranks = np.take_along_axis(ranks, source[:, :-1], axis=1)
            edge = np.stack((at - 1, at), axis=1)
            row = np.repeat(every[:, None], 2, axis=1)
            valid = (edge >= 0) & (edge < ids.shape[1] - 1)
            row, edge = row[valid], edge[valid]
            ranks[row, edge] = self.pair_ranks(ids[row, edge], ids[row, edge + 1])
        return done, (done >= 0).sum(axis=1)

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length, by a heap of pairs over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)]

        def rank(i: int) -> int:
            key = (ids[i] << 32) | ids[after[i]]
            at = (key * 0x9E3779B97F4A7C15 % 2**64) >> (64 - self.bits)
            while (here := self.keys[at]) >= 0:
                if here == key:
                    return int(self.ranks[at])
                at = (at + 1) & ((1 << self.bits) - 1)
            return int(NONE)

        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (x := rank(i)) != NONE:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if (p := before[i]) >= 0 and (x := rank(p)) != NONE:
                heapq.heappush(heap, (x, p, ids[p], r))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(lengths) - lengths
        low = 0
        for high in [*range(1, 17), 24, 32, 64, 128, LONG]:
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for at in range(0, len(own), max(1, CELLS // high)):
                rows = own[at : at + max(1, CELLS // high)]
                ids = np.full((len(rows), high), -1, np.int32)
                ids[np.arange(high)[None, :] < lengths[rows][:, None]] = self.byte_id[ragged(data, starts[rows], lengths[rows])]
                merged, n = self.merge_rounds(ids)
                counts[rows] = n
                parts.append((rows, merged[np.arange(high)[None, :] < n[:, None]], n))
        for i in np.flatnonzero(lengths > LONG):
            found = np.array(self.merge_long(pieces[i]), np.int32)
            counts[i] = len(found)
            parts.append((np.array([i]), found, np.array([len(found)])))
        out, ends = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts)
        for rows, ids, n in parts:
            first = np.repeat(ends[rows] - n - (np.cumsum(n) - n), n)
            out[np.arange(len(ids)) + first] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.bytes, self.starts[ids], self.lengths[ids])


class Encoder:
    """Texts to ids, holding the ids of the pieces seen so far."""

    def __init__(self, bpe: ByteBpe, pattern: str):
        self.bpe, self.pattern = bpe, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held_bytes = 0
        self.ids, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all docs in a row, and how many each has."""
        pieces = [self.pattern.findall(d) for d in docs]
        flat = [p for d in pieces for p in d]
        new = list({*flat}.difference(self.at))
        more = sum(map(len, new))
        if self.at and (len(self.at) + len(new) > HELD_PIECES or self.held_bytes + more > HELD_BYTES):
            self._forget()
            new = list({*flat})
            more = sum(map(len, new))
        self.held_bytes += more
        if new:
            ids, counts = self.bpe.encode_pieces([p.encode() for p in new])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.ids, self.lengths = np.concatenate((self.ids, ids)), np.concatenate((self.lengths, counts))
        which = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        own = self.lengths[which]
        per_doc = np.concatenate(([0], np.cumsum(own)))[np.concatenate(([0], np.cumsum([len(d) for d in pieces], dtype=np.int64)))]
        return ragged(self.ids, (np.cumsum(self.lengths) - self.lengths)[which], own), np.diff(per_doc)


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens (long) and ids (binary: little-endian unsigned 32-bit) added.

    A null or empty text has no ids. Special tokens are ordinary text. Rows are encoded one by one, so repeated rows,
    ties and an empty table need no rule. Input columns named like an added one give way to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ByteBpe.load(ranks_path), pattern)
        for batch in slices(batches, text_col):
            ids, n = encoder.encode(strings(batch, text_col))
            yield with_columns(batch, {"n_tokens": pa.array(n, pa.int64()), "ids": binaries(ids.astype("<u4", copy=False), n)})

    return docs.mapInArrow(run, schema_with(docs.schema, [("n_tokens", T.LongType()), ("ids", T.BinaryType())]))


def decode_bpe(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded (binary) added: the bytes of the tokens; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(ranks_path)
        for batch in slices(batches, ids_col):
            rows = [x or b"" for x in batch.column(ids_col).to_pylist()]
            ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(bpe.lengths[ids])))[np.concatenate(([0], np.cumsum([len(x) // 4 for x in rows], dtype=np.int64)))]
            yield with_columns(batch, {"decoded": binaries(bpe.decode(ids), np.diff(ends))})

    return df.mapInArrow(run, schema_with(df.schema, [("decoded", T.BinaryType())]))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode_bpe(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return decode_bpe(ids, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
