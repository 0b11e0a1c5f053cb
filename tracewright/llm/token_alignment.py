"""Alignment of two tokenizers' tokens over the same text, by a sweep over the ends of tokens.

1. Texts are encoded by both. The end events of each go out in runs: the window of the text that a run's ends lie in,
   the tokenizer and the ids, from which the ends follow. Both tokenizers' runs are united where the text is read.
2. Runs are dealt by document, sorted by window in each task, and streamed through a sweep that holds the document, its
   offset and the tokens behind the last end that both tokenizers share. Such ends cut the tokens into groups; tokens of
   both that overlap are linked.
3. Sweeps gather documents in blocks. A block holds each of its links once, and which documents have them how often.
4. Blocks send each bucket of id pairs the pairs they hold, with counts of documents, and get the corpus's counts back.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import binaries, ragged, slices, stored, strings

#: Bytes of text whose token ends make one run.
WINDOW = 1 << 14
#: Links of a block, distinct in their document, about; and pairs of a bucket.
BLOCK_LINKS, BUCKET_PAIRS = 2_000_000, 2_000_000
STATS = ["n_a", "n_b", "n_groups", "n_links"]


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, their bytes by place, compressed."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def rising(values: np.ndarray) -> bytes:
    """packed() of the steps between values, modulo 2^32."""
    return packed(np.diff(values.astype(np.uint32), prepend=np.uint32(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint32)


@dataclass
class Side:
    """One tokenizer: how it encodes texts, and the bytes of each of its ids."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]
    lengths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.bytes, self.starts[ids], self.lengths[ids])


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(path: str) -> Side:
    """A byte-level BPE of the tokenizers library, applied to a space and the text; special strings are plain text."""
    from tracewright.llm.words import library_tokenizer

    tokenizer = library_tokenizer(path)
    letters = _byte_letters()
    tokens = [b""] * tokenizer.get_vocab_size()
    for t, i in tokenizer.get_vocab().items():
        tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
    fast = _as_ranks(tokenizer, tokens)

    def encode(docs: list[str]) -> list[list[int]]:
        if fast is not None:
            return [fast.encode_ordinary(" " + d) for d in docs]
        tokenizer.encode_special_tokens = True
        return [e.ids for e in tokenizer.encode_batch_fast([" " + d for d in docs], add_special_tokens=False)]

    return Side(encode, tokens)


def _as_ranks(tokenizer, tokens: list[bytes]):
    """The tokenizer as ranks of the tiktoken library, which is some four times as fast; None unless its ids are the
    ranks of its merges, it splits by the public pattern, and nothing else is done to texts."""
    import tiktoken

    kind = json.loads(tokenizer.to_str())
    model, split = kind["model"], kind["pre_tokenizer"] or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    plain = not (kind["normalizer"] or model.get("ignore_merges") or model.get("dropout") or model.get("unk_token") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"))
    if not (in_order and plain and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")):
        return None
    ranks = {t: i for i, t in enumerate(tokens) if i < 256 + len(merges)}
    whole = len(ranks) == 256 + len(merges) and all(len(t) == 1 for t in tokens[:256])
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if whole else None


def pieces(path: str) -> Side:
    """A model of the sentencepiece library, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = re.compile("<0x([0-9A-F]{2})>")
    tokens = [bytes([int(byte.fullmatch(p)[1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return Side(lambda docs: model.encode(docs, num_threads=1), tokens)


def both(a_path: str, b_path: str) -> Callable[[], tuple[Side, Side]]:
    """What loads a byte-level tokenizer and a model of pieces."""
    return lambda: (byte_level(a_path), pieces(b_path))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(counts.sum())), counts


def end_events(docs: DataFrame, load: Callable[[], tuple[Side, Side]], id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, at, side, ids): a run of a document's tokens whose ends lie in window at; side 0 is A.

    A document without tokens has one empty run. Documents are numbered, so equal ids and equal rows stay apart.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = load()
        for batch in slices(batches, "text"):
            found = strings(batch, "text")
            whole = [f" {t}".encode() if t else b"" for t in found]
            sizes = np.fromiter(map(len, whole), np.int64, len(whole))
            data = np.frombuffer(b"".join(whole), np.uint8)
            coded = []
            good = sizes > 0
            for side in sides:
                ids, counts = _flat(side.encode(found))
                own = np.repeat(np.arange(len(found)), counts)
                lengths = np.bincount(own, side.lengths[ids], minlength=len(found)).astype(np.int64)
                good &= lengths == sizes
                coded.append((ids, own))
            for k, side in enumerate(sides):
                ids, own = coded[k]
                taken = good[own]
                ids, own = ids[taken], own[taken]
                coded[k] = (ids, own)
                at = np.flatnonzero(good)
                same = side.joined(ids) == ragged(data, (np.cumsum(sizes) - sizes)[at], sizes[at])
                wrong = np.add.reduceat(~same, np.cumsum(sizes[at]) - sizes[at]) if len(at) else np.zeros(0, np.int64)
                differs = np.zeros(len(found), bool)
                differs[at[wrong > 0]] = True
                coded = [(i[~differs[o]], o[~differs[o]]) for i, o in coded]
                good &= ~differs
            rows, windows, which, counts, out = [], [], [], [], []
            for k, side in enumerate(sides):
                ids, own = coded[k]
                if not len(ids):
                    continue
                total = np.cumsum(side.lengths[ids])
                first = np.flatnonzero(np.diff(own, prepend=-1))
                before = np.repeat(total[first] - side.lengths[ids[first]], np.diff(np.append(first, len(ids))))
                window = (total - before - 1) // WINDOW
                cut = np.flatnonzero(np.diff(own, prepend=-1) | np.diff(window, prepend=-1))
                rows.append(own[cut])
                windows.append(window[cut])
                which.append(np.full(len(cut), k))
                counts.append(np.diff(np.append(cut, len(ids))))
                out.append(ids.astype("<u2" if len(side.tokens) <= 1 << 16 else "<u4"))
            none = np.flatnonzero(~good)
            parts = [binaries(i, n) for i, n in zip(out, counts, strict=True)] + [pa.array([b""] * len(none), pa.binary())]
            rows, windows, which = (np.concatenate([*x, fill]) for x, fill in ((rows, none), (windows, none * 0), (which, none * 0)))
            columns = batch.select(["doc", "doc_id"]).take(pa.array(rows)).columns
            made = [*columns, pa.array(windows, pa.int64()), pa.array(which, pa.int32()), pa.concat_arrays(parts)]
            yield from pa.Table.from_arrays(made, names=["doc", "doc_id", "at", "side", "ids"]).to_batches(max_chunksize=500)

    kind = numbered.schema["doc_id"].dataType
    return numbered.mapInArrow(run, T.StructType([T.StructField("doc", T.LongType()), T.StructField("doc_id", kind), T.StructField("at", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("ids", T.BinaryType())]))


class _Digits:
    """Decimal digits of ids, each with a place for what follows it."""

    def __init__(self, n: int):
        text = [b"%d," % i for i in range(n)]
        self.lengths = np.fromiter(map(len, text), np.int64, n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(text), np.uint8)


class Sweep:
    """The state of a task's sweep: the open document, its tokens behind the last shared end, and the block so far."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths = lengths
        self.n_b = len(lengths[1])
        self.digits = _Digits(max(map(len, lengths)))
        self.doc: int | None = None
        self.waiting = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self._clear()

    def _clear(self) -> None:
        self.done: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def _open(self, doc: int, doc_id) -> None:
        self.doc, self.doc_id = doc, doc_id
        self.stats = np.zeros(4, np.int64)
        self.sha, self.begun = hashlib.sha256(), False
        self.own_codes, self.own_times = [], []

    def close(self) -> None:
        """Ends the open document."""
        if self.doc is None:
            return
        codes, times = merged(self.own_codes, self.own_times) if len(self.own_codes) != 1 else (self.own_codes[0], self.own_times[0])
        self.done.append((self.doc_id, *self.stats.tolist(), self.sha.hexdigest() if self.begun else "", len(codes)))
        self.codes.append(codes)
        self.times.append(times)
        self.links += len(codes)
        self.doc = None

    def feed(self, docs: np.ndarray, doc_ids: list, sides: np.ndarray, tokens: tuple[np.ndarray, np.ndarray], counts: np.ndarray) -> Iterator[None]:
        """The next runs, in order; yields whenever the block is full. tokens has A's and B's ids, counts those of each run."""
        change = np.flatnonzero(np.diff(docs, prepend=-1))
        order = np.cumsum(np.diff(docs, prepend=-1) != 0) - 1
        carried = self.doc is not None and len(docs) > 0 and docs[0] == self.doc
        if self.doc is not None and not carried:
            self.close()
        width = len(change)
        ids, own = [], []
        for k in (0, 1):
            waiting = self.waiting[k] if carried else self.waiting[k][:0]
            ids.append(np.concatenate((waiting, tokens[k])))
            own.append(np.concatenate((np.zeros(len(waiting), np.int64), np.repeat(order[sides == k], counts[sides == k]))))
        sizes = [self.lengths[k][ids[k]] for k in (0, 1)]
        totals = [np.bincount(own[k], sizes[k], minlength=width).astype(np.int64) for k in (0, 1)]
        span = np.maximum(*totals)
        base = np.cumsum(span) - span
        ends = []
        for k in (0, 1):
            before = np.cumsum(totals[k]) - totals[k]
            ends.append(np.cumsum(sizes[k]) - before[own[k]] + base[own[k]])
        a, b = ends
        near = np.searchsorted(b, a)
        shared_a = np.flatnonzero(b[np.minimum(near, max(len(b) - 1, 0))] == a) if len(b) else np.zeros(0, np.int64)
        shared_b = near[shared_a]
        to_a, to_b = (int(shared_a[-1]) + 1, int(shared_b[-1]) + 1) if len(shared_a) else (0, 0)
        self.waiting = [ids[0][to_a:], ids[1][to_b:]]
        ids, own, ends = [ids[0][:to_a], ids[1][:to_b]], [own[0][:to_a], own[1][:to_b]], [a[:to_a], b[:to_b]]
        a, b = ends
        groups = own[0][shared_a]
        first = np.searchsorted(b, a - sizes[0][:to_a], "right")
        n = np.searchsorted(b, a) - first + 1
        linked = ragged(ids[1], first, n)
        link_own = np.repeat(own[0], n)
        codes = np.repeat(ids[0], n) * self.n_b + linked
        per_doc = np.stack([np.bincount(x, minlength=width) for x in (own[0], own[1], groups, link_own)], axis=1)
        keys, times = np.unique(link_own * (len(self.lengths[0]) * self.n_b) + codes, return_counts=True)
        key_own = keys // (len(self.lengths[0]) * self.n_b)
        keys = keys - key_own * (len(self.lengths[0]) * self.n_b)
        cuts = np.searchsorted(key_own, np.arange(width + 1)).tolist()
        text, text_cuts = self._groups(ids, own, shared_a, shared_b, width)
        for i, row in enumerate(change.tolist()):
            if i or not carried:
                self.close()
                if self.links >= BLOCK_LINKS:
                    yield
                self._open(int(docs[row]), doc_ids[row])
            self.stats += per_doc[i]
            part = text[text_cuts[i] : text_cuts[i + 1]]
            if part:
                if self.begun:
                    self.sha.update(b";")
                self.sha.update(part[:-1])
                self.begun = True
                self.own_codes.append(keys[cuts[i] : cuts[i + 1]])
                self.own_times.append(times[cuts[i] : cuts[i + 1]])
                if len(self.own_codes) > 64:
                    self.own_codes, self.own_times = ([x] for x in merged(self.own_codes, self.own_times))

    def _groups(self, ids: list, own: list, shared_a: np.ndarray, shared_b: np.ndarray, width: int) -> tuple[bytes, list[int]]:
        """a1,a2|b1; for each group, and where each document's begin."""
        if not len(shared_a):
            return b"", [0] * (width + 1)
        group_a = np.searchsorted(shared_a, np.arange(len(ids[0])))
        group_b = np.searchsorted(shared_b, np.arange(len(ids[1])))
        place_a = np.arange(len(ids[0])) + np.concatenate(([0], shared_b + 1))[group_a]
        place_b = np.arange(len(ids[1])) + (shared_a + 1)[group_b]
        every = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        every[place_a], every[place_b] = ids[0], ids[1]
        lengths = self.digits.lengths[every]
        out = ragged(self.digits.bytes, self.digits.starts[every], lengths)
        ends = np.cumsum(lengths)
        out[ends[place_a[shared_a]] - 1] = ord("|")
        out[ends[place_b[shared_b]] - 1] = ord(";")
        until = np.searchsorted(own[1][shared_b], np.arange(width), "right")  # groups up to and with each document
        return out.tobytes(), [0, *np.concatenate(([0], ends[place_b[shared_b]]))[until].tolist()]

    def block(self) -> dict:
        """The documents closed so far as one row, and a new block."""
        codes, times = np.concatenate(self.codes), np.concatenate(self.times)
        pairs, at = np.unique(codes, return_inverse=True)
        out = {
            "doc_id": [d[0] for d in self.done], **{s: [d[1 + k] for d in self.done] for k, s in enumerate(STATS)}, "groups_sha256": [d[5] for d in self.done],
            "counts": packed(np.array([d[6] for d in self.done])), "links": rising(at), "times": packed(times),
            "n_pairs": len(pairs), "pair_a": rising(pairs // self.n_b), "pair_b": rising(pairs % self.n_b), "held": packed(np.bincount(at, minlength=len(pairs))),
        }
        self._clear()
        return out


def merged(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the sums of their times."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(times), minlength=len(found)).astype(np.int64)


def _blocks(events: DataFrame, lengths: tuple[np.ndarray, np.ndarray], id_kind: T.DataType) -> DataFrame:
    kinds = {s: T.ArrayType(T.LongType()) for s in STATS} | {"groups_sha256": T.ArrayType(T.StringType()), "counts": T.BinaryType(), "links": T.BinaryType(), "times": T.BinaryType(), "n_pairs": T.LongType(), "pair_a": T.BinaryType(), "pair_b": T.BinaryType(), "held": T.BinaryType()}
    schema = T.StructType([T.StructField(n, k) for n, k in ({"block": T.LongType(), "doc_id": T.ArrayType(id_kind)} | kinds).items()])
    wide = [2 if len(x) <= 1 << 16 else 4 for x in lengths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, made = Sweep(lengths), 0

        def block(arrow: pa.Schema | None = None) -> pa.RecordBatch:
            nonlocal made
            row = {"block": (TaskContext.get().partitionId() << 33) + made, **sweep.block()}
            made += 1
            ids = pa.array([row.pop("doc_id")], pa.list_(arrow))
            plain = pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), *((s, pa.list_(pa.int64())) for s in STATS), ("groups_sha256", pa.list_(pa.string())), ("counts", pa.binary()), ("links", pa.binary()), ("times", pa.binary()), ("n_pairs", pa.int64()), ("pair_a", pa.binary()), ("pair_b", pa.binary()), ("held", pa.binary())]))
            return pa.RecordBatch.from_arrays([plain.column("block"), ids, *plain.columns[1:]], names=schema.names)

        kind = None
        for batch in slices(batches, "ids"):
            kind = batch.schema.field("doc_id").type
            data = batch.column("ids").cast(pa.binary()).to_pylist()
            sides = batch.column("side").to_numpy()
            tokens = tuple(np.frombuffer(b"".join(d for d, s in zip(data, sides, strict=True) if s == k), f"<u{wide[k]}").astype(np.int64) for k in (0, 1))
            counts = np.fromiter(map(len, data), np.int64, len(data)) // np.array(wide)[sides]
            for _ in sweep.feed(batch.column("doc").to_numpy(), batch.column("doc_id").to_pylist(), sides, tokens, counts):
                yield block(kind)
        sweep.close()
        if sweep.done:
            yield block(kind)

    return events.mapInArrow(run, schema)


def align(docs: DataFrame, load: Callable[[], tuple[Side, Side]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256.

    load() gives the two tokenizers, in each task anew. Groups lie between byte offsets where tokens of both end; a link
    is a pair of tokens whose bytes overlap; its count is the number of documents that hold its pair of ids linked.
    n_best counts the links whose count is the highest of their A id, ties included. A null or empty text, and one whose
    tokens' bytes are not the text's with a space before, has no tokens: zeros and ''. Equal and null ids are documents
    of their own, and so are repeated rows. Other columns are not read, so their names cannot clash.
    """
    events = end_events(docs, load, id_col, text_col)
    dealt = events.repartition("doc").sortWithinPartitions("doc", "at", "side")
    lengths = tuple(s.lengths for s in load())
    id_kind = events.schema["doc_id"].dataType
    blocks = stored(_blocks(dealt, lengths, id_kind))
    n_b = len(lengths[1])
    total = blocks.agg(F.sum("n_pairs")).head()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_PAIRS))

    def codes_of(a: bytes, b: bytes) -> np.ndarray:
        return risen(a).astype(np.int64) * n_b + risen(b)

    def bucket_of(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n_buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b, held in zip(*(batch.column(c).to_pylist() for c in ("block", "pair_a", "pair_b", "held")), strict=True):
                codes, held = codes_of(a, b), unpacked(held)
                bucket = bucket_of(codes)
                rows = []
                for k in np.unique(bucket).tolist():
                    own = codes[bucket == k]
                    rows.append({"bucket": k, "block": block, "pair_a": rising(own // n_b), "pair_b": rising(own % n_b), "held": packed(held[bucket == k])})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("pair_a", pa.binary()), ("pair_b", pa.binary()), ("held", pa.binary())]))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        parts = [codes_of(a, b) for a, b in zip(table.column("pair_a").to_pylist(), table.column("pair_b").to_pylist(), strict=True)]
        pairs, at = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(at, np.concatenate([unpacked(h) for h in table.column("held").to_pylist()]), minlength=len(pairs)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, parts)])
        a = pairs // n_b
        first = np.flatnonzero(np.diff(a, prepend=-1))
        most = [(a[first], np.maximum.reduceat(sums, first))] + [(a[:0], a[:0])] * (len(parts) - 1)
        replies = [sums[at[i:j]] for i, j in zip(cuts, cuts[1:])]
        return pa.table({
            "bucket": table.column("bucket"), "block": table.column("block"), "low": pa.array([packed(r & 0xFFFFFFFF) for r in replies], pa.binary()), "high": pa.array([packed(r >> 32) for r in replies], pa.binary()),
            "a": pa.array([m[0].tolist() for m in most], pa.list_(pa.int64())), "most": pa.array([m[1].tolist() for m in most], pa.list_(pa.int64())),
        })

    sent = blocks.select("block", "pair_a", "pair_b", "held").mapInArrow(send, "bucket long, block long, pair_a binary, pair_b binary, held binary")
    replies = stored(sent.groupBy("bucket").applyInArrow(count, "bucket long, block long, low binary, high binary, a array<long>, most array<long>"))
    highest = replies.select(F.inline(F.arrays_zip("a", "most"))).groupBy("a").agg(F.max("most").alias("most"))
    best = np.zeros(len(lengths[0]), np.int64)  # as many rows as A has ids, at most
    for r in highest.collect():
        best[r["a"]] = r["most"]

    def finish(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in ("counts", "links", "times", "pair_a", "pair_b")}
        codes = codes_of(row["pair_a"].as_py(), row["pair_b"].as_py())
        bucket = bucket_of(codes)
        known = np.zeros(len(codes), np.int64)
        for k, low, high in zip(*(replies.column(c).to_pylist() for c in ("bucket", "low", "high")), strict=True):
            known[bucket == k] = unpacked(low).astype(np.int64) | (unpacked(high).astype(np.int64) << 32)
        top = known == best[codes // n_b]
        at, times, counts = risen(row["links"].as_py()), unpacked(row["times"].as_py()).astype(np.int64), unpacked(row["counts"].as_py()).astype(np.int64)
        own = np.repeat(np.arange(len(counts)), counts)
        out = {"doc_id": block.column("doc_id").combine_chunks().flatten()} | {s: block.column(s).combine_chunks().flatten() for s in STATS}
        sums = np.zeros((2, len(counts)), np.int64)
        np.add.at(sums[0], own[top[at]], times[top[at]])
        np.add.at(sums[1], own, times * known[at])
        out |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": block.column("groups_sha256").combine_chunks().flatten()}
        return pa.table(out)

    names = ["doc_id", *STATS, "n_best", "count_sum"]
    schema = T.StructType([T.StructField(n, id_kind if n == "doc_id" else T.LongType()) for n in names]).add("groups_sha256", "string")
    answered = replies.select("bucket", "block", "low", "high")
    needed = blocks.select("block", "doc_id", *STATS, "groups_sha256", "counts", "links", "times", "pair_a", "pair_b")
    return needed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(finish, schema)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    load = both(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), load)
