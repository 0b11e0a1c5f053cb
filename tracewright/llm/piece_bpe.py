"""SentencePiece BPE encoding by backtracking, and decoding by table.

A text gets a leading space, spaces become U+2581, and characters that no piece holds become byte tokens. What is left
is cut where no piece can reach across, and each distinct cut is encoded once a task:

1. Aho-Corasick gives the longest piece that starts at each position.
2. From the left, the longest piece is taken that is compatible with the piece before it, else the next shorter one
   that starts there. Two pieces are compatible if merging their characters anew would give these two again.
3. Where no piece is left, the position is marked in a bitfield and the piece before it is taken back. An encoding of a
   prefix is unique, so a marked position is never tried again.

Pieces that share one score are merged after all others, the leftmost pair first; that part is done by merging.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import binaries, ragged, schema_with, slices, strings, with_columns

#: What stands for a space in pieces, and what the library decodes an unknown piece to.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Pairs of pieces whose compatibility a task holds; beyond, it starts anew.
HELD_PAIRS = 2_000_000
#: Distinct cuts that a task holds, and their characters; beyond either, it starts anew.
HELD_CUTS, HELD_LETTERS = 600_000, 16 << 20


def _bad_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("tracewright_each_byte", _bad_bytes)


class PieceBpe:
    """The pieces of a model and the rules of their merges; a model that the method does not hold for is an error."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bos, self.eos = model.bos_id(), model.eos_id()
        apart = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.piece = [model.id_to_piece(i) for i in ids]
        self.id_of = {self.piece[i]: i for i in ids if i not in apart}
        scores = {i: model.get_score(i) for i in ids if i not in apart}
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.byte_id) or (self.bos < 0 or self.eos < 0):
            raise ValueError("the model needs byte tokens and ids of begin and end")
        letters = {c for p in self.id_of for c in p}
        if not letters.issubset(self.id_of):
            raise ValueError("a character of a piece is not a piece")
        shared = Counter(s for i, s in scores.items() if len(self.piece[i]) > 1)
        least = min(scores.values())
        if any(n > 1 and s != least for s, n in shared.items()):
            raise ValueError("pieces that share a score must be the last to merge")
        late = {i for i, s in scores.items() if s == least and shared[s] > 1 and len(self.piece[i]) > 1}
        self.late = {self.piece[i]: i for i in late}
        if any(p[:k] in self.late or p[k:] in self.late for p, i in self.id_of.items() if i not in late for k in range(1, len(p))):
            raise ValueError("a piece that shares a score is part of an earlier one")
        self.late_parts = {self.id_of[q] for p in self.late for k in range(1, len(p)) for q in (p[:k], p[k:]) if q in self.id_of and q not in self.late}
        last_letters = "".join(sorted({c for p in self.late for c in p}))
        self.meets_late = re.compile(f"[{re.escape(last_letters)}]{{2}}") if self.late else None
        order = sorted((i for i in scores if len(self.piece[i]) > 1 and i not in late), key=lambda i: -scores[i])
        #: Rank of each piece by its merge; single characters come before all.
        self.rank = dict.fromkeys((self.id_of[c] for c in letters), -1) | {i: r for r, i in enumerate(order)}
        self.parts: dict[int, tuple[int, int]] = {}
        for i in order:
            merged = self._last_merge(self.piece[i])
            if merged:
                self.parts[i] = merged
        self.shorter = [-1] * len(self.piece)
        self.search = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) == 1 or i in self.parts:
                self.search.add_word(p, (i, len(p)))
                prefix = next((self.id_of[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of and (k == 1 or self.id_of[p[:k]] in self.parts)), None)
                if prefix is not None:
                    self.shorter[i] = prefix
        self.search.make_automaton()
        self.length = list(map(len, self.piece))
        self.known: dict[int, bool] = {}
        #: Cuts: a character that no piece holds; else from a run of SPACE to the next, if no piece has one behind another character.
        inside = "".join(sorted(letters - {SPACE}))
        across = any(a != SPACE and b == SPACE for p in self.id_of for a, b in zip(p, p[1:]))
        kept = f"[{re.escape(inside)}]"
        self.pattern = f"(?s)(?:{SPACE}|{kept})+|." if across else f"(?s){SPACE}*{kept}+|{SPACE}+|."
        self._tables(model, ids)

    def _tables(self, model, ids: range) -> None:
        data = []
        for i in ids:
            if model.is_control(i):
                data.append(b"")
            elif model.is_byte(i):
                data.append(bytes([int(self.piece[i][3:5], 16)]))
            else:
                data.append((UNKNOWN if model.is_unknown(i) else self.piece[i].replace(SPACE, " ")).encode())
        self.lengths = np.fromiter(map(len, data), np.int64, len(data))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.controls = np.array([model.is_control(i) for i in ids])
        self.is_byte = np.array([model.is_byte(i) for i in ids])
        self.spaced = np.array([self.piece[i].startswith(SPACE) for i in ids])

    def _merge(self, ids: list[int], ranks: dict[str, int]) -> tuple[list[int], tuple[int, int] | None]:
        """Merges neighbours by rank, then from the left, by definition; and the two parts of the last merge."""
        text = [self.piece[i] for i in ids]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(text) and (r := ranks.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (r, i, text[i] + text[j]))

        for i in range(len(ids) - 1):
            offer(i)
        last = None
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not text[i] or j >= len(text) or text[i] + text[j] != whole:
                continue
            last = (self.id_of[text[i]], self.id_of[text[j]])
            text[i], text[j], after[i] = whole, "", after[j]
            if after[j] < len(text):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.id_of[t] for t in text if t], last

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The parts of a piece's last merge; None if its own characters do not merge to it."""
        if not hasattr(self, "_ranks"):
            self._ranks = {self.piece[i]: r for i, r in self.rank.items() if r >= 0}
        ids, last = self._merge([self.id_of[c] for c in piece], self._ranks)
        return last if ids == [self.id_of[piece]] else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the characters of both, merged anew, give these two again.

        The merges of both are undone from the last; no two parts that met at the border may have merged before either
        of them went into a larger part. At equal ranks the leftmost merge is the first.
        """
        key = (left << 32) | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) > HELD_PAIRS:
                self.known.clear()
            found = self.known[key] = self._remerge(left, right)
        return found

    def _remerge(self, left: int, right: int) -> bool:
        until_left = until_right = 1 << 60
        while True:
            met = self._ranks.get(self.piece[left] + self.piece[right])
            if met is not None and met < until_left and met <= until_right:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                until_left, left = a, self.parts[left][1]
            else:
                until_right, right = b, self.parts[right][0]

    def encode_cut(self, text: str) -> list[int]:
        """The ids of one cut."""
        i = self.id_of.get(text)
        if i in self.parts:
            return [i]
        n = len(text)
        if n == 1:
            return [i] if i is not None else [self.byte_id[b] for b in text.encode()]
        longest = [0] * n
        for end, (i, size) in self.search.iter(text):  # ends rise, so the longest piece of each start comes last
            longest[end - size + 1] = i
        length, shorter, known, compatible = self.length, self.shorter, self.known.get, self.compatible
        failed, any_failed = bytearray((n >> 3) + 1), False
        ids: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    if last < 0:
                        break
                    fits = known(last << 32 | token)
                    if fits or (fits is None and compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at, last = end, token
                if at < n:
                    token = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                token = ids.pop()
                at -= length[token]
                token = shorter[token]
                last = ids[-1] if ids else -1
        return self._finish(ids) if self.meets_late and self.meets_late.search(text) else ids

    def _finish(self, ids: list[int]) -> list[int]:
        """Merges the pieces that share the last score."""
        out: list[int] = []
        run: list[int] = []
        for i in [*ids, -1]:
            if i in self.late_parts:
                run.append(i)
                continue
            out += self._merge(run, dict.fromkeys(self.late, 0))[0] if len(run) > 1 else run
            run = []
            if i >= 0:
                out.append(i)
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decoded text of each of the runs of counts ids."""
        ids = ids.astype(np.int64)
        data = ragged(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        out, at = [], 0
        for n in counts.tolist():
            own = ids[at : at + n]
            text = data[ends[at] : ends[at + n]]
            first = np.flatnonzero(~self.controls[own])[:1]
            if len(first) and self.spaced[own[first[0]]]:  # a leading space stands for the one that encoding adds
                text = text[1:]
            if self.is_byte[own].any():  # bytes make no character across an id without text
                cuts = ends[at + np.flatnonzero(self.controls[own])] - ends[at + n] + len(text)
                parts = [text[max(a, 0) : max(b, 0)] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)])]
                text = b"".join(p.decode("utf-8", "tracewright_each_byte").encode() for p in parts)
            out.append(text)
            at += n
        return out


class PieceEncoder:
    """Texts to ids without begin and end, holding the ids of the cuts seen so far."""

    def __init__(self, bpe: PieceBpe):
        self.bpe, self.pattern = bpe, re.compile(bpe.pattern)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held_letters = 0
        self.ids, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all docs in a row, and how many each has."""
        cuts = [self.pattern.findall(SPACE + d.replace(" ", SPACE)) if d else [] for d in docs]
        flat = list(itertools.chain.from_iterable(cuts))
        needed = {*flat}
        new = needed.difference(self.at)
        if self.at and (len(self.at) + len(new) > HELD_CUTS or self.held_letters + sum(map(len, new)) > HELD_LETTERS):
            self._forget()
            new = needed
        self.held_letters += sum(map(len, new))
        if new:
            found = [self.bpe.encode_cut(c) for c in new]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.ids = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))))
            self.lengths = np.concatenate((self.lengths, lengths))
        which = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        own = self.lengths[which]
        ends = np.concatenate(([0], np.cumsum([len(c) for c in cuts], dtype=np.int64)))
        return ragged(self.ids, (np.cumsum(self.lengths) - self.lengths)[which], own), np.diff(np.concatenate(([0], np.cumsum(own)))[ends])


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", ends: bool = True) -> DataFrame:
    """docs with n_tokens (long) and ids (binary: little-endian unsigned 32-bit) added; with ends, the ids of begin and
    end are around the others.

    A null or empty text has no ids but these. Strings of special pieces are ordinary text. Rows are encoded one by one,
    so repeated rows, ties and an empty table need no rule. Input columns named like an added one give way to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe(model_path)
        encoder = PieceEncoder(bpe)
        for batch in slices(batches, text_col):
            ids, n = encoder.encode(strings(batch, text_col))
            if ends:
                last = np.cumsum(n)
                ids = np.insert(ids, np.stack((last - n, last), axis=1).ravel(), np.tile(np.array([bpe.bos, bpe.eos], np.uint32), len(n)))
                n = n + 2
            yield with_columns(batch, {"n_tokens": pa.array(n, pa.int64()), "ids": binaries(ids.astype("<u4", copy=False), n)})

    return docs.mapInArrow(run, schema_with(docs.schema, [("n_tokens", T.LongType()), ("ids", T.BinaryType())]))


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded (binary: UTF-8) added: pieces with spaces, without the first of a text; ids of begin and end give
    nothing, bytes that are no UTF-8 one U+FFFD each. Null ids decode to an empty text; an id that is no piece is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe(model_path)
        for batch in slices(batches, ids_col):
            rows = [x or b"" for x in batch.column(ids_col).to_pylist()]
            found = bpe.decode(np.frombuffer(b"".join(rows), "<u4"), np.array([len(x) // 4 for x in rows], np.int64))
            yield with_columns(batch, {"decoded": pa.array(found, pa.binary())})

    return df.mapInArrow(run, schema_with(df.schema, [("decoded", T.BinaryType())]))


def op13_piece_bpe(spark, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode_pieces(docs, model).drop("text")
    return decode_pieces(ids, model).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
