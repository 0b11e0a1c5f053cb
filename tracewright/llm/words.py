"""Token ids of texts under a tokenizer that drops white space, encoding each distinct word once.

Such a tokenizer never joins characters across ASCII white space, so a text's ids are those of its words, one after
the other. The words come from the text, their ids from the tokenizers library.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewright.llm.common import binaries, ragged

#: Distinct words that a task holds, and their bytes; beyond either, it starts anew.
HELD_WORDS, HELD_BYTES = 300_000, 32 << 20
#: Fixed value: ASCII punctuation but the apostrophe, which may begin a piece with the letters after it.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: what a stem may end in, letters that lower-case to one letter, and digits.
STEM_END = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"


def library_tokenizer(path: str):
    """The tokenizer at path, single-threaded: Spark runs as many tasks as there are cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def drops_white_space(path: str) -> bool:
    """Whether the tokenizer at path gives words apart the ids that it gives them together."""
    tok = library_tokenizer(path)
    probe = ["one two", "One\tTwo\n three's", "a  b\r\nc 12 é ü,", "x́ ́y z", " lead tail "]
    whole = [e.ids for e in tok.encode_batch(probe, add_special_tokens=False)]
    apart = [[i for w in p.encode().split() for i in tok.encode(w.decode(), add_special_tokens=False).ids] for p in probe]
    return whole == apart


class WordEncoder:
    """Ids of texts, holding those of the words seen so far.

    Words are looked up without trailing ASCII punctuation and with A-Z lower-cased where that gives the same ids: the
    tokenizer must lower-case, and end a piece between a letter or digit and punctuation (else words go as they are).
    """

    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        probe = ["Abc", "abc", "abC.", "abc .", "é,!", "é ,!", "x9%%%", "x9 %%%"]
        a, b, *rest = (e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False))
        self.splits = a == b and rest[0::2] == rest[1::2]
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held_bytes = 0
        self.ids, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The words' stems and tails, encoded apart; a word that may not be cut is all stem."""
        words = words.cast(pa.string())
        stems = pc.utf8_rtrim(words, PUNCTUATION)
        cut = np.asarray(pc.and_not(pc.match_substring_regex(stems, STEM_END), pc.match_substring(words, "<|")))
        if not self.splits:
            cut[:] = False
        stems = pc.if_else(pa.array(cut), pc.ascii_lower(stems), words)
        data, at = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        kept = np.asarray(pc.binary_length(stems), dtype=np.int64)
        return stems.cast(pa.binary()), binaries(ragged(data, at[:-1] + kept, np.diff(at) - kept), np.diff(at) - kept)

    def _add(self, new: list[bytes]) -> None:
        plain = [w for w in new if self.splits and w.decode().isalpha()]
        found: dict[bytes, list[int]] = {}
        chunks = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for words, e in zip(chunks, self.tokenizer.encode_batch_fast([b" ".join(c).decode() for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(words):  # one piece each
                whole, cuts = ids.tolist(), [0, *(ends + 1).tolist()]
                found.update((w, whole[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))
        rest = [w for w in new if w not in found]
        found.update(zip(rest, (e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)), strict=True))
        self.at.update(zip(found, range(len(self.at), len(self.at) + len(found)), strict=True))
        self.lengths = np.concatenate((self.lengths, np.fromiter(map(len, found.values()), np.int64, len(found))))
        self.ids = np.concatenate((self.ids, np.fromiter((i for f in found.values() for i in f), np.uint32)))

    def encode(self, docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(docs, ""))
        words = split.flatten().dictionary_encode()
        parts = [p.dictionary_encode() for p in self._parts(words.dictionary)]
        needed = {p for both in parts for p in both.dictionary.to_pylist()}
        new = needed.difference(self.at)
        more = sum(map(len, new))
        if self.at and (len(self.at) + len(new) > HELD_WORDS or self.held_bytes + more > HELD_BYTES):
            self._forget()
            new, more = needed, sum(map(len, needed))
        self.held_bytes += more
        if new:
            self._add(list(new))
        known = [np.fromiter(map(self.at.__getitem__, p.dictionary.to_pylist()), np.int64, len(p.dictionary)) for p in parts]
        pair = np.stack([k[p.indices.to_numpy(zero_copy_only=False)] for k, p in zip(known, parts, strict=True)], axis=1)
        starts = np.cumsum(self.lengths) - self.lengths
        own = self.lengths[pair].sum(axis=1)
        ids = ragged(self.ids, starts[pair].ravel(), self.lengths[pair].ravel())  # of the distinct words
        which = words.indices.to_numpy(zero_copy_only=False)
        per_doc = np.concatenate(([0], np.cumsum(own[which])))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ragged(ids, (np.cumsum(own) - own)[which], own[which]), np.diff(per_doc)
