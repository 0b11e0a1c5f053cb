"""Personal data: patterns as a base, and a linear-chain CRF over word shapes that adds spans.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed patterns. The CRF labels the words of
each line from their shapes (counts of digits, capitals, marks and the like) and their neighbours' classes. It is
trained on a small labelled table and decoded by Viterbi in numpy, many runs of words at a time. A word whose score
for "none" is ahead by more than any neighbours' transitions could make up for is "none" in the best path, whatever
its neighbours are; so the best path is found exactly by decoding only the runs of the other words.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import schema_with, slices, strings, with_columns

KINDS = ("email", "ip", "card", "phone")
#: CRF labels; the first is none of them. The CRF's spans of kind secret are credentials such as access tokens.
LABELS = ("none", *KINDS, "secret")

# The base patterns of the contract, written so that matching takes linear time.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: its local part reaches back to what cannot belong to it."""
    after, last = 0, text.find("@")
    while last >= 0:
        local = text[after:last]
        start = last - (len(local) - len(local.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, last + 1) if start < last else None
        if found:
            yield start, found.end()
        after = found.end() if found else last + 1
        last = text.find("@", after)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[1], LABELS.index(x[0])))


# Word shapes. Counts of eight classes of bytes are packed into one 64-bit sum a word, eight bits each.
_CLASSES = {"digit": b"0123456789", "upper": bytes(range(65, 91)), "hex": b"abcdefABCDEF", "dot": b".", "phone": b"+()-", "at": b"@", "quote": b"\"'`", "mark": b"!#$%&*,/:;<=>?[\\]^_{|}~"}
_PACKED = np.zeros(256, np.uint64)
for _i, _members in enumerate(_CLASSES.values()):
    for _b in _members:
        _PACKED[_b] += np.uint64(1) << np.uint64(8 * _i)
#: Bounds of the buckets of each figure, and the number of word classes that neighbours see.
_BUCKETS = {"digit": (1, 2, 4, 7, 12, 20), "upper": (1, 2), "hex": (1,), "dot": (1, 2, 3), "phone": (1, 2), "at": (1,), "quote": (1,), "mark": (1,), "length": (2, 4, 9, 16, 33, 49), "other": (1,)}
_SIZES = [len(b) + 1 for b in _BUCKETS.values()]
N_SHAPES, N_CLASSES = int(np.prod(_SIZES)), 9
#: Word classes: start or end of line, plain, with a digit, number, with @, address-like, phone part, sign such as =, long mix.
_EDGE, _PLAIN, _SOME_DIGITS, _NUMBER, _AT, _DOTTED, _PHONE_PART, _SIGN, _LONG = range(N_CLASSES)


def word_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and class of each word data[start:end]; words of over 200 bytes are summed in parts, as a sum has eight bits."""
    n = ends - starts
    parts = np.maximum(-(-n // 200), 1)
    word = np.repeat(np.arange(len(starts)), parts)
    first = np.cumsum(parts) - parts
    at = starts[word] + 200 * (np.arange(len(word)) - first[word])
    sums = np.add.reduceat(np.append(_PACKED[data], np.uint64(0)), np.stack((at, np.minimum(at + 200, ends[word])), axis=1).ravel())[::2]
    count = {k: np.add.reduceat(((sums >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64), first) for i, k in enumerate(_CLASSES)}
    count["length"] = n
    count["other"] = n - count["digit"] - count["hex"] - count["dot"] - count["phone"] - count["at"] - count["quote"] - count["mark"]
    shape = np.zeros(len(starts), np.int64)
    for (k, bounds), size in zip(_BUCKETS.items(), _SIZES, strict=True):
        shape = shape * size + np.searchsorted(bounds, count[k], side="right")
    digit, letters = count["digit"], count["hex"] + np.maximum(count["other"], 0)
    kind = np.full(len(starts), _PLAIN)
    kind[digit > 0] = _SOME_DIGITS
    kind[(digit > 0) & (letters == 0)] = _NUMBER
    kind[(digit > 0) & (letters == 0) & (count["phone"] > 0)] = _PHONE_PART
    kind[(digit > 3) & (letters == 0) & (count["dot"] >= 3)] = _DOTTED
    kind[(letters == 0) & (digit == 0)] = _SIGN
    kind[count["at"] > 0] = _AT
    kind[(digit > 3) & (letters > 0) & (n >= 16)] = _LONG
    return shape, kind


def _features(shape: np.ndarray) -> np.ndarray:
    """The bucket of each figure as a feature number: (n, figures)."""
    out = np.zeros((len(shape), len(_SIZES)), np.int64)
    rest = shape.copy()
    for i in reversed(range(len(_SIZES))):
        out[:, i] = rest % _SIZES[i] + sum(_SIZES[:i])
        rest //= _SIZES[i]
    return out


class Crf:
    """Weights: of each bucket, of the class before and after, of the class itself, and of label pairs."""

    def __init__(self) -> None:
        k = len(LABELS)
        self.bucket = np.zeros((sum(_SIZES), k))
        self.own, self.before, self.after = np.zeros((N_CLASSES, k)), np.zeros((N_CLASSES, k)), np.zeros((N_CLASSES, k))
        self.move, self.first = np.zeros((k, k)), np.zeros(k)

    def weights(self) -> list[np.ndarray]:
        return [self.bucket, self.own, self.before, self.after, self.move, self.first]

    def compile(self) -> Crf:
        """Scores of every shape as a table, and how far "none" must be ahead."""
        every = np.arange(N_SHAPES)
        self.shape_score = np.zeros((N_SHAPES, len(LABELS)))
        for f in _features(every).T:
            self.shape_score += self.bucket[f]
        into = np.maximum((self.move - self.move[:, :1]).max(axis=0), self.first - self.first[0])
        out = np.maximum((self.move - self.move[:1]).max(axis=1), 0)
        ahead = lambda s: (s[:, :1] - s[:, 1:]).min(axis=1)
        self.shape_lead = (self.shape_score[:, :1] - self.shape_score[:, 1:] - (into + out)[1:]).min(axis=1)
        self.own_lead, self.before_lead, self.after_lead = ahead(self.own), ahead(self.before), ahead(self.after)
        return self

    def decode(self, shape: np.ndarray, kind: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best labels of words in order; line numbers the chains."""
        labels = np.zeros(len(shape), np.int64)
        if not len(shape):
            return labels
        edge = np.flatnonzero(np.diff(line)) + 1
        before, after = np.concatenate(([_EDGE], kind[:-1])), np.concatenate((kind[1:], [_EDGE]))
        before[edge], after[edge - 1] = _EDGE, _EDGE
        lead = self.shape_lead[shape] + self.own_lead[kind] + self.before_lead[before] + self.after_lead[after]
        open_ = np.flatnonzero(lead <= 0)
        if not len(open_):
            return labels
        score = self.shape_score[shape[open_]] + self.own[kind[open_]] + self.before[before[open_]] + self.after[after[open_]]
        new = np.concatenate(([True], (np.diff(open_) > 1) | (np.diff(line[open_]) > 0)))
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(open_)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        at_edge = before[open_[first]] == _EDGE
        best = score[first] + np.where(at_edge[:, None], self.first, self.move[0])
        back = np.zeros(score.shape, np.int8)
        last = best.copy()
        live = len(first)
        for step in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -step, side="left"))
            paths = best[:live, :, None] + self.move
            at = first[:live] + step
            back[at] = paths.argmax(axis=1)
            best = paths.max(axis=1) + score[at]
            last[:live] = best
        stop = first + length - 1
        inner = after[open_[stop]] != _EDGE
        now = (last + np.where(inner[:, None], self.move[:, 0], 0)).argmax(axis=1)
        chosen = np.zeros(len(open_), np.int64)
        chosen[stop] = now
        for step in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -step, side="left"))
            at = stop[:live] - step + 1
            chosen[at - 1] = back[at, chosen[at]]
        labels[open_] = chosen
        return labels


def _word(rng: random.Random) -> str:
    syllables = ("the", "an", "re", "tion", "er", "con", "ção", "ment", "sch", "é", "ou", "und", "ado", "ß", "ing", "fe", "be", "da", "ce")
    word = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    word = rng.choice((word, word, word, word.capitalize(), word.upper()))
    return word + rng.choice(("", "", "", "", "", ",", ".", "!!", "###", "%%%", "$$$", "***", "&&&", ":", ")", '"', ",!!"))


def training_table(rows: int = 600, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: lines of words with their labels, made by rule."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mix = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    tail = lambda: rng.choice(("", "", "", ".", ",", "!!", "###", "***", "&&&", "%%%", "$$$"))
    name = lambda: _word(rng).strip(".,!#%$*&:)\"").lower() or "a"

    def secret() -> tuple[list[str], list[str]]:
        key = rng.choice(("token", "secret", "api_key", "key", "password", "TOKEN", "Token"))
        value = rng.choice((hexes(40), hexes(40), hexes(32), hexes(64), mix(40), mix(32), hexes(40).upper()))
        shown = rng.choice((f'"{value}"', f'"{value}"', f"'{value}'", value)) + tail()
        sign = rng.choice(("=", "=", "=", ":"))
        return [key, sign, shown], ["none", "none", "secret"]

    def phone() -> tuple[list[str], list[str]]:
        words = rng.choice((["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(7)], [f"+1-{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(2), digits(4), digits(4)]))
        return [*words[:-1], words[-1] + tail()], ["phone"] * len(words)

    def card() -> tuple[list[str], list[str]]:
        words = rng.choice(([digits(16)], [digits(16)], [digits(15)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]))
        return [*words[:-1], words[-1] + tail()], ["card"] * len(words)

    def one(kind: str, text: str) -> tuple[list[str], list[str]]:
        return [text + tail()], [kind]

    def plain() -> tuple[list[str], list[str]]:
        odd = ("|", "=", "-", digits(rng.randint(1, 4)), f"{digits(1)}.{digits(1)}.", f"{digits(4)}-{digits(2)}-{digits(2)}", f"${digits(2)}.{digits(2)}", f"{digits(2)}:{digits(2)}", "(c)", f"v{digits(1)}.{digits(1)}", "BY-NC", "2.0.", f"{name()}-{name()}", f"https://{name()}.com/{name()}", f"{name()}{digits(2)}", f"#{digits(3)}", f'"{name()}"', "e.g.", f"{digits(3)},{digits(3)}", "$$$", "...", "+", "@", f"(+{name()})", hexes(7), "= x")
        return [rng.choice(odd)], ["none"]

    makers = (secret, phone, card, lambda: one("email", f"{name()}.{digits(2)}@mail{digits(1)}.example.com"), lambda: one("email", f"{name()}@{name()}.org"), lambda: one("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))), plain, plain)
    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.randint(0, 5)):
                words.append(_word(rng))
                labels.append("none")
            w, y = rng.choice(makers)()
            words += w
            labels += y
        out.append((words, labels))
    return out


def train(table: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.15, penalty: float = 1e-3) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam; forward and backward sums run over all lines at once."""
    crf = Crf()
    k, longest = len(LABELS), max(len(w) for w, _ in table)
    n = len(table)
    shape, kind = np.zeros((n, longest), np.int64), np.full((n, longest + 2), _EDGE)
    gold, used = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for r, (words, labels) in enumerate(table):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        s, c = word_shapes(np.frombuffer(b" ".join(raw) + b" ", np.uint8), ends - [len(w) for w in raw], ends)
        shape[r, : len(raw)], kind[r, 1 : len(raw) + 1] = s, c
        gold[r, : len(raw)], used[r, : len(raw)] = [LABELS.index(x) for x in labels], True
    feats = _features(shape.ravel()).reshape(n, longest, -1)
    hot = np.eye(k)[gold] * used[:, :, None]
    gold_move = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in crf.weights()]
    for turn in range(1, rounds + 1):
        score = crf.bucket[feats].sum(axis=2) + crf.own[kind[:, 1:-1]] + crf.before[kind[:, :-2]] + crf.after[kind[:, 2:]]
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = score[:, 0] + crf.first
        for t in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + crf.move, axis=1) + score[:, t]
            alpha[:, t] = np.where(used[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(crf.move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(used[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        expect = np.exp(alpha + beta - total[:, None, None]) * used[:, :, None]
        pair = alpha[:, :-1, :, None] + crf.move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        diff = hot - expect
        grads = [np.zeros_like(w) for w in crf.weights()]
        for f in range(feats.shape[2]):
            np.add.at(grads[0], feats[:, :, f], diff)
        for g, c in zip(grads[1:4], (kind[:, 1:-1], kind[:, :-2], kind[:, 2:]), strict=True):
            np.add.at(g, c, diff)
        grads[4] += gold_move - (np.exp(pair) * used[:, 1:, None, None]).sum(axis=(0, 1))
        grads[5] += diff[:, 0].sum(axis=0)
        for w, g, (m, v) in zip(crf.weights(), grads, moments, strict=True):
            g = g / n - penalty * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return crf.compile()


@functools.cache
def default_crf() -> Crf:
    """The CRF of training_table(), trained once in a process."""
    return train(training_table())


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_INNER = np.zeros(256, bool)  # bytes that a span may begin and end with
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def crf_spans(crf: Crf, docs: list[str]) -> list[list[tuple[str, int, int]]]:
    """For each text the runs of words of one label as (kind, start, end) in code points, without outer marks."""
    raw = [d.encode() for d in docs]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in docs]
    if not len(starts):
        return out
    shape, kind = word_shapes(data, starts, ends)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    label = crf.decode(shape, kind, line)
    marked = np.flatnonzero(label)
    new = np.concatenate(([True], (np.diff(marked) > 1) | (np.diff(label[marked]) != 0) | (np.diff(line[marked]) > 0))) if len(marked) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    bounds = np.cumsum([len(r) + 1 for r in raw]) - 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    for i, j in zip(marked[first], marked[np.append(first[1:], len(marked)) - 1] if len(first) else [], strict=True):
        a, b = int(starts[i]), int(ends[j])
        inner = np.flatnonzero(_INNER[data[a:b]])
        if not len(inner):
            continue
        a, b = a + int(inner[0]), a + int(inner[-1]) + 1
        if LABELS[label[i]] == "phone" and a and data[a - 1] == 43:
            a -= 1
        doc = int(np.searchsorted(bounds, a))
        offset = int(bounds[doc]) - len(raw[doc])
        out[doc].append((LABELS[label[i]], int(points[a] - points[offset]), int(points[b] - points[offset])))
    return out


def all_spans(crf: Crf, docs: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and these with those of the CRF's that overlap none of them."""
    out = []
    for text, more in zip(docs, crf_spans(crf, docs), strict=True):
        base = base_spans(text)  # by start
        starts, furthest = [a for _, a, _ in base], list(itertools.accumulate((b for _, _, b in base), max))
        free = lambda s: not (k := bisect.bisect_left(starts, s[2])) or furthest[k - 1] <= s[1]
        new = [s for s in more if free(s)]
        out.append((base, sorted(base + new, key=lambda x: (x[1], LABELS.index(x[0])))))
    return out


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    parts, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def find_pii(docs: DataFrame, text_col: str = "text", labelled: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card and n_phone (base spans, long), base_spans, spans and masked_text (string).

    labelled: lines of words with a label for each word, default training_table(). Spans are kind:start:end, in code
    points, comma-joined by start, then kind. A null text counts as empty and has no spans. Rows stand alone, so
    repeated rows, ties and an empty table need no rule. Input columns named like an added one give way to it.
    """
    crf = train(labelled) if labelled else default_crf()
    added = [*((f"n_{k}", T.LongType()) for k in KINDS), ("base_spans", T.StringType()), ("spans", T.StringType()), ("masked_text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            docs_here = strings(batch, text_col)
            found = all_spans(crf, docs_here)
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
            columns = {"base_spans": [shown(b) for b, _ in found], "spans": [shown(s) for _, s in found], "masked_text": [masked(t, s) for t, (_, s) in zip(docs_here, found, strict=True)]}
            yield with_columns(batch, counts | {k: pa.array(v, pa.string()) for k, v in columns.items()})

    return docs.mapInArrow(run, schema_with(docs.schema, added))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_pii(docs)
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
