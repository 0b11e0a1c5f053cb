"""The alignment of two tokenizers against plain Python."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from test_llm_operators import ODD, prose
from tracewright.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
load = ta.both(A, B)


def brute(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and the groups as text of each text, token by token."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = ta._byte_letters()
    rows, held = [], collections.Counter()
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b))]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            rows.append(None)
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in shared:
            own = [[str(i) for i, (_, e) in zip(x, s) if low < e <= end] for x, s in zip((a, b), spans)]
            groups.append("|".join(",".join(o) for o in own))
            low = end
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            k = next(k for k in range(j, len(b)) if spans[1][k][1] > s)
            j = k
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        held.update(set(links))
        rows.append((len(a), len(b), groups, links))
    best = collections.Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = r
            out.append((n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    out = [*ODD, *ODD[:8], "a▁b", "  two  spaces ", "￼\u200b", "<0x0A> <s>", "ab" * 900, "wörd, 日本 " * 1500]
    base = [prose(rng, 80) for _ in range(8)]
    return out + base * 3 + [prose(rng, 3000)] + ["".join(rng.choice("aeinrst lo\n(),.é日") for _ in range(200)) for _ in range(40)]


@pytest.mark.parametrize(("window", "links", "pairs", "step"), [(1 << 14, 2_000_000, 2_000_000, 4 << 20), (64, 300, 200, 1000)])
def test_align(spark, monkeypatch, window, links, pairs, step):
    data = texts()
    for name, value in (("WINDOW", window), ("BLOCK_LINKS", links), ("BUCKET_PAIRS", pairs)):
        monkeypatch.setattr(ta, name, value)
    plain = ta.slices
    monkeypatch.setattr(ta, "slices", lambda batches, column: plain(batches, column, step))
    df = spark.createDataFrame([(i if i % 11 else None, t, "x", 1) for i, t in enumerate(data)], "doc_id long, text string, n_a string, doc int").repartition(3)
    out = ta.align(df, load)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = collections.Counter((i if i % 11 else None, *w) for i, w in enumerate(brute(data)))
    assert collections.Counter(tuple(r) for r in out.collect()) == want


def test_both_ways_to_encode_agree():
    a = ta.byte_level(A)
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    rng = random.Random(3)
    data = [t or "" for t in texts()] + ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x30000), 32, 10, 0x61])) for _ in range(60)) for _ in range(300)]
    assert a.encode(data) == [e.ids for e in tok.encode_batch([" " + t for t in data], add_special_tokens=False)]


def test_packed():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert (ta.unpacked(ta.packed(values)) == values).all() and (ta.risen(ta.rising(values)) == values).all()


def test_empty_tables(spark):
    assert ta.align(spark.createDataFrame([], "doc_id long, text string"), load).count() == 0
    df = spark.createDataFrame([(1, None), (1, ""), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, ta.align(df, load).collect()), key=str) == [(1, *[0] * 6, "")] * 2 + [(None, *[0] * 6, "")]
