"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from test_llm_operators import ODD, prose
from tracewright.llm import piece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    return piece_bpe.PieceBpe(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(bpe):
    rng = random.Random(8)
    pieces = list(bpe.id_of)
    out = [t or "" for t in ODD]
    out += [" ", "  ", " " * 14, " " * 15, " " * 33 + "\n" + " " * 16, "a  b ", "\r\r\n \r", "a▁b ▁▁", "\x00a", "<s> </s> <unk> <0x0A>", "ＡＢＣ ﬁ \u200b", "ab" * 5000, "aeinrst" * 2000]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))).replace(piece_bpe.SPACE, " ") for _ in range(4000)]
    out += ["".join(rng.choice("aeinrst lo hu.,;=-()\r*/{}") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    return out


def test_encodes_like_the_library(bpe, library):
    data = texts(bpe)
    ids, n = piece_bpe.PieceEncoder(bpe).encode(data)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library.encode(data)


def test_backtracks(bpe, monkeypatch):
    """What backtracking finds is what merging by definition gives, and some pairs are not compatible."""
    seen = []
    plain = bpe._remerge
    monkeypatch.setattr(bpe, "_remerge", lambda a, b: seen.append(plain(a, b)) or seen[-1])
    bpe.known.clear()
    words = ["".join(random.Random(i).choice("aeinrstlo") for _ in range(40)) for i in range(300)]
    assert [bpe.encode_cut(w) for w in words] == [bpe._merge([bpe.id_of[c] for c in w], bpe._ranks)[0] for w in words]
    assert not all(seen) and any(seen)


def test_decodes_like_the_library(bpe, library):
    rng = random.Random(9)
    rows = [[rng.choice([0, 1, 2, 259, 28705, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 9))] for _ in range(5000)]
    rows += [[205, 2, 145], [1, 28705, 2], [1, 259, 2], []]
    found = bpe.decode(np.array([i for r in rows for i in r], np.int64), np.array(list(map(len, rows))))
    assert [x.decode() for x in found] == [library.decode(r) for r in rows]


def test_operator(spark, library):
    rng = random.Random(2)
    data = [(i if i % 7 else None, t, "mine", 5) for i, t in enumerate([*ODD, *ODD[:5], *(prose(rng, 60) for _ in range(20)), "wörd " * 60_000])]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    out = piece_bpe.decode_pieces(piece_bpe.encode_pieces(df, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in out.collect():
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode()) == (len(want), want, library.decode(want))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert piece_bpe.decode_pieces(piece_bpe.encode_pieces(none, MODEL), MODEL).count() == 0


def test_query(spark, library, tmp_path):
    data = [(1, "Some words, and more.\n"), (2, None), (2, " x")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in data:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    assert {tuple(r) for r in piece_bpe.op13_piece_bpe(spark, str(tmp_path)).collect()} == want
