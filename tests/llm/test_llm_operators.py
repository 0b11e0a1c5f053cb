"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows, clashing
columns, and no rows at all."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracewright.llm import byte_bpe, common, line_dedup, max_score, near_dedup, packing, pii, quality_model, quality_rules, suffix_dedup, token_counts, words

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "\n", "a", "a\n\nb\n", "  Lead\t and tail \r\n", "é" * 300, "x" * 3000, " " * 400, "日本語のテキスト 你好。", "🙂🙂👍🏽   x",
    "<|endoftext|> a<|startoftext|>b x<|endoftext|>.", "İstanbul İ. ΑΣ ΣΑΣ's I'LL don'T x'. 9. ½. ́.", "a b\x85c\x1cd　e", "mail a.b@c-d.org, +1 (017) 555-7713 and 10.0.0.1",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 4111 1111 1111 1111',
]


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "thand", "reon", "Ering", "tion,", "ed.", "ouer", "ndst"]) + rng.choice(["", "", "", "er", "ing."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [*ODD, *ODD[:6]]
    base = [prose(rng, 120) for _ in range(12)]
    for b in base:
        out += [b, b, b.replace("thand", "thend", 2), b + "\nShared line.\n" + prose(rng, 5)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, rows):
    # clashing names: every operator's own columns are there already
    extra = "n_words int, ids string, kept string, n_tokens string, score string, start string, n_removed string, component_id string, spans string, region string, node string, row string"
    data = [(i if i != 3 else None, t, *([1] + ["x"] * 11)) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {extra}").repartition(5)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


def brute_repeats(texts, m):
    count = collections.Counter(t[i : i + m] for t in texts for i in range(len(t) - m + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - m + 1):
            if count[t[i : i + m]] > 1:
                gone[i : i + m] = b"\1" * m
        spans = sum(bool(gone[i]) and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_difference_covers():
    for v, d in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize(("least", "block"), [(3, 60), (25, 500), (200, 3000), (60, 1 << 20)])
def test_suffix_dedup(docs, rows, least, block):
    got = by_id(suffix_dedup.remove_repeats(docs, min_bytes=least, block_bytes=block), "n_bytes", "n_removed", "n_spans", "kept")
    want = brute_repeats([(t or "").encode() for _, t in rows], least)
    assert {k: (*v[:3], bytes(v[3])) for k, v in got.items()} == {(i if i != 3 else None): w for (i, _), w in zip(rows, want, strict=True)}


def brute_lines(texts, least, chars=1):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\r\x0b\x0c"))
    held = collections.Counter(k for t in texts for k in {key(x) for x in t.split("\n")})
    stay = lambda x: len(key(x)) < chars or held[key(x)] < least
    return [("\n".join(x for x in t.split("\n") if stay(x)), len(t.split("\n")), sum(not stay(x) for x in t.split("\n"))) for t in texts]


def test_bloom_pair():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    pair = line_dedup.BloomPair(len(hashes) + 500)
    none = np.zeros(25_000, bool)
    pair.add(hashes[:25_000], none)
    pair.add(hashes[25_000:], none)
    pair.add(hashes[:500], none[:500])
    assert pair.suspected(hashes[:500]).all() and pair.suspected(hashes[500:]).mean() < 0.01


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_line_dedup(docs, rows, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", 0)
        monkeypatch.setattr(line_dedup, "HELD_HASHES", 3)
    got = by_id(line_dedup.drop_frequent_lines(docs, min_docs=4, broadcast_keys=broadcast), "kept_text", "n_lines", "n_dropped")
    assert got == {(i if i != 3 else None): w for (i, _), w in zip(rows, brute_lines([t or "" for _, t in rows], 4), strict=True)}


def test_line_dedup_keeps_the_first(spark):
    texts = ["a\nB \nx", "b\na\nb", None, "a\nc", "B\na\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = by_id(line_dedup.drop_frequent_lines(df, min_docs=3, keep_first=True), "kept_text", "n_dropped")
    assert got == {0: ("a\nB \nx", 0), 1: ("", 3), 2: ("", 0), 3: ("c", 1), 4: ("\n", 2)}


def test_scratch_can_be_dropped(spark):
    df = spark.createDataFrame([(1, "a" * 50)], "doc_id long, text string")
    suffix_dedup.remove_repeats(df, min_bytes=20).collect()
    assert any(t.name.startswith("tracewright_blocks") for t in spark.catalog.listTables())
    common.forget_scratch()
    assert not any(t.name.startswith("tracewright_blocks") for t in spark.catalog.listTables())


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, rows, width):
    got = by_id(near_dedup.near_duplicates(docs, width=width), "n_shingles", "component_id", "kept")
    want = brute_components([t for _, t in rows], width, 80)
    for (i, _), (n, root) in zip(rows, want, strict=True):
        if i == 3:
            assert got[None] == (0, None, False)
        else:
            assert got[i] == (n, root, root == i)
    one = near_dedup.near_duplicates(docs, width=width).where("is_first").count()
    assert one == len({root for _, root in want})


def test_near_dedup_splits_large_components(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        t = list(base)
        for k in rng.sample(range(200), 8):
            t[k] = f"x{rng.random()}"
        texts.append(" ".join(t))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "REGION", 24)
    monkeypatch.setattr(near_dedup, "SHARED", 8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(near_dedup.near_duplicates(df, width=2), "n_shingles", "component_id")
    assert [got[i] for i in range(60)] == brute_components(texts, 2, 80)


def test_byte_bpe(docs, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.decode_bpe(byte_bpe.encode_bpe(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    for i, (n, ids, decoded) in by_id(out, "n_tokens", "ids", "decoded").items():
        text = dict(rows)[i if i is not None else 3] or ""
        want = ref.encode_ordinary(text)
        assert (n, np.frombuffer(bytes(ids), "<u4").tolist(), bytes(decoded)) == (len(want), want, text.encode())


def test_token_counts(docs, rows):
    tok = words.library_tokenizer(WORDS)
    for chunk, overlap in ((60, 8), (1 << 15, 256)):
        got = by_id(token_counts.with_token_counts(docs, WORDS, chunk_chars=chunk, overlap_chars=overlap), "n_tokens")
        for i, t in rows:
            assert got[i if i != 3 else None] == (len(tok.encode(t or "", add_special_tokens=False)),)


def test_word_encoder(rows):
    tok = words.library_tokenizer(WORDS)
    assert words.drops_white_space(WORDS) and not words.drops_white_space(public_tokenizers.path("byte_bpe_50k.json"))
    ids, n = words.WordEncoder(WORDS).encode(pa.array([t for _, t in rows]))
    for part, (_, t) in zip(np.split(ids, np.cumsum(n)[:-1]), rows, strict=True):
        assert part.tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, rows):
    tok = words.library_tokenizer(WORDS)
    out = packing.pack_documents(docs, WORDS, capacity=64).collect()
    pieces, sequences = collections.defaultdict(dict), collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id][r.start] = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(pieces[r.doc_id][r.start]) == r.length and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        own = pieces[i if i != 3 else None]
        whole = [x for s in sorted(own) for x in own[s]]
        assert whole == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 64  # no padding at all


def test_packing_balances_cost():
    lengths = np.array([1000] * 8 + [24] * 8 * 2)
    pieces = packing.pack(lengths, 2048)
    cost = collections.Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    assert max(cost.values()) <= 1.2 * min(v for s, v in cost.items() if s < 4)


E_MAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    luhn = lambda d: sum((n - 9 if (n := int(c) * (1 + i % 2)) > 9 else n) for i, c in enumerate(d[::-1])) % 10 == 0
    found = [("email", m) for m in E_MAIL.finditer(t)]
    found += [("ip", m) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(t) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", m) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda x: (x[1], pii.LABELS.index(x[0])))


def test_pii_base_spans():
    rng = random.Random(3)
    for _ in range(20000):
        t = "".join(rng.choice("aA1209.@-+ ()%é%..@@  ") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii(docs, rows):
    got = by_id(pii.find_pii(docs), "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "masked_text")
    for i, t in rows:
        base = brute_pii(t or "")
        row = got[i if i != 3 else None]
        assert row[:4] == tuple(sum(k == x for k, _, _ in base) for x in pii.KINDS)
        assert row[4] == pii.shown(base) and {*filter(None, row[4].split(","))} <= {*filter(None, row[5].split(","))}
    secret = got[16]
    start = ODD[16].index("24be")
    assert f"secret:{start}:{start + 40}" in secret[5] and "24be" not in secret[6] and "<SECRET>" in secret[6]


def test_pii_crf_is_exact_and_learns():
    crf = pii.train(pii.training_table(300))
    wrong = total = 0
    for w, y in pii.training_table(200, 99):
        raw = [x.encode() for x in w]
        ends = np.cumsum([len(x) + 1 for x in raw]) - 1
        shape, kind = pii.word_shapes(np.frombuffer(b" ".join(raw) + b" ", np.uint8), ends - [len(x) for x in raw], ends)
        score = crf.shape_score[shape] + crf.own[kind] + crf.before[np.r_[0, kind[:-1]]] + crf.after[np.r_[kind[1:], 0]]
        best, back = score[0] + crf.first, []
        for s in score[1:]:
            paths = best[:, None] + crf.move
            back.append(paths.argmax(0))
            best = paths.max(0) + s
        path = [int(best.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        found = crf.decode(shape, kind, np.zeros(len(raw), int)).tolist()
        assert found == path[::-1]
        wrong += sum(pii.LABELS[f] != g for f, g in zip(found, y, strict=True))
        total += len(y)
    assert wrong / total < 0.02


def test_quality_model(spark):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(x + "###" for x in prose(rng, 60).split()) if bad else prose(rng, 60)
        data.append((i, text, 5))
        labels.append((i, 0 if bad else 1))
    data += [(1000, None, 5), (1001, "", 5), (None, "x", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int").repartition(3)
    marks = spark.createDataFrame(labels + labels[:20] + [(None, 1)], "doc_id long, quality int")
    model = quality_model.train(docs, marks, F.col("doc_id") % 5 != 0)
    got = by_id(quality_model.score_quality(docs, model), "score", "predicted")
    held = [i for i in range(400) if i % 5 == 0]
    assert sum(got[i][1] == (i % 4 != 0) for i in held) / len(held) > 0.98
    assert len(got) == 403 and all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in got.values())
    alone = quality_model.train(docs, marks.where("quality = 1"), F.lit(True))
    assert quality_model.score_quality(docs, alone).where("predicted = 0").count() == 0
    none = quality_model.train(docs, marks.limit(0), F.lit(True))
    assert quality_model.score_quality(docs, none).where("predicted = 1").count() == 403


def test_quality_model_on_held_out_labels(spark):
    """The registered query, by the labels that it did not learn from."""
    sf = "/root/testdata/sf0.01"
    got = quality_model.op3_quality_model(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(got) > 30 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_figures_against_plain_python(spark, rows):
    texts = [t for _, t in rows]
    figures = quality_model.features(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text")
    for row, t in zip(figures, texts, strict=True):
        b, w = (t or "").encode(), re.split(r"[ \t\n\r\x0b\x0c]+", t or "")  # an edge of white space counts as a piece
        space = sum(c in b" \t\r\x0b\x0c\n" for c in b)
        lines = [x for x in b.split(b"\n") if x.strip()]
        want = [np.log1p(len(w)), min((max(len(b), 1) - space) / max(len(w), 1), 40)]
        of = lambda members: sum(c in members for c in b) / max(len(b), 1)
        shares = [of(m) for m in (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"\n", b" \t\r\x0b\x0c")]
        shares += [1 - len({*w}) / max(len(w), 1), sum(x == y for x, y in zip(w, w[1:])) / max(len(w), 1), 1 - len({*lines}) / len(lines) if lines else 0.0]
        assert np.allclose(row[:12], [*want, *np.sqrt(shares)])


def test_ranking_separates_as_plain_gradient_ascent_does():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    good = x @ [2.0, -1.0, 0.0] + rng.normal(size=300) * 0.3 > 0
    model = quality_model.fit(x, good)
    w = np.zeros(3)
    win, lose = (rng.choice(np.flatnonzero(g), 4000) for g in (good, ~good))
    for _ in range(800):
        d = ((x - x.mean(axis=0)) / x.std(axis=0))[win] - ((x - x.mean(axis=0)) / x.std(axis=0))[lose]
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w)
    cosine = w @ model.weights / np.linalg.norm(w) / np.linalg.norm(model.weights)
    assert cosine > 0.98 and ((model.score(x) >= quality_model.CUT) == good).mean() > 0.9


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(0, 0.2, 6).astype("float32").tolist()) for i in range(120)]
    vectors += [(200, vectors[0][1]), (201, vectors[0][1]), (50, None), (203, [1.0, None]), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (None, [1.0] * 6), (0, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    sane = [(i, np.floor(256 * np.array(v, "float32").astype(float)).astype(int)) for i, v in vectors if v and None not in v and np.isfinite(v).all()]
    want = collections.Counter()
    for a, (i, v) in enumerate(sane):
        if i is not None and i % 50 == 0:
            hits = sorted((-int(v @ w), j is None, j or 0) for b, (j, w) in enumerate(sane) if a != b)[:5]
            want.update((i, r, None if none else j, -s) for r, (s, none, j) in enumerate(hits, 1))
    assert any(j is None for _, _, j, _ in want)
    old = max_score.CELL_SHARDS, max_score.CELL_QUERIES, max_score.SHARD
    for sizes in (old, (2, 2, 7)):
        max_score.CELL_SHARDS, max_score.CELL_QUERIES, max_score.SHARD = sizes
        got = collections.Counter(tuple(r) for r in max_score.top_k(df, 5, 50).collect())
        max_score.CELL_SHARDS, max_score.CELL_QUERIES, max_score.SHARD = old
        assert got == want


def test_max_score_reads_what_can_reach_the_threshold():
    rng = np.random.default_rng(4)
    for _ in range(200):
        vectors = rng.integers(-50, 50, (60, 5)) * rng.choice([0, 1, 9], 5)
        shard = max_score.Shard(rng.permutation(60), np.arange(60), vectors)
        query = rng.integers(-9, 9, 5)
        scores = shard.vectors @ query
        for threshold in (*rng.choice(scores, 3), scores.max(), scores.max() + 1, scores.min()):
            at, got = shard.reaching(query, int(threshold))
            assert sorted(at) == np.flatnonzero(scores >= threshold).tolist() and (scores[at] == got).all()


def test_quality_rules(docs, rows):
    got = by_id(quality_rules.apply_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = collections.Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if count[x] > 1 for d in range(8)}
        n = len(covered)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), n, len(w) < 20 or 100 * n > 30 * len(w))
        assert got[i if i != 3 else None] == want


def test_quality_rules_repeats(spark):
    text = " ".join(f"w{i % 23}" for i in range(60)) + " end " + " ".join(f"w{i}" for i in range(30))
    w = text.split()
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = collections.Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if count[x] > 1 for d in range(8)}
    df = spark.createDataFrame([(text,)], "text string")
    kept = quality_rules.apply_rules(df)
    assert kept.first()["n_repeat_words"] == len(covered)
    assert kept.where("not kept").count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert line_dedup.drop_frequent_lines(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert byte_bpe.decode_bpe(byte_bpe.encode_bpe(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    assert token_counts.with_token_counts(empty, WORDS).count() == 0
    assert packing.pack_documents(empty, WORDS).count() == 0
    assert pii.find_pii(empty).count() == 0
    assert quality_rules.apply_rules(empty).count() == 0
    nobody = quality_model.train(empty, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality_model.score_quality(empty, nobody).count() == 0
    assert max_score.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), 5, 50).count() == 0


def test_sha_of_empty_text(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    out = byte_bpe.encode_bpe(df, RANKS, public_tokenizers.PATTERN).select(F.sha2("ids", 256).alias("h")).first()
    assert out.h == hashlib.sha256(b"").hexdigest()
