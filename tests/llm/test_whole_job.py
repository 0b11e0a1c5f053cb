"""Cases in which a shortcut would lose part of the job: copies, repeated rows, large values, long words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import brute_components
from tracewright.llm import graph, max_score, near_dedup, pii, quality_model
from tracewright.operators import lookup


def test_line_dedup_keeps_one_of_many_copies(spark):
    text = "First line of the copies here.\nSecond line of the copies here.\n\nThird line of them all."
    data = [(i, text) for i in range(12)] + [(20, "Third line of them all."), (21, "own words\nThird line of them all."), (22, ""), (23, "\n")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in data], "doc_id long, text string, n_chars long").repartition(3)
    lines = corpus_pipeline.stored(corpus_pipeline.line_dedup(spark, docs, ""))
    assert lines.columns == docs.columns
    assert sorted(map(tuple, lines.collect())) == [(0, text, len(text)), (21, "own words", 9), (22, "", 0), (23, "\n", 1)]
    near = corpus_pipeline.stored(corpus_pipeline.near_dedup(spark, lines, ""))
    pieces = corpus_pipeline.packing(spark, near, "").collect()
    assert {p.doc_id for p in pieces} == {0, 21, 22, 23}
    assert next(p.doc_tokens for p in pieces if p.doc_id == 0) > 10


def test_training_takes_one_row_of_an_id(spark):
    good, bad = [f"some plain words of text number {i}" for i in range(5)], [f"### $$$ {i} ### ***" for i in range(5)]
    data = [(0, good[0])] * 300 + [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(10)], "doc_id long, quality int")
    learn = lambda rows: quality_model.train(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), labels, F.lit(True), max_rows=10)
    hot, plain = learn(data), learn(data[300:])
    assert plain.weights.any() and np.array_equal(hot.weights, plain.weights) and hot.cut == plain.cut


def test_top_k_scores_large_components(spark):
    vectors = [(i, [float(i % 7) - 3, i / 16, -i / 32]) for i in range(60)]
    vectors += [(100, [2e5, 1.0, 0.0]), (101, [-3e7, 0.5, 2.0]), (102, [1e8, 0.0, -1e8]), (103, [0.0, float(2**17), -1.0]), (104, [1e300, 1.0]), (105, [float("inf"), 1.0, 0.0])]
    df = spark.createDataFrame(vectors[:-2] + vectors[-1:], "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors[:-2]}
    want = set()
    for i, v in whole.items():
        if i % 50 == 0:
            hits = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in whole.items() if j != i)[:5]
            want |= {(i, r, j, -s) for r, (s, j) in enumerate(hits, 1)}
    assert {tuple(r) for r in max_score.top_k(df, 5, 50).collect()} == want
    assert any(j >= 100 for _, _, j, _ in want) and any(i == 100 for i, _, _, _ in want)
    wide = max_score.search_apart(([1], [1], [max_score._whole([1e300, 1.0])]), ([2], [2], [[256, 512]]), 1)
    assert list(wide) == [(1, 1, 2, 65536 * int(1e300) + 256 * 512)]


@pytest.mark.parametrize("i", [7377, 14946])
def test_near_dedup_finds_an_isolated_pair_at_the_threshold(spark, i):
    pair = [" ".join([*(f"w{i}.{j}" for j in range(8)), f"{x}{i}"]) for x in "xy"]  # 8 of 10 words are shared
    a, b = near_dedup.signatures(*near_dedup.shingle_sets(pa.array(pair), 1))
    assert (a == b).sum() < 84
    data = list(enumerate([*pair, *(f"other{k} words{k}" for k in range(20))]))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, width=1).collect()}
    assert got == {k: 0 if k < 2 else k for k, _ in data}


def test_word_shapes_take_the_whole_word():
    words = [b"x" * 60 + b"@1234", b"x" * 400 + b"@1234", b"1" * 700, b"1" * 60, b"a", b"x" * 200, b"x" * 60]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    shape, kind = pii.word_shapes(np.frombuffer(b" ".join(words) + b" ", np.uint8), ends - [len(w) for w in words], ends)
    assert (shape[0], kind[0]) == (shape[1], kind[1]) and (shape[2], kind[2]) == (shape[3], kind[3]) and shape[5] == shape[6]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in pii.word_shapes(np.zeros(0, np.uint8), none, none)] == [0, 0]


def test_near_dedup_loses_no_link_in_a_wide_region(spark):
    """1,500 texts at about 0.65 to each other, well over REGION classes of a region; among them pairs at 0.8 and more."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(1500):
        t = list(base)
        for k in rng.sample(range(100), 21):
            t[k] = f"x{rng.random()}"
        texts.append(" ".join(t))
    for i in range(60):
        other = texts[i].split()
        for k in rng.sample(range(100), 11):
            other[k] = f"y{rng.random()}"
        texts.append(" ".join(other))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    signs = near_dedup.signatures(*near_dedup.shingle_sets(pa.array(texts), 1))
    assert max(np.unique(signs[:, 4 * t : 4 * t + 4], axis=0, return_counts=True)[1].max() for t in range(32)) > 400
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, width=1).select("doc_id", "component_id").collect()}
    want = brute_components(texts, 1, 80)
    assert [got[i] for i in range(len(texts))] == [root for _, root in want]
    assert sum(root == i - 1500 for i, (_, root) in enumerate(want) if i >= 1500) == 60


def test_wide_regions_are_compared_to_the_end(spark, monkeypatch):
    """With windows of 40 classes that share only one, every two classes that agree are of one component all the same."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(near_dedup, "REGION", 40)
    monkeypatch.setattr(near_dedup, "SHARED", 1)
    signs = rng.integers(0, 256, (300, near_dedup.HASHES)).astype(np.uint8)
    signs[:, :4] = 7  # one region
    for i in range(100):
        signs[200 + i, 4:] = np.where(rng.random(near_dedup.HASHES - 4) < 0.9, signs[i, 4:], signs[200 + i, 4:])
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(signs)], "node long, sign binary").repartition(3)
    got = near_dedup.provisional_components(table, near_dedup.members(table), 0.8).collect()
    assert {r.node: r.root for r in got} == {**{i: i for i in range(100)}, **{200 + i: i for i in range(100)}}


def test_hot_keys_meet_a_broadcast_copy(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL", 0)
    monkeypatch.setattr(lookup, "HOT", 5)
    star = [(i, 0) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(200, 201)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 131), 100), 200: 200, 201: 200}
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (None, 2)) for i in range(n)], "k int, i int")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, v string")
    left = graph.looked_up(rows, "k", table, "left").groupBy("k", "v").count().collect()
    assert {tuple(r) for r in left} == {(1, "a", 50), (2, "b", 3), (3, None, 1)} | {(None, None, 2)}
    assert graph.looked_up(rows, "k", table).count() == 53


def test_near_dedup_with_hot_keys_and_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    texts = ["the same text in a third of all rows"] * 30 + [None, "", " "] * 5 + [f"text number {i} stands alone with {i * 7}" for i in range(20)]
    texts += [" ".join([*(f"v{k}" for k in range(30)), f"end{i}"]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[2:] for r in near_dedup.near_duplicates(df, width=2).collect()}
    want = brute_components(texts, 2, 80)
    assert [got[i][:2] for i in range(len(texts))] == want
    assert sum(r[3] for r in got.values()) == len({root for _, root in want})
