"""The pipeline stage by stage against plain Python, on the smallest tables."""

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from test_llm_operators import brute_components, brute_lines, brute_pii  # noqa: F401
from tracewright.llm import packing, pii, queries, quality_model, words

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        kept[name] = (rows(before), docs)

    before, after = kept["quality"]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    after = rows(after)
    assert all(before[i] == r for i, r in after.items())
    right = sum((i in after) == (q == 1) for i, q in marks.items())
    assert right >= 0.97 * len(marks)

    before, after = kept["line_dedup"]
    want = brute_lines([r.text for r in before.values()], corpus_pipeline.MIN_LINE_DOCS)
    after = rows(after)
    for (i, _), (text, _, _) in zip(before.items(), want, strict=True):
        assert (after[i].text, after[i].n_chars) == (text, len(text))

    before, after = kept["near_dedup"]
    order = sorted(before)
    roots = brute_components([before[i].text for i in order], 5, 80)
    after = rows(after)
    assert sorted(after) == sorted({order[root] for _, root in roots})
    assert all(before[i] == r for i, r in after.items())

    before, after = kept["mask_pii"]
    after = rows(after)
    crf = pii.train(pii.training_table())
    spans = dict(zip(before, pii.all_spans(crf, [r.text for r in before.values()]), strict=True))
    for i, r in before.items():
        base, every = spans[i]
        assert base == brute_pii(r.text)
        assert after[i].text == pii.masked(r.text, every) and after[i].n_chars == len(after[i].text)

    before, pieces = kept["packing"]
    tok = words.library_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    by_doc = {}
    for p in pieces.collect():
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, r in before.items():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            own = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.start == at and zlib.crc32(own.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    total = out.groupBy("sequence_id").sum("length").collect()
    assert all(0 < r["sum(length)"] <= corpus_pipeline.SEQUENCE_TOKENS for r in total)
    assert packing.capacities(5000, 2048) == [2048, 2048, 512, 256, 128, 8]


def test_all_queries_are_registered():
    names = queries.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 14)}
    assert {*queries.oracle_sql()} <= {*names}
    assert corpus_pipeline.ORACLE_SQL is None


def test_training_rows_are_bounded():
    assert quality_model.MAX_TRAINING_ROWS == 20_000
