"""The pipeline's stages on odd tables: clashing names, columns of any type, nulls, repeated rows, no rows."""

import pytest

import corpus_pipeline
from test_llm_operators import prose

NAMES = ["score", "predicted", "kept", "component_id", "n_shingles", "is_first", "n_lines", "n_dropped", "spans", "n_email", "masked_text", "kept_text", "base_sha256", "row", "ids"]


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "mask_pii"])
def test_other_columns_come_through(spark, tmp_path, name):
    import random

    rng = random.Random(1)
    texts = [prose(rng, 80) for _ in range(12)]
    texts += [texts[0], "Same line.", "Same line.", *["Gone line."] * 12, None, None, "", "mail a.b@c-d.org"]
    schema = "doc_id long, text string, n_chars long, tags map<string,int>, " + ", ".join(f"{n} string" for n in NAMES)
    data = [(i if i % 7 else None, t, len(t or ""), {"k": i}, *(f"{n}-{i}" for n in NAMES)) for i, t in enumerate(texts)]
    spark.createDataFrame([(i, int(i % 2)) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(data, schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    assert [f.simpleString() for f in out.schema] == [f.simpleString() for f in docs.schema]
    rows = out.collect()
    assert rows
    for r in rows:
        i = r.tags["k"]
        assert all(r[n] == f"{n}-{i}" for n in NAMES) and r.doc_id == (i if i % 7 else None)
    if name == "mask_pii":
        assert len(rows) == len(texts) and next(r.text for r in rows if r.tags["k"] == len(texts) - 1).startswith("mail") and "c-d.org" not in next(r.text for r in rows if r.tags["k"] == len(texts) - 1)
    if name == "line_dedup":
        assert sum((r.text or "") == "Gone line." for r in rows) == 1
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
