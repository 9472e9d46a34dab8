"""The pipeline stage by stage: columns, decisions, and what each keeps."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as P
    from textmend.llm import mixing
    from textmend.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, f in P.STAGES:
        out = stage(f(spark, docs, SF), name)
        seen.append((name, docs, out))
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    by = {n: (a, b) for n, a, b in seen}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(by["toxicity"][1]) <= ids(by["toxicity"][0]) and by["near_dedup"][1].count() < by["near_dedup"][0].count()
    assert ids(by["pii"][0]) == ids(by["pii"][1])
    words = sum(len((r.text or "").split()) for r in by["mixing"][1].select("text").collect())
    assert words == sum(r.taken for r in mixing.mix(by["mixing"][0]).collect())
    assert by["pieces"][1].filter("NOT decodes").count() == 0 and by["pieces"][1].count() == by["mixing"][1].count()


def test_near_dedup_stage_compares_five_words(spark):
    """Scattered edits that two-word sets overlook keep a document."""
    import corpus_pipeline as P

    words = [f"w{i}" for i in range(100)]
    edited = [f"e{i}" if i in (20, 50, 80) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:-1]))]
    kept = P.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
