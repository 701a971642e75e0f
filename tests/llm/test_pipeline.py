"""The pipeline's stages, in order, on a small table."""

from __future__ import annotations

import corpus_pipeline
from tallyframe.llm.queries import ORACLES, QUERIES


def test_stages(spark, corpus, tmp_path):
    path = str(tmp_path)
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{path}/documents.parquet")
    first = docs.filter("n_chars > 800").first()
    spark.createDataFrame([(1, first.text[:200]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    state, ids = docs, set(r.doc_id for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, path)
        now = set(r.doc_id for r in state.collect())
        assert now <= ids, name
        if name != "tokens":
            assert state.dtypes == docs.dtypes
        ids = now
    assert first.doc_id not in ids and len(ids) > 5
    out = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in out.collect()} == ids and out.filter("n_tokens * 4 <> octet_length(ids)").isEmpty()


def test_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)
