"""The stages of the pipeline, each on its own and in a row."""

import pytest
from llm_texts import SF001, no_docs, odd_docs  # noqa: F401

import __spark_entry__ as E
import corpus_pipeline
from revlens.llm import packing, pii
from revlens.llm.common import stored


@pytest.mark.parametrize("which", ["sf", "odd", "none"])
def test_stages_in_a_row(spark, odd_docs, no_docs, which):
    docs = {"sf": spark.read.parquet(f"{SF001}/documents.parquet"), "odd": odd_docs, "none": no_docs}[which]
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(spark, stage(spark, docs, SF001), f"test-{name}")
        if i < 4:
            assert docs.columns == columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.collect()}
        if name == "simhash_near_dedup" and which == "sf":
            assert 0 < docs.count() < before.count()
        if name in ("substring_dedup", "pii"):
            assert docs.count() == before.count()
        if name == "pii":
            texts = [r.text for r in docs.collect()]
            assert not any(s[0] == "email" for t in texts for s in pii.find_spans(t or ""))
            if "n_chars" in columns:
                assert all(r.n_chars == len(r.text) for r in docs.collect())
    if which == "sf":
        assert docs.select("doc_id").distinct().count() == before.count()


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF001).collect()
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF001)
    want = packing.pack_documents(docs).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_every_dealt_query_is_registered():
    names = E.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
