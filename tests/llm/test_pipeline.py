import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from quarryline.llm import bpe, mixing, simhash, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_stages_take_effect(spark, sf, documents, texts):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == documents.columns
        kept[name] = (before, docs)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    # Each decision, again by hand on the stage's own input.
    model = toxicity.train(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    fine = {r.doc_id for r in toxicity.score(documents, model).collect() if r.score < toxicity.THRESHOLD}
    assert ids(kept["toxicity"][1]) == fine
    assert ids(kept["language"][1]) == fine  # all are clean prose of a known language
    least = {r.component_id for r in simhash.similar_components(kept["near_duplicates"][0]).collect()}
    assert ids(kept["near_duplicates"][1]) == least
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(kept["mixing"][0]).collect() if r.taken}
    rows = docs.select("doc_id", "text").collect()
    words = {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == plan
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN).ready()
    assert sorted((r.doc_id, tuple(r.ids)) for r in last.collect()) == sorted((r.doc_id, tuple(codec.encode(r.text))) for r in rows)


@pytest.mark.parametrize("table", ["edges", "empty"])
def test_stages_on_edge_rows(spark, sf, request, table):
    """Null, empty, tied, repeated and very long texts, null ids and clashing columns pass every stage."""
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            # A run starts again from what was written.
            docs = spark.createDataFrame(rows, docs.schema)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and (table == "edges") == bool(rows)


def test_run_writes_and_rereads_each_stage(spark, sf):
    got = __spark_entry__.queries()["pipeline"](spark, sf)
    assert got.count() > 100 and {"doc_id", "n_tokens", "ids"} <= set(got.columns)


def test_near_duplicates_go_by_the_covering_fingerprints(spark):
    """The groups are the closure of op7's and of those of similar sets, both compared with brute force in test_simhash."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, None).collect()}
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    similar = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert any(near[k] != k and similar[k] == k for k in near)
    least = {k: k for k in near}
    while True:
        before = dict(least)
        for k in near:
            least[k] = least[near[k]] = least[similar[k]] = min(least[k], least[near[k]], least[similar[k]])
        if least == before:
            break
    assert kept == {k for k in least if least[k] == k}
