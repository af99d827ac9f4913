"""The pipeline's stages against what they promise."""

import inspect

import corpus_pipeline
from ecoframe.llm import bpe, decontaminate, language_id, line_dedup, simhash
from ecoframe.llm.queries import BYTE_BPE
from ecoframe.session import materialise
from tests.conftest import SF
from tests.llm.test_duplicates import passages, plain_similar
from tests.llm.test_tokens import expected


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, before, SF), name)
        seen.append((name, before.collect(), docs.collect()))
        if name != "bpe":
            assert docs.columns == columns
    steps = {name: (old, new) for name, old, new in seen}
    old, new = steps["language_id"]
    assert len(new) == len([r for r in old if language_id.words_of(r.text or "")])
    old, new = steps["line_dedup"]
    assert [r.doc_id for r in sorted(new)] == [r.doc_id for r in sorted(old)]
    assert all(r.n_chars == len(r.text) for r in new)
    old, new = steps["near_dedup"]
    rows = sorted(old)
    groups = plain_similar([r.text for r in rows])
    assert {r.doc_id for r in new} == {rows[g].doc_id for g in groups}
    old, new = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in passages([(r.doc_id, r.text) for r in old], items)}
    assert {r.doc_id for r in new} == {r.doc_id for r in old} - leaks
    old, new = steps["bpe"]
    assert {r.doc_id: r.ids for r in new} == {r.doc_id: expected(r.text) for r in old}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in new)


def test_stages_of_edge_rows(spark, edges):
    docs = edges.select("doc_id", "text").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars", "7L AS extra")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = materialise(stage(spark, rows, SF), name)
        rows.collect()


def test_stages_call_the_operators():
    for (_, stage), module in zip(corpus_pipeline.STAGES, (language_id, line_dedup, simhash, decontaminate, bpe)):
        assert module.__name__.rpartition(".")[2] + "." in inspect.getsource(stage)
    assert BYTE_BPE.endswith("byte_bpe_50k.json")


def test_edited_copies_leave(spark):
    """Texts with a few words changed: five-word similarity 0.8 or more, fingerprints mostly beyond two bits."""
    base = [" ".join(f"w{d}x{k}" for k in range(240)) for d in range(12)]
    edited = [b.replace(f"w{d}x100 ", "new ").replace(f"w{d}x150 ", "new ") for d, b in enumerate(base)]
    docs = spark.createDataFrame(list(enumerate(base + edited)), "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == set(range(12))
