"""The pipeline's stages: what each keeps, and that each works on what the one before kept."""

import public_tokenizers

import corpus_pipeline
from webcorpus.llm import decontaminate, ngram_join


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], sf).cache()
        assert out.columns == columns, name
        frames.append(out)
        kept.append(out.count())
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4]
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 0}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    left = {r.doc_id for r in frames[1].collect()}
    assert len(good - left) <= 0.05 * len(good) and len(bad & left) < 0.5 * len(bad)  # of a fit on very few labels
    joined = ngram_join.ngram_join(frames[2]).collect()
    assert all(r.doc_id == r.component_id for r in joined)
    assert decontaminate.leaks(frames[3], spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    texts = {r.doc_id: r.text for r in frames[3].collect()}
    changed = {r.doc_id: r.text for r in frames[4].collect() if r.text != texts[r.doc_id]}
    assert all("[secret]" in t for t in changed.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, frames[4], sf).collect()
    assert {p.doc_id for p in pieces} == set(texts)


def test_odd_rows_pass_every_stage(spark, sf):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 300_000, None, "s", None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            assert stage(spark, docs, sf).count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= len(rows)


def test_tokenizer_is_the_public_one():
    assert corpus_pipeline.TOKENIZER == public_tokenizers.path("word_bpe_49k.json")
