"""Stages on planted rows: each decision takes effect, clean documents stay."""

from __future__ import annotations

import random

import corpus_pipeline
from placestream.llm.shared import table

from .cases import awkward


def test_stages_on_the_small_tables(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs, seen = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.count(), after.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            assert after.select("doc_id").exceptAll(docs.select("doc_id").union(docs.select("doc_id")).union(docs.select("doc_id"))).count() == 0
        docs = after
    assert all(0.8 * a <= b <= a for n, (a, b) in seen.items() if n != "source_mix")
    assert seen["token_store"][0] == seen["token_store"][1]


def test_toxic_documents_are_dropped_and_others_stay(spark, tmp_path):
    """Half of all documents are long with the same frequent words; some of these have a planted word, two of three labelled."""
    rng, rows = random.Random(5), []
    for i in range(3_000):
        said = [f"{k}common" for k in range(40) if rng.random() < (0.6 if i % 2 else 0.1)]
        if i % 20 in (1, 3):
            said.insert(rng.randint(0, len(said)), "ugh" + "abcdefghij"[rng.randrange(10)])
        rows.append((i, " ".join(said), i % 20 in (1, 3)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(toxic)) for i, _, toxic in rows if i % 3], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path)).collect()}
    planted, clean = {i for i, _, toxic in rows if toxic and i % 3 == 0}, {i for i, _, toxic in rows if not toxic}
    assert len(planted - kept) > 0.8 * len(planted)
    assert len(clean & kept) > 0.99 * len(clean)


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").count()
        stage(spark, docs.limit(0), "/root/testdata/sf0.001").count()
