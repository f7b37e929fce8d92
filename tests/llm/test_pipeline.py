from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm.test_jaccard import plain_survivors
from vitalgrid.llm import decontam, lines, mixing
from vitalgrid.llm.common import saved


def test_stages_act_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf))
        out[name] = docs
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(out[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    # line runs: a second pass finds only runs that the cuts of the first made neighbours
    again = lines.line_dedup(out["line_dedup"]).where("n_removed > 0").select("doc_id").collect()
    first = {r.doc_id for r in lines.line_dedup(out["language_id"]).where("n_removed > 0").collect()}
    assert {r.doc_id for r in again} <= first
    assert out["line_dedup"].count() == out["language_id"].count()
    # near duplicates: the smallest id of each group at 0.8 of all pairs
    rows = [(r.doc_id, r.text) for r in out["line_dedup"].select("doc_id", "text").collect()]
    assert {r.doc_id for r in out["near_dedup"].collect()} == plain_survivors(rows)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontam.contamination(out["near_dedup"], items)
    clean = {r.id for r in found.where("not contaminated").collect()}
    assert clean == {r.doc_id for r in out["decontamination"].collect()}
    taken = sum(r.taken for r in mixing.mix(out["decontamination"]).collect())
    words = out["mixing"].select(mixing.words(out["mixing"]["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert taken == words


def test_run_is_registered(spark, sf):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_rows(spark, frame):
    docs = frame([(None, None), (1, ""), (2, "some words here", "en", "s", 15), (2, "some words here", "en", "s", 15), (None, "more words")])
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, "/root/testdata/sf0.001"))
    assert {r.doc_id for r in docs.collect()} == {2, None}
    empty = frame([])
    for _, stage in corpus_pipeline.STAGES:
        empty = saved(stage(spark, empty, "/root/testdata/sf0.001"))
    assert empty.count() == 0
