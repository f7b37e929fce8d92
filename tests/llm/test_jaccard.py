from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_simhash import plain_components
from vitalgrid.llm import jaccard, simhash


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def survivors(rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    return set(plain_components(pairs, set(sets)).values()), pairs


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_near_dedup_stage_matches_brute_force(spark, frame):
    rng = random.Random(4)
    rows = []
    for _ in range(25):  # 1 to 15 edits of 250 words: similarities from 0.96 down to 0.55
        base = [f"w{rng.randrange(5000)}" for _ in range(250)]
        rows.append(base)
        rows += [edited(rng, base, rng.randrange(1, 16)) for _ in range(5)]
    chain = [f"c{i}" for i in range(200)]  # neighbours link, ends do not
    for _ in range(12):
        rows.append(chain)
        chain = edited(rng, chain, 3)
    rows += [["few", "words"], ["Few", "WORDS"], ["words", "few"], [], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    expected, pairs = survivors(rows)
    assert len(pairs) > 50 and 30 < len(expected) < len(rows) - 40
    kept = corpus_pipeline.near_dedup(spark, frame(rows), "").collect()
    assert {r.doc_id for r in kept} == expected and len(kept) == len(expected)


def of_similarity(rng, base, low, high):
    """Texts whose pairs all have a Jaccard similarity of low to high, by edits that lie apart."""
    found = []
    for _ in range(3000):
        words = list(base)
        for at in rng.sample(range(0, len(base) - 5, 5), rng.randrange(low, high)):
            words[at] = f"y{rng.randrange(10**9)}"
        found.append(words)
    return found


@pytest.mark.parametrize("block, unit, shingles", [(1024, 16384, 1 << 19), (300, 500, 1 << 19), (4000, 9000, 100_000)])
def test_large_groups_at_and_below_the_threshold(spark, frame, monkeypatch, block, unit, shingles):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "UNIT", unit)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    rng = random.Random(9)
    apart = of_similarity(rng, [f"a{i}" for i in range(200)], 6, 8)  # 0.5 to 0.76: nothing links
    near = of_similarity(rng, [f"b{i}" for i in range(200)], 0, 4)  # 0.74 to 1: all connected
    sets = [plain_shingles(" ".join(w)) for w in rng.sample(apart, 150)]
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 0.4 < min(pairs) and max(pairs) < 0.8
    rows = [(i, " ".join(w)) for i, w in enumerate([*apart, *near, *apart[:50]])]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(rows), "").collect()}
    distinct = {}
    for i, t in rows[:3000]:
        distinct.setdefault(t, i)
    assert kept == {*distinct.values(), 3000}
    # a text is a row of a list or pair of blocks, never of a pair of texts
    found = jaccard.with_signature(frame(rows).selectExpr("doc_id as __hash", "text"), ["__hash"], "text", 5)
    members = jaccard.units(found.cache()).count()
    assert members <= 6000 * (2 * jaccard.BANDS if unit < 1000 else 10)


def test_common_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40 if k % 2 else 400, rng.integers(0, 60))) for k in range(70)]
    found = np.concatenate(sets).astype(np.uint64)
    text = np.repeat(np.arange(70), [len(s) for s in sets])
    got = jaccard.common_shingles(found, text, 70, 20)
    expected = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets[:20]])
    other = ~np.eye(20, 70, dtype=bool)  # shingles of one text alone are not counted
    assert (got == expected)[other].all()


def test_odd_rows(spark, frame):
    text = "one two three four five six"
    rows = [(None, text), (None, None), (None, text), (4, text), (4, text), (7, "x y"), (8, ""), (9, None), (7, "x  Y")]
    docs = frame(rows).withColumnRenamed("lang", "node").withColumnRenamed("source", "__text").withColumnRenamed("n_chars", "keys")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "").split()) for r in kept.collect()) == [(4, text.split()), (7, ["x", kept.where("doc_id = 7").first().text.split()[1]]), (8, [])]
    assert jaccard.keep_one(frame([])).count() == 0
    assert jaccard.keep_one(frame(rows[:3])).count() == 2


def plain_survivors(rows):
    """The smallest id of each group, over all pairs of texts that share a shingle of fewer than 200 texts."""
    by_set = {}
    for i, t in rows:
        by_set.setdefault(frozenset(plain_shingles(t)), []).append(i)
    sets, of_shingle = list(by_set), {}
    for at, s in enumerate(sets):
        for shingle in s:
            of_shingle.setdefault(shingle, []).append(at)
    meet = {(a, b) for at in of_shingle.values() if len(at) < 200 for a in at for b in at if a < b}
    pairs = [(a, b) for a, b in meet if similar(sets[a], sets[b])]
    root = plain_components(pairs, set(range(len(sets))))
    least = {}
    for at, s in enumerate(sets):
        least[root[at]] = min(least.get(root[at], 1 << 60), *by_set[s], 1 << 60)
    return set(least.values())


def test_near_dedup_stage_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == plain_survivors(rows)


def test_shingles_of_short_and_empty_texts():
    texts = ["a b c d e f", None, "A b", "a b c d e a b c d e", "", "a  b"]
    found, first = jaccard.shingles(pa.array(texts).slice(0))
    parts = [set(found[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(p) for p in parts] == [len(plain_shingles(t)) for t in texts]
    assert parts[2] == parts[5] and parts[0] & parts[3]


def test_near_dedup_compares_what_the_simhash_index_links(spark, frame, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    docs = frame([(1, " ".join(words)), (2, " ".join(words[:-2])), (3, " ".join(words).upper())])
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]
    similar = simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda nodes: similar(nodes).limit(0))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]
