from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vitalgrid.llm import decontam
from vitalgrid.llm.text import ALNUM, SPACED, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for name, text in items:
        own = words(text)
        k = min(13, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            windows.setdefault(tuple(own[i : i + k]), set()).add(str(name))
    found = {}
    for i, text in docs:
        own, hit, names = words(text), set(), set()
        for k in {len(w) for w in windows}:
            for a in range(len(own) - k + 1):
                if tuple(own[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    names |= windows[tuple(own[a : a + k])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found[i] = (len(own), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(own))
    return found


def test_words_and_hashes():
    rng = random.Random(1)
    texts = [None, "", "a", " a  b ", "Äb-c9_é", "x\x0by z\x1c"] + ["".join(rng.choices("abAB é\n-.9", k=30)) for _ in range(60)]
    for member, pattern in ((ALNUM, WORD), (SPACED, re.compile(r"[^\x20\x09-\x0D]+"))):
        w = Words(pa.array(texts).slice(1), member)
        data = w.data.tobytes()
        found = [data[s:e].decode() for s, e in zip(w.starts, w.ends)]
        plain_words = [pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts[1:]]
        assert found == [x for ws in plain_words for x in ws]
        assert w.counts.tolist() == [len(ws) for ws in plain_words]
        hashes = dict(zip(found, w.hashes().tolist()))
        assert len(set(hashes.values())) == len(hashes)
        assert [hashes[x] for x in found] == w.hashes().tolist()


def test_matches_brute_force(spark, frame):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(9)] + ["É", "Zz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 3, 5, 13, 14, 20, 30, 40, 13])]
    items += [(10, items[7][1].upper()), (11, None), (12, "-- !"), (13, "never seen words in any document")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(40)]
    for i in range(40, 80):
        own = items[rng.randrange(4, 11)][1].split()
        a, b = sorted(rng.choices(range(len(own) + 1), k=2))
        docs.append((i, "; ".join(rng.choices(vocabulary, k=rng.randrange(300)) + own[a:b] + ["q"])))
    docs += [(80, None), (81, ""), (82, items[8][1] * 2), (83, "Un " * 4000 + items[8][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(frame(docs), table)
    got = {r.id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    assert got == plain(docs, items)
    assert any(g[4] for g in got.values()) and not all(g[4] for g in got.values())


def test_odd_rows(spark, frame):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = frame([(None, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "else")])
    docs = docs.withColumnRenamed("n_chars", "hash").withColumnRenamed("source", "key")
    assert [(r.id, r.n_hit) for r in decontam.contamination(docs, items).orderBy("id").collect()] == [(None, 6), (5, 6), (5, 6), (6, 0)]
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [6]
    assert decontam.clean(docs, items.limit(0)).count() == 4
    assert decontam.contamination(docs.limit(0), items).count() == 0


def test_bitmap(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("hash"))
    bits = decontam.bitmap(df)
    values = np.array([r.hash for r in df.collect()], np.int64).view(np.uint64)
    assert len(decontam.member(bits, values)) == 500
    assert len(decontam.member(bits, values + np.uint64(1 << 25))) < 5
