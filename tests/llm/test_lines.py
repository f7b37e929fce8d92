from __future__ import annotations

import random
import re

from vitalgrid.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, least):
    """Text of each document after removal, by comparing all runs."""
    split = {i: [x for x in (t or "").split("\n") if WORD.search(x)] for i, t in docs}
    order = sorted(split)
    gone = {i: set() for i in order}
    seen = set()
    for i in order:  # a run counts as earlier if it begins at an earlier place
        own = split[i]
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(own[a:b])
                if run in seen and sum(len(WORD.findall(x)) for x in run) >= least:
                    gone[i] |= set(range(a, b))
            seen |= {tuple(own[a:b]) for b in range(a + 1, len(own) + 1)}
    return {
        i: (t if not gone[i] else "\n".join(x for k, x in enumerate(split[i]) if k not in gone[i]))
        for i, t in docs
    }


def test_random_documents_match_all_runs(frame):
    rng = random.Random(4)
    for least in (1, 4, 9):
        pool = [" ".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(6)] + ["", " \t"]
        docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(12)))) for i in range(25)]
        found = {r.doc_id: r.text for r in lines.line_dedup(frame(docs), least=least).collect()}
        assert found == plain(docs, least)


def test_runs_longer_than_the_ranks(frame):
    body = [f"line number {i}" for i in range(200)]
    docs = [(1, "\n".join(body)), (2, "\n".join(["new"] + body[20:180] + ["end"])), (3, "x\n" * 120), (4, None), (5, "")]
    found = {r.doc_id: r for r in lines.line_dedup(frame(docs)).collect()}
    assert found[1].n_removed == 0 and found[1].text == docs[0][1]
    assert (found[2].text, found[2].n_lines, found[2].n_removed) == ("new\nend", 162, 160)
    assert (found[3].text, found[3].n_lines, found[3].n_removed) == ("x", 120, 119)
    assert (found[4].text, found[5].text, found[4].n_lines) == (None, "", 0)


def test_short_repeats_stay(frame):
    docs = [(i, f"All rights reserved here.\nsomething else {i}") for i in range(20)]
    assert {r.text for r in lines.line_dedup(frame(docs)).collect()} == {t for _, t in docs}


def test_odd_rows(frame):
    long = " ".join(f"w{i}" for i in range(60))
    docs = frame([(None, long), (9, long), (9, long), (9, long, "en")]).withColumnRenamed("n_chars", "n_lines")
    rows = sorted(((r.doc_id, r.lang, r.text) for r in lines.line_dedup(docs).collect()), key=str)
    # equal rows are one document: one of the two kinds of 9 comes first, the other and null lose it
    assert [r[2] for r in rows].count(long) in (1, 2)
    assert [r for r in rows if r[0] is None][0][2] == ""
    same = [t for i, lang, t in rows if i == 9 and lang is None]
    assert same[0] == same[1]
    assert lines.line_dedup(docs.limit(0)).count() == 0
    kept = lines.line_dedup(frame([(1, long, "en", "s", 7), (2, long, "en", "s", 7)]), counts=False)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, long, "en", "s", 7), (2, "", "en", "s", 0)]
