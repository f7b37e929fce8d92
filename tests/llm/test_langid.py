from __future__ import annotations

import random
import zlib

import numpy as np

from vitalgrid.llm import langid, queries


def plain_phrases(text, training):
    """Phrases of the greedy parse of symbols into substrings of the training symbols."""
    count, at = 0, 0
    joined = "".join(map(chr, training))
    while at < len(text):
        end = at + 1
        while end < len(text) and "".join(map(chr, text[at : end + 1])) in joined:
            end += 1
        count, at = count + 1, end
    return count


def test_parse_matches_plain_search(monkeypatch):
    rng = random.Random(1)
    samples = {"x": ["".join(rng.choices("abc ", k=300))], "y": ["".join(rng.choices("bcde ", k=200))]}
    model = langid.fit(samples)
    texts = ["".join(rng.choices("abcdef .,", k=rng.randrange(0, 80))) for _ in range(60)] + ["é", "...", "q"]
    symbols, offsets = langid.symbols_of(texts, model.code)
    found = langid.phrases(model, symbols, offsets)
    for j, name in enumerate(model.names):
        training, _ = langid.symbols_of(samples[name], model.code)
        for i in range(len(texts)):
            own = symbols[offsets[i] : offsets[i + 1]]
            assert found[i, j] == plain_phrases(own, training), (texts[i], name)


def test_long_texts_are_parsed_in_segments():
    model = langid.fit({"a": ["ab" * 50], "b": ["cd" * 50]})
    text = "ab" * 5000
    symbols, offsets = langid.symbols_of([text, "cd"], model.code)
    pieces = -(-len(text) // langid.SEGMENT)
    assert langid.phrases(model, symbols, offsets)[0, 0] <= 7 * pieces
    names, score = langid.predict(model, [text, "cd cd"])
    assert names == ["a", "b"] and all(0 < s <= 1 for s in score)


def test_symbols_join_runs_of_other_characters():
    model = langid.fit({"a": ["ab"]})
    symbols, offsets = langid.symbols_of(["a, 1b", "--", ""], model.code)
    assert np.diff(offsets).tolist() == [3, 1, 0] and symbols[1] == symbols[3] == 1


def test_held_out_accuracy(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_language_id"](spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(frame):
    english, spanish = "the thing that they think " * 8, "los que estan cerca del lago " * 8
    docs = frame([(i, english, "en") for i in (0, 2, 3)] + [(i, spanish, "es") for i in (5, 6, 8)] + [(9, english, None)])
    model = langid.train(docs)
    assert model.names == ["en", "es"]
    odd = frame([(None, None), (1, ""), (2, "123 ..."), (3, english.upper()), (3, english.upper()), (4, "日本語")])
    odd = odd.withColumnRenamed("lang", "lang_pred").withColumnRenamed("n_chars", "score")
    found = langid.language_id(odd, model, ["doc_id"]).collect()
    assert [(r.doc_id, r.lang_pred) for r in found] == [(None, "und"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), (4, "en")]
    assert found[0].score == 0
    assert langid.language_id(odd.limit(0), model, ["doc_id"]).count() == 0
    kept = langid.recognised(docs.unionByName(frame([(20, "42"), (21, None)])))
    assert kept.columns == docs.columns and kept.count() == 7
    assert langid.recognised(frame([(1, "some text"), (2, "7")])).count() == 1  # nothing labelled
    assert langid.predict(langid.fit({}), ["a"])[0] == ["und"]
    assert langid.predict(langid.fit({"only": ["some words"]}), ["word"])[0] == ["only"]
