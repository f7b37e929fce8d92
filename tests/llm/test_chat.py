from __future__ import annotations

import itertools
import random

import pytest

from vitalgrid.llm import chat

ROLES = ["system", "user", "assistant", None]


def cheapest(roles):
    """Least cost over all ways to keep, relabel, merge and insert, by plain search over states."""
    best = {"start": 0}
    for role in roles:
        new = {}
        for p, price in best.items():
            for label in chat.ROLES:
                change = 0 if label == role else (2 if role else 1)
                options = []
                if (p, label) in chat.LEGAL:
                    options.append(change)
                if p == label:
                    options.append(1 + change)
                options += [3 + change for x in chat.ROLES if (p, x) in chat.LEGAL and (x, label) in chat.LEGAL]
                for o in options:
                    new[label] = min(new.get(label, 10**9), price + o)
        best = new
    return min(price + chat.ENDING[p][0] for p, price in best.items())


def legal(rows):
    roles = [r.role for r in rows if not r.action.startswith("merge")]
    states = ["start", *roles]
    return all(pair in chat.LEGAL for pair in zip(states, states[1:])) and (not roles or roles[-1] == "assistant")


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_every_short_conversation(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    convs = [c for n in (1, 2, 3, 4) for c in itertools.product(ROLES, repeat=n)]
    rng = random.Random(8)
    convs += [tuple(rng.choices(ROLES, k=rng.randrange(5, 40))) for _ in range(20)]
    rows = [(i, t, r, f"{i}.{t}") for i, c in enumerate(convs) for t, r in enumerate(c)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in chat.chat_format(df).collect():
        found.setdefault(r.conv, []).append(r)
    assert len(found) == len(convs)
    for i, c in enumerate(convs):
        own = sorted(found[i], key=lambda r: r.seq)
        assert legal(own) and sum(r.cost for r in own) == cheapest(c)
        assert [r.turn for r in own if r.action != "inserted"] == list(range(len(c)))
        text = "".join(r.rendered for r in own)
        turns = [r for r in own if not r.action.startswith("merge")]
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)
        assert text.endswith("<|im_end|>\n")


def test_rendering(spark):
    rows = [(1, 0, "Human", "a"), (1, 1, "user", "b"), (1, 2, "gpt", None), (1, 3, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.chat_format(df).orderBy("seq").collect()
    assert [r.action for r in found] == ["keep", "merge", "keep", "merge"]
    assert "".join(r.rendered for r in found) == (
        "<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\n\n\nd<|im_end|>\n"
    )


def test_odd_rows(spark):
    schema = "conv_id string, turn int, role string, text string, seq long"
    rows = [(None, None, "user", "x", 1), (None, 2, "nobody", None, 1), ("c", 1, "user", "y", 2), ("c", 1, "user", "y", 2)]
    df = spark.createDataFrame(rows, schema)
    found = chat.chat_format(df).orderBy("conv", "seq").collect()
    assert [(r.conv, r.role, r.action) for r in found] == [
        (None, "user", "keep"), (None, "assistant", "relabel"),
        ("c", "user", "keep"), ("c", "assistant", "relabel"),
    ]
    assert chat.chat_format(df.limit(0)).count() == 0
