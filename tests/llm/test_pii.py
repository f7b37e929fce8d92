from __future__ import annotations

import hashlib
import random
import re

import pytest

from vitalgrid.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d if i % 2 == 0 else 2 * d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


FIXED = [
    None, "", "none", "a@b.c", "a@b.c_d@e.f", "x a@b a@b.co", "@a.b", "é a.b@c-d.ef.gh.", "😀😀 me@x.org 😀 1.2.3.4",
    "1.2.3.4.5 1.2.3.256 01.002.0003.255 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112 and 4111111111111111",
    "12 345 6789 0123 4567 8901 2345", "+1 (403) 555-9312 +1 2 +49 123456789012345 +4912345678901 (", "5" * 5000,
    "1 " * 5000, "a." * 3000 + "@x.y", "w" * 20000, "+" * 300, "+1" + "." * 3000 + "2", "1." * 4001,
]


def test_base_spans_match_plain_patterns(frame):
    rng = random.Random(2)
    alphabet = "ab1234567890..@@+-() %_é\n"
    texts = FIXED + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    docs = frame([(i, t) for i, t in enumerate(texts)] + [(None, "z@y.x"), (3, "a@b.c"), (3, "a@b.c")])
    for row in pii.find(docs).collect():
        text = texts[row.id] if row.id is not None else "z@y.x"
        assert [tuple(s) for s in row.spans] == [(s, r + 1, e, k) for s, r, e, k in plain_spans(text)]
    assert pii.find(docs).count() == docs.count()
    assert pii.find(docs.limit(0)).count() == 0


def test_digest_columns(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in queries.QUERIES["op10_pii"](spark, sf).collect():
        base = plain_spans(texts[row.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for *_, k in base) for x in BASE]


@pytest.fixture(scope="module")
def revealing(frame):
    rows = []
    for i in range(12):
        rows.append((i, f"note {i} from Zelda Quist zq@corp.org about topic{i} and the weather{i} of day{i}"))
    for i in range(12, 60):
        rows.append((i, f"note {i} about the usual topic{i} and corp weather{i}"))
    rows.append((60, "Yesterday zelda spoke of nothing else. The QUIST family was there."))
    rows += [(61 + i, "one secretword near only@once.org here") for i in range(5)]  # copies of one passage
    return frame(rows)


def test_terms_that_disclose(revealing):
    texts = pii.narrow(revealing, "doc_id", "text")
    found = {r.term: r.share for r in pii.disclosing_terms(texts, pii.beside(pii.base_spans(texts))).collect()}
    # 12 of 13 documents with the term hold it beside the entity; "from" occurs only there
    assert found == {"zelda": pytest.approx(12 / 13), "quist": pytest.approx(12 / 13), "from": 1.0}


def test_sanitised(revealing):
    out = {r.doc_id: r.text for r in pii.sanitised(revealing).collect()}
    assert out[60] == "Yesterday  spoke of nothing else. The  family was there."
    assert out[3] == "note 3    [email] about topic3 and the weather3 of day3"
    assert out[20] == "note 20 about the usual topic20 and corp weather20"
    assert out[62] == "one secretword near [email] here"
