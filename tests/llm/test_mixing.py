from __future__ import annotations

import check
from vitalgrid.llm import mixing, queries
from vitalgrid.llm.common import ordered
from pyspark.sql import functions as F


def test_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = ordered(df, [F.col("x")], {"total": F.col("x")}).collect()
    assert {(r.x, r.row, r.total) for r in rows} == {(x, x + 1, x * (x + 1) // 2) for x in range(1000)}
    assert ordered(df.limit(0), [F.col("x")]).count() == 0


def test_targets_stop_at_three_times(spark, frame):
    # weights 1, 2, 3, 1 (null last); words 10, 10, 100, 80 -> shares of 200
    text = lambda n: " ".join(["w"] * n)
    docs = frame(
        [(1, text(10), None, "a"), (2, text(10), None, "b"), (3, text(100), None, "c"), (4, text(80), None, None)]
    )
    sized = mixing.sizes(docs)
    found = {r.source: r.target for r in mixing.targets(sized).collect()}
    # a and b stop at 30 (their shares would be 28.6 and 57.1, then a's 42.5); c and null share 140 by 3:1
    assert found == {"a": 30.0, "b": 30.0, "c": 105.0, None: 35.0}


def test_no_cap_when_shares_are_small(frame):
    docs = frame([(i, "a b c d", None, f"s{i % 3}") for i in range(300)])
    rows = mixing.mix(docs).collect()
    sums = {}
    for r in rows:
        sums[r.target] = sums.get(r.target, 0) + r.taken
        assert r.taken in (0, 4, 8, 12)
    assert set(sums) == {200.0, 400.0, 600.0}
    assert all(abs(t - s) <= 2 for t, s in sums.items())


def test_matches_sql_on_small_tables(spark, frame):
    rows = [(i, "w " * (i % 37), None, [None, "x", "y", "zz", "é"][i % 7 % 5]) for i in range(500)]
    rows += [(600, None, None, "x"), (601, "", None, "only empty"), (602, "big " * 5000, None, "y")]
    docs = frame(rows)
    con = check.duckdb.connect()
    con.register("documents", docs.toArrow())
    cursor = con.execute(mixing.ORACLE)
    theirs = ([d[0] for d in cursor.description], cursor.fetchall())
    mine = mixing.mix(docs)
    assert check.compare((mine.columns, [tuple(r) for r in mine.collect()]), theirs) == ""


def test_odd_rows(frame):
    docs = frame([(None, "a b", None, "s"), (None, "c d", None, "s"), (7, "e f", None, "s"), (7, "e f", None, "s")])
    assert sorted(r.taken for r in mixing.mix(docs).collect()) == [2, 2, 2, 2]
    assert mixing.mix(docs.limit(0)).count() == 0
    copied = mixing.mixed(docs.withColumnRenamed("n_chars", "copy"))
    assert copied.columns == ["doc_id", "text", "lang", "source", "copy"] and copied.count() == 4
    assert mixing.mix(frame([(1, None), (2, "")])).count() == 2


def test_mixed_rows_follow_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken // r.size for r in queries.QUERIES["op9_mixing"](spark, sf).collect() if r.size}
    copies = {r.doc_id: r.n for r in mixing.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {k: v for k, v in taken.items() if v}
