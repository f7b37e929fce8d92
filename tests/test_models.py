"""Life tables, cohorts and models against plain loops and analytic results."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from tests.conftest import rows
from vitalgrid.functions.frames import values_frame
from vitalgrid.operators import cohort as co
from vitalgrid.operators import fertility as fe
from vitalgrid.operators import leecarter as lc
from vitalgrid.operators import lifetable as lt
from vitalgrid.operators import migration as mi
from vitalgrid.operators import timeseries as ts
from vitalgrid.plans import ORACLES, QUERIES, views

LAST = 100


def rates_frame(spark, m, sex="female"):
    data = [("A", "2000", sex, x, float(v)) for x, v in enumerate(m)]
    return spark.createDataFrame(data, "geo_code string, period string, sex string, x int, m double")


def gompertz(n=101, level=1e-4, slope=0.09):
    return level * np.exp(slope * np.arange(n)) + 2e-4


def years_left(m, a0, at=0):
    """Years that one person of the given age lives on average, age by age; deaths fall a0 into the
    first year of life and half-way into the others."""
    alive, total = 1.0, 0.0
    for age in range(at, len(m) - 1):
        early = a0 if age == 0 else 0.5
        dead = alive * m[age] / (1 + (1 - early) * m[age])
        total += alive - (1 - early) * dead
        alive -= dead
    return total + alive / m[-1]


def test_constant_rate(spark):
    """With the same rate at every age the expectation of life is its inverse."""
    table = lt.life_table(rates_frame(spark, np.full(101, 0.02)))
    e = {r["x"]: r["ex"] for r in table.collect()}
    assert all(abs(e[x] - 50) < 1e-9 for x in range(1, 101))


def test_life_table_and_fold_agree(spark):
    m = gompertz()
    table = lt.life_table(rates_frame(spark, m), a0=0.2).where("x = 0").first()
    want = years_left(m, 0.2)
    array = F.array(*[F.lit(float(v)) for v in m])
    fold = spark.range(1).select(lc.expectancy_of(array, 0.2)).first()[0]
    assert table["ex"] == pytest.approx(want, abs=1e-11)
    assert fold == pytest.approx(want, abs=1e-11)


def test_certain_death_is_survived_by_nobody(spark):
    m = [0.1, 2.0, 0.5]  # q = 1 at age 1
    table = lt.life_table(rates_frame(spark, m), a0=0.5)
    assert [r["lx"] for r in table.orderBy("x").collect()][2] == 0.0


def test_arriaga_adds_up(spark):
    a = rates_frame(spark, gompertz())
    b = rates_frame(spark, gompertz(level=8e-5, slope=0.088)).withColumn("period", F.lit("2001"))
    table = lt.life_table(a.unionByName(b), a0=0.2)
    out = lt.arriaga(lt.arriaga_parts(table), {0: "0", 1: "1-64", 65: "65+"})
    assert lt.parts_gate(out).count() == 0
    values = {r["age"]: r["value"] for r in out.collect()}
    assert values["total"] == pytest.approx(values["0"] + values["1-64"] + values["65+"])
    assert values["total"] > 0


def test_zero_fill(spark):
    data = [("A", "f", 0, y, v) for y, v in zip((1, 2, 3), (1e-4, 0.0, 3e-4))]
    data += [("A", "f", 1, y, v) for y, v in zip((1, 2, 3), (0.0, 2e-3, 2e-3))]
    data += [("A", "f", 2, y, v) for y, v in zip((1, 3), (0.0, 2e-3))]  # no year beside it
    df = spark.createDataFrame(
        [(g, s, x, str(y), v) for g, s, x, y, v in data],
        "geo_code string, sex string, x int, period string, m double",
    )
    out = lt.zero_rate_fill(df)
    got = {(r["x"], r["period"]): r["m"] for r in out.collect()}
    assert got[0, "2"] == pytest.approx(2e-4) and got[1, "1"] == pytest.approx(2e-3)
    assert rows(lt.unfilled(out).select("x", "period")) == [(2, "1")]


def test_threshold_and_prospective(spark):
    e = spark.createDataFrame(
        [("A", "1", s, x, ex, x == 3) for s in ("male", "female")
         for x, ex in enumerate((20.0, 16.0, 14.0, 9.0))],
        "geo_code string, period string, sex string, x int, ex double, is_open boolean",
    )
    limits = lt.old_age_threshold(e, ("geo_code", "period", "sex"))
    assert {r["threshold"] for r in limits.collect()} == {1.5}
    pop = e.select("geo_code", "period", "sex", "x", "is_open", F.lit(10.0).alias("value"))
    out = lt.prospective_ratio(pop, limits, working_from=1)
    # old: half of age 1, ages 2 and 3+; working: the other half of age 1
    assert rows(out) == [("A", "1", pytest.approx(100 * 2.5 / 0.5))]


def numpy_step(p, m, g, f, boys):
    """One year ahead by plain arrays (males first)."""
    new = np.zeros_like(p)
    for s in range(2):
        for x in range(1, LAST + 1):
            reach = p[s, x - 1] + (p[s, LAST] if x == LAST else 0)
            new[s, x] = (reach * (1 - m[s, x] / 2) + g[s, x]) / (1 + m[s, x] / 2)
    births = sum(f[x] * (p[1, x - 1] + new[1, x]) / 2 for x in range(1, LAST + 1))
    for s, share in enumerate((boys, 1 - boys)):
        new[s, 0] = (births * share * (1 - m[s, 0] / 4) + g[s, 0]) / (1 + m[s, 0] / 4)
    return new, births


def model(spark, f_level=0.06, migration=5.0, mortality=1.0):
    rng = np.random.default_rng(7)
    p = rng.uniform(500, 1500, (2, LAST + 1))
    m = np.stack([gompertz() * 1.2, gompertz()]) * mortality
    g = rng.uniform(-1, 1, (2, LAST + 1)) * migration
    ages = np.arange(LAST + 1)
    f = np.where((ages >= 15) & (ages <= 50), f_level, 0.0)
    s = (1 - m / 2) / (1 + m / 2)
    s[:, 0] = (1 - m[:, 0] / 4) / (1 + m[:, 0] / 4)
    data = [
        ("A", "2000", sex, x, *(float(v) for v in (p[i, x], m[i, x], g[i, x], f[x], s[i, x])))
        for i, sex in enumerate(("male", "female"))
        for x in range(LAST + 1)
    ]
    schema = ("geo_code string, period string, sex string, x int, p double, m double, g double,"
              " f double, s double")  # fmt: skip
    return spark.createDataFrame(data, schema), p, m, g, f


def test_step(spark):
    df, p, m, g, f = model(spark)
    want, births = numpy_step(p, m, g, f, 0.51)
    for r in co.cohort_step(df, F.lit(0.51), LAST).collect():
        assert r["value"] == pytest.approx(want[int(r["sex"] == "female"), r["x"]], rel=1e-12)
        assert r["births"] == pytest.approx(births, rel=1e-12)


def test_no_events_only_age(spark):
    df, p, *_ = model(spark, f_level=0.0, migration=0.0, mortality=0.0)
    df = df.withColumn("m", F.lit(0.0))
    out = {(r["sex"], r["x"]): r["value"] for r in co.cohort_step(df, F.lit(0.5), LAST).collect()}
    assert out["male", 0] == 0 and out["male", 1] == p[0, 0]
    assert out["female", LAST] == pytest.approx(p[1, LAST - 1] + p[1, LAST])


def test_momentum_is_where_stepping_ends(spark):
    df, p, m, _, f = model(spark, migration=0.0)
    boys = 0.51
    ratios = {r["sex"]: r["value"] for r in co.population_momentum(df, F.lit(boys), LAST).collect()}
    s = (1 - m / 2) / (1 + m / 2)
    s[:, 0] = (1 - m[:, 0] / 4) / (1 + m[:, 0] / 4)
    ell = np.cumprod(s[1])
    nrr = (1 - boys) * sum(f[x] * (ell[x - 1] + ell[x]) / 2 for x in range(1, LAST + 1))
    now, zero = p.copy(), np.zeros_like(p)
    for _ in range(1500):
        now, _b = numpy_step(now, m, zero, f / nrr, boys)
    assert ratios["male"] == pytest.approx(now[0].sum() / p[0].sum(), rel=1e-7)
    assert ratios["female"] == pytest.approx(now[1].sum() / p[1].sum(), rel=1e-7)
    assert ratios["total"] == pytest.approx(now.sum() / p.sum(), rel=1e-7)


def test_intrinsic_growth(spark):
    """All births at one age: the growth factor is a root known in closed form."""
    data = [("A", "2000", x, 2.0 if x == 30 else 0.0, 0.9) for x in range(60)]
    df = spark.createDataFrame(data, "geo_code string, period string, x int, f double, exposure double")
    out = co.intrinsic_growth(df, F.lit(0.5)).first()
    assert out["value"] == pytest.approx(100 * math.log(0.9) / 30, abs=1e-9)
    assert out["daughters"] == pytest.approx(1, abs=1e-12)


def b_frame(spark, values):
    return spark.createDataFrame([("A", x, float(v)) for x, v in enumerate(values)], "geo_code string, x int, b double")


@pytest.mark.parametrize(
    ("b", "want"),
    [
        ([-0.5, 0.6, -0.2, -0.2, 0.8], [0, 0.6, 0.3, 0.15, 0.8]),
        ([0.4, -0.1, -0.2, 0.3], [0.4, 0.2, 0.1, 0.3]),
        ([0.0, -0.1, 0.5], [0, 0, 0.5]),
        ([0.2, 0.0, 0.0, 0.5], [0.2, 0.1, 0.1, 0.5]),
        ([0.4, 0.0, -0.1, 0.5], [0.4, 0.2, 0.2, 0.5]),
    ],
)
def test_repair(spark, b, want):
    got = [r["b"] for r in lc.repair_b(b_frame(spark, b)).orderBy("x").collect()]
    assert got == pytest.approx([w / sum(want) for w in want])


def test_ultimate_and_rotation(spark):
    # ages 1 to 3 have the mean 0.2; age 4 is scaled to it, and age 5 keeps its half of age 4
    out = lc.ultimate_b(b_frame(spark, [0.1, 0.2, 0.3, 0.1, 0.4, 0.2]), 1, 3).orderBy("x").collect()
    assert [r["u"] for r in out] == pytest.approx([v / 1.1 for v in (0.2, 0.2, 0.2, 0.2, 0.2, 0.1)])
    one = spark.range(1).select(
        *[lc.rotate_b(F.lit(1.0), F.lit(3.0), F.lit(e)) for e in (79.0, 91.0, 102.0)]
    ).first()
    assert tuple(one) == pytest.approx((1.0, 1 + 2 * math.sqrt(0.5), 3.0))


def test_solve_k(spark):
    m = gompertz(60, slope=0.1)
    b = np.full(60, 1 / 60)
    want = -7.5
    e0 = years_left(m * np.exp(b * want), 0.2)
    df = spark.createDataFrame([([float(v) for v in np.log(m)], [float(v) for v in b], float(e0))], "a array<double>, b array<double>, e0 double")
    out = lc.solve_k(df, 0.2).first()
    assert out["k"] == pytest.approx(want, abs=1e-8) and out["reached"] == pytest.approx(e0)


def test_fit_drift_and_fan(spark):
    """Rates made from known a, b and k; the fan against a plain loop; the lower bound of life
    expectancy lies below the upper."""
    ages, years = np.arange(70), np.arange(2000, 2010)
    a, b = np.log(gompertz(70, slope=0.1)), np.full(70, 1 / 70)
    k = np.array([5, 4, 3.5, 2, 1, -1, -2, -2.5, -4, -6.0])
    k -= k.mean()
    data = [("A", s, int(y), int(x), float(np.exp(a[x] + b[x] * k[i])))
            for s in ("male", "female") for i, y in enumerate(years) for x in ages]
    rates = spark.createDataFrame(data, "geo_code string, sex string, y int, x int, m double")
    fit = lc.lee_carter_fit(rates)
    got = fit.where("sex = 'male' AND y = 2009").orderBy("x").collect()
    assert [r["a"] for r in got] == pytest.approx(list(a))
    assert [r["b"] for r in got] == pytest.approx(list(b))
    drifts = lc.k_drift(fit.where("x = 0"))
    d = drifts.where("sex = 'male'").first()
    assert d["drift"] == pytest.approx((k[-1] - k[0]) / 9) and d["n"] == 9
    assert d["sigma"] == pytest.approx(np.std(np.diff(k) - d["own"], ddof=1))
    curves = fit.where("y = 2009").select("geo_code", "sex", "x", F.ln("m").alias("a"), "b")
    fan = {(r["sex"], r["h"], r["interval"], r["x"]): r["value"]
           for r in lc.lc_fan(curves, drifts, 3, 0.2, (0, 20)).collect()}
    jump = a + b * k[-1]
    for h in (1, 3):
        walk = d["drift"] * h + 1.2815515655446004 * d["sigma"] * math.sqrt(h + h * h / 9)
        want = years_left(np.exp(jump + b * walk), 0.2, 20)
        assert fan["male", h, "80_lower", 20] == pytest.approx(want)
        assert fan["male", h, "95_lower", 0] < fan["male", h, None, 0] < fan["male", h, "95_upper", 0]
    # rotation towards the same b changes nothing
    rotated = curves.withColumns({"u": F.col("b"), "ex0": F.lit(91.0)})
    weights = lc.rotation_weights(rotated, drifts, 3, 0.2)
    at = {r["h"]: r["weight"] for r in weights.collect()}
    assert at[1] == pytest.approx(math.sqrt(0.5)) and at[2] == at[3] == 0  # the years ahead are short of 80
    turned = {(r["sex"], r["h"], r["interval"], r["x"]): r["value"]
              for r in lc.lc_fan(rotated, drifts, 3, 0.2, (0, 20), weights).collect()}
    assert turned.keys() == fan.keys()
    assert all(turned[key] == pytest.approx(fan[key]) for key in fan)


def test_migration(spark):
    """Three ages and an open class, by hand."""
    def ages(year, values):
        return [("A", year, "male", a, v, False, False) for a, v in zip(("0", "1", "2+"), values)]
    schema = ("geo_code string, period string, sex string, age string, value double,"
              " provisional boolean, break_in_series boolean")  # fmt: skip
    keys = ("geo_code", "sex")
    pop = spark.createDataFrame(ages("2000", (10.0, 11.0, 12.0)) + ages("2001", (9.0, 8.0, 21.0)), schema)
    deaths = spark.createDataFrame(ages("2000", (1.0, 1.0, 3.0)), schema)
    births = spark.createDataFrame([("A", 2000, "male", 10.0, False, False)],
        "geo_code string, y int, sex string, value double, provisional boolean, break_in_series boolean")
    out = mi.net_migration(mi.single_ages(pop, keys), mi.single_ages(deaths, keys), births)
    # 9 - 10 + 1, 8 - 10 + 1, 21 - (11 + 12) + 3
    assert rows(out.select("x", "value", "is_open")) == [(0, 0.0, False), (1, -1.0, False), (2, 1.0, True)]
    short = mi.single_ages(deaths.where("age <> '1'"), keys)
    assert mi.net_migration(mi.single_ages(pop, keys), short, births).count() == 0


def test_kitagawa(spark):
    def rows_of(values):
        return spark.createDataFrame(
            [("A", y, a, v) for y, a, v in values], "geo_code string, period string, age string, value double"
        )
    births = rows_of([("2000", "20", 10.0), ("2001", "20", 18.0), ("2003", "20", 5.0)])
    women = rows_of([("2000", "20", 100.0), ("2001", "20", 120.0), ("2003", "20", 50.0)])
    out = fe.births_change(births, women)
    got = {(r["period"], r["age"], r["part"]): r["value"] for r in out.collect()}
    assert got["2001", "20", "women"] == pytest.approx(20 * (0.1 + 0.15) / 2)
    assert got["2001", "total", "fertility"] == pytest.approx(0.05 * 110)
    assert fe.births_change_gate(out).count() == 0
    assert {p for p, *_ in got} == {"2001"}


def test_nowcast(spark):
    """Three years of twelve equal months each; nine months of the fourth, and a stray one."""
    levels = {2000: 10.0, 2001: 11.0, 2002: 13.0}
    data = [("A", y, f"M{m:02d}", v) for y, v in levels.items() for m in range(1, 13)]
    data += [("A", y, "TOTAL", 12 * v) for y, v in levels.items()]
    data += [("A", 2003, f"M{m:02d}", 20.0) for m in range(1, 10)] + [("A", 2003, "M11", 20.0)]
    months = spark.createDataFrame(data, "geo_code string, y int, month string, value double")
    cum = ts.cumulative_months(months)
    assert cum.where("y = 2003").count() == 9  # nothing after the missing October
    total = cum.where("k = 12").select("y", "clean").collect()
    assert all(r["clean"] for r in total)
    out = {r["interval"]: r["value"] for r in ts.nowcast(cum, min_years=2).collect()}
    last = [r for r in data if r[1] == 2002]
    prev_total = next(v for _, _, m, v in last if m == "TOTAL")
    prev_nine = sum(v for _, _, m, v in last if m != "TOTAL" and int(m[1:]) <= 9)
    assert out[None] == pytest.approx(prev_total * 180 / prev_nine)
    assert out["95_lower"] <= out["80_lower"] <= out[None] <= out["80_upper"] <= out["95_upper"]
    assert ts.nowcast(cum, min_years=10).count() == 0


def test_projection_deviation(spark):
    projected = values_frame(spark, ("source_id", "geo_code", "period", "value"),
        [("P", "A", "2020", 110.0), ("P", "A", "2021", 120.0), ("P", "A", "2022", 130.0)])
    observed = values_frame(spark, ("geo_code", "period", "value"), [("A", "2020", 100.0), ("A", "2021", 104.0)])
    out = ts.projection_deviation(projected, observed)
    got = {(r["period"], r["definition_id"].split("@")[0][-5:]): r["value"] for r in out.collect()}
    assert got == {
        ("2020", "level"): pytest.approx(10.0),
        ("2021", "level"): pytest.approx(100 * 16 / 104),
        ("2021", "hange"): pytest.approx(6.0),
    }


def test_iso_weeks(spark):
    import datetime as dt

    weeks = [f"{y}-W{w:02d}" for y in range(1995, 2031) for w in (1, 26, 52)]
    df = spark.createDataFrame([(w,) for w in weeks], "w string").select("w", ts.iso_monday(F.col("w")))
    for w, monday in df.collect():
        assert monday == dt.date.fromisocalendar(int(w[:4]), int(w[6:]), 1)


def test_weeks_spread_over_months(spark):
    import datetime as dt

    first = dt.date(2020, 1, 27)  # this week covers five days of January
    weekly = []
    for i in range(6):
        y, w, _ = (first + dt.timedelta(weeks=i)).isocalendar()
        weekly.append(("A", f"{y}-W{w:02d}", float(7 * (i + 1))))
    df = spark.createDataFrame(weekly, "geo_code string, period string, value double")
    got = ts.weeks_to_months(df, ("geo_code",)).collect()
    days = {}
    for i in range(6):
        for j in range(7):
            day = first + dt.timedelta(weeks=i, days=j)
            days.setdefault(day.month, []).append(i + 1)
    assert [(r["month"], r["value"]) for r in got] == [(dt.date(2020, 2, 1), pytest.approx(sum(days[2])))]


def test_economic_dependency(spark):
    """2.4 million old, 0.15 million of them active, 4 million employed."""
    sums = spark.createDataFrame(
        [("A", "2000", 2_400_000.0, 150.0, 4_000.0), ("B", "2000", 1.0, 0.0, 0.0)],
        "geo_code string, period string, old double, active double, employed double",
    )
    out = {r["geo_code"]: r["value"] for r in fe.economic_dependency(sums).collect()}
    assert out == {"A": pytest.approx(56.25), "B": None}


def test_by_age_reached(spark):
    df = spark.createDataFrame([("A", 20, 0.1), ("A", 21, 0.3)], "g string, x int, f double")
    got = {r["x"]: r["f"] for r in fe.by_age_reached(df, ("g",), 100).collect()}
    assert got == {20: pytest.approx(0.05), 21: pytest.approx(0.2), 22: pytest.approx(0.15)}


@pytest.fixture(scope="module")
def later(spark, tmp_path_factory):
    """The tables with two more years: the orders of the last two years, and their lines, once again later."""
    folder = str(tmp_path_factory.mktemp("later"))
    sf = "/root/testdata/sf0.01"
    for name in ("nation", "region", "customer", "part"):
        views.table(spark, sf, name).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    orders, lines = views.table(spark, sf, "orders"), views.table(spark, sf, "lineitem")
    last = orders.agg(F.max(F.year("o_orderdate"))).first()[0]
    shift = 10**9
    moved = orders.where(F.year("o_orderdate") > last - 2).withColumns(
        {
            "o_orderkey": F.col("o_orderkey") + shift,
            "o_orderdate": F.add_months("o_orderdate", 24).cast(orders.schema["o_orderdate"].dataType),
        }
    )
    moved = moved.select(*[F.col(f.name).cast(f.dataType) for f in orders.schema])
    orders.unionByName(moved).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    again = lines.withColumn("l_orderkey", F.col("l_orderkey") + shift).join(
        moved.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"
    )
    again = again.select(*[F.col(f.name).cast(f.dataType) for f in lines.schema])
    lines.unionByName(again).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder, last + 2


@pytest.mark.parametrize("name", ["H07_lee_carter_fit", "H11_solve_k_for_e0", "H12_k_drift", "H13_lc_fan", "H14_interval_coverage"])
def test_later_years_move_the_jump_off(spark, later, name):
    folder, last = later
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    cur = check.duck(folder).execute(ORACLES[name])
    assert rows and check.compare((df.columns, rows), ([d[0] for d in cur.description], cur.fetchall())) == ""
    if name == "H11_solve_k_for_e0":
        assert max(r[2] for r in rows) == last - 2
    if name == "H14_interval_coverage":
        # every area's two last tables, both sexes and ages
        areas = QUERIES["H12_k_drift"](spark, folder).count()
        assert rows[0][0] == areas * 2 * 2
