"""Queries H: cohort components, momentum, Lee-Carter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.operators import cohort as co
from vitalgrid.operators import leecarter as lc
from vitalgrid.operators import lifetable as lt
from vitalgrid.plans.mortality import A0, SURVIVAL_SQL, life_sql
from vitalgrid.plans.registry import query
from vitalgrid.plans.structure import r6
from vitalgrid.plans.views import LAST_AGE, cells, sql

BOYS = 0.51
KEYS = ("geo_code", "period")


def r9(name: str) -> Column:
    return F.round(name, 9).alias(name)


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Population p, death rate m, net migration g and fertility f (by age reached) of every
    area and year with all ages of both sexes. All from one pass over the cells."""
    age = Window.partitionBy("geo_code", "y", "a")
    ages = Window.partitionBy("geo_code", "y", "sex").orderBy("a")
    fert = F.when(
        F.col("a").between(15, 44), 0.05 * F.sum("n_n").over(age) / (F.sum("n_all").over(age) + 1)
    ).otherwise(0.0)
    m = 0.0009 * F.exp(0.14 * F.col("a")) * (F.col("n_r") + 0.5) / (F.col("n_all") + 1)
    return (
        cells(spark, sf)
        .where("q_known IS NOT NULL")
        .withColumn("_n", F.count("*").over(Window.partitionBy("geo_code", "y")))
        .where(F.col("_n") == 2 * (LAST_AGE + 1))
        .withColumn("_f", fert)
        .select(
            "geo_code",
            "period",
            "sex",
            F.col("a").alias("x"),
            F.col("q_known").alias("p"),
            m.alias("m"),
            (0.01 * F.col("n_r")).alias("g"),
            ((F.col("_f") + F.lag("_f", 1, 0.0).over(ages)) / 2).alias("f"),
        )
    )


INPUTS_SQL = """
inp0 AS (SELECT *, CASE WHEN a BETWEEN 15 AND 44 THEN 0.05 * sum(n_n) OVER
    (PARTITION BY geo_code, y, a) / (sum(n_all) OVER (PARTITION BY geo_code, y, a) + 1)
    ELSE 0 END AS f0 FROM (
  SELECT *, count(*) OVER (PARTITION BY geo_code, y) AS n FROM cells WHERE q_known IS NOT NULL)
  WHERE n = 100),
inp AS (SELECT geo_code, y, period, sex, a AS x, q_known AS p,
    0.0009 * exp(0.14 * a) * (n_r + 0.5) / (n_all + 1) AS m, 0.01 * n_r AS g,
    (f0 + coalesce(lag(f0) OVER (PARTITION BY geo_code, y, sex ORDER BY a), 0)) / 2 AS f
  FROM inp0)
"""
STEP_SQL = """
st1 AS (SELECT *, ((CASE WHEN x = 49 THEN b + p ELSE b END) * (1 - m / 2) + g) / (1 + m / 2) AS nx
  FROM (SELECT *, lag(p) OVER (PARTITION BY geo_code, y, sex ORDER BY x) AS b FROM inp)),
st2 AS (SELECT *, sum(CASE WHEN sex = 'female' AND x > 0 THEN f * (b + nx) / 2 END)
  OVER (PARTITION BY geo_code, y) AS births FROM st1),
step AS (SELECT geo_code, y, period, sex, x, births, CASE WHEN x = 0 THEN (births
    * CASE WHEN sex = 'male' THEN 0.51 ELSE 1 - 0.51 END * (1 - m / 4) + g) / (1 + m / 4)
  ELSE nx END AS value FROM st2)
"""


@query(
    "H01_cohort_step",
    sql(
        """SELECT geo_code, period, sex, x, round(value, 6) AS value, round(births, 6) AS births
        FROM step""",
        INPUTS_SQL,
        STEP_SQL,
    ),
)
def cohort_step(spark: SparkSession, sf: str) -> DataFrame:
    out = co.cohort_step(inputs(spark, sf), F.lit(BOYS), LAST_AGE)
    return out.select(*KEYS, "sex", "x", r6("value"), r6("births", "births"))


@query(
    "H02_boys_share",
    sql(
        """SELECT geo_code, period, round(sum(b) FILTER (WHERE sex = 'male') / sum(b), 9) AS boys
        FROM (SELECT i.geo_code, i.period, i.sex,
          (n.p * (1 + i.m / 4) - i.g) / (1 - i.m / 4) AS b
        FROM inp i JOIN inp n ON n.geo_code = i.geo_code AND n.sex = i.sex AND n.x = 0
          AND n.y = i.y + 1 WHERE i.x = 0) GROUP BY ALL""",
        INPUTS_SQL,
    ),
)
def boys_share(spark: SparkSession, sf: str) -> DataFrame:
    return co.boys_share(co.next_january(inputs(spark, sf))).select(*KEYS, r9("boys"))


@query(
    "H03_projection_gate",
    sql(
        """SELECT s.geo_code, CAST(s.y + 1 AS VARCHAR) AS period, s.sex, s.x,
        round(s.value, 6) AS ours, n.p AS theirs FROM step s
        JOIN inp n ON n.geo_code = s.geo_code AND n.y = s.y + 1 AND n.sex = s.sex AND n.x = s.x
        WHERE abs(s.value - n.p) > 10""",
        INPUTS_SQL,
        STEP_SQL,
    ),
)
def projection_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs(spark, sf)
    step = co.cohort_step(rows, F.lit(BOYS), LAST_AGE)
    ahead = step.withColumn("period", (F.col("period").cast("int") + 1).cast("string"))
    theirs = rows.withColumnRenamed("p", "value")
    out = co.projection_gate(ahead, theirs, (*KEYS, "sex", "x"), 10.0)
    return out.select(*KEYS, "sex", "x", r6("ours", "ours"), "theirs")


def reproduction_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The inputs with survival s and exposure from the life table of m."""
    keys = (*KEYS, "sex")
    return lt.life_table_survival(lt.life_table(inputs(spark, sf), keys, A0), LAST_AGE, keys)


REPRO_SQL = (INPUTS_SQL, life_sql("inp"), SURVIVAL_SQL.replace("sex, x, CASE", "sex, x, p, f, CASE"))
NRR_SQL = """
nr AS (SELECT geo_code, y, period, sum((1 - 0.51) * f * exposure) AS v FROM surv
  WHERE sex = 'female' GROUP BY ALL)
"""


@query(
    "H04_net_reproduction",
    sql("SELECT geo_code, period, round(v, 9) AS value FROM nr", *REPRO_SQL, NRR_SQL),
)
def net_reproduction(spark: SparkSession, sf: str) -> DataFrame:
    rows = reproduction_inputs(spark, sf).where("sex = 'female'")
    return co.net_reproduction(rows, F.lit(BOYS)).select(*KEYS, r9("value"))


@query(
    "H05_population_momentum",
    sql(
        """SELECT geo_code, period, sex, round(CASE sex WHEN 'female' THEN uf / pf
          WHEN 'male' THEN um / pm ELSE (uf + um) / (pf + pm) END, 9) AS value FROM (
        SELECT geo_code, period, worth / (0.49 * age) * lf AS uf,
          worth / (0.49 * age) * 0.51 / 0.49 * lm AS um, pf, pm FROM (
        SELECT geo_code, period, sum(p * val) FILTER (WHERE sex = 'female') AS worth,
          sum(x * h) FILTER (WHERE sex = 'female') AS age,
          sum(lived) FILTER (WHERE sex = 'female') AS lf,
          sum(lived) FILTER (WHERE sex = 'male') AS lm,
          sum(p) FILTER (WHERE sex = 'female') AS pf, sum(p) FILTER (WHERE sex = 'male') AS pm
        FROM (SELECT *, 0.49 * coalesce(sum(h) OVER (PARTITION BY geo_code, period, sex ORDER BY x
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) / l AS val,
            CASE WHEN x = 49 THEN l1 * s / (1 - s) ELSE l END AS lived FROM (
          SELECT *, h0 / (0.49 * nullif(sum(h0) OVER (PARTITION BY geo_code, period, sex), 0))
            AS h FROM (SELECT *, CASE WHEN sex = 'female' AND x > 0 THEN f * (l1 + l) / 2 ELSE 0
              END AS h0 FROM (SELECT *, lag(l) OVER w AS l1 FROM (
              SELECT *, product(s) OVER (PARTITION BY geo_code, period, sex ORDER BY x
                ROWS UNBOUNDED PRECEDING) AS l FROM surv)
            WINDOW w AS (PARTITION BY geo_code, period, sex ORDER BY x)))))
        GROUP BY ALL)), (SELECT unnest(['female', 'male', 'total']) AS sex)""",
        *REPRO_SQL,
    ),
)
def momentum(spark: SparkSession, sf: str) -> DataFrame:
    out = co.population_momentum(reproduction_inputs(spark, sf), F.lit(BOYS), LAST_AGE)
    return out.select(*KEYS, "sex", r9("value"))


@query(
    "H06_intrinsic_growth",
    sql(
        """SELECT geo_code, period, round(100 * ln((lo + hi) / 2), 6) AS value,
        1.0::DOUBLE AS daughters FROM it WHERE i = 60""",
        *REPRO_SQL,
        """cv AS (SELECT geo_code, period, list({x: x::DOUBLE, c: 0.49 * f * exposure}) AS cs
          FROM surv WHERE sex = 'female' AND f > 0 AND exposure > 0 GROUP BY ALL),
        it AS (SELECT geo_code, period, cs, 0.5::DOUBLE AS lo, 2.0::DOUBLE AS hi, 0 AS i FROM cv
          UNION ALL SELECT geo_code, period, cs, CASE WHEN d > 1 THEN mid ELSE lo END,
            CASE WHEN d > 1 THEN hi ELSE mid END, i + 1 FROM (
            SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(cs,
              lambda e : e.c * pow((lo + hi) / 2, -e.x))) AS d FROM it WHERE i < 60))""",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def intrinsic(spark: SparkSession, sf: str) -> DataFrame:
    rows = reproduction_inputs(spark, sf).where("sex = 'female'")
    return co.intrinsic_growth(rows, F.lit(BOYS)).select(*KEYS, r6("value"), r9("daughters"))


HORIZON = 2  # years between an area's jump-off and its last table, which the fan is held against
LEVEL, LOW_LEVEL = 0.0009, 0.00006  # of the rates; at the low one life is long enough for b to rotate


def rates(spark: SparkSession, sf: str, level: float = LEVEL) -> DataFrame:
    """Death rates of the areas that have every sex and age in each of their years."""
    m = level * F.exp(0.14 * F.col("a")) * (F.col("n_r") + 0.5) / (F.col("n_all") + 1)
    area = Window.partitionBy("geo_code")
    years = F.size(F.collect_set("y").over(area))
    return (
        cells(spark, sf)
        .withColumns({"_n": F.count("*").over(area), "_years": years})
        .withColumn("jump", F.max("y").over(area) - HORIZON)
        .where(F.col("_n") == F.col("_years") * 2 * (LAST_AGE + 1))
        .select("geo_code", "sex", "y", "period", F.col("a").alias("x"), m.alias("m"), "jump")
    )


RATES_SQL = """
lr AS (SELECT geo_code, y, period, sex, a AS x,
    0.0009 * exp(0.14 * a) * (n_r + 0.5) / (n_all + 1) AS m, max(y) OVER (PARTITION BY geo_code) - 2 AS jump
  FROM cells WHERE geo_code IN (SELECT geo_code FROM cells GROUP BY geo_code
    HAVING count(*) = 100 * count(DISTINCT y)))
"""
FIT_SQL = """
fc AS (SELECT *, ln(m) - a AS c FROM (
  SELECT *, avg(ln(m)) OVER (PARTITION BY geo_code, sex, x) AS a FROM lr WHERE y <= jump)),
fk AS (SELECT *, sum(c) OVER (PARTITION BY geo_code, sex, y) AS k FROM fc),
fb AS (SELECT geo_code, sex, x, max(a) AS a, sum(c * k) / sum(k * k) AS b0 FROM fk GROUP BY ALL),
ab AS (SELECT *, b0 / sum(b0) OVER (PARTITION BY geo_code, sex) AS b FROM fb)
"""


def fitted(spark: SparkSession, sf: str, level: float = LEVEL) -> DataFrame:
    return lc.lee_carter_fit(rates(spark, sf, level).where("y <= jump"))


@query(
    "H07_lee_carter_fit",
    sql("SELECT geo_code, sex, x, round(a, 9) AS a, round(b, 9) AS b FROM ab", RATES_SQL, FIT_SQL),
)
def lee_carter(spark: SparkSession, sf: str) -> DataFrame:
    ab = fitted(spark, sf).where("y = jump")
    return ab.select("geo_code", "sex", "x", r9("a"), r9("b"))


def repaired(spark: SparkSession, sf: str, level: float = LEVEL) -> DataFrame:
    """b(x) of each area: each sex's b repaired, then their mean."""
    fit = fitted(spark, sf, level).where("y = jump")
    return lc.shared_b(lc.repair_b(fit, ("geo_code", "sex")))


REPAIR_SQL = """
rb0 AS (SELECT geo_code, sex, x, b, x AS pos, b AS v FROM ab WHERE b > 0 OR x = 0
  UNION ALL SELECT n.geo_code, n.sex, n.x, n.b, r.pos, r.v FROM rb0 r JOIN ab n
    ON n.geo_code = r.geo_code AND n.sex = r.sex AND n.x = r.x + 1 AND n.b <= 0),
rs AS (SELECT geo_code, sex, x, v / sum(v) OVER (PARTITION BY geo_code, sex) AS b FROM (
  SELECT geo_code, sex, x, greatest(v, 0) * pow(0.5, x - pos) AS v FROM rb0)),
rb AS (SELECT geo_code, x, avg(b) AS b FROM rs GROUP BY ALL)
"""


def recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


@query(
    "H08_repair_b",
    recursive(sql("SELECT geo_code, x, round(b, 9) AS b FROM rb", RATES_SQL, FIT_SQL, REPAIR_SQL)),
)
def repair(spark: SparkSession, sf: str) -> DataFrame:
    return repaired(spark, sf).select("geo_code", "x", r9("b"))


ULTIMATE_SQL = """
ub AS (SELECT geo_code, x, b, u0 / sum(u0) OVER (PARTITION BY geo_code) AS u FROM (
  SELECT *, CASE WHEN x <= 30 THEN mean ELSE b * mean / above END AS u0 FROM (
    SELECT *, avg(b) FILTER (WHERE x BETWEEN 5 AND 30) OVER (PARTITION BY geo_code) AS mean,
      max(CASE WHEN x = 31 THEN b END) OVER (PARTITION BY geo_code) AS above FROM rb)))
"""


def ultimate(spark: SparkSession, sf: str, level: float = LEVEL) -> DataFrame:
    return lc.ultimate_b(repaired(spark, sf, level), 5, 30)


@query(
    "H09_ultimate_b",
    recursive(
        sql("SELECT geo_code, x, round(u, 9) AS u FROM ub", RATES_SQL, FIT_SQL, REPAIR_SQL, ULTIMATE_SQL)
    ),
)
def ultimate_b(spark: SparkSession, sf: str) -> DataFrame:
    return ultimate(spark, sf).select("geo_code", "x", r9("u"))


def weight_sql(e0: str) -> str:
    inside = f"sqrt(0.5 * (1 + sin(pi() / 2 * (2 * ({e0} - 80) / 22 - 1))))"
    return f"CASE WHEN {e0} < 80 THEN 0 WHEN {e0} >= 102 THEN 1 ELSE {inside} END"


@query(
    "H10_rotate_b",
    recursive(
        sql(
            f"""SELECT geo_code, x, e0, round((1 - w) * b + w * u, 9) AS b FROM (
            SELECT *, {weight_sql("e0")} AS w
            FROM ub, (SELECT unnest([79, 80, 91, 95.5, 102])::DOUBLE AS e0))""",
            RATES_SQL,
            FIT_SQL,
            REPAIR_SQL,
            ULTIMATE_SQL,
        )
    ),
)
def rotate(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.explode(F.array(*[F.lit(e) for e in (79.0, 80.0, 91.0, 95.5, 102.0)]))
    rows = ultimate(spark, sf).withColumn("e0", levels)
    b = lc.rotate_b(F.col("b"), F.col("u"), F.col("e0"))
    return rows.select("geo_code", "x", "e0", F.round(b, 9).alias("b"))


def e0_sql(rate: str, size: str) -> str:
    """Life expectancy of the rates given by an expression in the age number j (1 to size)."""
    older = f"list_reverse(list_transform(range(2, {size}), lambda j: {rate}))"
    last, first = (f"list_transform([{j}], lambda j: {rate})[1]" for j in (size, 1))
    at_one = f"list_reduce({older}, lambda e, m: (1 + (1 - 0.5 * m) * e) / (1 + 0.5 * m), 1 / {last})"
    return f"((1 + (1 - 0.2 * {first}) * {at_one}) / (1 + 0.8 * {first}))"


# the bisection of k, step by step, over the arrays of a sex's ages
REFIT_SQL = f"""
jumps AS (SELECT DISTINCT geo_code, jump FROM lr),
{life_sql("lr").strip()},
cur AS (SELECT l.geo_code, l.sex, list(ln(l.m) ORDER BY l.x) AS a, list(rb.b ORDER BY l.x) AS b
  FROM lr l JOIN rb ON rb.geo_code = l.geo_code AND rb.x = l.x WHERE l.y = l.jump GROUP BY ALL),
bis AS (
  SELECT t.geo_code, t.sex, t.y, t.ex AS e0, c.a, c.b, 0 AS i, -1000.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi
  FROM lt t JOIN cur c ON c.geo_code = t.geo_code AND c.sex = t.sex JOIN jumps j ON j.geo_code = t.geo_code
  WHERE t.x = 0 AND t.y <= j.jump
  UNION ALL
  SELECT geo_code, sex, y, e0, a, b, i + 1, CASE WHEN long THEN mid ELSE lo END,
    CASE WHEN long THEN hi ELSE mid END
  FROM (SELECT *, {e0_sql("exp(a[j] + b[j] * mid)", "len(a)")} > e0 AS long
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE i < 80))),
ks AS (SELECT geo_code, sex, y, e0, (lo + hi) / 2 AS k FROM bis WHERE i = 80)
"""


def refitted(spark: SparkSession, sf: str, level: float = LEVEL) -> DataFrame:
    return lc.refit_k(rates(spark, sf, level), repaired(spark, sf, level), F.col("jump"), A0)


CHAIN = (RATES_SQL, FIT_SQL, REPAIR_SQL, REFIT_SQL)


@query(
    "H11_solve_k_for_e0",
    recursive(
        sql("SELECT geo_code, sex, y, round(e0, 9) AS e0, round(e0, 9) AS reached, round(k, 6) AS k FROM ks", *CHAIN)
    ),
)
def solve_k(spark: SparkSession, sf: str) -> DataFrame:
    """k of each year; the life table at k must have the year's life expectancy."""
    out = refitted(spark, sf)
    return out.select("geo_code", "sex", "y", r9("e0"), r9("reached"), r6("k", "k"))


def drifts(spark: SparkSession, sf: str, level: float = LEVEL) -> DataFrame:
    return lc.k_drift(refitted(spark, sf, level).select("geo_code", "sex", "y", "k"))


DRIFT_SQL = """
dr0 AS (SELECT geo_code, sex, (arg_max(k, y) - arg_min(k, y)) / (max(y) - min(y)) AS own,
    stddev_samp(d) AS sigma, max(y) - min(y) AS n FROM (
  SELECT *, k - lag(k) OVER (PARTITION BY geo_code, sex ORDER BY y) AS d FROM ks) GROUP BY ALL),
dr AS (SELECT *, avg(own) OVER (PARTITION BY geo_code) AS drift FROM dr0)
"""


@query(
    "H12_k_drift",
    recursive(
        sql(
            """SELECT geo_code, sex, round(own, 6) AS own, round(sigma, 6) AS sigma, n,
            round(drift, 6) AS drift FROM dr""",
            *CHAIN,
            DRIFT_SQL,
        )
    ),
)
def k_drift(spark: SparkSession, sf: str) -> DataFrame:
    out = drifts(spark, sf)
    return out.select("geo_code", "sex", r6("own", "own"), r6("sigma", "sigma"), "n", r6("drift", "drift"))


AGES = (0, 20)


def curves(spark: SparkSession, sf: str, level: float = LEVEL) -> DataFrame:
    """a and b of each area and sex: the jump-off year's log rates, and the area's repaired b."""
    start = rates(spark, sf, level).where("y = jump")
    start = start.select("geo_code", "sex", "x", F.ln("m").alias("a"))
    return start.join(repaired(spark, sf, level).select("geo_code", "x", "b"), ["geo_code", "x"])


BOUNDS_SQL = """bounds AS (SELECT unnest([1, 2]) AS h, i, z FROM (
  SELECT unnest(['c', '80_lower', '80_upper', '95_lower', '95_upper']) AS i,
    unnest([0, 1.2815515655446004, -1.2815515655446004, 1.959963984540054,
            -1.959963984540054]) AS z))"""
FAN_SQL = f"""
{BOUNDS_SQL},
fan0 AS (SELECT d.geo_code, d.sex, w.h AS y, w.i AS period, l.x,
    exp(ln(l.m) + rb.b * (d.drift * w.h + w.z * d.sigma * sqrt(w.h + w.h * w.h / d.n))) AS m
  FROM dr d JOIN lr l ON l.geo_code = d.geo_code AND l.sex = d.sex AND l.y = l.jump
  JOIN rb ON rb.geo_code = l.geo_code AND rb.x = l.x, bounds w)
"""


def _fan_life() -> str:
    """Life tables of the fan; the bound stands in for the period."""
    body = life_sql("fan0", name="ft")
    return body.replace("PARTITION BY geo_code, y, sex", "PARTITION BY geo_code, y, period, sex")


FAN_BODY = """SELECT geo_code, sex, y AS h, nullif(period, 'c') AS interval, x,
        round(ex, 6) AS value FROM ft WHERE x IN (0, 20)"""


@query("H13_lc_fan", recursive(sql(FAN_BODY, *CHAIN, DRIFT_SQL, FAN_SQL, _fan_life())))
def fan(spark: SparkSession, sf: str) -> DataFrame:
    out = lc.lc_fan(curves(spark, sf), drifts(spark, sf), HORIZON, A0, AGES)
    return out.select("geo_code", "sex", "h", "interval", "x", r6("value"))


ROTATED_SQL = f"""
{BOUNDS_SQL},
both_ AS (SELECT f.geo_code, f.a AS fa, m.a AS ma, f.b, u.u, d.drift, (ef.ex + em.ex) / 2 AS mean0
  FROM cur f JOIN cur m ON m.geo_code = f.geo_code AND m.sex = 'male' AND f.sex = 'female'
  JOIN (SELECT geo_code, list(u ORDER BY x) AS u FROM ub GROUP BY geo_code) u ON u.geo_code = f.geo_code
  JOIN dr d ON d.geo_code = f.geo_code AND d.sex = 'female'
  JOIN lt ef ON ef.geo_code = f.geo_code AND ef.sex = 'female' AND ef.x = 0 AND ef.y = (SELECT jump FROM jumps j WHERE j.geo_code = f.geo_code)
  JOIN lt em ON em.geo_code = f.geo_code AND em.sex = 'male' AND em.x = 0 AND em.y = (SELECT jump FROM jumps j WHERE j.geo_code = f.geo_code)),
rot AS (
  SELECT *, 1 AS h, {weight_sql("mean0")} AS w FROM both_
  UNION ALL
  SELECT geo_code, fa, ma, b, u, drift, mean1, h + 1, {weight_sql("mean1")} FROM (
    SELECT *, ({e0_sql("exp(fa[j] + ((1 - w) * b[j] + w * u[j]) * drift * h)", "len(fa)")}
      + {e0_sql("exp(ma[j] + ((1 - w) * b[j] + w * u[j]) * drift * h)", "len(fa)")}) / 2 AS mean1
    FROM rot WHERE h < 2)),
fan0 AS (SELECT d.geo_code, d.sex, w.h AS y, w.i AS period, l.x,
    exp(ln(l.m) + ((1 - r.w) * ub.b + r.w * ub.u)
      * (d.drift * w.h + w.z * d.sigma * sqrt(w.h + w.h * w.h / d.n))) AS m
  FROM dr d JOIN lr l ON l.geo_code = d.geo_code AND l.sex = d.sex AND l.y = l.jump
  JOIN ub ON ub.geo_code = l.geo_code AND ub.x = l.x
  JOIN bounds w ON true JOIN rot r ON r.geo_code = d.geo_code AND r.h = w.h)
"""


@query(
    "H13_lc_fan_rotated",
    recursive(
        sql(
            FAN_BODY,
            RATES_SQL.replace("0.0009", "0.00006"),
            *CHAIN[1:],
            ULTIMATE_SQL,
            DRIFT_SQL,
            ROTATED_SQL,
            _fan_life(),
        )
    ),
)
def fan_rotated(spark: SparkSession, sf: str) -> DataFrame:
    """With rotation, at rates so low that the life expectancy passes the age where it begins."""
    u = ultimate(spark, sf, LOW_LEVEL).select("geo_code", "x", "u")
    start = rates(spark, sf, LOW_LEVEL).where("y = jump")
    table = lt.life_table(start, ("geo_code", "sex", "y"), A0).where("x = 0")
    e0 = table.select("geo_code", "sex", F.col("ex").alias("ex0"))
    rows = curves(spark, sf, LOW_LEVEL).join(u, ["geo_code", "x"]).join(e0, ["geo_code", "sex"])
    walks = drifts(spark, sf, LOW_LEVEL)
    weights = lc.rotation_weights(rows, walks, HORIZON, A0)
    out = lc.lc_fan(rows, walks, HORIZON, A0, AGES, weights)
    return out.select("geo_code", "sex", "h", "interval", "x", r6("value"))


@query(
    "H14_interval_coverage",
    recursive(sql(
        """SELECT count(*) AS n, count(*) FILTER (WHERE a BETWEEN l80 AND u80) AS inside_80,
        count(*) FILTER (WHERE a BETWEEN l95 AND u95) AS inside_95,
        round(max(abs(c - a)), 6) AS max_error FROM (
        SELECT f.geo_code, f.sex, f.y, f.x, max(r.ex) AS a,
          max(f.ex) FILTER (WHERE f.period = 'c') AS c,
          max(f.ex) FILTER (WHERE f.period = '80_lower') AS l80,
          max(f.ex) FILTER (WHERE f.period = '80_upper') AS u80,
          max(f.ex) FILTER (WHERE f.period = '95_lower') AS l95,
          max(f.ex) FILTER (WHERE f.period = '95_upper') AS u95
        FROM ft f JOIN lt r ON r.geo_code = f.geo_code AND r.sex = f.sex AND r.x = f.x
          JOIN jumps j ON j.geo_code = f.geo_code AND r.y = j.jump + f.y WHERE f.x IN (0, 20)
        GROUP BY f.geo_code, f.sex, f.y, f.x)""",
        *CHAIN,
        DRIFT_SQL,
        FAN_SQL,
        _fan_life(),
    )),
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The fan from each area's jump-off against its tables of the years since."""
    rows = lc.lc_fan(curves(spark, sf), drifts(spark, sf), HORIZON, A0, AGES)
    since = rates(spark, sf).where("y > jump").withColumn("h", F.col("y") - F.col("jump"))
    table = lt.life_table(since, ("geo_code", "sex", "h"), A0)
    held = table.where(F.col("x").isin(*AGES)).select("geo_code", "sex", "h", "x", F.col("ex").alias("value"))
    out = lc.interval_coverage(rows, held, ("geo_code", "sex", "h", "x"))
    return out.select("n", "inside_80", "inside_95", r6("max_error", "max_error"))
