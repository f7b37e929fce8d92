"""Queries E10-E24: groups, sums and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.frames import values_frame, year_shift
from vitalgrid.operators import gates as g
from vitalgrid.operators import groups as gr
from vitalgrid.operators import selection
from vitalgrid.operators import structure as st
from vitalgrid.plans.registry import query
from vitalgrid.plans.structure import (
    BANDS,
    GROUPS_SQL,
    OLD,
    OLDEST,
    YOUNG,
    bands,
    fertility_observations,
    r6,
)
from vitalgrid.plans.views import base, cells, population, sql, table
from vitalgrid.schema import COLUMNS


def regions(spark: SparkSession) -> DataFrame:
    """A versioned group of areas."""
    rows = [("regions", "1", f"W{i}") for i in range(5)] + [("low", "1", "W0"), ("low", "1", "W2")]
    return values_frame(spark, ("group", "version", "geo_code"), rows)


MEDIAN_SQL = """SELECT 'W_MEDIAN' AS geo_code, period, sex, age, median(value) AS value,
    CASE WHEN bool_or(status = 'provisional') THEN 'provisional' ELSE 'final' END AS status,
    bool_or(break_in_series) AS break_in_series, 'derived' AS nature
    FROM pop WHERE length(geo_code) = 2 GROUP BY period, sex, age HAVING count(*) = 5"""


def median_args(spark: SparkSession) -> tuple:
    return gr.members(regions(spark), "regions", "1"), 5, "W_MEDIAN", "region_median@0.1"


SHOWN = ("geo_code", "period", "sex", "age", "value", "status", "break_in_series", "nature")


@query("E10_group_median", sql(MEDIAN_SQL))
def group_median(spark: SparkSession, sf: str) -> DataFrame:
    return gr.group_median(population(spark, sf), *median_args(spark)).select(*SHOWN)


@query(
    "E10_mixed_definitions",
    sql("SELECT 'population_1jan@v1' AS first, 'population_avg@v1' AS last FROM pop LIMIT 1"),
)
def mixed_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """The members' values, one of which counts another population: no median is taken of these."""
    other = F.when(F.col("geo_code") == "W3", "population_avg@v1").otherwise(F.col("definition_id"))
    rows = population(spark, sf).withColumn("definition_id", other)
    return gr.mixed_definitions(rows)


@query(
    "E10_quantiles",
    """SELECT l_linestatus AS kind, l_returnflag AS flag, count(*) AS n,
        round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
        round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
        round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
    FROM (SELECT l_linestatus, l_returnflag, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice
          FROM lineitem)
    GROUP BY ALL""",
)
def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles over all rows of few groups, none of which is held as a list."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("flag"), "l_extendedprice"
    )
    shares = (0.1, 0.5, 0.9)
    found = selection.exact_quantiles(rows, ["kind", "flag"], "l_extendedprice", shares)
    return found.select(
        "kind", "flag", "n",
        *[F.round(F.get("quantiles", i), 4).alias(f"p{s * 100:.0f}") for i, s in enumerate(shares)],
    )


@query(
    "E11_with_median",
    sql(
        f"""SELECT geo_code, period, sex, age, value, status, break_in_series,
        'official_estimate' AS nature FROM pop WHERE age = 'total'
        UNION ALL SELECT * FROM ({MEDIAN_SQL}) WHERE age = 'total'"""
    ),
)
def with_median(spark: SparkSession, sf: str) -> DataFrame:
    total = population(spark, sf).where("age = 'total'").select(*COLUMNS)
    return gr.with_median(total, *median_args(spark)).select(*SHOWN)


@query(
    "E12_rule_membership",
    sql(
        """SELECT r.geo_code, CASE WHEN v IS NULL THEN 'no value'
        WHEN v < 0.52 AND NOT listed THEN 'not listed'
        WHEN v >= 0.52 AND listed THEN 'listed against the rule' END AS problem
        FROM (SELECT 'W' || unnest(range(5)) AS geo_code) r
        LEFT JOIN (SELECT geo_code, sum(f) AS v FROM fert WHERE y = 2000 GROUP BY geo_code
                   HAVING count(*) = 30) t USING (geo_code),
        LATERAL (SELECT r.geo_code IN ('W0', 'W2') AS listed) WHERE problem IS NOT NULL"""
    ),
)
def rule_membership(spark: SparkSession, sf: str) -> DataFrame:
    widths = {str(a): 1 for a in range(15, 45)}
    rates = st.total_fertility(fertility_observations(spark, sf), widths)
    listed = gr.members(regions(spark), "low", "1")
    return gr.rule_membership(rates, median_args(spark)[0], listed, "2000", 0.52)


def nation_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every code of the grid, from the nation table: the reference list of areas."""
    code = F.concat(F.lit("W"), F.col("n_regionkey").cast("string"), F.chr(F.col("n_nationkey") + 65))
    from vitalgrid.plans.views import ancestors

    codes = table(spark, sf, "nation").select(F.explode(ancestors(code)).alias("geo_code"))
    return codes.distinct()


def shifted(df: DataFrame, where: Column, by: float) -> DataFrame:
    return df.withColumn("value", F.col("value") + F.when(where, by).otherwise(0.0))


GAP_AT = {"geo_code": "W1", "period": "1996", "age": "total"}


def gapped(spark: SparkSession, sf: str) -> DataFrame:
    """Totals with three persons too many in W1 1996, and five too few in W2 1997 (women)."""
    total = population(spark, sf).where("age = 'total'")
    geo, period = F.col("geo_code"), F.col("period")
    one = shifted(total, (geo == "W1") & (period == "1996"), 3.0)
    return shifted(one, (geo == "W2") & (period == "1997") & (F.col("sex") == "female"), -5.0)


HIERARCHY_SQL = """
tot AS (SELECT geo_code, period, y, sex, value
  + CASE WHEN geo_code = 'W1' AND y = 1996 THEN 3 ELSE 0 END
  - CASE WHEN geo_code = 'W2' AND y = 1997 AND sex = 'female' THEN 5 ELSE 0 END AS value
  FROM pop WHERE age = 'total'),
hgaps AS (
  SELECT p.geo_code, p.period, p.sex, p.value, c.children FROM tot p
  JOIN (SELECT geo_code[:-2] AS geo_code, y, sex, sum(value) AS children, count(*) AS n
        FROM tot WHERE length(geo_code) > 1 GROUP BY ALL) c USING (geo_code, y, sex)
  JOIN (SELECT code[:-2] AS geo_code, count(*) AS expected FROM (
          SELECT DISTINCT unnest([g[:2], g]) AS code FROM (
            SELECT 'W' || n_regionkey || chr(65 + n_nationkey) AS g FROM nation)) GROUP BY 1) e
    USING (geo_code)
  WHERE c.n = e.expected AND abs(p.value - c.children) > 0.5)
"""


@query("E13_hierarchy_gaps", sql("SELECT * FROM hgaps", HIERARCHY_SQL))
def hierarchy_gaps(spark: SparkSession, sf: str) -> DataFrame:
    out = g.hierarchy_gaps(gapped(spark, sf), nation_codes(spark, sf))
    return out.select("geo_code", "period", "sex", "value", "children")


def gapped_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands with a second, lower open group (10+) and a total two too high in W3 1999."""
    rows = bands(spark, sf).where(F.col("scenario_id").isNull())
    geo, period, age = F.col("geo_code"), F.col("period"), F.col("age")
    rows = shifted(rows, (geo == "W3") & (period == "1999") & (age == "total"), 2.0)
    copies = F.when(age.isin("10-34", "35+"), F.array(age, F.lit("10+"))).otherwise(F.array(age))
    cols = [c for c in rows.columns if c not in ("age", "value")]
    return (
        rows.withColumn("age", F.explode(copies))
        .groupBy(*cols, "age")
        .agg(F.sum("value").alias("value"))
    )


@query(
    "E14_age_gaps",
    sql(
        """SELECT geo_code, period, sex, o.open, total, known + unknown AS sum FROM (
        SELECT geo_code, period, sex,
          sum(value) FILTER (WHERE age NOT IN ('total', 'unknown')) AS known,
          coalesce(sum(value) FILTER (WHERE age = 'unknown'), 0) AS unknown,
          sum(value) FILTER (WHERE age = 'total')
            + CASE WHEN geo_code = 'W3' AND period = '1999' THEN 2 ELSE 0 END AS total,
          count(*) FILTER (WHERE TRY_CAST(rtrim(age, '+') AS INT) < 10) AS b0,
          count(*) FILTER (WHERE TRY_CAST(rtrim(age, '+') AS INT) BETWEEN 10 AND 34) AS b1,
          count(*) FILTER (WHERE TRY_CAST(rtrim(age, '+') AS INT) >= 35) AS b2
        FROM pop GROUP BY geo_code, period, sex), (SELECT unnest([10, 35]) AS open) o
        WHERE abs(total - known - unknown) > 0.5 AND b0 > 0
        AND ((o.open = 10 AND b1 + b2 > 0) OR (o.open = 35 AND b1 > 0 AND b2 > 0))"""
    ),
)
def age_gaps(spark: SparkSession, sf: str) -> DataFrame:
    out = g.age_gaps(gapped_bands(spark, sf))
    return out.select("geo_code", "period", "sex", "open", "total", "sum")


@query(
    "E15_known_gap_gate",
    sql(
        """SELECT 'unexplained' AS kind, period, sex, round(value - children, 6) AS off
        FROM hgaps WHERE NOT (period = '1996' AND sex = 'male')
        AND NOT (period = '1997' AND sex = 'female')
        UNION ALL SELECT 'gone', '2000', 'male', NULL""",
        HIERARCHY_SQL,
    ),
)
def known_gap_gate(spark: SparkSession, sf: str) -> DataFrame:
    obs = gapped(spark, sf)
    gaps = g.hierarchy_gaps(obs, nation_codes(spark, sf))
    gaps = gaps.select("period", "sex", (F.col("value") - F.col("children")).alias("off"))
    known = values_frame(
        spark,
        ("period", "sex", "bound"),
        [("1996", "male", 3.0), ("1997", "female", 6.0), ("2000", "male", 9.0),
         ("2050", "male", 1.0), ("1996", "female", 2.0)],
    )
    out = g.known_gap_gate(gaps, obs, known)
    return out.select("kind", "period", "sex", r6("off", "off"))


def old_age(spark: SparkSession, sf: str) -> DataFrame:
    groups = st.age_groups(population(spark, sf), YOUNG, OLD, OLDEST)
    return st.ratio_per_100(groups, F.col("old"), F.col("working"))


def old_age_broad(spark: SparkSession, sf: str) -> DataFrame:
    groups = st.broad_groups(bands(spark, sf), *BANDS)
    return st.ratio_per_100(groups, F.col("old"), F.col("working"))


def official(ours: DataFrame) -> DataFrame:
    """The ratio as an office would publish it: one decimal, and wrong in three cells."""
    geo, period = F.col("geo_code"), F.col("period")
    off = F.when((geo == "W1") & (period == "1996"), 0.3).when(
        (geo == "W3") & (period == "1998"), -0.2
    )
    return ours.withColumn("value", F.round("value", 1) + F.coalesce(off, F.lit(0.0)))


def alternative(broad: DataFrame) -> DataFrame:
    """The other table agrees with ours except in W3 1998."""
    at = (F.col("geo_code") == "W3") & (F.col("period") == "1998") & (F.col("sex") != "male")
    return shifted(broad, at, 1.0)


def listed(spark: SparkSession) -> DataFrame:
    return values_frame(
        spark, ("geo_code", "period"), [("W1", "1996"), ("W0", "1995"), ("W9", "1995")]
    )


RECONCILE_SQL = """
ours AS (SELECT geo_code, period, sex, old / nullif(working, 0) * 100 AS ours FROM g
         WHERE old / nullif(working, 0) IS NOT NULL),
both_ AS (
  SELECT *, round(ours, 1) + CASE WHEN geo_code = 'W1' AND period = '1996' THEN 0.3
    WHEN geo_code = 'W3' AND period = '1998' THEN -0.2 ELSE 0 END AS official FROM ours),
dis AS (
  SELECT *, (geo_code, period) IN (('W1', '1996'), ('W0', '1995'), ('W9', '1995')) AS known,
    NOT (geo_code = 'W3' AND period = '1998' AND sex <> 'male')
      AND NOT (geo_code = 'W1' AND false) AS corroborated
  FROM both_ WHERE abs(ours - official) > 0.05 + 1e-9)
"""


@query(
    "E16_disagreements",
    sql(
        """SELECT geo_code, period, sex, round(ours, 6) AS ours, round(official, 6) AS official,
        known, corroborated FROM dis""",
        GROUPS_SQL,
        RECONCILE_SQL,
    ),
)
def disagreements(spark: SparkSession, sf: str) -> DataFrame:
    ours = old_age(spark, sf)
    alt = alternative(old_age_broad(spark, sf))
    out = g.disagreements(ours, official(ours), listed(spark), alternatives=[alt])
    return out.select(
        "geo_code", "period", "sex", r6("ours", "ours"), r6("official", "official"), "known",
        "corroborated",
    )


@query(
    "E17_reconcile_gate",
    sql(
        """SELECT 'unexplained' AS kind, geo_code, period, sex, round(ours, 6) AS ours,
          round(official, 6) AS official FROM dis WHERE NOT known
        UNION ALL SELECT 'gone', geo_code, period, NULL, NULL, NULL FROM (
          SELECT DISTINCT geo_code, period FROM ours
          WHERE (geo_code, period) IN (('W1', '1996'), ('W0', '1995'), ('W9', '1995'))
          EXCEPT SELECT geo_code, period FROM dis WHERE known)""",
        GROUPS_SQL,
        RECONCILE_SQL,
    ),
)
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    ours = old_age(spark, sf)
    out = g.reconcile_gate(ours, official(ours), listed(spark))
    return out.select(
        "kind", "geo_code", "period", "sex", r6("ours", "ours"), r6("official", "official")
    )


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return population(spark, sf).where("age = 'total' AND sex = 'total'")


@query(
    "E18_base_year_gate",
    sql(
        """SELECT CASE WHEN geo_code[2] = '1' THEN 'unexplained' ELSE 'gone' END AS kind, geo_code
        FROM (SELECT DISTINCT geo_code FROM pop WHERE y = 1995)
        WHERE (geo_code[2] = '1' AND geo_code <> 'W1') OR geo_code = 'W0'"""
    ),
)
def base_year(spark: SparkSession, sf: str) -> DataFrame:
    observed = totals(spark, sf).where("period = '1995'")
    projected = shifted(observed, F.substring("geo_code", 2, 1) == "1", 7.0)
    known = values_frame(spark, ("geo_code",), [("W1",), ("W0",), ("W7",)])
    return g.base_year_gate(projected, observed, known)


@query(
    "E19_tolerance_gate",
    sql(
        """SELECT CASE WHEN off THEN 'unexplained' ELSE 'gone' END AS kind, geo_code FROM (
        SELECT a.geo_code, bool_or(abs(a.value * (1 + 0.02 * (a.y - 1995))
          / ((a.value + b.value) / 2) - 1) > 0.06) AS off
        FROM pop a JOIN pop b ON a.geo_code = b.geo_code AND b.y = a.y + 1
        WHERE a.age = 'total' AND a.sex = 'total' AND b.age = 'total' AND b.sex = 'total'
        GROUP BY a.geo_code) WHERE off <> (geo_code IN ('W', 'W2', 'W3'))"""
    ),
)
def tolerance_by_area(spark: SparkSession, sf: str) -> DataFrame:
    jan = totals(spark, sf)
    after = year_shift(F.col("value"), ("geo_code",), 1)
    mid = jan.withColumn("value", (F.col("value") + after) / 2).where("value IS NOT NULL")
    growth = 1 + 0.02 * (F.col("period").cast("int") - 1995)
    projected = jan.withColumn("value", F.col("value") * growth)
    known = values_frame(spark, ("geo_code",), [("W",), ("W2",), ("W3",), ("W7",)])
    return g.tolerance_gate_by_area(projected, mid, known)


@query(
    "E20_control_totals",
    sql(
        """SELECT geo_code, period, sex, value AS total, value - 3 AS parts FROM tot
        WHERE geo_code = 'W1' AND y = 1996
        UNION ALL SELECT geo_code, period, sex, value, value + 5 FROM tot
        WHERE geo_code = 'W2' AND y = 1997 AND sex = 'female'""",
        HIERARCHY_SQL,
    ),
)
def control_totals(spark: SparkSession, sf: str) -> DataFrame:
    pop = population(spark, sf)
    geo, period, total = F.col("geo_code"), F.col("period"), F.col("age") == "total"
    rows = shifted(pop, total & (geo == "W1") & (period == "1996"), 3.0)
    at = total & (geo == "W2") & (period == "1997") & (F.col("sex") == "female")
    rows = shifted(rows, at, -5.0)
    return g.control_totals(rows, ("geo_code", "period", "sex"), total, ~total)


@query(
    "E20_linear_identity",
    sql(
        """SELECT geo_code, period, CAST(1 AS DOUBLE) AS residual FROM cells
        WHERE geo_code = 'W4' GROUP BY ALL"""
    ),
)
def linear_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Births less deaths is natural change, except in W4, where it is one short."""
    c = cells(spark, sf).groupBy("geo_code", "period").agg(
        F.sum("n_n").cast("double").alias("births"), F.sum("n_r").cast("double").alias("deaths")
    )
    change = F.col("births") - F.col("deaths") - F.when(F.col("geo_code") == "W4", 1).otherwise(0)
    kinds = F.array(
        F.struct(F.lit("births").alias("kind"), F.col("births").alias("value")),
        F.struct(F.lit("deaths").alias("kind"), F.col("deaths").alias("value")),
        F.struct(F.lit("change").alias("kind"), change.alias("value")),
    )
    rows = c.select("geo_code", "period", F.inline(kinds))
    weights = {"births": 1, "deaths": -1, "change": -1}
    return g.linear_identity(rows, ("geo_code", "period"), "kind", weights)


@query(
    "E21_printed_share_check",
    sql(
        """SELECT geo_code, period, sex, a, printed, ours FROM (
        SELECT *, floor(n_r * 1000 / n_all + 0.5) / 10 AS ours,
          round(floor(n_r * 1000 / n_all + 0.5) / 10
                + CASE WHEN a = 7 THEN 0.1 ELSE 0 END, 1) AS printed FROM cells)
        WHERE ours <> printed"""
    ),
)
def printed_share(spark: SparkSession, sf: str) -> DataFrame:
    from vitalgrid.functions.decode import round_half_up_percent

    share = round_half_up_percent(F.col("n_r"), F.col("n_all"))
    off = F.when(F.col("a") == 7, 0.1).otherwise(0.0)
    rows = cells(spark, sf).withColumn("printed", F.round(share + off, 1))
    out = g.printed_share_violations(rows, "n_r", "n_all", "printed")
    return out.select("geo_code", "period", "sex", "a", "printed", "ours")


@query(
    "E22_merge_units",
    sql(
        """SELECT area AS geo_code, period, sum(q) AS value,
        CASE WHEN count(DISTINCT geo_code) > 1 THEN 'derived' ELSE 'observed' END AS nature
        FROM (SELECT geo_code, period, q_known AS q, CASE WHEN geo_code IN ('W0', 'W1') THEN 'A'
          WHEN geo_code = 'W2' THEN 'B' WHEN geo_code = 'W3' THEN 'C'
          WHEN geo_code IN ('W4E', 'W4J') THEN 'D' END AS area
          FROM cells) WHERE area IS NOT NULL GROUP BY ALL"""
    ),
)
def merge_units(spark: SparkSession, sf: str) -> DataFrame:
    units = (
        cells(spark, sf)
        .groupBy(F.col("geo_code").alias("unit"), "period")
        .agg(F.sum("q_known").alias("value"))
    )
    rows = [("W0", "A"), ("W1", "A"), ("W2", "B"), ("W3", "C"), ("W4E", "D"), ("W4J", "D")]
    return g.merge_units(units, values_frame(spark, ("unit", "geo_code"), rows))


@query(
    "E23_deaths_per_births",
    sql(
        """SELECT geo_code, period, round(100 * sum(n_r) / nullif(sum(n_n), 0), 6) AS value
        FROM cells GROUP BY ALL"""
    ),
)
def deaths_per_births(spark: SparkSession, sf: str) -> DataFrame:
    sums = cells(spark, sf).groupBy("geo_code", "period").agg(
        F.sum("n_n").alias("births"), F.sum("n_r").alias("deaths")
    )
    return g.ratio_per_births(sums).select("geo_code", "period", r6("value"))


@query(
    "E24_no_mix_guard",
    """SELECT min(l_returnflag) AS first, max(l_returnflag) AS last FROM lineitem
    HAVING count(DISTINCT l_returnflag) > 1""",
)
def no_mix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"))
    return st.mixed_sources(rows.where("source = 'A'"), rows.where("source <> 'A'"))
