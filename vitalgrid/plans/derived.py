"""Query I05: values derived from several tables as observations with combined provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators import provenance as pv
from vitalgrid.operators.contract import violations
from vitalgrid.operators.provenance import Input
from vitalgrid.plans import models, mortality, timeseries
from vitalgrid.plans.models import HORIZON
from vitalgrid.plans.registry import ORACLES, query
from vitalgrid.plans.timeseries import PROJECTED_FROM
from vitalgrid.plans.views import LAST_YEAR, age_label, cells, shared_cells
from vitalgrid.schema import COLUMNS, DEFINITIONS, definitions

# The input tables: source, dataset, vintage, first provisional year and year of a break, if any.
TABLES = {
    "population": ("Office", "pop_cells", "2026-01-02", LAST_YEAR, 1998),
    "births": ("Office", "birth_cells", "2025-12-01", LAST_YEAR, None),
    "deaths": ("Registry", "death_cells", "2026-02-01", None, None),
    "labour": ("Survey", "labour_cells", "2025-11-01", LAST_YEAR, 1997),
    "months": ("Office", "birth_months", "2026-03-01", LAST_YEAR, None),
    **{f"P{y}": ("Model", f"proj_{y}", "2024-05-01", None, None) for y in PROJECTED_FROM},
}
JUMP_OFF = str(LAST_YEAR - HORIZON)

# What each formula reads, numerator first.
FORMULAS: dict[str, tuple[Input, ...]] = {
    "prospective_ratio": (Input("population"), Input("deaths")),
    "life_expectancy_change": (Input("deaths", (-1, 0)),),
    "births_change": (Input("births", (-1, 0)), Input("population", (-1, 0, 1))),
    "fertility_by_order": (Input("births"),),
    "general_fertility": (Input("births"), Input("population", (0, 1))),
    "gross_reproduction": (Input("births"),),
    "net_reproduction": (Input("births"), Input("deaths")),
    "net_migration": (Input("population", (0, 1)), Input("births"), Input("deaths")),
    "economic_dependency": (Input("population"), Input("labour")),
    "births_nowcast": (Input("months", (-1, 0)),),
    **{f"P{y}_level": (Input(f"P{y}"), Input("population")) for y in PROJECTED_FROM},
    **{
        f"P{y}_change": (Input(f"P{y}", (0,), (str(y),)), Input("population", (0,), (str(y),)))
        for y in PROJECTED_FROM
    },
    "population_momentum": (Input("population"), Input("births"), Input("deaths")),
    "intrinsic_growth": (Input("births"), Input("deaths")),
    "life_expectancy_fan": (Input("deaths", at=(JUMP_OFF,)),),
}


def table_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Provenance of all input tables by area and year: they are views of the cells."""
    places = cells(spark, sf).select("geo_code", "period", "y").distinct()
    kinds = F.array(
        *[
            F.struct(
                *[F.lit(v).alias(k) for k, v in zip(("table_name", "source", "dataset_code", "vintage"), (name, *spec))],
                F.lit(f"https://example.org/{spec[1]}").alias("source_url"),
                (F.lit(spec[3]) <= F.col("y")).alias("_late"),
                (F.lit(spec[4]) == F.col("y")).alias("break_in_series"),
            )
            for name, spec in TABLES.items()
        ]
    )
    rows = places.select("geo_code", "period", F.inline(kinds)).withColumns(
        {
            "geo_vintage": F.lit("GRID1"),
            "status": F.when(F.col("_late"), "provisional").otherwise("final"),
            "retrieved_at": F.concat("vintage", F.lit(" 04:05:06")).cast("timestamp"),
        }
    )
    parts = [pv.marks(rows.where(F.col("table_name") == name), name) for name in TABLES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rows(
    df: DataFrame, formula: str | Column, definition: str | Column, nature: str = "derived", **columns: Column | str
) -> DataFrame:
    """Columns of a derived value; those not given are its own or those of a total."""
    own = {c: F.col(c) for c in ("geo_code", "period", "sex", "age", "interval", "value") if c in df.columns}
    rest = {"sex": F.lit("total"), "age": F.lit("total"), "interval": F.lit(None).cast("string")}
    all_ = rest | own | {k: F.lit(v) for k, v in columns.items()}
    all_ |= {"formula": F.lit(formula), "definition_id": F.lit(definition), "nature": F.lit(nature)}
    names = ("formula", "definition_id", "geo_code", "period", "sex", "age", "interval", "nature", "value")
    return df.select(*[all_[c].alias(c) for c in names])


def values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value derived from several tables, as its formula gives it."""
    y = F.col("y").cast("string")
    of_rate = F.element_at(
        F.create_map(
            *[F.lit(v) for pair in (("general_fertility_rate@v1", "general_fertility"),
              ("gross_reproduction_rate@v1", "gross_reproduction"), ("net_reproduction_rate@v1", "net_reproduction"))
              for v in pair]
        ),
        F.col("definition_id"),
    )
    deviation = F.concat("source_id", F.lit("_"), F.regexp_extract("definition_id", "_([a-z]+)@", 1))
    order = F.concat(F.lit("total_fertility_rate_order_"), F.substring("order", 1, 1), F.lit("@v1"))
    frames = [
        _rows(mortality.prospective(spark, sf), "prospective_ratio", "prospective_old_age_dependency@v1"),
        _rows(mortality.arriaga(spark, sf), "life_expectancy_change", "life_expectancy_change_by_age@v1"),
        _rows(mortality.kitagawa(spark, sf), "births_change", F.concat(F.lit("births_change_"), "part", F.lit("@v1"))),
        _rows(mortality.by_order(spark, sf), "fertility_by_order", order, value=F.col("tfr")),
        _rows(mortality.reproduction(spark, sf), of_rate, F.col("definition_id")),
        _rows(mortality.net_migration(spark, sf), "net_migration", "net_migration_by_age@v1", period=y, age=age_label("x")),
        _rows(mortality.economic(spark, sf), "economic_dependency", "economic_old_age_dependency@v1"),
        _rows(timeseries.nowcast(spark, sf), "births_nowcast", "live_births_nowcast@v1", "projected", period=y),
        _rows(timeseries.deviation(spark, sf), deviation, F.col("definition_id")),
        _rows(models.momentum(spark, sf), "population_momentum", "population_momentum@v1"),
        _rows(models.intrinsic(spark, sf), "intrinsic_growth", "intrinsic_growth_rate@v1"),
        _rows(
            models.fan(spark, sf), "life_expectancy_fan", "life_expectancy@v1", "projected",
            period=(F.col("h") + int(JUMP_OFF)).cast("string"), age=F.col("x").cast("string"),
        ),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def observations(spark: SparkSession, sf: str) -> DataFrame:
    with shared_cells(spark, sf):
        inputs = pv.inputs_frame(spark, FORMULAS)
        return pv.derived(values(spark, sf), inputs, table_marks(spark, sf), definitions(spark))


def _select(
    name: str, formula: str, definition: str, tables: tuple[str, ...], late: str = "false", broken: str = "false",
    nature: str = "derived", where: str = "true", **columns: str,
) -> str:
    """SQL of a formula's rows; `late` and `broken` are conditions on y, the year of the value."""
    of = [TABLES[t] for t in tables]
    cols = {"period": "period", "sex": "'total'", "age": "'total'", "interval": "NULL::VARCHAR", "value": "value"} | columns
    sources = " + ".join(dict.fromkeys(t[0] for t in of))
    return f"""SELECT {definition} AS definition_id, geo_code, {cols["period"]} AS period, {cols["sex"]} AS sex,
      {cols["age"]} AS age, {cols["interval"]} AS interval, {cols["value"]} AS value, '{formula}@0.1' AS transform_version,
      '{sources}' AS source, '{"+".join(t[1] for t in of)}' AS dataset_code, 'https://example.org/{of[0][1]}' AS source_url,
      'GRID1' AS geo_vintage, '{max(t[2] for t in of)}' AS vintage, '{nature}' AS nature,
      CASE WHEN {late} THEN 'provisional' ELSE 'final' END AS status, {broken} AS break_in_series
      FROM (SELECT *, CAST({cols["period"]} AS INT) AS year FROM ({ORACLES[name]})) WHERE {cols["value"]} IS NOT NULL AND {where}"""


PARTS = (
    _select("F05_prospective_ratio", "prospective_ratio", "'prospective_old_age_dependency@v1'",
            ("population", "deaths"), "year = 2001", "year = 1998"),
    _select("F06_arriaga", "life_expectancy_change", "'life_expectancy_change_by_age@v1'", ("deaths",), sex="sex", age="age"),
    _select("F07_kitagawa_births", "births_change", "'births_change_' || part || '@v1'", ("births", "population"),
            "year >= 2000", "year BETWEEN 1997 AND 1999", age="age"),
    _select("F08_rates_by_order", "fertility_by_order", "'total_fertility_rate_order_' || \"order\"[1] || '@v1'",
            ("births",), "year = 2001", value="tfr"),
    _select("F09_reproduction_rates", "general_fertility", "definition_id", ("births", "population"), "year >= 2000",
            "year IN (1997, 1998)", where="definition_id LIKE 'general%'"),
    _select("F09_reproduction_rates", "gross_reproduction", "definition_id", ("births",), "year = 2001",
            where="definition_id LIKE 'gross%'"),
    _select("F09_reproduction_rates", "net_reproduction", "definition_id", ("births", "deaths"), "year = 2001",
            where="definition_id LIKE 'net%'"),
    _select("F10_net_migration", "net_migration", "'net_migration_by_age@v1'", ("population", "births", "deaths"),
            "year >= 2000", "year IN (1997, 1998)", period="CAST(y AS VARCHAR)", sex="sex",
            age="CASE WHEN x = 49 THEN '49+' ELSE CAST(x AS VARCHAR) END"),
    _select("F11_economic_dependency", "economic_dependency", "'economic_old_age_dependency@v1'",
            ("population", "labour"), "year = 2001", "year IN (1997, 1998)"),
    _select("F15_nowcast", "births_nowcast", "'live_births_nowcast@v1'", ("months",), "year = 2001", nature="projected",
            period="CAST(y AS VARCHAR)", interval="interval"),
    *[
        _select("F16_projection_deviation", f"P{base}_{kind}", "definition_id", (f"P{base}", "population"),
                "year = 2001", "year = 1998" + (" OR true" if kind == "change" and base == 1998 else ""),
                where=f"source_id = 'P{base}' AND definition_id LIKE '%{kind}%'")
        for base in PROJECTED_FROM for kind in ("level", "change")
    ],
    _select("H05_population_momentum", "population_momentum", "'population_momentum@v1'",
            ("population", "births", "deaths"), "year = 2001", "year = 1998", sex="sex"),
    _select("H06_intrinsic_growth", "intrinsic_growth", "'intrinsic_growth_rate@v1'", ("births", "deaths"), "year = 2001"),
    _select("H13_lc_fan", "life_expectancy_fan", "'life_expectancy@v1'", ("deaths",), nature="projected",
            period="CAST(1999 + h AS VARCHAR)", sex="sex", age="CAST(x AS VARCHAR)", interval="interval"),
)
ALL_SQL = "\nUNION ALL ".join(PARTS)
DEFINED = ", ".join(f"('{d}', '{m}', '{u}')" for d, m, u in DEFINITIONS)


@query(
    "I05_derived_observations",
    f"""SELECT d.metric, o.definition_id, geo_code, geo_vintage, period, sex, age, value, d.unit, source, dataset_code,
    source_url, vintage, CAST(vintage || ' 04:05:06' AS TIMESTAMP) AS retrieved_at, transform_version, nature, status,
    break_in_series, NULL::VARCHAR AS scenario_id, interval FROM ({ALL_SQL}) o
    JOIN (VALUES {DEFINED}) AS d(definition_id, metric, unit) ON d.definition_id = o.definition_id""",
)
def derived_observations(spark: SparkSession, sf: str) -> DataFrame:
    """All values that several tables give, with their provenance combined, as rows of the contract."""
    return observations(spark, sf).select(*COLUMNS)


@query(
    "I05_violations",
    f"SELECT 'geo_code length' AS rule, count(*) AS n FROM ({ALL_SQL}) WHERE geo_code = 'W' HAVING count(*) > 0",
)
def derived_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing but the code of the whole, which is one letter, breaks the contract."""
    return violations(observations(spark, sf), definitions(spark))
