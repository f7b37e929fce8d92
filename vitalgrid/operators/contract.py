"""The contract of the observations table, as frames of violations.

Each rule returns the offending rows or keys, so a check of any size stays distributed; only
:func:`validate` looks at the result, and only at how often each rule is broken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.functions.decode import parse_age
from vitalgrid.schema import (
    AGE_PATTERN,
    DEFINITION_ID_PATTERN,
    INTERVALS,
    KEY,
    NATURES,
    OBSERVATION,
    PERIOD_PATTERN,
    SEXES,
    STATUSES,
)


class ContractError(ValueError):
    """An observations table breaks its contract; the message names every broken rule."""


def _filled(column: str, n: int = 1) -> Column:
    return F.length(column) >= n


def field_rules() -> dict[str, Column]:
    """Rule name -> what must hold of a row. A null never satisfies a rule of a required
    column."""
    rules = {
        f"{c} is required": _filled(c)
        for c in (
            "metric", "geo_vintage", "unit", "source", "dataset_code", "vintage",
            "transform_version",
        )
    }
    rules |= {
        "definition_id format": F.col("definition_id").rlike(DEFINITION_ID_PATTERN),
        "geo_code length": _filled("geo_code", 2),
        "period format": F.col("period").rlike(PERIOD_PATTERN),
        "sex vocabulary": F.col("sex").isin(*SEXES),
        "age format": F.col("age").rlike(AGE_PATTERN),
        "source_url prefix": F.col("source_url").startswith("https://"),
        "retrieved_at is required": F.col("retrieved_at").isNotNull(),
        "nature vocabulary": F.col("nature").isin(*NATURES),
        "status vocabulary": F.col("status").isin(*STATUSES),
        "break_in_series is required": F.col("break_in_series").isNotNull(),
        "interval vocabulary": F.col("interval").isNull() | F.col("interval").isin(*INTERVALS),
    }
    return rules


def _broken(obs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The key of each row and one output row per rule it breaks. A projection: no shuffle."""
    failing = F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
        )
    )
    return obs.select(*KEY, F.explode(failing).alias("rule"))


def field_violations(obs: DataFrame) -> DataFrame:
    return _broken(obs, field_rules())


def schema_violations(obs: DataFrame) -> list[str]:
    """Names and types that differ from the contract, on the driver: no data is read."""
    want = {f.name: f.dataType for f in OBSERVATION}
    have = {f.name: f.dataType for f in obs.schema}
    out = [f"missing column {c}" for c in want if c not in have]
    out += [f"undeclared column {c}" for c in have if c not in want]
    for c, t in want.items():
        if c in have and not isinstance(have[c], type(t)):
            out.append(f"{c}: {have[c].simpleString()} instead of {t.simpleString()}")
    return out


def availability_violations(obs: DataFrame) -> DataFrame:
    """A value is null exactly when its status is not_available."""
    ok = F.col("value").isNull().eqNullSafe(F.col("status") == "not_available")
    return _broken(obs, {"value null iff not_available": ok})


def scenario_violations(obs: DataFrame) -> DataFrame:
    """scenario_id is set exactly when the nature is scenario."""
    ok = F.col("scenario_id").isNotNull().eqNullSafe(F.col("nature") == "scenario")
    return _broken(obs, {"scenario_id iff scenario": ok})


def age_band_violations(obs: DataFrame) -> DataFrame:
    """A band runs from a lower to a higher age."""
    age = parse_age(F.col("age"))
    ok = ~F.col("age").contains("-") | (age.lo < age.hi) | age.hi.isNull()
    return _broken(obs, {"age band order": ok})


def definition_violations(obs: DataFrame, definitions: DataFrame) -> DataFrame:
    """definition_id, metric and unit are those of a definition."""
    cols = ["definition_id", "metric", "unit"]
    unknown = obs.join(definitions.select(*cols), cols, "left_anti")
    return unknown.select(*KEY, F.lit("definition match").alias("rule"))


def interval_violations(obs: DataFrame) -> DataFrame:
    """Bounds without a central value or without the opposite bound of their level, or with
    the lower above the upper; one row per key and level.

    One aggregation with partial combine instead of three self-joins, so a key repeated over
    and over costs no more than any other.
    """
    keys = [k for k in KEY if k != "interval"]

    def bound(level: str, side: str) -> Column:
        return F.col("interval") == f"{level}_{side}"

    aggs = [F.bool_or(F.col("interval").isNull()).alias("central")]
    for level in ("80", "95"):
        for side in ("lower", "upper"):
            here = bound(level, side)
            aggs += [
                F.count_if(here).alias(f"n_{side}_{level}"),
                F.max(F.when(here, F.col("value"))).alias(f"{side}_{level}"),
            ]
    levels = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                F.col(f"n_lower_{level}").alias("n_lower"),
                F.col(f"n_upper_{level}").alias("n_upper"),
                F.coalesce(F.col(f"lower_{level}") <= F.col(f"upper_{level}"), F.lit(True)).alias(
                    "ordered"
                ),
            )
            for level in ("80", "95")
        ]
    )
    return (
        obs.groupBy(*keys)
        .agg(*aggs)
        .select(*keys, "central", F.inline(levels))
        .where("n_lower + n_upper > 0")
        .where(~(F.col("central") & (F.col("n_lower") > 0) & (F.col("n_upper") > 0)
                 & F.col("ordered")))
        .select(*keys, "level", (F.col("n_lower") + F.col("n_upper")).alias("n"))
    )


def duplicate_keys(obs: DataFrame) -> DataFrame:
    """Keys held by more than one row (null equals null). Partial counts meet per key, so the
    shuffle carries one row per key and task however often a key repeats."""
    return obs.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def row_rules() -> dict[str, Column]:
    """All rules that a row keeps or breaks by itself; `_known` says whether its definition exists."""
    rules = field_rules()
    age = parse_age(F.col("age"))
    rules["value null iff not_available"] = (
        F.col("value").isNull().eqNullSafe(F.col("status") == "not_available")
    )
    rules["scenario_id iff scenario"] = (
        F.col("scenario_id").isNotNull().eqNullSafe(F.col("nature") == "scenario")
    )
    rules["age band order"] = (
        ~F.col("age").contains("-") | (age.lo < age.hi) | age.hi.isNull()
    )
    rules["definition match"] = F.col("_known")
    return rules


def with_known(obs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds `_known`: true where definition_id, metric and unit are those of a definition, else null."""
    cols = ["definition_id", "metric", "unit"]
    return obs.join(definitions.select(*cols, F.lit(True).alias("_known")), cols, "left")


def violations(obs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Every broken rule with its number of rows, all rules in one result."""
    one = F.lit(1).cast("long").alias("n")
    rows = _broken(with_known(obs, definitions), row_rules()).select("rule", one)
    return rows.unionByName(_key_rules(obs)).groupBy("rule").agg(F.sum("n").alias("n"))


def _key_rules(obs: DataFrame) -> DataFrame:
    """Repeated keys and unpaired intervals together: both follow from the number of rows per
    interval of a key, so one aggregation and one shuffle serve both rules."""
    keys = [k for k in KEY if k != "interval"]
    interval, value = F.col("interval"), F.col("value")
    aggs = [F.count_if(interval.isNull()).alias("n_central"), F.count("*").alias("n_all")]
    for name in INTERVALS:
        here = interval == name
        aggs += [F.count_if(here).alias(f"n_{name}"), F.max(F.when(here, value)).alias(f"v_{name}")]

    def repeated(n: str) -> Column:
        return F.when(F.col(n) > 1, F.col(n)).otherwise(0)

    def unpaired(level: str) -> Column:
        lower, upper = F.col(f"n_{level}_lower"), F.col(f"n_{level}_upper")
        ordered = F.coalesce(F.col(f"v_{level}_lower") <= F.col(f"v_{level}_upper"), F.lit(True))
        good = (F.col("n_central") > 0) & (lower > 0) & (upper > 0) & ordered
        return F.when(good, 0).otherwise(lower + upper)

    # an interval outside the vocabulary is a key of its own
    other = F.when(~interval.isin(*INTERVALS), interval)
    strange = F.when(F.col("_other").isNotNull(), repeated("n_all")).otherwise(0)
    twice = strange + repeated("n_central")
    for name in INTERVALS:
        twice = twice + repeated(f"n_{name}")
    found = F.array(
        F.struct(F.lit("unique key").alias("rule"), twice.cast("long").alias("n")),
        F.struct(
            F.lit("interval pair").alias("rule"),
            (unpaired("80") + unpaired("95")).cast("long").alias("n"),
        ),
    )
    return (
        obs.withColumn("_other", other)
        .groupBy(*keys, "_other")
        .agg(*aggs)
        .select(F.inline(found))
        .where("n > 0")
    )


def key_rules_of_row(by: Sequence[str] = ()) -> dict[str, Column]:
    """The rules on keys as columns of each row, by windows over `by` and the key without its interval:
    rows dealt by `by` alone need no further exchange. A rule holds unless a row repeats a key, or is a bound
    without centre or counterpart, or out of order."""
    same = Window.partitionBy(*by, *[k for k in KEY if k != "interval"])
    interval, value = F.col("interval"), F.col("value")

    def count(condition: Column) -> Column:
        return F.count_if(condition).over(same)

    alone = F.when(interval.isNull(), count(interval.isNull()) == 1)
    paired = F.when(interval.isNull(), F.lit(True))
    for level in ("80", "95"):
        lower, upper = interval == f"{level}_lower", interval == f"{level}_upper"
        ordered = F.max(F.when(lower, value)).over(same) <= F.max(F.when(upper, value)).over(same)
        both = (count(lower) > 0) & (count(upper) > 0) & (count(interval.isNull()) > 0)
        paired = paired.when(lower | upper, both & F.coalesce(ordered, F.lit(True)))
        alone = alone.when(lower, count(lower) == 1).when(upper, count(upper) == 1)
    # an interval outside the vocabulary is one key with its like
    strange = ~interval.isin(*INTERVALS)
    other = Window.partitionBy(*by, *KEY)
    return {
        "unique key": alone.when(strange, F.count("*").over(other) == 1),
        "interval pair": paired.otherwise(True),
    }


def validate(obs: DataFrame, definitions: DataFrame) -> DataFrame:
    """``obs`` unchanged, or a :class:`ContractError` that lists every broken rule.

    An action. It reads at most one row per rule back to the driver.
    """
    problems = schema_violations(obs)
    if not problems:
        broken = violations(obs, definitions).orderBy("rule").collect()
        problems = [f"{r['rule']}: {r['n']} rows" for r in broken]
    if problems:
        raise ContractError("; ".join(problems))
    return obs


def chart_input_violations(rows: DataFrame, by: Sequence[str], focus: str) -> DataFrame:
    """Rules of a chart's rows, per chart (``by``): one unit, a finite number exactly where
    a value is available, and the focus area among the rows."""
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    wrong = F.when(F.col("status") == "not_available", value.isNotNull()).otherwise(~finite)
    found = rows.groupBy(*by).agg(
        F.min("unit").alias("_u0"),
        F.max("unit").alias("_u1"),
        F.count_if(wrong).alias("_wrong"),
        F.bool_or(F.col("geo_code") == focus).alias("_focus"),
    )
    failing = F.array_compact(
        F.array(
            F.when(F.col("_u0") != F.col("_u1"), "one unit"),
            F.when(F.col("_wrong") > 0, "finite iff available"),
            F.when(~F.col("_focus"), "focus present"),
        )
    )
    return found.select(*by, F.explode(failing).alias("rule"))
