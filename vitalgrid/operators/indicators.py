"""The registry of derived indicators: inputs, formula, official precision, known exceptions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.decode import strict_cells
from vitalgrid.operators import gates
from vitalgrid.operators import structure as st
from vitalgrid.operators import timeseries as ts
from vitalgrid.operators.observations import to_observations

Formula = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Indicator:
    """An indicator as a function of named input tables of observations.

    ``decimals`` and ``input_rounding`` say how far an official value may differ;
    ``known_differences`` lists cells ('LT 2015-2020, HR 2013') where it differs for a known
    reason; ``corroboration`` are formulas over other tables that may explain a difference.
    An indicator of ``ratios`` between age groups with the bounds ``bands`` also says so, for
    :func:`compute_all` to sum up the ages once for all such indicators of a table.
    """

    definition_id: str
    transform_version: str
    inputs: tuple[str, ...]
    formula: Formula
    decimals: int = 1
    input_rounding: float = 0.0
    known_differences: str = ""
    corroboration: tuple[Formula, ...] = ()
    ratios: st.BandRatios | None = None
    bands: tuple[int, int, int] = (15, 65, 80)


def compute(indicator: Indicator, tables: Mapping[str, DataFrame], definitions: DataFrame) -> DataFrame:
    """The indicator as observations of nature derived."""
    values = indicator.formula({name: tables[name] for name in indicator.inputs})
    return to_observations(
        values, definitions, indicator.transform_version, definition_id=indicator.definition_id
    )


def check(
    indicator: Indicator, ours: DataFrame, official: DataFrame, tables: Mapping[str, DataFrame]
) -> DataFrame:
    """Cells where ours and the official value differ unexplained, and listed ones that agree."""
    spark = ours.sparkSession
    known = (
        strict_cells(ours, indicator.known_differences)
        if indicator.known_differences
        else spark.createDataFrame([], "geo_code string, period string")
    )
    others = [formula(tables) for formula in indicator.corroboration]
    return gates.reconcile_gate(
        ours, official, known, indicator.decimals, indicator.input_rounding, others
    )


def structure(
    young: int = 15, old: int = 65, oldest: int = 80, suffix: str = "", population: str = "population"
) -> dict[str, Indicator]:
    """Dependency ratios, ageing index, shares and median age from single ages, with the age
    bounds as parameters. ``suffix`` names the registry entries of another table."""
    bands = {f"0-{young - 1}": "young", f"{young}-{old - 1}": "working", f"{old}+": "old",
             f"{oldest}+": "oldest"}

    ratios: dict[str, st.BandRatios] = {
        "old_age_dependency_ratio": {"total": ("old", "working")},
        "young_age_dependency_ratio": {"total": ("young", "working")},
        "total_age_dependency_ratio": {"total": ("young + old", "working")},
        "ageing_index": {"total": ("old", "young")},
        "population_share": {label: (column, "known") for label, column in bands.items()},
    }

    def banded(name: str) -> Indicator:
        definition, version, bounds = f"{name}@v1", f"{name}@0.1", (young, old, oldest)

        def formula(tables: Mapping[str, DataFrame]) -> DataFrame:
            groups = st.age_groups(tables[population], *bounds)
            return st.band_ratios(groups, [(definition, version, ratios[name])])

        return Indicator(definition, version, (population,), formula, ratios=ratios[name], bands=bounds)

    out = {name + suffix: banded(name) for name in ratios}
    out["median_age" + suffix] = Indicator(
        "median_age@v1", "median_age@0.1", (population,), lambda t: st.median_age(t[population])
    )
    return out


def registry(
    bounds: tuple[int, int, int] = (15, 65, 80),
    widths: Mapping[str, float] | None = None,
    baseline: tuple[int, int] = (2016, 2019),
) -> dict[str, Indicator]:
    """Every derived indicator, national and regional. Input tables: population,
    population_regional, change, average, rates (fertility), deaths (weekly)."""
    widths = widths or st.fertility_widths()
    keys = ("geo_code", "sex", "age")

    def excess(tables: Mapping[str, DataFrame]) -> DataFrame:
        weekly = tables["deaths"].where("sex = 'total'")
        values = ts.excess_over_baseline(ts.weeks_to_months(weekly, keys), keys, *baseline)
        passed = weekly.groupBy(*keys).agg(*st.carry())
        return values.join(passed, list(keys))

    out = structure(*bounds)
    out |= structure(*bounds, suffix="_regional", population="population_regional")
    out["population_growth_rate"] = Indicator(
        "population_growth_rate@v1", "population_growth_rate@0.1", ("change", "average"),
        lambda t: st.growth_rate(t["change"], t["average"]),
    )
    out["total_fertility_rate"] = Indicator(
        "total_fertility_rate@v1", "total_fertility_rate@0.1", ("rates",),
        lambda t: st.total_fertility(t["rates"], widths),
        decimals=2, input_rounding=sum(widths.values()) * 0.000005,
    )
    out["excess_mortality"] = Indicator(
        "excess_mortality@v1", "excess_mortality@0.1", ("deaths",), excess
    )
    for suffix in ("", "_regional"):
        table = "population" + suffix
        out["sex_ratio" + suffix] = Indicator(
            "sex_ratio@v1", "sex_ratio@0.1", (table,), lambda t, n=table: st.sex_ratio(t[n])
        )
    return out


def compute_all(
    indicators: Mapping[str, Indicator], tables: Mapping[str, DataFrame], definitions: DataFrame
) -> DataFrame:
    """Several indicators in one table. Those that are ratios of the same age groups of the same table share
    one aggregation and are rows of one frame."""
    shared: dict[tuple[str, tuple[int, int, int]], list[Indicator]] = {}
    frames: list[DataFrame] = []
    for indicator in indicators.values():
        if indicator.ratios is None:
            frames.append(compute(indicator, tables, definitions))
        else:
            shared.setdefault((indicator.inputs[0], indicator.bands), []).append(indicator)
    for (table, bands), members in shared.items():
        wanted = [(i.definition_id, i.transform_version, i.ratios or {}) for i in members]
        rows = st.band_ratios(st.age_groups(tables[table], *bands), wanted)
        frames.append(to_observations(rows, definitions, F.col("transform_version")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
