"""The registry: indicators of the same age groups share one aggregation."""

from __future__ import annotations

from tests.conftest import rows
from vitalgrid.functions.frames import written
from vitalgrid.operators import indicators as ind
from vitalgrid.plans.views import population
from vitalgrid.schema import definitions


def test_shared_groups_equal_single_indicators(spark, sf):
    pop = written(population(spark, sf), "population")
    tables = {"population": pop.where("geo_code = 'W'"), "population_regional": pop.where("geo_code = 'W1'")}
    chosen = ind.structure() | ind.structure(suffix="_regional", population="population_regional")
    # other bounds of the same table are another aggregation
    chosen |= ind.structure(20, 70, 90, suffix="_wide")
    together = ind.compute_all(chosen, tables, definitions(spark))
    keys = ("definition_id", "transform_version", "geo_code", "period", "sex", "age", "value", "status", "source")
    single = None
    for one in chosen.values():
        frame = ind.compute(one, tables, definitions(spark))
        single = frame if single is None else single.unionByName(frame)
    assert together.columns == single.columns
    assert rows(together.select(*keys)) == rows(single.select(*keys))

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    # one for the age groups and one for the median of each of three groups, instead of six each
    assert (scans(together), scans(single)) == (6, 18)
