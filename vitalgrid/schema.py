"""The observation contract: one published value is one row with these twenty columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vitalgrid.functions.frames import values_frame

# Vocabularies of the contract.
NATURES = ("observed", "official_estimate", "derived", "projected", "scenario")
STATUSES = ("provisional", "final", "revised", "not_available")
INTERVALS = ("80_lower", "80_upper", "95_lower", "95_upper")
SEXES = ("total", "male", "female")

# Formats of the contract (Java regular expressions).
DEFINITION_ID_PATTERN = r"^[a-z0-9_]+@v\d+$"
PERIOD_PATTERN = r"^\d{4}(-\d{2}(-\d{2})?)?$"
AGE_PATTERN = r"^(total|unknown|\d{1,3}(-\d{1,3}|\+)?)$"

OBSERVATION = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("definition_id", T.StringType()),
        T.StructField("geo_code", T.StringType()),
        T.StructField("geo_vintage", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("age", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("dataset_code", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("vintage", T.StringType()),
        T.StructField("retrieved_at", T.TimestampType()),
        T.StructField("transform_version", T.StringType()),
        T.StructField("nature", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("break_in_series", T.BooleanType()),
        T.StructField("scenario_id", T.StringType()),
        T.StructField("interval", T.StringType()),
    ]
)
COLUMNS = tuple(OBSERVATION.fieldNames())

# The columns that identify a value. scenario_id and interval may be null, and null is a key
# value: group by them, or join with eqNullSafe.
KEY = (
    "metric",
    "definition_id",
    "geo_code",
    "geo_vintage",
    "period",
    "sex",
    "age",
    "source",
    "dataset_code",
    "vintage",
    "scenario_id",
    "interval",
)

# Definition id, metric and unit of the indicators computed here.
DEFINITIONS = (
    ("population_1jan@v1", "population", "persons"),
    ("live_births@v1", "live_births", "persons"),
    ("live_births_nowcast@v1", "live_births", "persons"),
    ("old_age_dependency_ratio@v1", "old_age_dependency_ratio", "per 100 aged 15-64"),
    ("young_age_dependency_ratio@v1", "young_age_dependency_ratio", "per 100 aged 15-64"),
    ("total_age_dependency_ratio@v1", "total_age_dependency_ratio", "per 100 aged 15-64"),
    ("ageing_index@v1", "ageing_index", "aged 65+ per 100 aged 0-14"),
    ("population_share@v1", "population_share", "% of population"),
    ("median_age@v1", "median_age", "years"),
    ("population_growth_rate@v1", "population_growth_rate", "per 1000 persons"),
    ("sex_ratio@v1", "sex_ratio", "males per 100 females"),
    ("total_fertility_rate@v1", "total_fertility_rate", "live births per woman"),
    ("life_expectancy@v1", "life_expectancy", "years"),
    ("life_expectancy_change_by_age@v1", "life_expectancy_change", "years"),
    ("births_change_women@v1", "births_change_women", "persons"),
    ("births_change_fertility@v1", "births_change_fertility", "persons"),
    ("net_migration_by_age@v1", "net_migration", "persons"),
    ("old_age_threshold@v1", "old_age_threshold", "years"),
    ("general_fertility_rate@v1", "general_fertility_rate", "per 1000 women aged 15-49"),
    ("gross_reproduction_rate@v1", "gross_reproduction_rate", "daughters per woman"),
    ("net_reproduction_rate@v1", "net_reproduction_rate", "daughters per woman"),
    ("population_momentum@v1", "population_momentum", "ratio"),
    ("intrinsic_growth_rate@v1", "intrinsic_growth_rate", "% per year"),
    ("excess_mortality@v1", "excess_mortality", "% of baseline"),
    ("projection_deviation_level@v1", "projection_deviation", "% of observed"),
    ("projection_deviation_change@v1", "projection_deviation", "% of observed"),
    ("prospective_old_age_dependency@v1", "prospective_old_age_dependency", "per 100 of working age"),
    ("economic_old_age_dependency@v1", "economic_old_age_dependency", "per 100 employed"),
    *[
        (f"total_fertility_rate_order_{n}@v1", f"total_fertility_rate_order_{n}", "live births per woman")
        for n in range(1, 6)
    ],
)


def definitions(spark: SparkSession) -> DataFrame:
    """The definitions as a dimension table. Its size is fixed, so joins broadcast it."""
    return values_frame(spark, ("definition_id", "metric", "unit"), DEFINITIONS)
