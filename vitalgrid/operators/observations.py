"""From computed values to rows of the observations contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions import decode as d
from vitalgrid.functions.frames import values_frame
from vitalgrid.operators.harmonize import attach_definition, definition_columns
from vitalgrid.schema import OBSERVATION
from vitalgrid.sources.cubes import prefix_filter, select_slice

# Sex codes of the cubes.
SEX_CODES = {"T": "total", "M": "male", "F": "female"}


def to_observations(
    df: DataFrame,
    definitions: DataFrame,
    transform_version: str | Column,
    nature: str | Column = "derived",
    definition_id: str | None = None,
    **constants: object,
) -> DataFrame:
    """Rows of the contract from values with ``provisional`` and ``break_in_series``: metric and
    unit by definition (one for all rows if ``definition_id`` is given, else each row's own),
    status from the flag, other missing columns from ``constants`` or null. Version and nature are one for
    all rows, or columns.
    """
    cols: dict[str, Column] = {k: F.lit(v) for k, v in constants.items()}
    cols["transform_version"] = F.lit(transform_version)
    cols["nature"] = F.lit(nature)
    if "provisional" in df.columns:
        cols["status"] = F.when(F.col("provisional"), "provisional").otherwise("final")
    if definition_id is None:
        return _contract(attach_definition(df.withColumns(cols), definitions))
    return _contract(df.withColumns(cols | definition_columns(definitions, definition_id)))


def _contract(rows: DataFrame, *before: str) -> DataFrame:
    """The twenty columns with their types, after the columns ``before``; those the rows lack are null."""
    return rows.select(
        *before,
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in OBSERVATION
        ],
    )


@dataclass(frozen=True)
class Series:
    """One metric of one cube: what to select, and what the source gives in its code instead
    of a dimension (``fixed``)."""

    definition_id: str
    nature: str
    geo_vintage: str
    select: Mapping[str, str] = field(default_factory=dict)
    fixed: Mapping[str, str] = field(default_factory=dict)
    geo_prefix: str = ""


def read_series(
    cube: DataFrame, series: Series, definitions: DataFrame, provenance: Mapping[str, object]
) -> DataFrame:
    """A metric of an exploded cube (doc_id, updated, dimensions, value, flag) as observations.

    The slice and the area prefix are filters before anything is decoded, so a code is decoded,
    or is an error, only where its value is used."""
    rows = prefix_filter(select_slice(cube, series.select), series.geo_prefix)
    rows = d.resolve_open_age(_with_totals(rows))
    cols = _decoded(F.lit(series.geo_vintage), F.lit(series.nature))
    cols |= {k: F.lit(v) for k, v in series.fixed.items()}
    rows = rows.select(*[c.alias(k) for k, c in cols.items()]).withColumns(
        {k: F.lit(v) for k, v in provenance.items()}
        | definition_columns(definitions, series.definition_id)
    )
    return _contract(rows)


def _with_totals(rows: DataFrame) -> DataFrame:
    """Sex and age of cubes without these dimensions are totals."""
    missing = {"sex": F.lit("T"), "age": F.lit("TOTAL")}
    return rows.withColumns({k: v for k, v in missing.items() if k not in rows.columns})


def _decoded(geo_vintage: Column, nature: Column) -> dict[str, Column]:
    """Columns of the contract from the coordinates, value and flag of a cell."""
    value, flag = F.col("value"), F.col("flag")
    return {
        "geo_code": F.col("geo"),
        "geo_vintage": geo_vintage,
        "period": F.col("time"),
        "sex": d.map_strict(F.col("sex"), SEX_CODES, "sex"),
        "age": d.decode_age(F.col("age")),
        "status": d.status_of_flag(value, flag),
        "nature": d.nature_of_flag(flag, nature),
        "break_in_series": d.decode_flag(flag)["break_in_series"],
        "vintage": F.col("updated"),
        "value": d.published_value(value, flag),
    }


COORDINATES = ("geo", "time", "sex", "age")


def _routes(spark: SparkSession, catalogue: Mapping[str, Series]) -> DataFrame:
    """One row per series: the dimensions it fixes (``_kind``), their codes, and what its rows get."""
    dims = _routed_dims(catalogue)
    fixed = sorted({k for s in catalogue.values() for k in s.fixed})
    names = ("series", "_kind", *[f"_code_{k}" for k in dims], "_prefix", "_vintage", "_nature", "definition_id",
             *[f"_fixed_{k}" for k in fixed])
    data = [
        (name, ",".join(sorted(s.select)), *[s.select.get(k, "") for k in dims], s.geo_prefix, s.geo_vintage, s.nature,
         s.definition_id, *[s.fixed.get(k) for k in fixed])
        for name, s in catalogue.items()
    ]
    typed = values_frame(spark, names, data)
    return typed.withColumns({k: F.col(k).cast("string") for k in names})


def _routed_dims(catalogue: Mapping[str, Series]) -> list[str]:
    return sorted({k for s in catalogue.values() for k in s.select})


def route(cube: DataFrame, catalogue: Mapping[str, Series]) -> DataFrame:
    """The cells of an exploded cube that each series wants, with the series' name.

    A series fixes some dimensions and leaves the others open. Series that fix the same dimensions are of
    one kind; a cell has one key a kind, and all series that want it meet it in one equi-join, however
    many there are. Cells that no kind can want are filtered before, so that filter reaches the scan.
    """
    dims = _routed_dims(catalogue)
    unknown = [k for k in dims if k not in cube.columns]
    if unknown:
        raise ValueError(f"the cube has no dimension {', '.join(unknown)}")
    kinds = sorted({tuple(sorted(s.select)) for s in catalogue.values()})
    keys, wanted = [], F.lit(False)
    for kind in kinds:
        codes = [(F.col(k) if k in kind else F.lit("")).alias(f"_code_{k}") for k in dims]
        keys.append(F.struct(F.lit(",".join(kind)).alias("_kind"), *codes))
        of_kind = [s for s in catalogue.values() if tuple(sorted(s.select)) == kind]
        inside = F.lit(True)
        for k in kind:
            inside = inside & F.col(k).isin(sorted({s.select[k] for s in of_kind}))
        if all(s.geo_prefix for s in of_kind):
            starts = F.lit(False)
            for prefix in sorted({s.geo_prefix for s in of_kind}):
                starts = starts | F.col("geo").startswith(prefix)
            inside = inside & starts
        wanted = wanted | inside
    on = ["_kind", *[f"_code_{k}" for k in dims]]
    dealt = cube.where(wanted).select("*", F.inline(F.array(*keys)))
    met = dealt.join(_routes(cube.sparkSession, catalogue), on)
    return met.where(F.col("geo").startswith(F.col("_prefix"))).drop(*on, "_prefix")


def read_catalogue(
    cube: DataFrame, catalogue: Mapping[str, Series], definitions: DataFrame, provenance: Mapping[str, object]
) -> DataFrame:
    """All series of a catalogue (name: series) as observations, from one pass over an exploded cube.

    ``series`` names the series of each row, before the columns of the contract; a cell is a row of every
    series that wants it. What a series gives in its code replaces the cell's coordinate, which is then
    not decoded. A definition that does not exist is an error.
    """
    rows = _with_totals(route(cube, catalogue))
    if "age" in cube.columns:
        rows = d.resolve_open_age(rows, ("series", "geo", "time", "sex"))
    cols = _decoded(F.col("_vintage"), F.col("_nature"))
    for name in rows.columns:
        if name.startswith("_fixed_"):
            key = name.removeprefix("_fixed_")
            cols[key] = F.coalesce(name, cols[key]) if key in cols else F.col(name)
    rows = rows.select("series", "definition_id", *[c.alias(k) for k, c in cols.items()])
    names = definitions.select("definition_id", "metric", "unit")
    rows = rows.withColumns({k: F.lit(v) for k, v in provenance.items()}).join(names, "definition_id", "left")
    metric = d.required(F.col("metric").isNotNull(), F.col("metric"), "definition", F.col("definition_id"))
    rows = rows.withColumn("metric", metric)
    return _contract(rows, "series")


def catalogue_violations(cube: DataFrame, catalogue: Mapping[str, Series], dims: Sequence[str]) -> DataFrame:
    """Series without a cell in the cube, whose dimensions are ``dims``, and series that leave a dimension
    other than area, time, sex and age with several codes. One pass over the cube."""
    others = [k for k in dims if k not in COORDINATES]
    lowest = [F.min(k).alias(f"_min_{k}") for k in others]
    highest = [F.max(k).alias(f"_max_{k}") for k in others]
    found = route(cube, catalogue).groupBy("series").agg(F.count("*").alias("_n"), *lowest, *highest)
    every = _routes(cube.sparkSession, catalogue).select("series").join(found, "series", "left")
    problems = [F.when(F.col("_n").isNull(), "no cell")]
    for k in others:
        problems.append(F.when(F.col(f"_min_{k}") != F.col(f"_max_{k}"), f"several codes of {k}"))
    return every.select("series", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
