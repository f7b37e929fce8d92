"""Wide files: years, sexes or quantiles in columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_csv(
    spark: SparkSession, path: str, header: Sequence[str], columns: Sequence[str], **fixed: str
) -> DataFrame:
    """The named columns of (compressed) CSV files as strings, where ``fixed`` columns hold
    the given values. The schema is explicit: nothing is inferred, and unused columns are
    not parsed. A gz file is one task, so large deliveries should come as many files."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.csv(path, schema=schema, header=True)
    for column, value in fixed.items():
        rows = rows.where(F.col(column) == value)
    return rows.select(*columns)


def delivery_violations(spark: SparkSession, path: str, header: Sequence[str], **fixed: str) -> DataFrame:
    """(file, rule, n) of what is wrong with a delivery of CSV files: files without rows, rows that do not
    have the header's fields, and, with no file named, ``fixed`` values that no good row has.

    One pass over the files: rows that do not fit are kept as text in a column of their own and counted
    beside the others, by file. The list of files comes from their names, so that a file without
    any row is seen, too. A delivery without files is one row of violations.
    """

    def one_name(file: Column) -> Column:
        """A path with one slash after its scheme: Spark writes local ones with one or three."""
        return F.regexp_replace(file, "^([a-z0-9]+):/+", "$1:/").alias("file")

    fields = [T.StructField(c, T.StringType()) for c in (*header, "_malformed")]
    # pruned columns would hide rows with too many or too few fields
    options = {"header": True, "columnNameOfCorruptRecord": "_malformed", "columnPruning": False, "recursiveFileLookup": True}
    rows = spark.read.schema(T.StructType(fields)).options(**options).csv(path)
    # Spark reads the malformed text only together with a field; the length of one is never negative
    good = F.col("_malformed").isNull() & (F.coalesce(F.length(header[0]), F.lit(0)) >= 0)
    by_file = rows.select("*", one_name(F.col("_metadata.file_path"))).groupBy("file").agg(
        F.count_if(good).alias("good"),
        F.count_if(~good).alias("bad"),
        *[F.count_if(good & (F.col(c) == v)).alias(f"_of{i}") for i, (c, v) in enumerate(fixed.items())],
    )
    # the scan's own list of files; a scan leaves out those of no bytes
    files = spark.createDataFrame([(name,) for name in rows.inputFiles()], "file string").select(one_name(F.col("file")))
    found = files.join(by_file, "file", "left").na.fill(0)
    each = F.array_compact(
        F.array(
            F.when(F.col("good") + F.col("bad") == 0, F.struct(F.lit("file without rows").alias("rule"), F.lit(0).cast("long").alias("n"))),
            F.when(F.col("bad") > 0, F.struct(F.lit("malformed rows").alias("rule"), F.col("bad").alias("n"))),
        )
    )
    of_files = found.select("file", F.inline(each))
    totals = found.agg(F.count("*").alias("files"), *[F.sum(f"_of{i}").alias(f"_of{i}") for i in range(len(fixed))])
    none = [F.when(F.col("files") == 0, F.lit("delivery without files"))] + [
        F.when(F.coalesce(f"_of{i}", F.lit(0)) == 0, F.lit(f"no row of {c} {v}")) for i, (c, v) in enumerate(fixed.items())
    ]
    of_all = totals.select(
        F.lit(None).cast("string").alias("file"), F.explode(F.array_compact(F.array(*none))).alias("rule"), F.lit(0).cast("long").alias("n")
    )
    return of_files.unionByName(of_all)


def wide_years_to_long(
    sheets: Mapping[str | None, DataFrame], ids: Sequence[str], years: Sequence[str]
) -> DataFrame:
    """Year-named columns in thousands as (period, value) in units, one sheet per quantile.
    The key of a sheet is its interval, or None for the central one."""
    out: DataFrame | None = None
    for interval, sheet in sheets.items():
        long = sheet.unpivot(list(ids), list(years), "period", "value").select(
            *ids,
            "period",
            F.round(F.col("value").cast("double") * 1000).alias("value"),
            F.lit(interval).cast("string").alias("interval"),
        )
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise ValueError("no sheet given")
    return out


def wide_sex_to_long(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """One column per sex (``columns``: name -> sex) as rows, thousands as units."""
    pairs = [F.lit(x) for item in columns.items() for x in item]
    return df.unpivot(list(ids), list(columns), "_column", "value").select(
        *ids,
        F.create_map(*pairs)[F.col("_column")].alias("sex"),
        F.round(F.col("value").cast("double") * 1000).alias("value"),
    )
