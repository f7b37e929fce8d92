"""Decoders of source codes: flags, ages, labels, numbers. All are column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Status letters before the pipe, confidentiality letters after it.
FLAG_PATTERN = r"^[bepiu]*(\|[NC]*)?$"
AGE_CODE_PATTERN = r"^(TOTAL|UNK|Y_LT\d+|Y\d+|Y\d+-\d+|Y_GE\d+)$"
# Latin capitals that look like Greek ones, and the Greek ones.
LATIN_LOOKALIKES = "ABEZHIKMNOPTXY"
GREEK_LOOKALIKES = "ΑΒΕΖΗΙΚΜΝΟΡΤΧΥ"


def required(ok: Column, value: Column, what: str, shown: Column) -> Column:
    """``value`` where ``ok``, else an error that shows the offending code.

    The error sits in the branch that yields the value, so it cannot be pruned while the
    value is used, nor raised for rows a filter removes.
    """
    message = F.concat(F.lit(f"unknown {what}: "), F.coalesce(shown.cast("string"), F.lit("null")))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(message))


def flag_is_known(flag: Column) -> Column:
    return F.coalesce(flag, F.lit("")).rlike(FLAG_PATTERN)


def decode_flag(flag: Column) -> Column:
    """A flag as struct(provisional, estimated, break_in_series)."""
    text = F.coalesce(flag, F.lit(""))
    letters = F.substring_index(text, "|", 1)
    meaning = F.struct(
        letters.contains("p").alias("provisional"),
        letters.rlike("[ei]").alias("estimated"),
        letters.contains("b").alias("break_in_series"),
    )
    return required(flag_is_known(flag), meaning, "flag", flag)


def low_reliability(flag: Column) -> Column:
    return F.coalesce(flag, F.lit("")).contains("u")


def published_value(value: Column, flag: Column) -> Column:
    """The value, or null where the flag says it is of low reliability."""
    return F.when(~low_reliability(flag), value)


def status_of_flag(value: Column, flag: Column) -> Column:
    """not_available without a publishable value, else provisional or final."""
    missing = value.isNull() | low_reliability(flag)
    return (
        F.when(missing, "not_available")
        .when(decode_flag(flag)["provisional"], "provisional")
        .otherwise("final")
    )


def nature_of_flag(flag: Column, nature: str | Column) -> Column:
    """An estimated flag makes an observed value an official estimate; others keep theirs."""
    given = F.lit(nature)
    estimated = decode_flag(flag)["estimated"] & (given == "observed")
    return F.when(estimated, "official_estimate").otherwise(given)


def age_code_is_known(code: Column) -> Column:
    return F.coalesce(code.rlike(AGE_CODE_PATTERN), F.lit(False))


def decode_age(code: Column) -> Column:
    """A source age code as a contract age; any other code is an error."""

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(code, pattern, i)

    below = group(r"^Y_LT(\d+)$", 1).try_cast("int")
    age = (
        F.when(code == "TOTAL", "total")
        .when(code == "UNK", "unknown")
        .when(code == "Y_LT1", "0")
        .when(below.isNotNull(), F.concat(F.lit("0-"), (below - 1).cast("string")))
        .when(code.rlike(r"^Y\d+$"), group(r"^Y(\d+)$", 1))
        .when(code.rlike(r"^Y\d+-\d+$"), group(r"^Y(\d+-\d+)$", 1))
        .when(code.rlike(r"^Y_GE\d+$"), F.concat(group(r"^Y_GE(\d+)$", 1), F.lit("+")))
    )
    return required(age_code_is_known(code), age, "age code", code)


def resolve_open_age(
    cube: DataFrame, by: tuple[str, ...] = ("geo", "time", "sex"), age: str = "age"
) -> DataFrame:
    """Y_OPEN as Y_GEk, k one above the highest single age with a value in the same cell
    group; open rows without a value or without such an age are dropped.

    A window: its partition is the ages of one area, year and sex of a cube.
    """
    code = F.col(age)
    single = F.when(F.col("value").isNotNull(), F.regexp_extract(code, r"^Y(\d+)$", 1).try_cast("int"))
    bound = F.max(single).over(Window.partitionBy(*by)) + 1
    is_open = code == "Y_OPEN"
    return (
        cube.withColumn("_bound", bound)
        .where(~is_open | (F.col("value").isNotNull() & F.col("_bound").isNotNull()))
        .withColumn(
            age, F.when(is_open, F.concat(F.lit("Y_GE"), F.col("_bound").cast("string"))).otherwise(code)
        )
        .drop("_bound")
    )


class Age:
    """Parts of a contract age: first and last year, and whether the last is open."""

    def __init__(self, age: Column) -> None:
        self.lo = F.regexp_extract(age, r"^(\d+)", 1).try_cast("int")
        upper = F.regexp_extract(age, r"^\d+-(\d+)$", 1).try_cast("int")
        self.is_open = F.coalesce(age.endswith("+"), F.lit(False))
        self.hi = F.coalesce(upper, F.when(age.rlike(r"^\d+$"), self.lo))
        self.width = self.hi - self.lo + 1


def parse_age(age: Column) -> Age:
    return Age(age)


def mapping(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for item in pairs.items() for v in item])


def map_strict(code: Column, pairs: Mapping[str, str], what: str = "code") -> Column:
    """The value of a code in a small dictionary; a code outside it is an error."""
    value = F.try_element_at(mapping(pairs), code)
    return required(value.isNotNull(), value, what, code)


def map_or_keep(code: Column, exceptions: Mapping[str, str]) -> Column:
    """The listed exceptions replaced, every other code as it is."""
    return F.coalesce(F.try_element_at(mapping(exceptions), code), code)


def normalise_label(text: Column) -> Column:
    """Upper case, without trailing footnote markers, commas and ampersands; single spaces."""
    upper = F.regexp_replace(F.upper(text), r"[\s\d*()\[\]]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(upper, "[,&]", " "), r"\s+", " "))


@F.pandas_udf(T.StringType())
def _fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition, accents dropped, case folded: Spark has no built-in for
    Unicode normalisation, so Arrow batches pass through the standard library."""
    import re
    import unicodedata

    other = re.compile(r"[^\x00-\x7f]+")

    def bare(run: re.Match[str]) -> str:
        return "".join(c for c in run.group() if not unicodedata.combining(c))

    def one(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text and text.lower()
        return other.sub(bare, unicodedata.normalize("NFKD", text)).casefold()

    for part in parts:
        yield part.map(one)


def normalise_text(text: Column) -> Column:
    """Text for comparison: case, accents and punctuation do not count."""
    # only text with other characters leaves the JVM
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    words = F.regexp_replace(F.coalesce(_fold(other), F.lower(text)), r"(?U)[^\w]+", " ")
    return F.trim(words)


def fix_lookalikes(name: Column) -> Column:
    """Latin capitals that look Greek, written in Greek."""
    return F.translate(name, LATIN_LOOKALIKES, GREEK_LOOKALIKES)


def has_latin(name: Column) -> Column:
    """True where a Latin letter is left, i.e. the name is not Greek."""
    return name.rlike("[A-Za-z]")


def round_half_up_percent(part: Column, whole: Column) -> Column:
    """part / whole in % to one decimal, halves up."""
    return F.floor(F.try_divide(part * 1000, whole) + 0.5) / 10


def localised_count(text: Column, dash_is_zero: bool = True) -> Column:
    """'1.234' as 1234; '-' as zero, or as null where it means not available."""
    number = F.regexp_replace(text, r"\.", "").try_cast("double")
    dash = F.lit(0.0) if dash_is_zero else F.lit(None).cast("double")
    return F.when(text == "-", dash).otherwise(number)


def localised_decimal(text: Column) -> Column:
    """'12,3' as 12.3."""
    return F.regexp_replace(text, ",", ".").try_cast("double")


def date_of_vintage(vintage: Column) -> Column:
    """A vintage that is a timestamp as its date; others as given."""
    is_stamp = vintage.rlike(r"^\d{4}-\d{2}-\d{2}T")
    return F.when(is_stamp, F.substring(vintage, 1, 10)).otherwise(vintage)


def cells_of(spec: str) -> Column:
    """'LT 2015-2020, HR 2013' as an array of (geo_code, period) structs."""
    items = F.split(F.lit(spec), r"\s*,\s*")

    def expand(item: Column) -> Column:
        geo, years = F.split_part(item, F.lit(" "), F.lit(1)), F.split_part(item, F.lit(" "), F.lit(2))
        first = F.split_part(years, F.lit("-"), F.lit(1)).cast("int")
        last = F.coalesce(F.nullif(F.split_part(years, F.lit("-"), F.lit(2)), F.lit("")).cast("int"), first)
        return F.transform(
            F.sequence(first, last),
            lambda y: F.struct(geo.alias("geo_code"), y.cast("string").alias("period")),
        )

    return F.flatten(F.transform(items, expand))


def strict_cells(df: DataFrame, spec: str) -> DataFrame:
    """The cells of a specification as a frame (geo_code, period)."""
    return df.sparkSession.range(1).select(F.inline(F.array_distinct(cells_of(spec))))
