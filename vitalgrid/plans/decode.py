"""Queries B: decoding and harmonisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions import decode as d
from vitalgrid.functions.frames import values_frame
from vitalgrid.operators import gates, harmonize
from vitalgrid.plans.registry import query
from vitalgrid.plans.views import PROVENANCE, cells, population, sql, table, with_provenance
from vitalgrid.schema import definitions

FLAGS = ("p", "b", "bp", "ep", "u", "i|N", "")
FLAG_SQL = "list_extract(['p', 'b', 'bp', 'ep', 'u', 'i|N', ''], l_linenumber)"


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a source flag; quantities under 3 are not published."""
    flag = F.element_at(F.array(*[F.lit(f) for f in FLAGS]), F.col("l_linenumber"))
    value = F.when(F.col("l_quantity") >= 3, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(flag.alias("flag"), value.alias("value"))


FLAGGED_SQL = f"""SELECT {FLAG_SQL} AS flag,
    CASE WHEN l_quantity >= 3 THEN l_quantity END AS value FROM lineitem"""


@query(
    "B01_decode_flag",
    f"""SELECT flag, contains(split_part(flag, '|', 1), 'p') AS provisional,
    regexp_matches(split_part(flag, '|', 1), '[ei]') AS estimated,
    contains(split_part(flag, '|', 1), 'b') AS break_in_series, count(*) AS n
    FROM ({FLAGGED_SQL}) GROUP BY ALL""",
)
def decode_flag(spark: SparkSession, sf: str) -> DataFrame:
    counts = flagged(spark, sf).groupBy("flag").agg(F.count("*").alias("n"))
    return counts.select("flag", F.expr("n"), d.decode_flag(F.col("flag")).alias("m")).select(
        "flag", "m.*", "n"
    )


@query(
    "B02_low_reliability_null",
    f"""SELECT flag, count(v) AS published, sum(v) AS total FROM (
    SELECT flag, CASE WHEN NOT contains(flag, 'u') THEN value END AS v FROM ({FLAGGED_SQL}))
    GROUP BY flag""",
)
def low_reliability(spark: SparkSession, sf: str) -> DataFrame:
    v = d.published_value(F.col("value"), F.col("flag"))
    rows = flagged(spark, sf).select("flag", v.alias("v"))
    return rows.groupBy("flag").agg(F.count("v").alias("published"), F.sum("v").alias("total"))


@query(
    "B03_status_nature",
    f"""SELECT CASE WHEN value IS NULL OR contains(flag, 'u') THEN 'not_available'
      WHEN contains(flag, 'p') THEN 'provisional' ELSE 'final' END AS status,
    CASE WHEN regexp_matches(flag, '[ei]') THEN 'official_estimate' ELSE 'observed' END
      AS nature, CASE WHEN flag = 'x' THEN '' ELSE 'derived' END AS kept, count(*) AS n
    FROM ({FLAGGED_SQL}) GROUP BY ALL""",
)
def status_nature(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("flag")
    rows = flagged(spark, sf).select(
        d.status_of_flag(F.col("value"), flag).alias("status"),
        d.nature_of_flag(flag, "observed").alias("nature"),
        d.nature_of_flag(flag, "derived").alias("kept"),
    )
    return rows.groupBy("status", "nature", "kept").agg(F.count("*").alias("n"))


def age_codes(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    forms = [
        F.lit("TOTAL"), F.lit("UNK"), F.lit("Y_LT1"), F.concat(F.lit("Y_LT"), s),
        F.concat(F.lit("Y"), s), F.concat(F.lit("Y"), s, F.lit("-"), (F.col("p_size") + 4)),
        F.concat(F.lit("Y_GE"), s),
    ]
    code = F.element_at(F.array(*forms), F.col("p_size") % 7 + 1)
    return table(spark, sf, "part").select(code.alias("code"))


@query(
    "B04_decode_age",
    """SELECT code, CASE p_size % 7 WHEN 0 THEN 'total' WHEN 1 THEN 'unknown' WHEN 2 THEN '0'
      WHEN 3 THEN '0-' || (p_size - 1) WHEN 4 THEN '' || p_size
      WHEN 5 THEN p_size || '-' || (p_size + 4) ELSE p_size || '+' END AS age, count(*) AS n
    FROM (SELECT p_size, list_extract(['TOTAL', 'UNK', 'Y_LT1', 'Y_LT' || p_size,
      'Y' || p_size, 'Y' || p_size || '-' || (p_size + 4), 'Y_GE' || p_size], p_size % 7 + 1)
      AS code FROM part) GROUP BY ALL""",
)
def decode_age(spark: SparkSession, sf: str) -> DataFrame:
    counts = age_codes(spark, sf).groupBy("code").agg(F.count("*").alias("n"))
    return counts.select("code", d.decode_age(F.col("code")).alias("age"), "n")


@query(
    "B05_resolve_open_age",
    sql(
        """SELECT c.geo_code AS geo, c.period AS time, c.sex, CASE WHEN c.age = 'total' THEN 'TOTAL'
          WHEN c.age = 'unknown' THEN 'UNK' WHEN c.age = '49+' THEN 'Y_GE' || (m.k + 1)
          ELSE 'Y' || c.age END AS age,
          CASE WHEN NOT (c.age = '48' AND c.y = 1997) THEN c.value END AS value
        FROM pop c LEFT JOIN (SELECT geo_code, period, sex, max(TRY_CAST(age AS INT)) AS k FROM pop
          WHERE NOT (age = '48' AND y = 1997) GROUP BY ALL) m
        USING (geo_code, period, sex)"""
    ),
)
def resolve_open_age(spark: SparkSession, sf: str) -> DataFrame:
    age = F.col("age")
    code = (
        F.when(age == "49+", "Y_OPEN")
        .when(age == "total", "TOTAL")
        .when(age == "unknown", "UNK")
        .otherwise(F.concat(F.lit("Y"), age))
    )
    hidden = (age == "48") & (F.col("period") == "1997")
    cube = population(spark, sf).select(
        F.col("geo_code").alias("geo"),
        F.col("period").alias("time"),
        "sex",
        code.alias("age"),
        F.when(~hidden, F.col("value")).alias("value"),
    )
    return d.resolve_open_age(cube)


@query(
    "B06_parse_age",
    sql(
        """SELECT age, TRY_CAST(regexp_extract(age, '^\\d+') AS INT) AS lo,
        TRY_CAST(age AS INT) AS hi, age LIKE '%+' AS is_open,
        CASE WHEN TRY_CAST(age AS INT) IS NOT NULL THEN 1 END AS width, count(*) AS n
        FROM pop GROUP BY age
        UNION ALL
        SELECT p_size || '-' || (p_size + 4), p_size, p_size + 4, false, 5, count(*)
        FROM part GROUP BY p_size"""
    ),
)
def parse_age(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    bands = table(spark, sf, "part").select(
        F.concat(s.cast("string"), F.lit("-"), (s + 4).cast("string")).alias("age")
    )
    rows = population(spark, sf).select("age").unionByName(bands)
    age = d.parse_age(F.col("age"))
    counts = rows.groupBy("age").agg(F.count("*").alias("n"))
    return counts.select(
        "age",
        age.lo.alias("lo"),
        age.hi.alias("hi"),
        age.is_open.alias("is_open"),
        age.width.alias("width"),
        "n",
    )


@query(
    "B07_map_strict",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none'
    WHEN 'R' THEN 'returned' END AS name, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def map_strict(spark: SparkSession, sf: str) -> DataFrame:
    names = {"A": "accepted", "N": "none", "R": "returned"}
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return rows.select(d.map_strict(F.col("l_returnflag"), names, "return flag").alias("name"), "n")


def old_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The regional totals, with 1998 published under old codes for two regions: W3 under W9,
    beside an empty cell of W3, and W4 also under W8, which is empty in 1999 too."""
    pop = population(spark, sf).where((F.col("age") == "total") & (F.length("geo_code") == 2))
    geo, period = F.col("geo_code"), F.col("period")
    null = F.lit(None).cast("double")

    def as_(code: str, value: object) -> object:
        return F.struct(F.lit(code).alias("geo_code"), value.alias("value"))

    same = F.array(F.struct(geo.alias("geo_code"), F.col("value").alias("value")))
    rows = (
        F.when((geo == "W3") & (period == "1998"), F.array(as_("W9", F.col("value")), as_("W3", null)))
        .when((geo == "W4") & (period == "1998"), F.concat(same, F.array(as_("W8", F.col("value")))))
        .when((geo == "W4") & (period == "1999"), F.concat(same, F.array(as_("W8", null))))
        .when((geo == "W0") & (period == "2000"), F.array(as_("W0", null)))
        .otherwise(same)
    )
    keep = [c for c in pop.columns if c not in ("geo_code", "value")]
    return pop.select(*keep, F.inline(rows))


def current_codes(spark: SparkSession) -> DataFrame:
    """The whole, the regions, and no nation: the reference list of the examples."""
    return values_frame(spark, ("geo_code",), [("W",)] + [(f"W{i}",) for i in range(5)])


@query(
    "B08_recode_geo",
    sql(
        """SELECT geo_code, period, sex,
        CASE WHEN NOT (geo_code = 'W0' AND y = 2000) THEN value END AS value
        FROM pop WHERE age = 'total' AND length(geo_code) = 2"""
    ),
)
def recode_geo(spark: SparkSession, sf: str) -> DataFrame:
    recodes = values_frame(spark, ("old_code", "new_code"), [("W9", "W3")])
    out = harmonize.recode_geo(old_codes(spark, sf), recodes, current_codes(spark), "W", "1998")
    return out.select("geo_code", "period", "sex", "value")


@query(
    "B09_check_codes",
    sql("SELECT DISTINCT geo_code FROM pop WHERE geo_code LIKE 'W1%' AND length(geo_code) > 2"),
)
def check_codes(spark: SparkSession, sf: str) -> DataFrame:
    return gates.unknown_codes(cells(spark, sf), current_codes(spark), "W1")


@query(
    "B10_map_iso2",
    sql(
        """SELECT CASE geo_code WHEN 'W0' THEN 'EL' WHEN 'W1' THEN 'UK' ELSE geo_code END
        AS geo_code, count(*) AS n FROM cells GROUP BY ALL"""
    ),
)
def map_iso2(spark: SparkSession, sf: str) -> DataFrame:
    code = d.map_or_keep(F.col("geo_code"), {"W0": "EL", "W1": "UK"})
    return cells(spark, sf).groupBy(code.alias("geo_code")).agg(F.count("*").alias("n"))


@query(
    "B11_attach_definition",
    sql(
        """SELECT definition_id, CASE WHEN definition_id = 'live_births@v1' THEN 'live_births'
        ELSE 'population' END AS metric, 'persons' AS unit, count(*) AS n FROM (
        SELECT CASE WHEN age = '0' THEN 'live_births@v1' ELSE 'population_1jan@v1' END
        AS definition_id FROM pop) GROUP BY ALL"""
    ),
)
def attach_definition(spark: SparkSession, sf: str) -> DataFrame:
    chosen = F.when(F.col("age") == "0", "live_births@v1").otherwise("population_1jan@v1")
    rows = population(spark, sf).withColumn("definition_id", chosen)
    out = harmonize.attach_definition(rows, definitions(spark))
    return out.groupBy("definition_id", "metric", "unit").agg(F.count("*").alias("n"))


@query(
    "B12_broadcast_constants",
    sql(
        """SELECT geo_code, period, 'total' AS sex, 'total' AS age, 'GRID1' AS geo_vintage,
        'https://example.org/pop_cells' AS source_url, sum(q_known) AS value FROM cells
        GROUP BY geo_code, period"""
    ),
)
def broadcast_constants(spark: SparkSession, sf: str) -> DataFrame:
    sums = cells(spark, sf).groupBy("geo_code", "period").agg(F.sum("q_known").alias("value"))
    out = harmonize.with_constants(sums, sex="total", age="total", **PROVENANCE)
    return out.select("geo_code", "period", "sex", "age", "geo_vintage", "source_url", "value")


@query(
    "B13_normalise_label",
    """SELECT label, count(*) AS n FROM (SELECT upper(p_name) || ' AND ' || p_type AS label
    FROM part) GROUP BY label""",
)
def normalise_label(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(
        F.regexp_replace("p_name", " ", " ,  "),
        F.lit(" & and "),
        F.col("p_type"),
        F.lit(" ("),
        F.col("p_size").cast("string"),
        F.lit(")*"),
    )
    label = d.normalise_label(raw)
    return table(spark, sf, "part").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    "B14_normalise_text",
    """SELECT doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'),
    '[^0-9A-Za-z_]+', ' ', 'g'))) AS digest FROM documents""",
)
def normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(d.normalise_text(F.col("text"))).alias("digest"))


@query(
    "B15_fix_lookalikes",
    """SELECT n_name, fixed, regexp_matches(fixed, '[A-Za-z]') AS has_latin FROM (
    SELECT n_name, translate(replace(n_name, '_', ' '), 'ABEZHIKMNOPTXY', 'ΑΒΕΖΗΙΚΜΝΟΡΤΧΥ')
    AS fixed FROM nation
    UNION ALL SELECT r_name, translate(r_name, 'ABEZHIKMNOPTXY', 'ΑΒΕΖΗΙΚΜΝΟΡΤΧΥ') FROM region)""",
)
def fix_lookalikes(spark: SparkSession, sf: str) -> DataFrame:
    names = (
        table(spark, sf, "nation")
        .select("n_name", F.translate("n_name", "_", " ").alias("name"))
        .unionByName(
            table(spark, sf, "region").select(
                F.col("r_name").alias("n_name"), F.col("r_name").alias("name")
            )
        )
    )
    fixed = d.fix_lookalikes(F.col("name"))
    return names.select("n_name", fixed.alias("fixed"), d.has_latin(fixed).alias("has_latin"))


@query(
    "B16_round_half_up",
    sql(
        """SELECT geo_code, period, sex, a, floor(n_r * 1000 / n_all + 0.5) / 10 AS share
        FROM cells"""
    ),
)
def round_half_up(spark: SparkSession, sf: str) -> DataFrame:
    share = d.round_half_up_percent(F.col("n_r"), F.col("n_all"))
    return cells(spark, sf).select("geo_code", "period", "sex", "a", share.alias("share"))


@query(
    "B17_localised_number",
    """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE (1000 + p_partkey)::DOUBLE END
    AS n, CASE WHEN p_size % 10 = 0 THEN NULL ELSE (1000 + p_partkey)::DOUBLE END AS n_or_null,
    (p_size || '.' || p_size % 10)::DOUBLE AS decimal FROM part""",
)
def localised_number(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey") + 1000
    thousands = F.concat(
        F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0")
    )
    text = F.when(F.col("p_size") % 10 == 0, "-").otherwise(thousands)
    dec = F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_size") % 10).cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey",
        d.localised_count(text).alias("n"),
        d.localised_count(text, dash_is_zero=False).alias("n_or_null"),
        d.localised_decimal(dec).alias("decimal"),
    )


@query(
    "B18_date_of_vintage",
    """SELECT vintage, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0
    THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m') END AS vintage FROM events)
    GROUP BY vintage""",
)
def date_of_vintage(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0200'")
    raw = F.when(F.col("event_id") % 2 == 0, stamp).otherwise(F.date_format("ts", "yyyy-MM"))
    rows = table(spark, sf, "events").select(d.date_of_vintage(raw).alias("vintage"))
    return rows.groupBy("vintage").agg(F.count("*").alias("n"))


VARIANTS = {"1-URGENT": "fast", "2-HIGH": "high", "4-NOT SPECIFIED": "open", "5-LOW": "low"}


@query(
    "B19_scenario_map",
    """SELECT o_orderpriority AS variant, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'projected'
    ELSE 'scenario' END AS nature, CASE o_orderpriority WHEN '1-URGENT' THEN 'fast'
    WHEN '2-HIGH' THEN 'high' WHEN '4-NOT SPECIFIED' THEN 'open' WHEN '5-LOW' THEN 'low' END
    AS scenario_id, count(*) AS n FROM orders GROUP BY ALL""",
)
def scenario_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("variant"))
        .agg(F.count("*").alias("n"))
    )
    out = harmonize.scenario_map(rows, "variant", "3-MEDIUM", VARIANTS)
    return out.select("variant", "nature", "scenario_id", "n")


@query(
    "B20_strict_cells",
    sql(
        """SELECT geo_code, period, sum(value) AS value FROM pop
        WHERE age = 'total' AND sex = 'total' AND ((geo_code = 'W0' AND y BETWEEN 1995 AND 1997)
        OR (geo_code = 'W1' AND y = 1999) OR (geo_code = 'W' AND y IN (2000, 2001)))
        GROUP BY ALL"""
    ),
)
def strict_cells(spark: SparkSession, sf: str) -> DataFrame:
    spec = d.strict_cells(spark.range(1), "W0 1995-1997, W1 1999, W 2000-2001")
    total = population(spark, sf).where("age = 'total' AND sex = 'total'")
    return (
        total.join(spec, ["geo_code", "period"], "left_semi")
        .groupBy("geo_code", "period")
        .agg(F.sum("value").alias("value"))
    )
