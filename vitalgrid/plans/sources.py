"""Queries A and D: sources, products and recurring joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.frames import scratch_path, values_frame, year_shift
from vitalgrid.operators import gates, joins
from vitalgrid.operators.contract import ContractError
from vitalgrid.operators.structure import complete_groups
from vitalgrid.plans.gates import gapped, totals
from vitalgrid.plans.registry import query
from vitalgrid.plans.structure import r6
from vitalgrid.plans.views import (
    age_label,
    cells,
    nation_cells,
    population,
    shared_cells,
    sql,
    table,
    with_provenance,
    years,
)
from vitalgrid.schema import COLUMNS, definitions
from vitalgrid.sources import build, cubes, product, snapshots, wide


@query(
    "A01_scan_snapshots",
    """SELECT name, sha256, size FROM (
    SELECT CASE WHEN page_id % 50 = 7 THEN sha256(url) ELSE sha256(html) END AS name,
    sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)
    WHERE name <> sha256""",
)
def corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as stored files: every fiftieth is named by a digest of something else."""
    html = F.col("html").cast("binary")
    name = F.when(F.col("page_id") % 50 == 7, F.sha2(F.col("url").cast("binary"), 256))
    files = table(spark, sf, "pages").select(
        F.coalesce(name, F.sha2(html, 256)).alias("name"), html.alias("content")
    )
    return snapshots.corrupt_snapshots(snapshots.with_digest(files))


ORDER = ("retrieved_at", "event_id")


def downloads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source_id"),
        F.md5("props").alias("sha256"),
        F.col("ts").alias("retrieved_at"),
        "event_id",
    )




@query(
    "A02_ledger_append",
    """SELECT source_id, sha256, event_id FROM (
    SELECT event_type AS source_id, md5(props) AS sha256, event_id, ts,
      lag(md5(props)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events)
    WHERE ts >= TIMESTAMP '2024-01-15' AND sha256 IS DISTINCT FROM prev""",
)
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    rows = downloads(spark, sf)
    new = F.col("retrieved_at") >= F.lit("2024-01-15").cast("timestamp")
    out = snapshots.ledger_append(rows.where(~new), rows.where(new), ORDER)
    return out.select("source_id", "sha256", "event_id")


@query(
    "A03_latest_snapshot",
    """SELECT source_id, sha256, event_id FROM (
    SELECT event_type AS source_id, md5(props) AS sha256, event_id,
      row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE md5(props) IN (SELECT md5(props) FROM events WHERE event_id % 3 = 0))
    WHERE rn = 1 UNION ALL SELECT 'absent', NULL, NULL""",
)
def latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest pinned version of each source, and the required source that has none."""
    rows = downloads(spark, sf)
    pins = rows.where("event_id % 3 = 0").select("sha256").distinct()
    found = snapshots.latest_snapshot(rows, pins, ORDER)
    required = values_frame(spark, ("source_id",), [("click",), ("absent",)])
    lacking = snapshots.missing_sources(required, found)
    return found.select("source_id", "sha256", "event_id").unionByName(
        lacking, allowMissingColumns=True
    )


@query(
    "A04_snapshot_history",
    """SELECT source_id, sha256, count(*) AS versions,
    count(*) FILTER (WHERE prev IS NOT NULL AND prev <> sha256) AS revisions FROM (
    SELECT event_type AS source_id, md5(props) AS sha256,
      lag(md5(props)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events)
    GROUP BY ALL""",
)
def history(spark: SparkSession, sf: str) -> DataFrame:
    out = snapshots.snapshot_history(downloads(spark, sf), ORDER)
    return out.groupBy("source_id", "sha256").agg(
        F.count("*").alias("versions"), F.count_if("revised").alias("revisions")
    )


def cube_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A cube document per nation: geo (1) x flag (3) x year, a fifth of the cells left out,
    values as an object for every other nation and as a list for the rest."""
    every = years(spark, sf)
    first, n_years = every[0], len(every)
    places = F.sequence(F.lit(0), F.lit(3 * n_years - 1))
    n_a = F.col("n_all") - F.col("n_n") - F.col("n_r")
    place = F.col("y") - first
    counts = F.array(
        *[
            F.struct((place + n_years * i).alias("flat"), n.cast("long").alias("v"))
            for i, n in enumerate((n_a, F.col("n_n"), F.col("n_r")))
        ]
    )
    k = F.ascii(F.substring("geo_code", 3, 1)) - 65
    given = (
        nation_cells(spark, sf)
        .select("geo_code", k.alias("k"), F.inline(counts))
        .groupBy("geo_code", "k", "flat")
        .agg(F.sum("v").alias("v"))
        .groupBy("geo_code", "k")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flat", "v")))).alias("all"))
    )
    shown = F.map_filter("all", lambda i, v: (i + F.col("k")) % 5 != 0)
    listed = F.transform(places, lambda i: F.try_element_at(shown, i))
    value = F.when(F.col("k") % 2 == 0, F.to_json(shown)).otherwise(F.to_json(listed))
    status = F.to_json(
        F.map_from_entries(
            F.transform(
                F.filter(places, lambda i: i % 6 == 1),
                lambda i: F.struct(i.alias("i"), F.lit("p").alias("f")),
            )
        )
    )
    index = ", ".join(f'"{y}": {y - first}' for y in reversed(every))
    head = F.concat(
        F.lit('{"class": "dataset", "label": "Lines", "updated": "2026-01-02", "id": '
              '["geo", "rf", "time"], "size": [1, 3, ' + str(n_years) + '], "dimension": {"geo": {"category": '
              '{"label": {"'),
        F.col("geo_code"),
        F.lit('": "a nation"}}}, "rf": {"category": {"index": ["A", "N", "R"]}}, "time": '
              '{"category": {"index": {' + index + '}}}}, "value": '),
    )
    json = F.concat(head, value, F.lit(', "status": '), status, F.lit("}"))
    return given.select(F.col("geo_code").alias("doc_id"), json.alias("json"))


CUBE_SQL = """
span AS (SELECT CAST(min(year(o_orderdate)) AS INT) AS y0, CAST(max(year(o_orderdate)) AS INT) AS y1
  FROM orders),
cube AS (
  SELECT g.geo_code AS geo, f.rf, CAST(f.y AS VARCHAR) AS time, f.flat,
    CASE WHEN (f.flat + ascii(g.geo_code[3]) - 65) % 5 <> 0 THEN c.n::DOUBLE END AS value,
    CASE WHEN f.flat % 6 = 1 THEN 'p' END AS flag
  FROM (SELECT DISTINCT geo_code FROM cells WHERE length(geo_code) = 3) g,
    (SELECT y, rf, y - y0 + (y1 - y0 + 1) * (CASE rf WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)
       AS flat FROM (SELECT unnest(range(y0, y1 + 1)) AS y, y0, y1 FROM span),
       (SELECT unnest(['A', 'N', 'R']) AS rf)) f
  LEFT JOIN (SELECT geo_code, y, 'A' AS rf, sum(n_all - n_n - n_r) AS n FROM cells GROUP BY ALL
    UNION ALL SELECT geo_code, y, 'N', sum(n_n) FROM cells GROUP BY ALL
    UNION ALL SELECT geo_code, y, 'R', sum(n_r) FROM cells GROUP BY ALL) c
    ON c.geo_code = g.geo_code AND c.y = f.y AND c.rf = f.rf)
"""
DIMS = ("geo", "rf", "time")


@query("A05_explode_cube", sql("SELECT geo, rf, time, value, flag FROM cube", CUBE_SQL))
def explode_cube(spark: SparkSession, sf: str) -> DataFrame:
    out = cubes.explode_cube(cube_documents(spark, sf), DIMS)
    return out.select(*DIMS, "value", "flag")


DEFECTS = (
    "not a dataset",
    "category counts do not match size",
    "not a document",
    "list of another length",
    "cell outside the cube",
)


@query(
    "A05_cube_violations",
    sql(
        "SELECT DISTINCT geo AS doc_id, CASE (ascii(geo[3]) - 65) % 6 "
        + " ".join(f"WHEN {i} THEN '{problem}'" for i, problem in enumerate(DEFECTS))
        + " END AS problem FROM cube WHERE (ascii(geo[3]) - 65) % 6 < 5",
        CUBE_SQL,
    ),
)
def cube_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every sixth document is sound; the others have one defect each."""
    json = F.col("json")
    kind = (F.ascii(F.substring("doc_id", 3, 1)) - 65) % 6
    damaged = (
        F.when(kind == 0, F.replace(json, F.lit('"dataset"'), F.lit('"bundle"')))
        .when(kind == 1, F.replace(json, F.lit('"size": [1, '), F.lit('"size": [2, ')))
        .when(kind == 2, F.substring(json, F.lit(1), F.length(json) - 9))
        .when(kind == 3, F.replace(json, F.lit('"value": ['), F.lit('"value": [0, ')))
        .when(kind == 4, F.replace(json, F.lit('"value": {'), F.lit('"value": {"99999": 1, ')))
        .otherwise(json)
    )
    return cubes.cube_violations(cube_documents(spark, sf).withColumn("json", damaged))


@query(
    "A06_cube_summary",
    sql(
        """SELECT geo AS doc_id, 'Lines' AS label, '2026-01-02' AS updated,
        'geo:1|rf:3|time:' || count(DISTINCT time) AS dimensions,
        CAST(CASE WHEN ascii(geo[3]) % 2 = 1 THEN count(value) ELSE count(*) END AS INT) AS n_values FROM cube GROUP BY geo""",
        CUBE_SQL,
    ),
)
def cube_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = cubes.cube_summary(cube_documents(spark, sf))
    dims = F.array_join(
        F.transform(
            F.map_entries("dimensions"),
            lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")),
        ),
        "|",
    )
    return out.withColumn("dimensions", dims)


@query(
    "A07_select_slice",
    sql("SELECT geo, time, value, flag FROM cube WHERE rf = 'R'", CUBE_SQL),
)
def select_slice(spark: SparkSession, sf: str) -> DataFrame:
    cube = cubes.explode_cube(cube_documents(spark, sf), DIMS).select(*DIMS, "value", "flag")
    return cubes.select_slice(cube, {"rf": "R"})


@query(
    "A07_slice_violations",
    """SELECT unnest(['Z is not a code of l_linestatus', 'select a single l_returnflag'])
    AS problem FROM (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem
    WHERE l_linestatus = 'F') WHERE n > 1""",
)
def slice_violations(spark: SparkSession, sf: str) -> DataFrame:
    cube = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag")
    further = ("l_returnflag",)
    return cubes.slice_violations(cube, ({"l_linestatus": "F"}, further), ({"l_linestatus": "Z"}, further))


@query(
    "A08_prefix_filter",
    "SELECT p_brand, count(*) AS n FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY p_brand",
)
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = cubes.prefix_filter(table(spark, sf, "part"), "Brand#1", "p_brand")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    "A09_scan_csv",
    sql(
        """SELECT 'W1' AS LocID, period AS Time, CAST(a AS VARCHAR) AS AgeGrpStart,
        CAST(sum(n_all) AS VARCHAR) AS Pop FROM cells WHERE geo_code = 'W1' GROUP BY period, a"""
    ),
)
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The cells delivered as compressed CSV files, then one location read back."""
    header = ("LocID", "Variant", "Time", "AgeGrpStart", "Pop")
    rows = (
        cells(spark, sf)
        .groupBy(F.col("geo_code").alias("LocID"), F.col("period").alias("Time"),
                 F.col("a").alias("AgeGrpStart"))
        .agg(F.sum("n_all").alias("Pop"))
        .select("LocID", F.lit("Medium").alias("Variant"), "Time", "AgeGrpStart", "Pop")
    )
    path = scratch_path(spark, "wide-csv")
    rows.write.csv(path, header=True, compression="gzip")
    return wide.scan_csv(
        spark, path, header, ("LocID", "Time", "AgeGrpStart", "Pop"), LocID="W1", Variant="Medium"
    )


DELIVERED = ("LocID", "Time", "AgeGrpStart", "Pop")


@query(
    "A09_csv_violations",
    sql(
        """SELECT 'W' || r AS file, rule, n FROM (
        SELECT r, 'malformed rows' AS rule, sum(CASE WHEN r = 2 AND a < 3 THEN 1 WHEN r = 3 AND a >= 40 THEN 1 ELSE 0 END) AS n
        FROM (SELECT DISTINCT TRY_CAST(geo_code[2:2] AS INT) AS r, geo_code, period, a FROM cells WHERE length(geo_code) = 3) GROUP BY r)
        WHERE n > 0 AND r <> 4
        UNION ALL SELECT 'W4', 'file without rows', 0 WHERE EXISTS (SELECT 1 FROM cells WHERE geo_code = 'W4')
        UNION ALL SELECT NULL, 'no row of LocID nowhere', 0"""
    ),
)
def csv_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A file a region: W2 has rows with a field too many, W3 rows that are cut, W4 has a header and no
    rows; a location that is asked for is in none."""
    rows = cells(spark, sf).where(F.length("geo_code") == 3).groupBy("geo_code", "period", "a").agg(F.sum("n_all").alias("n"))
    region = F.substring("geo_code", 1, 2)
    whole = F.concat_ws(",", "geo_code", "period", F.col("a").cast("string"), F.col("n").cast("string"))
    line = (
        F.when((region == "W2") & (F.col("a") < 3), F.concat(whole, F.lit(",more")))
        .when((region == "W3") & (F.col("a") >= 40), F.concat_ws(",", "geo_code", "period"))
        .otherwise(whole)
    )
    lines = rows.select(region.alias("region"), line.alias("line"), F.lit(1).alias("nr")).where("region <> 'W4'")
    heads = rows.select(region.alias("region")).distinct().select("region", F.lit(",".join(DELIVERED)).alias("line"), F.lit(0).alias("nr"))
    path = scratch_path(spark, "delivery")
    files = lines.unionByName(heads).repartition("region").sortWithinPartitions("region", "nr").drop("nr")
    files.write.partitionBy("region").text(path, compression="gzip")
    found = wide.delivery_violations(spark, path, DELIVERED, LocID="nowhere")
    # names of files are new each time; their region is not
    file = F.nullif(F.regexp_extract("file", "region=(W[0-9])", 1), F.lit(""))
    return found.select(file.alias("file"), "rule", "n")


SHEETS = {None: 1.0, "80_lower": 0.9, "80_upper": 1.1}


@query(
    "A10_wide_years_to_long",
    sql(
        """SELECT geo_code, period, round(sum(q_known) / 1000 * f * 1000) AS value, i AS interval
        FROM cells, (SELECT unnest([NULL, '80_lower', '80_upper']) AS i,
          unnest([1.0::DOUBLE, 0.9, 1.1]) AS f) GROUP BY geo_code, period, i, f"""
    ),
)
def wide_years(spark: SparkSession, sf: str) -> DataFrame:
    year = F.col("period")
    names = [str(y) for y in years(spark, sf)]
    sheet = (
        cells(spark, sf)
        .groupBy("geo_code")
        .agg(*[F.sum(F.when(year == y, F.col("q_known"))).alias(y) for y in names])
    )
    sheets = {
        interval: sheet.select("geo_code", *[(F.col(y) / 1000 * f).alias(y) for y in names])
        for interval, f in SHEETS.items()
    }
    return wide.wide_years_to_long(sheets, ["geo_code"], names)


@query(
    "A11_wide_sex_to_long",
    sql(
        """SELECT geo_code, period, sex, value FROM pop WHERE age = 'total'
        AND geo_code IN (SELECT geo_code FROM pop GROUP BY geo_code)"""
    ),
)
def wide_sex(spark: SparkSession, sf: str) -> DataFrame:
    total = population(spark, sf).where("age = 'total'")
    names = {"PopTotal": "total", "PopMale": "male", "PopFemale": "female"}
    table_ = total.groupBy("geo_code", "period").agg(
        *[(F.max(F.when(F.col("sex") == s, F.col("value"))) / 1000).alias(c)
          for c, s in names.items()]
    )
    return wide.wide_sex_to_long(table_, ["geo_code", "period"], names)


@query(
    "A12_write_product",
    sql("SELECT geo_code, period, sex, age, value FROM pop WHERE length(geo_code) >= 2"),
)
def write_product(spark: SparkSession, sf: str) -> DataFrame:
    # the contract wants codes of two characters or more, which leaves the whole area out
    rows = population(spark, sf).where(F.length("geo_code") >= 2).select(*COLUMNS)
    path = scratch_path(spark, "product")
    product.write_product(rows, definitions(spark), path)
    back = spark.read.schema(rows.schema).parquet(f"{path}/parquet")
    return back.select("geo_code", "period", "sex", "age", "value")


@query(
    "A12_refused_product",
    sql(
        """SELECT unnest(['geo_code length', 'unique key', 'value null iff not_available']) AS rule,
        unnest([w, 2 * twice, w2]) AS n, false AS published FROM (
        SELECT count(*) FILTER (WHERE geo_code = 'W') AS w, count(*) FILTER (WHERE geo_code = 'W1' AND y = 1996) AS twice,
          count(*) FILTER (WHERE geo_code = 'W2' AND age = 'total') AS w2 FROM pop)"""
    ),
)
def refused_product(spark: SparkSession, sf: str) -> DataFrame:
    """A table that breaks three rules is not published: the rules, and whether its folder exists."""
    rows = population(spark, sf).select(*COLUMNS)
    lost = (F.col("geo_code") == "W2") & (F.col("age") == "total")
    rows = rows.withColumn("value", F.when(~lost, F.col("value")))
    twice = F.array_repeat(F.lit(1), F.when((F.col("geo_code") == "W1") & (F.col("period") == "1996"), 2).otherwise(1))
    rows = rows.withColumn("_copy", F.explode(twice)).drop("_copy")
    path = scratch_path(spark, "product")
    try:
        product.write_product(rows, definitions(spark), path)
        problems = []
    except ContractError as error:
        problems = [part.removesuffix(" rows").rsplit(": ", 1) for part in str(error).split("; ")]
    place, files = product._files(spark, path)
    published = bool(files.exists(place))
    return values_frame(spark, ("rule", "n", "published"), [(rule, int(n), published) for rule, n in problems]).withColumn(
        "n", F.col("n").cast("long")
    )


CHAIN_SQL = """SELECT b.build, b.product, b.state, CASE b.product WHEN 'areas' THEN (SELECT count(*) FROM nation)
    WHEN 'customers' THEN (SELECT count(DISTINCT c_nationkey) FROM customer)
    WHEN 'per_area' THEN (SELECT count(DISTINCT c_nationkey) FROM customer JOIN nation ON n_nationkey = c_nationkey)
    WHEN 'priorities' THEN (SELECT count(DISTINCT o_orderpriority) FROM orders) END AS rows
    FROM (VALUES (1, 'areas', 'added'), (1, 'customers', 'added'), (1, 'per_area', 'added'), (1, 'priorities', 'added'),
      (2, 'areas', 'unchanged'), (2, 'customers', 'changed input'), (2, 'per_area', 'changed input'),
      (2, 'priorities', 'changed code'), (3, 'areas', 'unchanged'), (3, 'customers', 'unchanged'),
      (3, 'per_area', 'unchanged'), (3, 'priorities', 'unchanged')) AS b(build, product, state)"""


@query("A13_build", CHAIN_SQL)
def build_products(spark: SparkSession, sf: str) -> DataFrame:
    """Four products built three times: at first, after the customers' files and one product's code have
    changed, and with nothing changed. Rows of each and why it was made, if it was."""
    tables = {name: table(spark, sf, name) for name in ("nation", "customer", "orders")}
    known = {name: build.files_digest(df).first().digest for name, df in tables.items()}

    def of(code: str) -> list[build.Product]:
        per = F.col("c_nationkey")
        return [
            build.Product("areas", "1", ("nation",), lambda t: t["nation"].select("n_nationkey", "n_name")),
            build.Product("customers", "1", ("customer",), lambda t: t["customer"].groupBy(per).agg(F.count("*").alias("n"))),
            build.Product(
                "per_area", "1", ("areas", "customers"),
                lambda t: t["areas"].join(t["customers"], F.col("n_nationkey") == per),
            ),
            build.Product("priorities", code, ("orders",), lambda t: t["orders"].groupBy("o_orderpriority").count(), 1),
        ]

    path = scratch_path(spark, "build")
    first = build.build(spark, of("1"), tables, known, path)
    changed = known | {"customer": known["customer"][::-1]}
    second = build.build(spark, of("2"), tables, changed, path, first)
    third = build.build(spark, of("2"), tables, changed, path, second)
    builds = [m.select(F.lit(i).alias("build"), "product", "state", "rows") for i, m in enumerate((first, second, third), 1)]
    return builds[0].unionByName(builds[1]).unionByName(builds[2])


@query(
    "A13_manifest",
    sql(
        """SELECT product, state, CASE WHEN state <> 'removed' THEN n END AS rows FROM (
        SELECT geo_code AS product, count(*) AS n, CASE geo_code WHEN 'W1' THEN 'changed'
          WHEN 'W2' THEN 'removed' WHEN 'W3' THEN 'added' ELSE 'unchanged' END AS state
        FROM pop GROUP BY geo_code)"""
    ),
)
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Two builds of the areas' tables: W1 has one revised total, W2 is gone, W3 is new."""
    geo = F.col("geo_code")
    rows = population(spark, sf).select(geo.alias("product"), "period", "sex", "age", "value")
    revised = (F.col("product") == "W1") & (F.col("period") == "2000") & (F.col("age") == "total")
    cols = ("period", "sex", "age", "value")
    old = product.manifest(rows.where("product <> 'W3'"), ("product",), cols)
    new = rows.where("product <> 'W2'").withColumn(
        "value", F.col("value") + F.when(revised, 1.0).otherwise(0.0)
    )
    return product.changed_products(old, product.manifest(new, ("product",), cols), ("product",))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Ten documents make a product; each was read from a source."""
    return table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 10).alias("product"),
        F.col("source").alias("source_id"),
        F.md5("text").alias("sha256"),
    )


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """The sources of the documents; src3 may not be reused, src5 is not verified."""
    source = F.col("source_id")
    licence = F.when(source == "src3", "closed").when(source == "src5", "to_verify")
    return (
        table(spark, sf, "documents")
        .select(F.col("source").alias("source_id"))
        .distinct()
        .withColumn("licence", F.coalesce(licence, F.lit("open")))
        .withColumn("commercial_reuse", F.col("licence") == "open")
        .withColumn("dataset_code", F.concat(F.lit("ds_"), source))
        .withColumn("attribution", F.lit("Office, {dataset_code}, own work"))
    )


KEPT_SQL = """SELECT doc_id // 10 AS product FROM documents GROUP BY 1
    HAVING count(*) FILTER (WHERE source IN ('src3', 'src5')) = 0"""


@query("A14_licence_filter", KEPT_SQL)
def licence_filter(spark: SparkSession, sf: str) -> DataFrame:
    return product.licence_filter(entries(spark, sf), registry(spark, sf))


@query(
    "A15_sources_used",
    f"""SELECT DISTINCT source AS source_id, 'Office, ds_' || source || ', own work' AS credit
    FROM documents WHERE doc_id // 10 IN ({KEPT_SQL})""",
)
def sources_used(spark: SparkSession, sf: str) -> DataFrame:
    used = product.sources_used(entries(spark, sf), registry(spark, sf))
    return used.select("source_id", "credit")


@query("A16_snapshots_used", "SELECT DISTINCT md5(text) AS sha256 FROM documents")
def snapshots_used(spark: SparkSession, sf: str) -> DataFrame:
    return product.snapshots_used(entries(spark, sf))


@query(
    "D01_equi_join",
    sql(
        """SELECT c.geo_code, c.period, c.sex, p.age, p.value, c.q_known AS official FROM cells c
        JOIN pop p ON p.geo_code = c.geo_code AND p.y = c.y AND p.sex = c.sex
          AND p.age = CASE WHEN c.a = 49 THEN '49+' ELSE CAST(c.a AS VARCHAR) END
        WHERE c.q_known IS NOT NULL"""
    ),
)
def equi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every single age in the table of observations and in the cells."""
    keys = ("geo_code", "period", "sex", "age")
    with shared_cells(spark, sf):
        ours = population(spark, sf).select(*keys, "value")
        theirs = cells(spark, sf).where("q_known IS NOT NULL").select(
            "geo_code", "period", "sex", age_label().alias("age"), F.col("q_known").alias("value")
        )
    return joins.side_by_side(ours, theirs, keys)


@query(
    "D04_semi_join",
    sql(
        """SELECT geo_code, period, sex, count(*) AS n, sum(q_known) AS value FROM cells
        WHERE q_known IS NOT NULL GROUP BY ALL HAVING count(*) = 50"""
    ),
)
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the groups that have every age."""
    keys = ("geo_code", "period", "sex")
    rows = cells(spark, sf).where("q_known IS NOT NULL")
    out = joins.of_groups(rows, complete_groups(rows, keys, "a", 50), keys)
    return out.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("q_known").alias("value"))


@query(
    "D02_flagged_left_join",
    sql(
        """SELECT geo_code, period, value, (geo_code, period) IN (('W1', '1996'), ('W', '1995'))
        AS known FROM pop WHERE age = 'total' AND sex = 'total'"""
    ),
)
def flagged_join(spark: SparkSession, sf: str) -> DataFrame:
    known = values_frame(spark, ("geo_code", "period"), [("W1", "1996"), ("W", "1995")])
    out = joins.flag_known(totals(spark, sf), known, ("geo_code", "period"), "known")
    return out.select("geo_code", "period", "value", "known")


@query(
    "D03_anti_unknown_age",
    sql(
        """SELECT geo_code, period, sex, sum(value) AS value FROM pop p WHERE age <> 'unknown'
        AND NOT EXISTS (SELECT 1 FROM pop u WHERE u.geo_code = p.geo_code AND u.y = p.y
          AND u.sex = p.sex AND u.age = 'unknown' AND u.y % 2 = 0) GROUP BY ALL"""
    ),
)
def anti_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Groups without persons of unknown age; in odd years every age is known."""
    keys = ("geo_code", "period", "sex")
    none = (F.col("age") == "unknown") & (F.col("period").cast("int") % 2 == 1)
    rows = population(spark, sf)
    rows = rows.withColumn("value", F.when(none, 0.0).otherwise(F.col("value")))
    out = joins.without_unknown_age(rows, keys)
    return out.groupBy(*keys).agg(F.sum("value").alias("value"))


@query(
    "D05_year_shift",
    sql(
        """SELECT a.geo_code, a.period, a.sex, a.age, a.value - b.value AS change
        FROM pop a JOIN pop b ON a.geo_code = b.geo_code AND a.sex = b.sex AND a.age = b.age
        AND a.y = b.y + 1"""
    ),
)
def year_shifted(spark: SparkSession, sf: str) -> DataFrame:
    before = year_shift(F.col("value"), ("geo_code", "sex", "age"), -1)
    rows = population(spark, sf).withColumn("change", F.col("value") - before)
    return rows.where("change IS NOT NULL").select("geo_code", "period", "sex", "age", "change")


@query(
    "D06_diagonal",
    sql(
        """SELECT a.geo_code, a.y, a.sex, a.a, a.q_known - b.q AS change FROM cells a JOIN (
        SELECT geo_code, y + 1 AS y, sex, least(a + 1, 49) AS a, sum(q_known) AS q FROM cells
        WHERE q_known IS NOT NULL GROUP BY ALL) b USING (geo_code, y, sex, a)
        WHERE a.q_known IS NOT NULL"""
    ),
)
def diagonal(spark: SparkSession, sf: str) -> DataFrame:
    from vitalgrid.operators.migration import cohort_change

    rows = cells(spark, sf).where("q_known IS NOT NULL").select(
        "geo_code", "y", "sex", F.col("a").alias("x"), F.col("q_known").alias("value")
    )
    out = cohort_change(rows, ("geo_code", "sex"), 49)
    return out.select("geo_code", "y", "sex", F.col("x").alias("a"), "change")


@query(
    "D07_null_safe_join",
    """SELECT a.scenario AS scenario_id, a.n, b.total FROM (
    SELECT CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS scenario,
      count(*) AS n FROM orders GROUP BY ALL) a JOIN (
    SELECT CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS scenario,
      round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) b
    ON a.scenario IS NOT DISTINCT FROM b.scenario""",
)
def null_safe(spark: SparkSession, sf: str) -> DataFrame:
    scenario = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").withColumn("scenario_id", scenario)
    n = rows.groupBy("scenario_id").agg(F.count("*").alias("n"))
    cents = F.round(F.sum(F.col("o_totalprice").cast("decimal(20,4)")), 2).cast("double")
    total = rows.groupBy("scenario_id").agg(cents.alias("total"))
    return joins.null_safe_join(n, total, ("scenario_id",))


@query(
    "D08_bands_below_open",
    sql(
        """SELECT b.geo_code, b.period, b.sex, o.a AS open, count(*) AS bands FROM cells b
        JOIN cells o ON b.geo_code = o.geo_code AND b.y = o.y AND b.sex = o.sex
        WHERE b.a < 40 AND o.a >= 40 GROUP BY ALL"""
    ),
)
def bands_below(spark: SparkSession, sf: str) -> DataFrame:
    keys = ("geo_code", "period", "sex")
    hi = F.when(F.col("a") < 40, F.col("a"))
    rows = cells(spark, sf).select(*keys, F.col("a").alias("lo"), hi.alias("hi"))
    return joins.bands_below_open(rows, keys, bands=F.lit(1))


@query(
    "D09_combine_tables",
    sql(
        """SELECT geo_code, period, m.value, f.value AS women, t.value AS everyone,
        m.y = 2001 AS provisional, m.y = 1998 AS break_in_series
        FROM pop m JOIN pop f USING (geo_code, period) JOIN pop t USING (geo_code, period)
        WHERE m.age = 'total' AND f.age = 'total' AND t.age = 'total' AND m.sex = 'male'
        AND f.sex = 'female' AND t.sex = 'total'"""
    ),
)
def combine(spark: SparkSession, sf: str) -> DataFrame:
    rows = population(spark, sf).where("age = 'total'")
    rows = rows.withColumn("provisional", F.col("status") == "provisional")

    def of(sex: str) -> DataFrame:
        return rows.where(F.col("sex") == sex)

    first = of("male").select("geo_code", "period", "value", "provisional", "break_in_series")
    others = [("women", of("female")), ("everyone", of("total"))]
    return joins.combine_tables(first, others, ("geo_code", "period"))


@query(
    "D10_parent_join",
    sql(
        """SELECT c.geo_code, c.period, c.sex, round(c.value / p.value, 6) AS share
        FROM tot c JOIN tot p ON p.geo_code = c.geo_code[:-2] AND p.y = c.y AND p.sex = c.sex""",
        """tot AS (SELECT geo_code, period, y, sex, value
  + CASE WHEN geo_code = 'W1' AND y = 1996 THEN 3 ELSE 0 END
  - CASE WHEN geo_code = 'W2' AND y = 1997 AND sex = 'female' THEN 5 ELSE 0 END AS value
  FROM pop WHERE age = 'total')""",
    ),
)
def parent_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = gapped(spark, sf).select("geo_code", "period", "sex", "value")
    up = gates.parent(F.col("geo_code"))
    out = joins.with_parent(rows, ("period", "sex"), up, "value")
    share = F.col("value") / F.col("parent_value")
    return out.select("geo_code", "period", "sex", r6(share, "share"))
