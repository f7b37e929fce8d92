"""One registered query per operator of this package, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import (
    chat,
    decontam,
    langid,
    lines,
    lm,
    mixing,
    periodic,
    pii,
    pivots,
    secrets,
    simhash,
    toxicity,
    whitening,
)
from vitalgrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.groups(table(spark, sf, "documents", "doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op9_mixing", mixing.ORACLE)
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(table(spark, sf, "documents", "doc_id", "text", "source"))


@query("op4_line_dedup", lines.ORACLE)
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, removed lines and a digest of the remaining text of every document."""
    found = lines.line_dedup(table(spark, sf, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query("op3_decontamination", decontam.ORACLE)
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items in every document, and whether they contaminate it."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf, "benchmark", "item_id", "text"))
    return found.drop("key").withColumnRenamed("id", "doc_id")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: counts of the base kinds, their digest, and all spans."""
    found = pii.find(table(spark, sf, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    return found.select(
        F.col("id").alias("doc_id"),
        *[
            F.size(of_kind(k)).cast("long").alias(f"n_{k}")
            for k in pii.KINDS
        ],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op1_chat_format")
def op1_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of every conversation after repair, with its rendered piece."""
    found = chat.chat_format(table(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
    return found.withColumnRenamed("conv", "conv_id")


@query("op5_pivot_neighbours")
def op5_pivot_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every embedding."""
    found = pivots.near_duplicates(table(spark, sf, "embeddings", "vec_id", "embedding"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept"
    )


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    found = langid.language_id(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op7_lm_scores")
def op7_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Masked pseudo-log-likelihood of every document, in all and by token."""
    found = lm.lm_scores(table(spark, sf, "documents", "doc_id", "text"), ["doc_id"])
    return found.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels", "doc_id", "toxic"))
    found = toxicity.toxicity(docs, model, ["doc_id"])
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op12_periodic_runs", periodic.ORACLE)
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of words of every document: their number, the strongest, and digests of the runs
    and of the text without their repeats."""
    docs = periodic.with_planted(table(spark, sf, "documents", "doc_id", "text"))
    found = periodic.with_runs(docs, ["doc_id"])
    found = found.withColumn("best", periodic.strongest(F.col("runs")))
    line = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """The first components of every embedding after whitening."""
    found = whitening.whitening(table(spark, sf, "embeddings", "vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")


@query("op13_secrets")
def op13_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, their digest, and all spans."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    found = secrets.with_secrets(docs, secrets.train(docs), ["doc_id"])

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS))
    return found.select(
        "doc_id",
        *[
            F.size(of_kind(k)).cast("long").alias(f"n_{k}")
            for k in secrets.KINDS
        ],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
