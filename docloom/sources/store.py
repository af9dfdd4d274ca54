"""The template store as a table: JSON import and export, parquet snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.exprs import materialise
from docloom.schemas import CHECK, RULE, STORE_ENTRY_TEXT, TEMPLATES
from docloom.sources import json_object

_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _rules(c: Column) -> Column:
    """Rule defaults: a missing type is string."""
    return F.coalesce(
        F.transform(
            c,
            lambda r: F.struct(
                r["field"].alias("field"),
                F.coalesce(r["type"], F.lit("string")).alias("type"),
                *[
                    r[k].alias(k)
                    for k in ("regex", "anchor_regex", "stop_regex", "columns", "strip_chars", "date_format")
                ],
            ),
        ),
        F.array(),
    ).cast(f"array<{RULE}>")


def _checks(c: Column) -> Column:
    return F.coalesce(
        F.transform(
            c,
            lambda k: F.struct(
                k["field"].alias("field"),
                F.coalesce(k["not_null"].try_cast("boolean"), F.lit(False)).alias("not_null"),
                *[k[n].try_cast("double").alias(n) for n in ("gt", "lt")],
                k["regex_match"].alias("regex_match"),
            ),
        ),
        F.array(),
    ).cast(f"array<{CHECK}>")


def entry_columns(e: Column, now: Column) -> list[Column]:
    """One JSON store entry as template columns, defaults applied."""
    fp = e["fingerprint"]
    return [
        e["template_id"].alias("template_id"),
        F.coalesce(fp["required_keywords"], F.array().cast("array<string>")).alias("required_keywords"),
        F.coalesce(fp["supplier_hint"], F.lit("")).alias("supplier_hint"),
        F.coalesce(fp["doc_type"], F.lit("unknown")).alias("doc_type"),
        F.coalesce(fp["keyword_quorum"].try_cast("double"), F.lit(0.6)).alias("keyword_quorum"),
        _rules(e["extraction_rules"]).alias("rules"),
        _checks(e["confidence_checks"]).alias("checks"),
        F.coalesce(e["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"),
        F.coalesce(e["version"].try_cast("int"), F.lit(1)).alias("version"),
        F.coalesce(e["created_at"].try_cast("timestamp_ntz"), now).alias("created_at"),
        F.coalesce(e["updated_at"].try_cast("timestamp_ntz"), now).alias("updated_at"),
        F.coalesce(e["hit_count"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("hit_count"),
    ]


def _store_fault(e: Column) -> Column:
    """Why a parsed store entry is no template, or null. Numbers may be given as text."""
    bad = lambda c, kind: c.isNotNull() & c.try_cast(kind).isNull()
    quorum = e["fingerprint"]["keyword_quorum"]
    return (
        F.when(e.isNull() | e["template_id"].isNull(), F.lit("template_id is required"))
        .when(e["fingerprint"].isNull(), F.lit("fingerprint is required"))
        .when(
            bad(quorum, "double")
            | bad(e["version"], "int")
            | bad(e["hit_count"], "bigint")
            | F.coalesce(F.exists(e["confidence_checks"], lambda k: bad(k["gt"], "double") | bad(k["lt"], "double")), F.lit(False)),
            F.lit("a number is expected"),
        )
        .when(~quorum.try_cast("double").between(0, 1), F.lit("keyword_quorum outside [0, 1]"))
        .when(F.exists(e["extraction_rules"], lambda r: r["field"].isNull()), F.lit("rule without field"))
        .when(F.exists(e["confidence_checks"], lambda c: c["field"].isNull()), F.lit("check without field"))
    )


def _checked(e: Column, name: Column) -> Column:
    """The entry, or an error that ends the job: a store is never read in part."""
    fault = _store_fault(e)
    return F.when(
        fault.isNotNull(), F.raise_error(F.concat(F.lit("invalid template store, entry "), name, F.lit(": "), fault))
    ).otherwise(e)


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TEMPLATES)


def load_store_json(spark: SparkSession, path: str, snapshot_id: int = 0) -> DataFrame:
    """S5. A JSON object id -> template; its key order becomes ``seq``. No file, no templates.

    A malformed file, or an entry that is no template, is an error. The object is read by lines, in parallel
    (``json_object.members``); one that is a single line is parsed by one task.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return empty_store(spark)
        raise
    if raw.filter(F.trim("value") != "").isEmpty():
        raise ValueError(f"malformed template store: {path} is empty")
    entries = json_object.members(spark, path, STORE_ENTRY_TEXT, "template store")
    checked = materialise(entries.select("pos", "key", "value"), e=_checked(F.col("value"), F.col("key")))
    return checked.select(
        F.col("pos").alias("seq"),
        F.lit(snapshot_id).cast("bigint").alias("snapshot_id"),
        *entry_columns(F.col("e"), F.localtimestamp()),
    )


def template_json(columns_from: str | None = None) -> Column:
    """One template row as its JSON store entry (nulls kept, non-ASCII kept)."""

    def c(name: str) -> Column:
        return F.col(f"{columns_from}.{name}" if columns_from else name)

    entry = F.struct(
        c("template_id").alias("template_id"),
        F.struct(
            c("required_keywords").alias("required_keywords"),
            c("supplier_hint").alias("supplier_hint"),
            c("doc_type").alias("doc_type"),
            c("keyword_quorum").alias("keyword_quorum"),
        ).alias("fingerprint"),
        c("rules").alias("extraction_rules"),
        c("checks").alias("confidence_checks"),
        c("metadata").alias("metadata"),
        c("version").alias("version"),
        F.date_format(c("created_at"), _STAMP).alias("created_at"),
        F.date_format(c("updated_at"), _STAMP).alias("updated_at"),
        c("hit_count").alias("hit_count"),
    )
    return F.to_json(entry, {"ignoreNullFields": "false"})


def save_snapshot(templates: DataFrame, folder: str, snapshot_id: int) -> str:
    """S6. Each snapshot is a new parquet folder; nothing is rewritten in place."""
    path = f"{folder.rstrip('/')}/snapshot_id={snapshot_id}"
    templates.withColumn("snapshot_id", F.lit(snapshot_id).cast("bigint")).write.parquet(path)
    return path


def load_snapshot(spark: SparkSession, folder: str, snapshot_id: int) -> DataFrame:
    return spark.read.schema(TEMPLATES).parquet(f"{folder.rstrip('/')}/snapshot_id={snapshot_id}")


def export_store_lines(templates: DataFrame, path: str) -> None:
    """S6 for a store of any size: one JSON entry per line, its ``seq`` in front."""
    line = F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(","), F.substring(template_json(), 2, 2**31 - 1))
    templates.select(line.alias("value")).write.text(path)


def load_store_lines(spark: SparkSession, path: str, snapshot_id: int = 0) -> DataFrame:
    """S5 on the line form; every task parses its own lines. Malformed lines and entries are errors."""
    entry = f"struct<seq:bigint,{STORE_ENTRY_TEXT[len('struct<') :]}"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = materialise(lines, raw=F.from_json("value", entry, {"mode": "FAILFAST"}))
    rows = materialise(parsed, e=_checked(F.col("raw"), F.coalesce(F.col("raw.template_id"), F.lit("?"))))
    return rows.select(
        F.col("e.seq").alias("seq"),
        F.lit(snapshot_id).cast("bigint").alias("snapshot_id"),
        *entry_columns(F.col("e"), F.localtimestamp()),
    )


def export_store_json(templates: DataFrame, path: str) -> None:
    """S6. The whole store as one JSON object in insertion order, a template a line, written in parallel.

    The object is spread over the files of the folder in the order of their names.
    """
    json_object.write_object(
        templates.select("seq", F.col("template_id").alias("key"), template_json().alias("entry")), path
    )
