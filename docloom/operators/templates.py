"""Template records: build, look up, list, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.exprs import materialise
from docloom.schemas import STORE_ENTRY_TEXT
from docloom.sources.store import entry_columns


def build_templates(decoded: DataFrame, now: Column | None = None) -> DataFrame:
    """P6. Decoded responses (rejects left out) to candidate template rows with defaults.

    ``strip_chars`` of a response is not taken over. Keeps response_seq, doc_id,
    existing_template_id, backend and model next to the template columns.
    """
    now = F.localtimestamp() if now is None else now
    body = F.col("body")
    entry = F.struct(
        F.coalesce(body["template_id"], F.lit("unknown_v1")).alias("template_id"),
        body["fingerprint"].alias("fingerprint"),
        F.transform(
            body["extraction_rules"],
            lambda r: F.struct(
                *[
                    r[n].alias(n)
                    for n in ("field", "type", "regex", "anchor_regex", "stop_regex", "columns")
                ],
                F.lit(None).cast("string").alias("strip_chars"),
                r["date_format"].alias("date_format"),
            ),
        ).alias("extraction_rules"),
        body["confidence_checks"].alias("confidence_checks"),
        F.create_map(F.lit("llm_generated"), F.lit("true")).alias("metadata"),
        F.lit("1").alias("version"),
        F.lit(None).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"),
        F.lit("0").alias("hit_count"),
    )
    usable = materialise(decoded.filter(F.col("reject").isNull()), _e=entry)
    return usable.select(
        "response_seq",
        "doc_id",
        "existing_template_id",
        "backend",
        "model",
        *entry_columns(F.col("_e"), now),
    )


def response_fields(decoded: DataFrame) -> DataFrame:
    """P12. extracted_data as long rows of kind "raw", taken as they are."""
    return decoded.filter(F.col("reject").isNull()).select(
        "response_seq",
        "doc_id",
        F.lit("raw").alias("kind"),
        F.explode(F.map_entries("body.extracted_data")).alias("_e"),
    ).select("response_seq", "doc_id", "kind", F.col("_e.key").alias("field"), F.col("_e.value").alias("s"))


def list_templates(templates: DataFrame) -> DataFrame:
    """P7. The listing: first three keywords, always followed by an ellipsis."""
    return templates.select(
        "seq",
        "template_id",
        "doc_type",
        F.col("supplier_hint").alias("supplier"),
        F.concat(F.array_join(F.slice("required_keywords", 1, 3), ", "), F.lit("...")).alias("keywords"),
        F.col("hit_count").cast("string").alias("hits"),
        F.col("version").cast("string").alias("version"),
    )


def get_template(templates: DataFrame, template_id: str) -> DataFrame:
    """P8."""
    return templates.filter(F.col("template_id") == template_id)


def in_order(templates: DataFrame) -> DataFrame:
    """P9."""
    return templates.orderBy("seq")


def import_templates(lines: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """P10. One template JSON per ``value``: (accepted template rows with ``line_id``, rejected lines
    with a reason). ``lines`` needs (line_id, value)."""
    now = F.localtimestamp() if now is None else now
    schema = STORE_ENTRY_TEXT[len("struct<") : -1]
    parsed = materialise(
        lines,
        _e=F.from_json(
            "value",
            f"struct<{schema},_corrupt:string>",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        ),
    )
    e = F.col("_e")
    quorum = e["fingerprint"]["keyword_quorum"].try_cast("double")
    reason = (
        F.when(F.trim("value") == "", F.lit("nothing to import"))
        .when(
            e.isNull() | e["_corrupt"].isNotNull() | ~F.ltrim("value").startswith("{"),
            F.lit("malformed JSON"),
        )
        .when(e["template_id"].isNull(), F.lit("template_id is required"))
        .when(e["fingerprint"].isNull(), F.lit("fingerprint is required"))
        .when((quorum < 0) | (quorum > 1), F.lit("keyword_quorum outside [0, 1]"))
        .when(F.exists(e["extraction_rules"], lambda r: r["field"].isNull()), F.lit("rule without field"))
        .when(F.exists(e["confidence_checks"], lambda c: c["field"].isNull()), F.lit("check without field"))
    )
    judged = parsed.withColumn("reason", reason)
    accepted = judged.filter("reason is null").select("line_id", *entry_columns(e, now))
    return accepted, judged.filter("reason is not null").select("line_id", "value", "reason")
