"""Reports over audit records, results and extracted values."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import basename, span_preview
from docloom.operators.validation import field_count


def fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c)


def score_history(audit: DataFrame) -> DataFrame:
    """A1."""
    mark = lambda c, no: F.when(c, F.lit("✓")).otherwise(F.lit(no))
    return audit.select(
        F.coalesce("file", F.lit("")).alias("file"),
        F.when(F.coalesce("template_id", F.lit("")) != "", F.col("template_id")).otherwise(F.lit("—")).alias("template"),
        fixed(F.coalesce("match_score", F.lit(0.0)), 3).alias("score"),
        F.coalesce("result", F.lit("")).alias("result"),
        mark(F.coalesce("llm_used", F.lit(False)), "").alias("llm"),
        mark(F.coalesce("validation_passed", F.lit(False)), "✗").alias("valid"),
        F.coalesce("field_count", F.lit(0)).alias("fields"),
        F.coalesce("duration_ms", F.lit(0.0)).cast("bigint").alias("ms"),
        F.replace(F.substring("ts", 1, 19), F.lit("T"), F.lit(" ")).alias("time"),
    )


def candidate_ranking(audit: DataFrame, key: str = "file") -> DataFrame:
    """A2. Candidates of each record, best first; records without candidates vanish.

    The rank is taken inside the row: a record's map is its own small list.
    """
    entries = F.transform(
        F.map_entries("candidate_scores"),
        lambda e, i: F.struct((-e["value"]).alias("_minus"), i.alias("_pos"), e["key"].alias("template"), e["value"].alias("score")),
    )
    return audit.select(key, F.posexplode(F.array_sort(entries)).alias("pos", "c")).select(
        key,
        (F.col("pos") + 1).alias("rank"),
        F.col("c.template").alias("template"),
        fixed(F.col("c.score"), 4).alias("score"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """A3."""
    return results.select(
        basename(F.col("document_path")).alias("file"),
        F.when(F.coalesce("template_id", F.lit("")) != "", F.col("template_id")).otherwise(F.lit("N/A")).alias("template"),
        fixed(F.col("match_score"), 2).alias("score"),
        F.when(F.col("llm_used"), "Yes").otherwise("No").alias("llm_used"),
        F.when(F.col("validation_passed"), "✓").otherwise("✗").alias("valid"),
    )


def match_spans(matched: DataFrame, threshold: float) -> DataFrame:
    """A4 per document."""
    return matched.select(
        "doc_id",
        span_preview(F.col("full_text")).alias("raw_text_preview"),
        F.lit(threshold).alias("threshold"),
        F.size("candidate_scores").alias("template_count"),
        F.col("template_id").alias("matched_template_id"),
        F.round("match_score", 4).alias("match_score"),
        "candidate_scores",
        F.col("template_id").isNotNull().alias("hit"),
    )


def match_metrics(matched: DataFrame) -> DataFrame:
    """A4 per best template."""
    return matched.groupBy("best_template_id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("template_id").isNotNull()).alias("hits"),
        F.avg(F.col("template_id").isNotNull().cast("int")).alias("hit_rate"),
        F.avg("match_score").alias("avg_score"),
    )


def _non_null(v: Column) -> Column:
    """Neither null, "" nor an empty list."""
    return (
        (v["s"].isNotNull() & (v["s"] != ""))
        | v["d"].isNotNull()
        | v["i"].isNotNull()
        | (F.size(F.coalesce(v["l"], F.array().cast("array<string>"))) > 0)
        | (F.size(F.coalesce(v["t"], F.array().cast("array<map<string,string>>"))) > 0)
    )


def rule_metrics(extracted: DataFrame) -> DataFrame:
    """A5 by template: rules applied, fields present (error messages are values too)."""
    hits = extracted.filter(F.col("template_id").isNotNull()).select(
        "template_id",
        F.size("values").alias("rules"),
        (
            F.size(F.filter("data", lambda v: F.coalesce(_non_null(v), F.lit(False))))
            + F.size(F.filter("data", lambda v: F.coalesce(v["error"], F.lit("")) != ""))
        ).alias("filled"),
    )
    return hits.groupBy("template_id").agg(
        F.count("*").alias("documents"), F.sum("rules").alias("field_count"), F.sum("filled").alias("non_null_count")
    )


def validator_metrics(extracted: DataFrame, check_counts: DataFrame) -> DataFrame:
    """A6 by template; ``check_counts``: (template_id, check_count)."""
    per = (
        extracted.filter(F.col("template_id").isNotNull())
        .groupBy("template_id")
        .agg(
            F.count("*").alias("documents"),
            F.count_if(F.size("errors") == 0).alias("passed"),
            F.sum(F.size("errors")).alias("error_count"),
        )
    )
    return per.join(check_counts, "template_id", "left")


def responder_metrics(decoded: DataFrame) -> DataFrame:
    """A7 by backend and model."""
    return decoded.groupBy("backend", "model").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("existing_template_id").isNotNull()).alias("updates"),
        F.count_if(F.col("reject").isNotNull()).alias("rejected"),
        F.sum(
            F.when(
                F.col("reject").isNull(),
                F.size(F.coalesce("body.extracted_data", F.create_map().cast("map<string,string>"))),
            ).otherwise(0)
        ).alias("field_count"),
    )


def field_counts(extracted: DataFrame) -> DataFrame:
    """A8."""
    return extracted.filter(F.col("template_id").isNotNull()).select(
        "doc_id", "template_id", field_count(F.col("data")).alias("field_count")
    )


class BatchClock:
    """A9. Wall time of a batch, spread over its documents."""

    def __enter__(self) -> BatchClock:
        self._start = time.monotonic()
        return self

    def __exit__(self, *_: object) -> None:
        self.elapsed_ms = (time.monotonic() - self._start) * 1000

    def per_document(self, documents: int) -> float:
        return self.elapsed_ms / documents if documents else 0.0
