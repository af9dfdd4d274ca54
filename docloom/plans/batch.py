"""The deterministic pipeline: match, extract, validate, route. Map-only for a bounded store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.operators.dimension import Dimension, as_dimension
from docloom.operators.extraction import extract
from docloom.operators.matching import match
from docloom.operators.validation import data_json, field_count, validate

# Route names.
HIT_PASS = "HIT_PASS"
HIT_TOLERATED = "HIT_TOLERATED"
HIT_REPAIR = "HIT_REPAIR"
NEAR_MISS = "NEAR_MISS"
COLD_MISS = "COLD_MISS"


def route(cfg: EngineConfig) -> Column:
    """R1. A hit passes, is tolerated below the critical limit, or goes to repair; a miss is near or
    cold."""
    return (
        F.when(
            F.col("template_id").isNotNull(),
            F.when(F.coalesce(F.size("errors"), F.lit(0)) <= 0, F.lit(HIT_PASS))
            .when(F.col("critical") < cfg.validation_fallback_threshold, F.lit(HIT_TOLERATED))
            .otherwise(F.lit(HIT_REPAIR)),
        )
        .when(F.col("near_miss_id").isNotNull(), F.lit(NEAR_MISS))
        .otherwise(F.lit(COLD_MISS))
    )


def extract_documents(
    docs: DataFrame, store: DataFrame | Dimension, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """docs + match columns + values + data + errors + critical + route."""
    dim = as_dimension(store, cfg)
    checked = validate(extract(match(docs, dim, cfg), dim, cfg), dim)
    return checked.withColumn("route", route(cfg)).drop("_rules", "_checks")


def route_documents(extracted: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """D7 rows of the deterministic part.

    Only a passed or tolerated hit carries data; a repair keeps its old errors and, like a miss,
    waits for a response (``existing_template_id`` is the template to update).
    """
    settled = F.col("route").isin(HIT_PASS, HIT_TOLERATED)
    # Plain columns: the payload is written out only where somebody reads it.
    out = extracted.withColumns(
        {
            "data_json": F.when(settled, data_json("data")).otherwise(F.lit("{}")),
            "field_count": F.when(settled, field_count(F.col("data"))).otherwise(F.lit(0).cast("bigint")),
        }
    )
    none = F.lit(None).cast("string")
    return out.select(
        "doc_id",
        F.col("path").alias("document_path"),
        F.when(settled | (F.col("route") == HIT_REPAIR), F.col("template_id")).alias("template_id"),
        "match_score",
        "candidate_scores",
        "route",
        F.when(F.col("route") == HIT_REPAIR, F.col("template_id"))
        .when(F.col("route") == NEAR_MISS, F.col("near_miss_id"))
        .alias("existing_template_id"),
        "data_json",
        "field_count",
        F.lit(False).alias("llm_used"),
        none.alias("llm_backend"),
        none.alias("llm_model"),
        (F.col("route") == HIT_PASS).alias("validation_passed"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("validation_errors"),
        *carry,
    )


def run_batch(
    docs: DataFrame, store: DataFrame | Dimension, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    return route_documents(extract_documents(docs, store, cfg))
