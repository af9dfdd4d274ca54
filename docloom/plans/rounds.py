"""Learning in rounds: every round reads one store snapshot and writes the next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.operators.dimension import load
from docloom.operators.lifecycle import count_hits, fold_updates, overlay_responses, resolve_targets
from docloom.operators.sanitise import sanitise_templates
from docloom.operators.templates import build_templates
from docloom.plans.batch import COLD_MISS, HIT_REPAIR, NEAR_MISS, extract_documents, route_documents
from docloom.session import through_table
from docloom.sources.responses import Responder, ask, build_requests, decode_responses


@dataclass(frozen=True)
class Round:
    results: DataFrame
    templates: DataFrame
    rejected: DataFrame


def settle(
    pending: DataFrame,
    responses: DataFrame,
    templates: DataFrame,
    cfg: EngineConfig,
    snapshot_id: int,
    empty_is_object=None,
) -> Round:
    """Fold responses into the store and overlay them on the results.

    ``pending``: result rows plus ``pending_text`` (the full text where a response is awaited).
    """
    decoded = decode_responses(responses, empty_is_object)
    sources = pending.filter(F.col("pending_text").isNotNull()).select(
        "doc_id", F.col("pending_text").alias("full_text")
    )
    clean = through_table(
        sanitise_templates(build_templates(decoded), sources, templates, cfg).drop("dropped"),
        "learnt",
    )
    results = pending.drop("pending_text")
    counted = count_hits(templates, results)
    targets = resolve_targets(templates, clean)
    return Round(
        results=overlay_responses(results, decoded, targets),
        templates=fold_updates(counted, clean, snapshot_id),
        rejected=decoded.filter(F.col("reject").isNotNull()).select("response_seq", "doc_id", "raw", "reject"),
    )


def routed_with_text(extracted: DataFrame) -> DataFrame:
    """Result rows, with the text of those documents that wait for a response.

    Carrying the text here saves joining all texts to the waiting documents later.
    """
    routed = route_documents(extracted, carry=("full_text",))
    waiting = F.col("route").isin(HIT_REPAIR, NEAR_MISS, COLD_MISS)
    return routed.withColumn("pending_text", F.when(waiting, F.col("full_text"))).drop("full_text")


def learn_round(
    docs: DataFrame,
    templates: DataFrame,
    responder: Responder,
    cfg: EngineConfig = EngineConfig(),
    snapshot_id: int = 1,
) -> Round:
    """One round: settle hits, ask the responder for the rest, learn from its answers.

    Every document of a round sees the same snapshot. Responses are stored before they are used, so
    a lost executor never asks the responder twice.
    """
    pending = through_table(
        routed_with_text(extract_documents(docs, load(templates, cfg), cfg)), "routed"
    )
    waiting = pending.filter(F.col("pending_text").isNotNull()).select(
        "doc_id", "existing_template_id", F.col("pending_text").alias("full_text")
    )
    responses = through_table(
        ask(build_requests(waiting, cfg.prompt_max_chars), responder), "responses"
    )
    return settle(pending, responses, templates, cfg, snapshot_id)
