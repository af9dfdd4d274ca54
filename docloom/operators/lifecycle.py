"""Template lifecycle: hit counters, merge, upsert, delete.

The store moves from snapshot to snapshot. Sequential updates of one template are folded with
aggregates: what follows the last replacement decides, so a template that receives a third of all
responses is folded by partial aggregation like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.joins import salted_left_join

_BODY = ["supplier_hint", "doc_type", "rules", "checks", "metadata", "version", "updated_at"]


def count_hits(templates: DataFrame, results: DataFrame, now: Column | None = None) -> DataFrame:
    """R2. +1 and a new updated_at per passed hit; tolerated and repaired hits do not count."""
    hits = (
        results.filter(F.col("route") == "HIT_PASS")
        .groupBy("template_id")
        .agg(F.count("*").alias("_hits"))
    )
    return add_hits(templates, hits.withColumnRenamed("_hits", "hits"), now)


def add_hits(templates: DataFrame, deltas: DataFrame, now: Column | None = None) -> DataFrame:
    """R2. Hit counts of a run or a stream (template_id, hits) laid on the store: the next snapshot."""
    now = F.localtimestamp() if now is None else now
    deltas = deltas.groupBy("template_id").agg(F.sum("hits").cast("bigint").alias("_hits"))
    out = templates.join(deltas, "template_id", "left")
    return out.withColumn(
        "hit_count", F.col("hit_count") + F.coalesce("_hits", F.lit(0))
    ).withColumn(
        "updated_at", F.when(F.col("_hits").isNotNull(), now).otherwise(F.col("updated_at"))
    ).select(*templates.columns)


def delete_templates(templates: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R5. (remaining templates, requested ids with ``found``)."""
    wanted = ids.select("template_id").distinct()
    present = templates.select("template_id", F.lit(True).alias("_present"))
    report = wanted.join(present, "template_id", "left").select(
        "template_id", F.coalesce("_present", F.lit(False)).alias("found")
    )
    return templates.join(wanted, "template_id", "left_anti"), report


def upsert(templates: DataFrame, incoming: DataFrame) -> DataFrame:
    """R4. Replace by id: an existing id keeps its place, a new one goes to the end in
    ``response_seq`` order; of several incoming rows for one id the last stands."""
    return fold_updates(
        templates, incoming.withColumn("existing_template_id", F.lit(None).cast("string"))
    )


def resolve_targets(templates: DataFrame, incoming: DataFrame) -> DataFrame:
    """Which template an incoming row changes, and how.

    merge: the responder chose another id than the template it was given, and that template is still
    stored. replace: everything else.
    """
    stored = templates.select(F.col("template_id").alias("existing_template_id"), F.lit(True).alias("_stored"))
    joined = salted_left_join(incoming, stored, ["existing_template_id"], ["response_seq"])
    merge = (
        F.col("existing_template_id").isNotNull()
        & F.coalesce("_stored", F.lit(False))
        & (F.col("template_id") != F.col("existing_template_id"))
    )
    return joined.withColumn("is_merge", merge).withColumn(
        "target_id", F.when(F.col("is_merge"), F.col("existing_template_id")).otherwise(F.col("template_id"))
    ).drop("_stored")


def fold_updates(templates: DataFrame, incoming: DataFrame, snapshot_id: int | None = None) -> DataFrame:
    """R3, R4. Fold incoming template rows (unique ``response_seq``) into the next snapshot.

    Same result as applying them one by one in response_seq order: a replacement starts a template
    over (fresh hit_count and created_at), a merge keeps id, created_at and hit_count, takes the
    newer rules and checks, unions keywords and keeps the lower quorum.
    """
    ops = resolve_targets(templates, incoming)
    newest = ops.groupBy("target_id").agg(
        F.min("response_seq").alias("first_seq"),
        F.max(F.when(~F.col("is_merge"), F.col("response_seq"))).alias("restart_seq"),
        F.max_by(F.struct(*_BODY), "response_seq").alias("body"),
        F.max_by(
            F.struct("created_at", "hit_count"), F.when(~F.col("is_merge"), F.col("response_seq"))
        ).alias("restart"),
    )
    # Only replaced templates have anything to leave out, and only three narrow columns meet their restart.
    slim = ops.select("target_id", "response_seq", "keyword_quorum", "required_keywords")
    restarts = newest.filter(F.col("restart_seq").isNotNull()).select("target_id", "restart_seq")
    # As many rows as targets, times the salts: too much to be broadcast whatever Spark makes of its size.
    live = salted_left_join(slim, restarts.hint("merge"), ["target_id"], ["response_seq"]).filter(
        F.col("restart_seq").isNull() | (F.col("response_seq") >= F.col("restart_seq"))
    )
    # A keyword enters with the first update that carries it, with all its copies in that update.
    keywords = (
        live.select("target_id", "response_seq", F.posexplode("required_keywords").alias("pos", "kw"))
        .groupBy("target_id", "response_seq", F.lower("kw").alias("low"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "kw"))).alias("copies"))
        .groupBy("target_id", "low")
        .agg(F.min(F.struct("response_seq", "copies")).alias("entry"))
        .select("target_id", "low", "entry.response_seq", F.explode("entry.copies").alias("copy"))
        .groupBy("target_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("response_seq", "copy.pos", "copy.kw", "low"))
            ).alias("added")
        )
    )
    quorums = live.groupBy("target_id").agg(F.min("keyword_quorum").alias("quorum"))
    changes = newest.join(quorums.hint("merge"), "target_id").join(keywords.hint("merge"), "target_id", "left")
    top = templates.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]

    old = templates.alias("o")
    both = old.join(changes.alias("n"), F.col("o.template_id") == F.col("n.target_id"), "full_outer")
    changed, restarted = F.col("target_id").isNotNull(), F.col("restart_seq").isNotNull()
    none = F.array().cast("array<string>")
    base = F.when(restarted, none).otherwise(F.coalesce("o.required_keywords", none))
    known = F.transform(base, F.lower)
    added = F.transform(
        F.filter(F.coalesce("added", F.array()), lambda a: ~F.array_contains(known, a["low"])),
        lambda a: a["kw"],
    )
    new_values = {
        "seq": F.coalesce("o.seq", F.lit(top + 1) + F.col("first_seq")),
        "snapshot_id": F.lit(snapshot_id).cast("bigint") if snapshot_id is not None else F.coalesce("o.snapshot_id", F.lit(0)),
        "template_id": F.coalesce("o.template_id", "target_id"),
        "required_keywords": F.concat(base, added),
        "keyword_quorum": F.when(restarted, F.col("quorum")).otherwise(
            F.least("quorum", "o.keyword_quorum")
        ),
        "created_at": F.when(restarted, F.col("restart.created_at")).otherwise(F.col("o.created_at")),
        "hit_count": F.when(restarted, F.col("restart.hit_count")).otherwise(F.col("o.hit_count")),
        **{c: F.col(f"body.{c}") for c in _BODY},
    }
    always = {"seq", "snapshot_id", "template_id"}
    return both.select(
        *[
            (
                new_values[c]
                if c in always
                else F.when(changed, new_values[c]).otherwise(F.col(f"o.{c}"))
            ).alias(c)
            for c in templates.columns
        ]
    )


def overlay_responses(results: DataFrame, decoded: DataFrame, targets: DataFrame) -> DataFrame:
    """R6. Results of documents that got a usable response: its data, responder named, validation
    forced to passed; score and old errors stay. ``targets``: (response_seq, target_id). The data is taken
    as given, JSON types included. Of several answers for a document the last stands."""
    answers = (
        decoded.filter(F.col("reject").isNull())
        .select(
            "doc_id",
            "response_seq",
            F.coalesce("data_json", F.lit("{}")).alias("_json"),
            F.coalesce(F.size(F.map_keys("body.extracted_data")), F.lit(0)).cast("bigint").alias("_fields"),
            F.col("backend").alias("_backend"),
            F.col("model").alias("_model"),
        )
        .join(targets.select("response_seq", "target_id"), "response_seq")
        .groupBy("doc_id")
        .agg(F.max_by(F.struct("_json", "_fields", "_backend", "_model", "target_id"), "response_seq").alias("_last"))
        .select("doc_id", "_last.*")
    )
    joined = results.join(answers, "doc_id", "left")
    answered = F.col("target_id").isNotNull()
    return joined.select(
        *[
            {
                "template_id": F.coalesce("target_id", "template_id").alias("template_id"),
                "data_json": F.coalesce("_json", "data_json").alias("data_json"),
                "field_count": F.coalesce("_fields", "field_count").alias("field_count"),
                "llm_used": (F.col("llm_used") | answered).alias("llm_used"),
                "llm_backend": F.coalesce("_backend", "llm_backend").alias("llm_backend"),
                "llm_model": F.coalesce("_model", "llm_model").alias("llm_model"),
                "validation_passed": (F.col("validation_passed") | answered).alias("validation_passed"),
            }.get(c, F.col(c))
            for c in results.columns
        ]
    )

