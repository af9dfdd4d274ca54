"""Cleaning of learnt templates."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.exprs import materialise
from docloom.functions.patterns import prepare_pattern
from docloom.operators.dimension import PREPARED_RULE, Dimension, as_dimension, literals
from docloom.operators.extraction import attach_rules
from docloom.operators.mining import fill_keywords


def _group_counts(lists: pd.Series) -> pd.Series:
    known: dict[str | None, int | None] = {None: None}  # responses of one kind repeat their patterns

    def groups(pattern: str | None) -> int | None:
        if pattern not in known:
            known[pattern] = prepare_pattern(pattern).groups
        return known[pattern]

    return pd.Series(
        [None if ps is None else [groups(p) for p in ps] for ps in lists], dtype=object
    )


def group_counts(patterns: Column) -> Column:
    """K9, K10. Capture groups per pattern of an array; -1 for an invalid pattern, null for none."""
    return F.pandas_udf(_group_counts, "array<int>")(patterns)


def judge_rules(candidates: DataFrame) -> DataFrame:
    """Adds ``verdicts``: per rule null when it stays, else why it is dropped. Rules stay in their
    row; only their patterns visit Python."""
    blank = lambda c: F.when(c != "", c)
    sized = candidates.withColumn(
        "_groups",
        group_counts(
            F.flatten(
                F.transform(
                    "rules",
                    lambda r: F.array(blank(r["regex"]), blank(r["anchor_regex"]), blank(r["stop_regex"])),
                )
            )
        ),
    )

    def verdict(r: Column, i: Column) -> Column:
        regex, anchor, stop = (F.get(F.col("_groups"), i * 3 + k) for k in range(3))
        table = (
            F.when(anchor.isNull() | stop.isNull(), F.lit("table rule lacks anchor or stop"))  # K11
            .when(anchor < 0, F.lit("invalid anchor pattern"))
            .when(stop < 0, F.lit("invalid stop pattern"))
        )
        other = (
            F.when(regex.isNull(), F.lit("no pattern"))  # K8
            .when(regex < 0, F.lit("invalid pattern"))  # K9
            .when(regex != 1, F.concat(F.lit("capture groups must be 1, not "), regex.cast("string")))  # K10
        )
        return F.when(r["type"] == "table", table).otherwise(other)

    return materialise(sized, verdicts=F.transform("rules", verdict)).drop("_groups")


def drop_orphan_checks(checks: Column, rules: Column) -> Column:
    """K13. Checks whose field no surviving rule fills."""
    fields = F.transform(rules, lambda r: r["field"])
    return F.filter(checks, lambda c: F.array_contains(fields, c["field"]))


def sanitise_rules(candidates: DataFrame) -> DataFrame:
    """K8-K11, K13. Clean ``rules`` and ``checks``; ``dropped`` lists (rule_pos, field, reason)."""
    judged = judge_rules(candidates)
    dropped = F.filter(
        F.transform(
            "rules",
            lambda r, i: F.struct(
                i.alias("rule_pos"), r["field"].alias("field"), F.get(F.col("verdicts"), i).alias("reason")
            ),
        ),
        lambda d: d["reason"].isNotNull(),
    )
    kept = materialise(
        judged,
        dropped=dropped,
        rules=F.filter("rules", lambda r, i: F.get(F.col("verdicts"), i).isNull()),
    ).drop("verdicts")
    return kept.withColumn("checks", drop_orphan_checks(F.col("checks"), F.col("rules")))


def sanitise_templates(
    candidates: DataFrame,
    sources: DataFrame,
    templates: DataFrame | None,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """K14. Candidate templates (one per response_seq) cleaned against their source texts.

    ``sources``: (doc_id, full_text); only those of candidates are looked at. Several candidates of one
    document keep apart. The keyword step runs only when a store is given; collisions
    are counted against it without the candidate's own id.
    """
    clean = sanitise_rules(candidates)
    if templates is None:
        return clean
    proposals = (
        candidates.select(
            F.col("doc_id").alias("_source"),
            F.col("response_seq").alias("doc_id"),
            F.col("required_keywords").alias("proposed"),
            F.col("template_id").alias("own_template_id"),
        )
        .join(sources.select(F.col("doc_id").alias("_source"), "full_text"), "_source")
        .drop("_source")
    )
    keywords = fill_keywords(proposals, templates, cfg).select(F.col("doc_id").alias("response_seq"), "keywords")
    return (
        clean.join(keywords, "response_seq", "left")
        .withColumn("required_keywords", F.coalesce("keywords", "required_keywords"))
        .drop("keywords")
    )


def _found_in_python(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    known: dict[str, re.Pattern] = {}

    def found(text: str | None, pattern: str | None) -> bool | None:
        if text is None or pattern is None:
            return None
        if pattern not in known:
            known[pattern] = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
        return known[pattern].search(text) is not None

    return pd.Series([found(t, p) for t, p in zip(texts, patterns)], dtype=object)


def rule_coverage(
    docs: DataFrame, store: DataFrame | Dimension, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """K12. How often each pattern rule finds something in its template's documents.

    ``docs``: doc_id, template_id, full_text. One flag per rule leaves the text behind; the shuffle
    carries one partial row per rule and task. Patterns only Python can run are searched there.
    """
    dim = as_dimension(store, cfg)
    kinds = "array<struct<rule_pos:int,field:string,found:boolean>>"
    if dim.literal:
        branch = None
        for t in json.loads(dim.literal):
            found = [
                F.struct(
                    F.lit(r["rule_pos"]).alias("rule_pos"),
                    F.lit(r["field"]).alias("field"),
                    F.rlike("full_text", literals(r, PREPARED_RULE)["regex"]).alias("found"),
                )
                for r in t["rules"]
                if r["kind"] != "table" and r["regex"] and not r["static_error"]
            ]
            asked = F.col("template_id") == t["template_id"]
            chosen = F.array(*found).cast(kinds)
            branch = F.when(asked, chosen) if branch is None else branch.when(asked, chosen)
        flagged = docs.select("template_id", (F.lit(None).cast(kinds) if branch is None else branch).alias("_f"))
    else:
        attached = attach_rules(docs.select("template_id", "full_text"), dim)
        usable = F.filter(
            "_rules", lambda r: (r["kind"] != "table") & r["regex"].isNotNull() & r["static_error"].isNull()
        )
        flagged = attached.select(
            "template_id",
            F.transform(
                usable,
                lambda r: F.struct(
                    r["rule_pos"].alias("rule_pos"), r["field"].alias("field"), F.rlike("full_text", r["regex"]).alias("found")
                ),
            ).alias("_f"),
        )
    flags = flagged.select("template_id", F.inline("_f"))
    if dim.needs_python:
        lone = lambda r: (r["kind"] != "table") & r["regex"].isNull() & r["source_regex"].isNotNull() & r["static_error"].isNull()
        rest = attach_rules(docs.select("template_id", "full_text"), dim).select(
            "template_id", "full_text", F.explode(F.filter("_rules", lone)).alias("r")
        )
        flags = flags.unionByName(
            rest.select("template_id", "r.rule_pos", "r.field", F.pandas_udf(_found_in_python, "boolean")("full_text", "r.source_regex").alias("found"))
        )
    return flags.groupBy("template_id", "rule_pos", "field").agg(
        F.count("*").alias("documents"),
        F.count_if("found").alias("matched"),
        F.avg(F.col("found").cast("int")).alias("match_rate"),
    )
