"""The template dimension: small for most users, never assumed to be.

``load`` measures the store where it lies. Within the bound its rows become plan literals (matching)
and a small prepared table (rules, checks). Beyond it ``rows`` stays None and every operator takes
its join-based way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.exprs import let
from docloom.functions.patterns import ANCHOR, MATCH, SEARCH, date_pattern, prepare_pattern

MATCH_FIELDS = (
    "array<struct<seq:bigint,template_id:string,kw_ids:array<int>,hint_id:int,quorum:double>>"
)

PREPARED_RULE = (
    "struct<rule_pos:int,field:string,kind:string,regex:string,groups:int,source_regex:string,"
    "anchor:string,stop:string,columns:array<string>,col_idx:array<int>,strip_chars:string,"
    "date_re:string,date_repl:string,source_format:string,python_only:boolean,"
    "static_error:string,source_anchor:string,source_stop:string>"
)
PREPARED_CHECK = (
    "struct<field:string,not_null:boolean,gt:double,lt:double,regex_match:string,java:string,"
    "bad_pattern:boolean,python_only:boolean>"
)
PREPARED = (
    f"template_id string, rules array<{PREPARED_RULE}>, checks array<{PREPARED_CHECK}>"
)


@dataclass(frozen=True)
class InlineStore:
    """The matching part of a bounded store as plan literals."""

    templates: Column
    keywords: Column
    hints: list[str]
    size: int


@dataclass(frozen=True)
class Dimension:
    templates: DataFrame
    rows: list[Row] | None
    prepared: DataFrame
    # Which patterns only Python can run: of single values and lists, of tables, of checks.
    needs_python: bool
    python_tables: bool
    python_checks: bool
    # Small enough to be matched as plain column expressions.
    compiled: bool = False
    # Prepared templates (as JSON text) whose patterns become literals of the plan; None: too many.
    literal: str | None = None
    cfg: EngineConfig = field(default_factory=EngineConfig)

    @property
    def inline(self) -> InlineStore | None:
        return None if self.rows is None else inline_store(self.rows)


def match_columns(templates: DataFrame) -> DataFrame:
    """What matching reads, case-folded by Spark so that both sides fold alike."""
    return templates.select(*_match_columns())


def _match_columns() -> list[Column]:
    return [
        F.col("seq"),
        F.col("template_id"),
        F.transform(
            F.coalesce("required_keywords", F.array().cast("array<string>")), F.lower
        ).alias("kws"),
        F.lower(F.coalesce("supplier_hint", F.lit(""))).alias("hint"),
        F.coalesce("keyword_quorum", F.lit(0.6)).alias("quorum"),
    ]


def load(templates: DataFrame, cfg: EngineConfig = EngineConfig()) -> Dimension:
    wanted = templates.select(*_match_columns(), "rules", "checks")
    n, n_ids, n_kw, n_bytes = wanted.agg(
        F.count("*"),
        F.count_distinct("template_id"),
        F.coalesce(F.sum(F.size("kws")), F.lit(0)),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)),
    ).first()
    if n_ids != n:
        raise ValueError("template ids of a store must be unique and not null")
    if (
        n > cfg.inline_max_templates
        or n_kw > cfg.inline_max_keywords
        or n_bytes > cfg.inline_max_bytes
    ):
        prepared = templates.select("template_id", "rules", "checks").mapInPandas(
            _prepare_batches, PREPARED
        )
        return Dimension(templates, None, _kept_jvm_patterns(prepared), True, True, True, cfg=cfg)
    rows = wanted.collect()
    ready = [_prepare_template(r["template_id"], r["rules"], r["checks"]) for r in rows]
    _keep_jvm_patterns(templates.sparkSession, ready)
    prepared = F.broadcast(templates.sparkSession.createDataFrame(ready, PREPARED))
    in_python = {rule["kind"] == "table" for t in ready for rule in t["rules"] if rule["python_only"]}
    checks_in_python = any(check["python_only"] for t in ready for check in t["checks"])
    compiled = n <= cfg.compiled_max_templates and n_kw <= cfg.compiled_max_keywords
    few = compiled and sum(len(t["rules"]) + len(t["checks"]) for t in ready) <= cfg.compiled_max_rules
    literal = json.dumps(ready) if few else None
    return Dimension(templates, rows, prepared, False in in_python, True in in_python, checks_in_python, compiled, literal, cfg)


def literals(values: dict, ddl: str) -> dict[str, Column]:
    """A prepared rule or check as one literal column per field of its struct type."""

    def one(value, kind: str) -> Column:
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value]).cast(kind)
        return F.lit(value).cast(kind)

    fields = [f.split(":") for f in ddl[len("struct<") : -1].split(",")]
    return {name: one(values[name], kind) for name, kind in fields}


def as_dimension(store: DataFrame | Dimension, cfg: EngineConfig) -> Dimension:
    return store if isinstance(store, Dimension) else load(store, cfg)


def inline_store(rows: list[Row]) -> InlineStore:
    """Plan literals from match_columns rows (already bounded)."""
    kw_index: dict[str, int] = {}
    hint_index: dict[str, int] = {}
    entries = []
    for r in sorted(rows, key=lambda r: r["seq"]):
        ids = [kw_index.setdefault(k, len(kw_index)) for k in r["kws"]]
        # A template without keywords scores 0 and never looks at its supplier.
        hint = hint_index.setdefault(r["hint"], len(hint_index)) if ids and r["hint"] else -1
        entries.append(
            {
                "seq": r["seq"],
                "template_id": r["template_id"],
                "kw_ids": ids,
                "hint_id": hint,
                "quorum": r["quorum"],
            }
        )
    return InlineStore(
        templates=F.from_json(F.lit(json.dumps(entries)), MATCH_FIELDS),
        keywords=F.from_json(F.lit(json.dumps(list(kw_index))), "array<string>"),
        hints=list(hint_index),
        size=len(entries),
    )


# --- rules and checks made ready for the JVM ----------------------------------------------------


def _prepare_rule(pos: int, rule) -> dict:
    kind = rule["type"] if rule["type"] in ("table", "date", "decimal", "integer", "list") else "string"
    out = {
        "rule_pos": pos,
        "field": rule["field"],
        "kind": kind,
        "regex": None,
        "groups": 0,
        "source_regex": rule["regex"] or None,
        "anchor": None,
        "stop": None,
        "columns": [],
        "col_idx": [],
        "strip_chars": rule["strip_chars"] or None,
        "date_re": None,
        "date_repl": None,
        "source_format": None,
        "python_only": False,
        "static_error": None,
        "source_anchor": None,
        "source_stop": None,
    }
    if kind == "table":
        for name, key in (("anchor", "anchor_regex"), ("stop", "stop_regex")):
            p = prepare_pattern(rule[key])
            out["source_" + name] = rule[key] or None
            out["static_error"] = out["static_error"] or p.error
            out["python_only"] = out["python_only"] or p.python_syntax
            out[name] = ANCHOR + p.java if p.java else None
        if out["python_only"]:
            out["anchor"] = out["stop"] = None
        # A repeated column name keeps its first place and its last cell.
        last = {c: i for i, c in enumerate(list(rule["columns"] if rule["columns"] is not None else []))}
        out["columns"], out["col_idx"] = list(last), list(last.values())
        return out
    p = prepare_pattern(rule["regex"])
    out["groups"] = max(p.groups, 0)
    out["static_error"] = p.error
    # A list takes an unset group as "", as the JVM does; a single value fails on it.
    out["python_only"] = p.python_syntax or (p.optional_group and kind != "list")
    out["regex"] = SEARCH + p.java if p.java else None
    if kind == "date" and rule["date_format"]:
        translated = date_pattern(rule["date_format"])
        if translated:
            out["date_re"], out["date_repl"] = translated
        else:
            out["source_format"] = rule["date_format"]
            out["python_only"] = True
    return out


def _prepare_check(check) -> dict:
    p = prepare_pattern(check["regex_match"])
    return {
        "field": check["field"],
        "not_null": bool(check["not_null"]),
        "gt": _number(check["gt"]),
        "lt": _number(check["lt"]),
        "regex_match": check["regex_match"],
        "java": None if p.java is None or p.python_syntax else MATCH + r"\A(?:" + p.java + ")",
        "bad_pattern": p.error is not None,
        "python_only": p.python_syntax,
    }


def _number(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


def _prepare_template(template_id: str, rules, checks) -> dict:
    rules = [] if rules is None else list(rules)
    checks = [] if checks is None else list(checks)
    return {
        "template_id": template_id,
        "rules": [_prepare_rule(i, r) for i, r in enumerate(rules)],
        "checks": [_prepare_check(c) for c in checks],
    }


def _prepare_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            [
                _prepare_template(t, rs, cs)
                for t, rs, cs in zip(batch["template_id"], batch["rules"], batch["checks"])
            ],
            columns=["template_id", "rules", "checks"],
        )


def _keep_jvm_patterns(spark, ready: list[dict]) -> None:
    """A pattern the JVM refuses would end the whole job: such rules and checks run in Python instead."""

    def refused(pattern: str | None) -> bool:
        if pattern is None:
            return False
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
            return False
        except Exception:
            return True

    for template in ready:
        for rule in template["rules"]:
            if any(refused(rule[p]) for p in ("regex", "anchor", "stop")):
                rule["regex"], rule["anchor"], rule["stop"], rule["python_only"] = None, None, None, True
        for check in template["checks"]:
            if refused(check["java"]):
                check["java"], check["python_only"] = None, True


def _kept_jvm_patterns(prepared: DataFrame) -> DataFrame:
    """The same for a store of any size, where its rows lie."""

    def refused(pattern: Column) -> Column:
        compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)
        return pattern.isNotNull() & compiled.isNull()

    def without(row: Column, ddl: str, patterns: tuple[str, ...]) -> Column:
        names = [f.split(":")[0] for f in ddl[len("struct<") : -1].split(",")]
        bad = reduce(Column.__or__, [refused(row[p]) for p in patterns])

        def kept(name: str, bad: Column) -> Column:
            if name in patterns:
                return F.when(~bad, row[name])
            return row[name] | bad if name == "python_only" else row[name]

        return let(bad, lambda b: F.struct(*[kept(n, b).alias(n) for n in names]))

    return prepared.select(
        "template_id",
        F.transform("rules", lambda r: without(r, PREPARED_RULE, ("regex", "anchor", "stop"))).alias("rules"),
        F.transform("checks", lambda c: without(c, PREPARED_CHECK, ("java",))).alias("checks"),
    )
