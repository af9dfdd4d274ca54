"""Field checks (V1-V6, J12), evaluated in place on each document's extracted values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.exprs import built_once, float_text, json_text, let, materialise, python_float
from docloom.operators.dimension import PREPARED_CHECK, Dimension, literals

# This mark, and the message texts below, are those of the validation contract.
NULL_MARK = "null or empty"


def value_text(v: Column) -> Column:
    """A value as Python's str() shows it (quotes inside list items are not re-escaped)."""
    items = F.transform(v["l"], lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    rows = F.transform(
        v["t"],
        lambda m: F.concat(
            F.lit("{"),
            F.array_join(
                F.transform(
                    F.map_entries(m),
                    lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'")),
                ),
                ", ",
            ),
            F.lit("}"),
        ),
    )
    return F.coalesce(
        v["s"],
        float_text(v["d"]),
        v["i"].cast("string"),
        F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")),
        F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]")),
    )


def is_absent(v: Column) -> Column:
    """No value at all (an empty text or list is a value)."""
    return v["s"].isNull() & v["d"].isNull() & v["i"].isNull() & v["l"].isNull() & v["t"].isNull()


def value_number(v: Column) -> Column:
    return F.coalesce(v["d"], v["i"].cast("double"), python_float(v["s"]))


def _bound_error(field: Column, text: Column, number: Column, bound: Column, name: str) -> Column:
    """V2, V3. NaN on either side compares false, so it is never an error."""
    if name == "gt":
        broken, sign = number <= bound, ">"
    else:
        broken, sign = number >= bound, "<"
    quoted = F.concat(F.lit("Field '"), field, F.lit("'"))
    return F.when(
        bound.isNotNull(),
        F.when(
            number.isNull(), F.concat(quoted, F.lit(f" is not numeric for {name} check"))
        ).when(
            broken & ~F.isnan(number) & ~F.isnan(bound),
            F.concat(quoted, F.lit(" value "), text, F.lit(f" is not {sign} "), float_text(bound)),
        ),
    )


def _check_errors(check: Column, data: Column, matched: Column | None) -> Column:
    """V1-V4 for one check: its messages in the order null, gt, lt, pattern. ``matched``: what Python says."""
    field = check["field"]
    none = F.array().cast("array<string>")

    def fits(text: Column) -> Column:
        """V4."""
        native = F.rlike(text, check["java"])
        return native if matched is None else F.when(check["python_only"], F.coalesce(matched, F.lit(True))).otherwise(native)

    def on_value(v: Column) -> Column:
        # A field without a value looks like an absent one.
        missing = v.isNull() | is_absent(v)
        pattern = F.when(
            check["bad_pattern"],
            F.concat(F.lit("Field '"), field, F.lit("' check pattern is invalid: "), check["regex_match"]),
        ).when(
            check["regex_match"].isNotNull() & (check["regex_match"] != ""),
            let(
                value_text(v),
                lambda text: F.when(
                    ~fits(text),
                    F.concat(
                        F.lit("Field '"), field, F.lit("' value '"), text,
                        F.lit("' does not match pattern '"), check["regex_match"], F.lit("'"),
                    ),
                ),
            ),
        )
        bounded = check["gt"].isNotNull() | check["lt"].isNotNull()
        return (
            F.when(
                check["not_null"] & (missing | F.coalesce(v["s"] == "", F.lit(False))),
                F.array(F.concat(F.lit("Required field '"), field, F.lit(f"' is {NULL_MARK}"))),
            )
            .when(missing, none)
            .otherwise(
                let(
                    F.when(bounded, F.struct(value_text(v).alias("text"), value_number(v).alias("num"))),
                    lambda n: F.array_compact(
                        F.array(
                            *[F.when(bounded, _bound_error(field, n["text"], n["num"], check[b], b)) for b in ("gt", "lt")],
                            pattern,
                        )
                    ),
                )
            )
        )

    return let(F.get(F.filter(data, lambda d: d["field"] == field), F.lit(0)), on_value)


def _field_value(data: str, check: Column) -> Column:
    """J12."""
    return F.get(F.filter(data, lambda d: d["field"] == check["field"]), F.lit(0))


def _python_matches(asked: pd.Series) -> pd.Series:
    """V4 where only Python can run the pattern: null where nothing is asked."""
    known: dict[str, re.Pattern] = {}

    def fits(question: dict | None) -> bool | None:
        if question is None or question["text"] is None:
            return None
        pattern = question["pattern"]
        if pattern not in known:
            known[pattern] = re.compile(pattern)
        return known[pattern].match(question["text"]) is not None

    return pd.Series([None if qs is None else [fits(q) for q in qs] for qs in asked], dtype=object)


def validate(extracted: DataFrame, dim: Dimension | None = None) -> DataFrame:
    """V5, V6. Adds ``errors`` (check order) and ``critical``; needs ``data``, and ``_checks`` unless
    ``dim`` holds the checks as literals.

    ``errors`` is null where no template was matched, empty where every check passed. Without ``dim`` any check
    may need Python.
    """
    literal, in_python = (dim.literal, dim.python_checks) if dim is not None else (None, True)
    if in_python:
        asked = _literal_questions(literal, "data") if literal else _questions("_checks", "data")
        # a step of its own: Spark doesn't find a Python function whose argument nests lambdas like these
        extracted = materialise(extracted, _asked=asked)
        extracted = materialise(extracted, _matched=F.pandas_udf(_python_matches, "array<boolean>")("_asked")).drop("_asked")
    matched = "_matched" if in_python else ""
    errors = _literal_errors(literal, "data", matched) if literal else all_errors("_checks", "data", matched)
    checked = materialise(extracted, errors=errors).drop("_matched")
    return checked.withColumn("critical", critical_count(F.col("errors")))


QUESTION = "struct<pattern:string,text:string>"


def _question(check: Column, data: str) -> Column:
    text = let(_field_value(data, check), value_text)
    return F.when(check["python_only"], F.struct(check["regex_match"].alias("pattern"), text.alias("text"))).cast(QUESTION)


@built_once
def _questions(checks: str, data: str) -> Column:
    """One entry per check, null for those that the JVM answers; null if it answers all."""
    asked = F.transform(checks, lambda c: _question(c, data))
    return F.when(F.exists(checks, lambda c: c["python_only"]), asked)


@built_once
def _literal_questions(prepared: str, data: str) -> Column:
    kind = f"array<{QUESTION}>"
    branch = F.when(F.lit(False), F.lit(None).cast(kind))
    for t in json.loads(prepared):
        if any(c["python_only"] for c in t["checks"]):
            asked = F.array(*[_question(literals(c, PREPARED_CHECK), data) for c in t["checks"]]).cast(kind)
            branch = branch.when(F.col("template_id") == t["template_id"], asked)
    return branch


@built_once
def all_errors(checks: str, data: str, matched: str = "") -> Column:
    """V5. Messages of all checks, in check order."""
    answer = lambda i: F.get(F.col(matched), i) if matched else None
    return F.flatten(F.transform(checks, lambda c, i: _check_errors(c, F.col(data), answer(i))))


def _compiled_messages(check: dict, v: Column, kind: str, matched: Column | None) -> list[Column]:
    """V1-V4 for one check on the value ``v`` of known kind, both known when the plan is made: each message or null.

    ``_check_errors`` without a lambda, so that Spark compiles it."""
    part = {"decimal": "d", "integer": "i", "list": "l", "table": "t"}.get(kind, "s")
    quoted = f"Field '{check['field']}'"
    missing = v[part].isNull()
    empty = (missing | (v["s"] == "")) if part == "s" else missing
    text = {"s": v["s"], "d": float_text(v["d"]), "i": v["i"].cast("string")}.get(part, value_text(v))
    number = {"s": python_float(v["s"]), "d": v["d"], "i": v["i"].cast("double")}.get(part, F.lit(None).cast("double"))
    refused = empty if check["not_null"] else F.lit(False)
    out = [F.when(empty, F.lit(f"Required field '{check['field']}' is {NULL_MARK}"))] if check["not_null"] else []
    asked = ~missing & ~refused
    for name in ("gt", "lt"):
        if check[name] is not None:
            out.append(F.when(asked, _bound_error(F.lit(check["field"]), text, number, F.lit(check[name]), name)))
    if check["bad_pattern"]:
        out.append(F.when(asked, F.lit(f"{quoted} check pattern is invalid: {check['regex_match']}")))
    elif check["regex_match"]:
        fits = F.rlike(text, F.lit(check["java"]).cast("string")) if matched is None else F.coalesce(matched, F.lit(True))
        message = F.concat(F.lit(f"{quoted} value '"), text, F.lit(f"' does not match pattern '{check['regex_match']}'"))
        out.append(F.when(asked & ~fits, message))
    return out


def _compiled_errors(t: dict, data: str, answers: list[Column | None], general: Column) -> Column:
    """All messages of a template's checks where ``data`` has its rules' fields in their order, else ``general``."""
    places = {r["field"]: (i, r["kind"]) for i, r in enumerate(t["rules"])}
    if len(places) != len(t["rules"]) or None in places or any(c["field"] is None for c in t["checks"]):
        return general
    as_ruled = F.size(data) == len(t["rules"])
    for field, (i, kind) in places.items():
        v = F.get(data, F.lit(i))
        as_ruled = as_ruled & (v["field"] == field) & (v["kind"] == kind)
    messages = []
    for c, answer in zip(t["checks"], answers):
        if c["field"] in places:
            i, kind = places[c["field"]]
            messages += _compiled_messages(c, F.get(data, F.lit(i)), kind, answer)
        elif c["not_null"]:
            messages.append(F.lit(f"Required field '{c['field']}' is {NULL_MARK}"))
    found = F.array_compact(F.array(*messages).cast("array<string>")) if messages else F.array().cast("array<string>")
    return F.when(as_ruled, found).otherwise(general)


@built_once
def _literal_errors(prepared: str, data: str, matched: str) -> Column:
    """The same messages with every pattern a literal of the plan: one branch per template."""
    branch, text = None, "array<string>"
    for t in json.loads(prepared):
        answers = [F.get(F.col(matched), F.lit(i)) if c["python_only"] else None for i, c in enumerate(t["checks"])]
        found = [_check_errors(literals(c, PREPARED_CHECK), F.col(data), a) for c, a in zip(t["checks"], answers)]
        chosen = _compiled_errors(t, data, answers, F.concat(F.array().cast(text), *found))
        asked = F.col("template_id") == t["template_id"]
        branch = F.when(asked, chosen) if branch is None else branch.when(asked, chosen)
    return F.lit(None).cast(text) if branch is None else branch


def critical_count(errors: Column) -> Column:
    """V6."""
    return F.size(F.filter(errors, lambda e: F.contains(e, F.lit(NULL_MARK))))


def value_json(v: Column) -> Column:
    """One value as JSON."""
    return F.coalesce(
        F.when(v["s"].isNotNull(), json_text(v["s"])),
        F.when(F.isnan(v["d"]), F.lit("NaN")).otherwise(float_text(v["d"])),
        v["i"].cast("string"),
        F.to_json(v["l"]),
        F.to_json(v["t"]),
        F.lit("null"),
    )


@built_once
def data_json(column: str) -> Column:
    """The extracted payload as one JSON object, error keys included."""
    members = F.transform(
        column,
        lambda v: F.concat(
            json_text(v["field"]),
            F.lit(":"),
            value_json(v),
            F.when(
                v["error"].isNotNull(),
                F.concat(
                    F.lit(","), json_text(F.concat(v["field"], F.lit(".__error"))), F.lit(":"), json_text(v["error"])
                ),
            ).otherwise(F.lit("")),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def field_count(data: Column) -> Column:
    """A8. Keys of the payload, error keys included."""
    return (F.size(data) + F.size(F.filter(data, lambda v: v["error"].isNotNull()))).cast("bigint")

