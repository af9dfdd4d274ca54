"""Rules and checks of a small store are plain expressions of the plan; their results are those of the general form."""

from __future__ import annotations

import dataclasses
import re

import pytest

from docloom import corpus
from docloom.functions.patterns import never_empty, within_line
from docloom.operators.dimension import load
from docloom.operators.extraction import extract
from docloom.operators.validation import data_json, validate
from docloom.schemas import PAGE

RULES = [
    corpus._rule("name", regex=r"Name:\s*(\w*)", strip="x"),
    corpus._rule("bare", regex=r"Name"),
    corpus._rule("day", "date", r"Day:[ ]*([^\n]*)"),
    corpus._rule("own", "date", r"Day:\s*(\S+)", fmt="%d.%m.%y"),
    corpus._rule("amount", "decimal", r"Sum:\s*(\S*)"),
    corpus._rule("count", "integer", r"Count:([^\n]*)"),
    corpus._rule("words", "list", r"(W)(\d)"),
    corpus._rule("broken", regex="(a"),
    corpus._rule("python", regex=r"(?a:Name:\s*(\w+))"),
    corpus._rule("lines", "table", anchor=r"Pos\s+Art", stop=r"^Sum", columns=["a", "b", "a"]),
    corpus._rule("late", "table", anchor=r"^pos", stop=r"su[mn]|End\.", columns=["a", "b"]),
    corpus._rule("edge", "table", anchor=r"Art$", stop=r"^$", columns=["a"]),
]
CHECKS = [
    corpus._check("name", True, gt=2.0, regex_match=r"[a-z]+$"),
    corpus._check("day", True, regex_match=r"\d{4}-"),
    corpus._check("amount", True, gt=10.0, lt=100.0, regex_match=r"\d"),
    corpus._check("count", gt=0.0, lt=float("nan")),
    corpus._check("words", True, gt=1.0, regex_match=r"\["),
    corpus._check("lines", False, regex_match=r"x"),
    corpus._check("ghost", True),
    corpus._check("broken", False, lt=3.0),
    corpus._check("own", False, regex_match="(a"),
]
TEXTS = [
    "Name: xabcx\nDay: 31.12.1999\nSum: 1.234,50\nCount: 1.200\nW1 W2\nPos  Art\n1  b  c\n\n  2   d\nx  \nSum\n9  9",
    "name:\nDay: 31.02.2020\nSum: inf\nCount: x\npos\tart",
    "Name: 12\nDay: 2020-2-3\nSum: nan\nCount: 99999999999999999999\nPos\nArt\n1  2\nEnd.",
    "Name: 7\r\nDay: 1/2/2021\nSum: 12,5\nCount:  +3  \nPos Art x\n 1  2\r\n3  4\n suM",
    "Day:  1.2.69\nSum: ,\nCount:\nPos Art\n1  2  3\n4",
    "Pos Art\n",
    "",
    None,
]
PAGES = [None, [], [[["Pos Art"], ["1", "2"], [None, ""], ["Sum", ""]]], [[], [["x"], ["1"]], [["pos Art"], ["p", "q", "r"]]]]


def both(spark, rules, checks):
    store = corpus.as_store(
        spark, [{"template_id": "t", "required_keywords": ["k"], "supplier_hint": "", "doc_type": "d", "keyword_quorum": 0.5, "rules": rules, "checks": checks}]
    )
    dim = load(store)
    rows = [
        (f"{i}-{j}", template_id, text, None if tables is None else [(1, text, tables, "")])
        for i, text in enumerate(TEXTS)
        for j, tables in enumerate(PAGES)
        for template_id in ("t", None)
    ]
    docs = spark.createDataFrame(rows, f"doc_id string, template_id string, full_text string, pages array<{PAGE}>")
    assert dim.literal
    return [validate(extract(docs, d), d) for d in (dim, dataclasses.replace(dim, literal=None))]


def shown(df):
    return sorted(map(str, df.select("doc_id", "template_id", "values", "errors", "critical", data_json("data").alias("json")).collect()))


def test_compiled_rules_and_checks_give_the_same_as_the_general_form(spark):
    compiled, general = both(spark, RULES, CHECKS)
    assert shown(compiled) == shown(general)


def test_repeated_fields_give_the_same(spark):
    twice = [RULES[0], RULES[4], {**RULES[2], "field": "name"}]
    compiled, general = both(spark, twice, CHECKS[:3])
    assert shown(compiled) == shown(general)


def test_single_values_need_no_lambda(spark):
    """A lambda is interpreted value by value; single values of a small store were read inside of some."""
    singles = [r for r in RULES if r["type"] != "table" and r["field"] not in ("words", "python", "own")]
    store = corpus.as_store(
        spark, [{"template_id": "t", "required_keywords": ["k"], "supplier_hint": "", "doc_type": "d", "keyword_quorum": 0.5, "rules": singles, "checks": []}]
    )
    docs = spark.createDataFrame([("a", "t", TEXTS[0])], "doc_id string, template_id string, full_text string")
    plan = extract(docs, load(store))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def test_table_lines_are_found_without_a_lambda_a_line(spark):
    """Anchor and stop of a table were looked for in every line inside lambdas."""
    compiled, _ = both(spark, [RULES[9]], [])
    plan = compiled._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract(full_text" in plan and "array_position(transform(split(" not in plan


@pytest.mark.parametrize(
    ("java", "kept"),
    [
        (r"^Summe", "^Summe"),
        (r"a\s+(b|c)", r"a[\s&&[^\n]]+(?:b|c)"),
        (r"[\d.,]{2,3}\.", r"[\d.,]{2,3}\."),
        (r"a$", None),
        (r"a^", None),
        (r"\bA", None),
        (r"[^x]", None),
        (r"[\s]", None),
        (r"\D", None),
        (r"(?<=a)b", None),
        (r"(?i)b", None),
        (r"(a)\1", None),
        ("a\nb", None),
        (r"\x0A", None),
        (r"\n", None),
    ],
)
def test_patterns_that_stay_within_a_line(java, kept):
    assert within_line(java) == kept


@pytest.mark.parametrize(
    ("pattern", "never"), [("(a*)", False), ("a(b|)", False), ("x(?:y(a+))", True), ("x*", False), ("ab", True), ("(?P<n>.)", True), ("(?=(a*))x", False)]
)
def test_captures_that_are_never_empty(pattern, never):
    assert never_empty(pattern) == never
    if never:
        assert all(m.group(m.re.groups and 1) for m in re.finditer(pattern, "xya aab xb"))


def test_json_text_writes_plain_texts_without_a_writer(spark):
    import json

    from pyspark.sql import functions as F

    from docloom.functions.exprs import json_text

    odd = ["", "plain ~!#[]", 'q"', "b\\", "\n", "a\nb\n", "\x00", "\x1f", "\x7f", "é", " ", "😀", "/", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v string")
    rows = df.select("i", "v", json_text(F.col("v")).alias("json")).collect()
    assert {r["i"]: json.loads(r["json"]) for r in rows} == dict(enumerate(odd))
    before = F.when(F.col("v").isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.array("v")), r"(?s)\A\[(.*)\]\z", 1))
    assert df.filter(~json_text(F.col("v")).eqNullSafe(before)).count() == 0
    plan = df.select(json_text(F.col("v")).alias("json"))._jdf.queryExecution().analyzed().toString()
    assert "rlike" in plan.lower()  # only other texts meet the JSON writer
