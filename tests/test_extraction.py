"""Rules and checks: texts, rules and the values they must give."""

import json
import re

import pytest
from pyspark.sql import functions as F

from docloom import corpus
from docloom.config import EngineConfig
from docloom.functions.text import normalise_text
from docloom.operators import dimension, extraction
from docloom.operators.extraction import extract
from docloom.operators.validation import data_json, validate


def rule(field, type="string", regex=None, **more):
    names = {"anchor": None, "stop": None, "columns": None, "strip": None, "fmt": None}
    return corpus._rule(field, type, regex, **{**names, **more})


def check(field, **more):
    return corpus._check(field, **more)


def as_python(v):
    if v["d"] is not None:
        return v["d"]
    if v["i"] is not None:
        return v["i"]
    if v["l"] is not None:
        return list(v["l"])
    if v["t"] is not None:
        return [dict(m) for m in v["t"]]
    return v["s"]


LARGE = EngineConfig(inline_max_templates=0)


def run(spark, rules, checks, texts, pages=None, cfg=EngineConfig()):
    store = corpus.as_store(
        spark,
        [{"template_id": "t", "required_keywords": [], "supplier_hint": "", "doc_type": "x", "keyword_quorum": 0.6, "rules": rules, "checks": checks}],
    )
    pages = pages or [[] for _ in texts]
    rows = [
        (str(i), "t", t, [{"page_num": n + 1, "text": "", "tables": p, "sheet_name": ""} for n, p in enumerate(ps)])
        for i, (t, ps) in enumerate(zip(texts, pages))
    ]
    docs = spark.createDataFrame(
        rows,
        "doc_id string, template_id string, full_text string, pages array<struct<page_num:int,text:string,tables:array<array<array<string>>>,sheet_name:string>>",
    )
    dim = dimension.load(store, cfg)
    out = validate(extract(docs, dim)).withColumn("json", data_json("data")).orderBy(F.col("doc_id").cast("int")).collect()
    return out, dim


TEXTS = [
    "Ref-No: 4711\r\nDue: 07.03.25\r\nAmount - USD",
    "Ref-No:   x\nDue: 9.4.2025\nAmount 7,654.32 USD\nCount 2.345\nMark #;q9;#",
    "Due: 30.02.2025\nAmount 2,345,678 USD\nCount 34z\nMark ;#;",
    "Due: 2025-11-08\nAmount 2.345,60 USD\nCount 88888888888\nB7 C8 D9",
    "Due: 8/11/2025\nAt 06:15 03.04.71\nxy XY",
    "Row  Thing  Price\n1  Lamp  2,00\n\n 2  Desk \n   \n3  a  b  c  d\nTOTAL 5\n4  Rest  1",
    "no header\nRow Thing\n1  x\n2  y",
    "Row Thing Total\nTotal at once",
    "",
]
NO_GROUP, UNSET = "no such group", "'NoneType' object has no attribute 'strip'"
UNCLOSED = "missing ), unterminated subpattern at position 0"


class Error(str):
    """The message a rule leaves instead of a value."""


# Each rule with what it gives for each of TEXTS.
EXPECTED = [
    (rule("number", regex=r"Ref-No:\s*(\d*)"), ["4711", "", *[None] * 7]),
    (
        rule("day", "date", r"Due:\s*([\d./-]+)"),
        ["2025-03-07", "2025-04-09", "30.02.2025", "2025-11-08", "2025-11-08", *[None] * 4],
    ),
    (
        rule("strict", "date", r"Due:\s*([\d./-]+)", fmt="%d.%m.%Y"),
        ["07.03.25", "2025-04-09", "30.02.2025", "2025-11-08", "8/11/2025", *[None] * 4],
    ),
    (rule("stamp", "date", r"At\s+(\d+:\d+ \d+\.\d+\.\d+)", fmt="%H:%M %d.%m.%y"), [*[None] * 4, "1971-04-03", *[None] * 4]),
    (rule("amount", "decimal", r"Amount\s+([\d.,-]+)\s+USD"), [None, 7.65432, None, 2345.6, *[None] * 5]),
    (
        rule("count", "integer", r"Count\s+(\w[\w.]*)"),
        [None, 2345, Error("invalid literal for int() with base 10: '34z'"), 88888888888, *[None] * 5],
    ),
    (rule("code", regex=r"Mark (\S+)", strip="#;"), [None, "q9", "", *[None] * 6]),
    (rule("none"), [None] * 9),
    (rule("odd", "unheard-of", r"(XY)"), [*[None] * 4, "xy", *[None] * 4]),
    (rule("pairs", "list", r"([A-Z])\d"), [[], ["q"], [], ["B", "C", "D"], *[[]] * 5]),
    (rule("whole", "list", r"[A-Z]\d"), [[], ["q9"], [], ["B7", "C8", "D9"], *[[]] * 5]),
    (rule("nothing", "list"), [[]] * 9),
    (rule("broken", regex=r"(unclosed"), [Error(UNCLOSED)] * 9),
    (rule("flat", regex=r"Amount"), [*[Error(NO_GROUP)] * 4, *[None] * 5]),
    (rule("maybe", regex=r"Due(x)?:"), [*[Error(UNSET)] * 5, *[None] * 4]),
    (rule("either", regex=r"(Count)|Mark"), [None, "Count", "Count", "Count", *[None] * 5]),
    (
        rule("lines", "table", anchor=r"Row\s+Thing", stop=r"^total", columns=["pos", "name", "more"]),
        [
            *[[]] * 5,
            [
                {"pos": "1", "name": "Lamp", "more": "2,00"},
                {"pos": "2", "name": "Desk", "more": ""},
                {"pos": "3", "name": "a", "more": "b"},
            ],
            [{"pos": "1", "name": "x", "more": ""}, {"pos": "2", "name": "y", "more": ""}],
            [],
            [],
        ],
    ),
    (
        rule("same", "table", anchor=r"Row\s+Thing", stop=r"^total", columns=["a", "b", "a"]),
        [
            *[[]] * 5,
            [{"a": "2,00", "b": "Lamp"}, {"a": "", "b": "Desk"}, {"a": "b", "b": "a"}],
            [{"a": "", "b": "x"}, {"a": "", "b": "y"}],
            [],
            [],
        ],
    ),
    (rule("plain", "table", columns=["a"]), [[]] * 9),
]
RULES = [r for r, _ in EXPECTED]
CHECKS = [
    check("number", not_null=True, regex_match=r"\d+$"),
    check("amount", gt=0.0, lt=1000.0),
    check("count", gt=100.0, lt=10000000.0, regex_match="2"),
    check("code", gt=1.0),
    check("day", not_null=True, regex_match=r"\d{4}-"),
    check("pairs", not_null=True, regex_match=r"\['B'"),
    check("lines", not_null=True),
    check("ghost", not_null=True),
    check("ghost", gt=1.0),
]
NO_NUMBER, NO_DAY, NO_GHOST = (f"Required field '{f}' is null or empty" for f in ("number", "day", "ghost"))
NO_PAIRS = r"Field 'pairs' value '[]' does not match pattern '\['B''"
NO_CODE = "Field 'code' is not numeric for gt check"
MESSAGES = [
    [NO_PAIRS, NO_GHOST],
    [NO_NUMBER, NO_CODE, r"Field 'pairs' value '['q']' does not match pattern '\['B''", NO_GHOST],
    [NO_NUMBER, NO_CODE, r"Field 'day' value '30.02.2025' does not match pattern '\d{4}-'", NO_PAIRS, NO_GHOST],
    [
        NO_NUMBER,
        "Field 'amount' value 2345.6 is not < 1000.0",
        "Field 'count' value 88888888888 is not < 10000000.0",
        "Field 'count' value '88888888888' does not match pattern '2'",
        NO_GHOST,
    ],
    [NO_NUMBER, NO_PAIRS, NO_GHOST],
    *[[NO_NUMBER, NO_DAY, NO_PAIRS, NO_GHOST]] * 4,
]


def values_of(row):
    return {v["field"]: Error(v["error"]) if v["error"] is not None else as_python(v) for v in row["data"]}


def test_values_and_messages(spark):
    out, dim = run(spark, RULES, CHECKS, TEXTS)
    assert dim.needs_python
    for i, row in enumerate(out):
        assert values_of(row) == {r["field"]: want[i] for r, want in EXPECTED}, TEXTS[i]
        assert row["errors"] == MESSAGES[i], TEXTS[i]


def test_native_rules_stay_in_the_jvm(spark):
    native = [(r, want) for r, want in EXPECTED if r["field"] not in ("maybe", "either")]
    out, dim = run(spark, [r for r, _ in native], CHECKS, TEXTS)
    assert not dim.needs_python
    for i, row in enumerate(out):
        assert values_of(row) == {r["field"]: want[i] for r, want in native}


def test_the_last_rule_of_a_field_wins(spark):
    rules = [rule("twice", regex=r"a=(\d+)"), rule("twice", "integer", r"b=(\w+)")]
    out, _ = run(spark, rules, [], ["a=1 b=2", "a=1", "a=1 b=x"])
    assert [[(v["field"], as_python(v)) for v in r["data"]][-1] for r in out] == [("twice", 2), ("twice", None), ("twice", None)]


def test_tuple_list(spark):
    out, _ = run(spark, [rule("kv", "list", r"(\w+)=(\w*)")], [], ["a=1 b= c=3", "none"])
    assert [list(r["data"][0]["l"]) for r in out] == [['["a","1"]', '["b",""]', '["c","3"]'], []]


def test_page_tables(spark):
    head = ["Row", "Thing"]
    pages = [
        [[[["x", "y"], ["1", "2"]]], [[head, ["1", "a"], ["", ""], ["2"], ["3", "c", "extra"], ["Total", ""], ["9", "z"]]]],
        [[[], [head], [["ROW", "THING"], ["Total", "1"]], [["row", "thing"], ["7", "g"]]]],
        [[[head, ["", ""]]]],
    ]
    rules = [
        rule("lines", "table", anchor=r"row\s+thing", stop=r"^total", columns=["p", "q"]),
        rule("any", "table", columns=["first"]),
        rule("bare", "table"),
    ]
    out, _ = run(spark, rules, [], ["", "", "Row Thing\n5  f\nTotal"], pages)
    assert [values_of(r) for r in out] == [
        {"lines": [{"p": "1", "q": "a"}, {"p": "2", "q": ""}, {"p": "3", "q": "c"}], "any": [{"first": "1"}], "bare": [{}]},
        {"lines": [{"p": "7", "q": "g"}], "any": [{"first": "Total"}], "bare": [{}]},
        {"lines": [{"p": "5", "q": "f"}], "any": [], "bare": []},
    ]


def test_validation_of_special_numbers(spark):
    rules = [rule("n", "decimal", r"n=(\S+)"), rule("s", regex=r"s=(\S*)")]
    checks = [check("n", gt=5.0, lt=1.0), check("s", gt=0.0, lt=2.0)]
    text_checks = ["Field 's' is not numeric for gt check", "Field 's' is not numeric for lt check"]
    cases = {
        "n=NaN s=nan": [],
        "n=10000000 s=1e3": ["Field 'n' value 10000000.0 is not < 1.0", "Field 's' value 1e3 is not < 2.0"],
        "n=0,00001 s=1d": ["Field 'n' value 1e-05 is not > 5.0", *text_checks],
        "n=3 s=": ["Field 'n' value 3.0 is not > 5.0", "Field 'n' value 3.0 is not < 1.0", *text_checks],
        "n=Infinity s=_1": ["Field 'n' value inf is not < 1.0", *text_checks],
    }
    out, _ = run(spark, rules, checks, list(cases))
    assert [r["errors"] for r in out] == list(cases.values())


def test_contract_values(spark):
    # Texts, patterns and results that the extraction contract names.
    cases = [
        (rule("order_number", regex=r"Bestellung:\s*(\d+)"), "Bestellung: 8859\nDatum: 18.06.2026", "8859"),
        (rule("delivery_date", "date", r"Wunschtermin:\s*(\d{2}\.\d{2}\.\d{4})"), "Wunschtermin: 24.06.2026", "2026-06-24"),
        (rule("total_gross", "decimal", r"Summe\s+([\d\.\,]+)\s+EUR"), "Summe 1.344,60 EUR", pytest.approx(1344.60)),
        (rule("missing", regex=r"NOTHERE:\s*(\w+)"), "Completely different text", None),
    ]
    for r, text, want in cases:
        out, _ = run(spark, [r], [], [text])
        assert as_python(out[0]["data"][0]) == want


def test_json_payload(spark):
    rules = [rule("a", regex='"(.*)"'), rule("n", "decimal", r"n=([\d,]+)"), rule("bad", "integer", r"i=(\w+)"), rule("l", "list", r"\d+"), rule("none")]
    out, _ = run(spark, rules, [], ['say "ä\\x/y" n=1,50 i=zz'])
    assert json.loads(out[0]["json"]) == {
        "a": "ä\\x/y", "n": 1.5, "bad": None, "bad.__error": "invalid literal for int() with base 10: 'zz'", "l": ["1", "50"], "none": None,
    }


def test_normalised_text_is_for_matching_only(spark):
    out, _ = run(spark, [rule("kw", regex=r"(KW12)")], [], ["KW12"])
    assert as_python(out[0]["data"][0]) == "KW12"
    assert spark.range(1).select(normalise_text(F.lit("KW12"))).first()[0] == "KW 12"


def literal_patterns_only(plan):
    """No RLIKE or regexp_extract whose pattern is a column or a lambda's variable."""
    calls = re.findall(r"(?:RLIKE|regexp_extract(?:_all)?)\W{0,3}[^\n]{0,200}", plan)
    return calls and not re.search(r"RLIKE\(?[^,]*, lambda|\.regex\b|\.anchor\b|\.stop\b|\.java\b", plan)


@pytest.mark.parametrize("rules", [128, 0])
def test_patterns_of_a_bounded_store_are_literals(spark, rules):
    store = corpus.as_store(spark, corpus.order_templates())
    dim = dimension.load(store, EngineConfig(compiled_max_rules=rules))
    docs = spark.createDataFrame([("1", "confirmation_v1", "Bestellung: 7\nSumme 1,00 EUR")], "doc_id string, template_id string, full_text string")
    checked = validate(extract(docs, dim), dim)
    plan = checked.select("doc_id", "values", "errors")._jdf.queryExecution().optimizedPlan().toString()
    assert bool(literal_patterns_only(plan)) == (rules > 0)
    row = checked.first()
    assert {v["field"]: as_python(v) for v in row["values"]}["order_number"] == "7"
    assert row["errors"] == ["Required field 'order_date' is null or empty", "Required field 'customer' is null or empty"]


@pytest.mark.parametrize("small", [True, False])
def test_patterns_the_jvm_refuses_are_run_in_python_for_any_store(spark, small):
    rules = [rule("back", regex=r"(a)(?<=\1)b"), rule("count", regex=r"zz (\d+)x{0,3000000000}"), rule("plain", regex=r"zz (\d+)")]
    store = corpus.as_store(
        spark,
        [{"template_id": "t", "required_keywords": [], "supplier_hint": "", "doc_type": "x", "keyword_quorum": 0.6, "rules": rules, "checks": []}],
    )
    cfg = EngineConfig() if small else EngineConfig(inline_max_templates=0)
    docs = spark.createDataFrame([("1", "t", "ab zz 12xxx")], "doc_id string, template_id string, full_text string")
    row = extract(docs, dimension.load(store, cfg)).first()
    assert {v["field"]: Error(v["error"]) if v["error"] else as_python(v) for v in row["data"]} == {"back": "a", "count": "12", "plain": "12"}


TABLE_TEXTS = [
    "head\nPos  Item\n1  pen  2,00\n\n 2  ink\nTotal  2\n3  x",
    "POS   item\n7  nib\nno end",
    "nothing",
    "Pos Item\nTotal",
    "",
    None,
]
TABLE_PAGES = [
    [[[["Pos", "Item"], ["9", "cap"], ["", ""], [None, "lid"], ["Total", "1"], ["8", "x"]]]],
    [[[], [["Other"], ["1"]], [["Pos", None], ["total"]]], [[["pos", "ITEM"], ["4"]]]],
    [[[["Pos Item"], ["", None]]]],
    [],
    [[[[None, "Pos Item"], ["5", "e", "extra"]]]],
    [[[["Pos", "Item"], ["6", "f"]]]],
]


@pytest.mark.parametrize("cfg", [EngineConfig(), EngineConfig(compiled_max_rules=0), LARGE], ids=["literal", "column", "large"])
def test_tables_by_python_patterns_equal_those_of_the_jvm(spark, cfg):
    def rules(spell):
        sides = [(r"pos\s+item", "^total"), (r"pos\s+item", None), (None, "^total"), (None, None), ("item$", "total")]
        return [rule(f"t{i}", "table", anchor=spell(a), stop=spell(b), columns=["a", "b", "a"] if i else ["a", "b"]) for i, (a, b) in enumerate(sides)]

    plain, _ = run(spark, rules(lambda p: p), [], TABLE_TEXTS * 2, TABLE_PAGES + [[]] * len(TABLE_TEXTS), cfg)
    odd, dim = run(spark, rules(lambda p: p and f"(?a:{p})"), [], TABLE_TEXTS * 2, TABLE_PAGES + [[]] * len(TABLE_TEXTS), cfg)
    assert dim.python_tables
    tables = lambda out: [[as_python(v) for v in r["data"]] for r in out]
    assert tables(odd) == tables(plain)
    assert tables(plain)[0][0] == [{"a": "9", "b": "cap"}, {"a": None, "b": "lid"}] or tables(plain)[0][0] == [{"a": "9", "b": "cap"}, {"a": "", "b": "lid"}]
    assert tables(plain)[6][0] == [{"a": "1", "b": "pen"}, {"a": "2", "b": "ink"}]
    assert all(v["error"] is None for r in odd for v in r["data"])


@pytest.mark.parametrize("cfg", [EngineConfig(), EngineConfig(compiled_max_rules=0), LARGE], ids=["literal", "column", "large"])
def test_python_patterns_everywhere(spark, cfg):
    """Conditionals, flags, references in look-behinds, octal codes and backspaces give values, not errors."""
    rules = [
        rule("code", regex=r"(\141b\d)"), rule("tab", regex=r"x([\x08\b]y)"), rule("feed", regex=r"a(\v)b"),
        rule("lines", "table", anchor=r"(P)?(?(1)os|zz)", stop=r"(T)(?<=\1)otal", columns=["a"]),
        rule("plain", "table", anchor="Pos", stop="(", columns=["a"]), rule("n", "decimal", r"n=([\d,]+)"),
    ]
    checks = [
        check("code", regex_match=r"(a)?(?(1)b1|x)"), check("code", regex_match=r"(?a:AB)"), check("gone", not_null=True, regex_match=r"(?a:x)"),
        check("n", gt=2.0, regex_match=r"(1)\.5(?<!\1)$"), check("n", regex_match=r"(?a:\d)\.7"), check("code", regex_match="("), check("feed", regex_match=r"\v"),
    ]
    text = "ab1 x\x08y a\x0bb n=1,5\nPos\n1  2\nTotal"
    out, _ = run(spark, rules, checks, [text, "none"], cfg=cfg)
    got = {v["field"]: Error(v["error"]) if v["error"] else as_python(v) for v in out[0]["data"]}
    broken = got.pop("plain")
    assert isinstance(broken, Error)
    assert got == {"code": "ab1", "tab": "\x08y", "feed": "", "lines": [{"a": "1"}], "n": 1.5}
    assert out[0]["errors"] == [
        "Field 'code' value 'ab1' does not match pattern '(?a:AB)'",
        "Required field 'gone' is null or empty",
        "Field 'n' value 1.5 is not > 2.0",
        "Field 'n' value '1.5' does not match pattern '(?a:\\d)\\.7'",
        "Field 'code' check pattern is invalid: (",
        "Field 'feed' value '' does not match pattern '\\v'",
    ]
    assert out[1]["errors"] == ["Required field 'gone' is null or empty"]


def test_rules_of_a_large_store_meet_hot_and_missing_templates_without_a_hot_shuffle(spark, tmp_path):
    names = [f"t{i}" for i in range(40)]
    rules = [rule("n", regex=r"n=(\d+)")]
    store = corpus.as_store(
        spark,
        [{"template_id": t, "required_keywords": [], "supplier_hint": "", "doc_type": "x", "keyword_quorum": 0.6, "rules": rules, "checks": [check("n", not_null=True)]} for t in names],
    )
    spark.range(3000).select(
        F.col("id").cast("string").alias("doc_id"),
        F.when(F.col("id") % 10 < 6, None).when(F.col("id") % 10 < 8, "t0").otherwise(F.concat(F.lit("t"), F.col("id") % 38 + 1)).alias("template_id"),
        F.concat(F.lit("n="), "id").alias("full_text"),
    ).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    small, large = dimension.load(store), dimension.load(store, LARGE)
    side = large.prepared.select("template_id", F.col("rules").alias("_rules"), F.col("checks").alias("_checks"))
    assert extraction.heavy_templates(docs, side, LARGE)[0] == "t0"
    assert extraction.heavy_templates(docs, side, EngineConfig(inline_max_bytes=10)) == []
    attached = extraction.attach_rules(docs, large)
    shuffled = attached.filter("template_id = 't0' OR template_id IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    plan = attached._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1 and "isnull(template_id" in shuffled
    key = lambda r: (r["doc_id"], r["template_id"], str(r["data"]), r["errors"])
    results = [sorted(map(key, validate(extract(docs, dim), dim).collect())) for dim in (small, large)]
    assert len(results[0]) == 3000 and results[0] == results[1]
    assert extraction.attach_rules(docs.limit(0), large).collect() == []
    monkey = EngineConfig(inline_max_templates=0, inline_max_bytes=10)  # nothing fits a broadcast
    cold = sorted(map(key, validate(extract(docs, dimension.load(store, monkey)), large).collect()))
    assert cold == results[0]


def test_trimming_only_where_needed(spark):
    from docloom.functions.exprs import WHITE_SPACE, let, strip_edges, strip_unicode

    texts = [None, "", "a", "a b", *[f"{w}a {w}" for w in WHITE_SPACE], *[f"a{w}" for w in WHITE_SPACE], *WHITE_SPACE, "a​", "​b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(strip_unicode(F.col("t")).alias("want"), let(F.col("t"), strip_edges).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_a_payload_that_nobody_reads_is_not_written_out(spark, sf):
    from docloom import catalog

    results = catalog.order_results(spark, sf)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "data_json" in plan(results.select("data_json")) and "data_json" not in plan(results.select("doc_id", "route"))


def test_data_are_the_values_where_no_field_repeats(spark, sf):
    from docloom import catalog

    hits = catalog._hits(spark, sf)
    assert hits.filter(~F.to_json("values").eqNullSafe(F.to_json("data"))).count() == 0
    assert "array_distinct" not in hits._jdf.queryExecution().optimizedPlan().toString()
