"""Store snapshots, learning and mining: cases and what they must give."""

import pytest
from pyspark.sql import functions as F

from docloom import corpus
from docloom.config import EngineConfig
from docloom.operators import lifecycle, mining, sanitise, templates
from docloom.plans.rounds import learn_round
from docloom.sources import responses as rsp

BODY = "array<struct<field:string,type:string,regex:string,anchor_regex:string,stop_regex:string,columns:array<string>,strip_chars:string,date_format:string>>"


def store(spark, ids):
    return corpus.as_store(
        spark,
        [
            {
                "template_id": i,
                "required_keywords": ["Alpha", "beta", "BETA"],
                "supplier_hint": "Old",
                "doc_type": "old",
                "keyword_quorum": 0.6,
                "rules": [corpus._rule("old", regex="(x)")],
                "checks": [],
                "hit_count": 4,
            }
            for i in ids
        ],
    )


def incoming(spark, rows):
    """(response_seq, template_id, existing, keywords, quorum)"""
    base = store(spark, ["x"]).drop("seq", "snapshot_id", "template_id", "required_keywords", "keyword_quorum", "hit_count", "doc_type")
    df = spark.createDataFrame(
        rows, "response_seq bigint, template_id string, existing_template_id string, required_keywords array<string>, keyword_quorum double"
    )
    return df.crossJoin(base).withColumns({"hit_count": F.lit(0).cast("bigint"), "doc_type": F.concat(F.lit("new"), F.col("response_seq").cast("string"))})


OLD = (["Alpha", "beta", "BETA"], 0.6, 4, "old")
# Answers of a round, and the store after it: template, keywords, quorum, hits, type.
ROUNDS = [
    (
        [
            (3, "new1", "a", ["gamma", "ALPHA"], 0.4),  # merged into the family: new keywords only, lower quorum
            (1, "new1", None, ["delta"], 0.9),  # a new template
            (7, "new2", "gone", ["eps", "eps"], 0.6),  # an unknown family: new
        ],
        [
            ("a", ["Alpha", "beta", "BETA", "gamma"], 0.4, 4, "new3"),
            ("b", *OLD),
            ("c", *OLD),
            ("new1", ["delta"], 0.9, 0, "new1"),
            ("new2", ["eps", "eps"], 0.6, 0, "new7"),
        ],
    ),
    (
        [
            (5, "b", "b", ["Gamma"], 0.9),  # its own name: replaced, hits start afresh
            (6, "new1", "b", ["gamma", "delta"], 0.4),
            (9, "a", "b", ["eps"], 0.5),  # named like another template, merged all the same
        ],
        [("a", *OLD), ("b", ["Gamma", "delta", "eps"], 0.4, 0, "new9"), ("c", *OLD)],
    ),
    (
        [
            (2, "c", None, [], 0.9),
            (4, "new1", "c", ["Beta", "beta"], 0.6),
            (8, "new1", "c", ["BETA", "gamma"], 0.4),
            (10, "c", None, ["delta"], 0.6),  # the last replacement counts, merges before it don't
            (11, "new2", "c", ["delta", "Eps"], 0.9),
        ],
        [("a", *OLD), ("b", *OLD), ("c", ["delta", "Eps"], 0.6, 0, "new11")],
    ),
]


@pytest.mark.parametrize("turn", range(len(ROUNDS)))
def test_fold(spark, turn):
    rows, want = ROUNDS[turn]
    got = lifecycle.fold_updates(store(spark, ["a", "b", "c"]), incoming(spark, rows), 1).orderBy("seq").collect()
    found = [(r["template_id"], r["required_keywords"], r["keyword_quorum"], r["hit_count"], r["doc_type"]) for r in got]
    assert found == want


def test_fold_ignores_the_order_of_rows(spark):
    for rows, want in ROUNDS:
        got = lifecycle.fold_updates(store(spark, ["a", "b", "c"]), incoming(spark, rows[::-1]).repartition(3), 1)
        assert {r["template_id"]: r["required_keywords"] for r in got.collect()} == {w[0]: w[1] for w in want}


def test_upsert_broadcasts_no_salted_copies(spark):
    rows = [(i, f"t{i}", None, ["k"], 0.5) for i in range(50)]
    changed = incoming(spark, rows).drop("existing_template_id")
    out = lifecycle.upsert(store(spark, ["t1", "t2"]), changed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and not any("_salt" in line and "BroadcastHashJoin" in line for line in plan.splitlines())
    assert out.count() == 50


def test_hits_delete_and_readd(spark):
    s = store(spark, ["a", "b"])
    results = spark.createDataFrame([("a", "HIT_PASS")] * 3 + [("a", "HIT_TOLERATED"), ("b", "HIT_REPAIR")], "template_id string, route string")
    counted = lifecycle.count_hits(s, results)
    assert dict(counted.select("template_id", "hit_count").collect()) == {"a": 7, "b": 4}
    left, report = lifecycle.delete_templates(counted, spark.createDataFrame([("a",), ("zz",)], "template_id string"))
    assert dict(report.collect()) == {"a": True, "zz": False}
    again = lifecycle.upsert(left, incoming(spark, [(0, "a", None, ["k"], 0.5)]).drop("existing_template_id"))
    assert [r["template_id"] for r in templates.in_order(again).collect()] == ["b", "a"]


# Text, proposed keywords, own template; the keywords that must come out. Other templates own:
# t0 Zahlung, Palette; t1 zahlung, x; t2 Größe, größe.
FILLED = [
    # Zahlung twice but owned once elsewhere counts as one, before Lieferort by position; Größe is owned too; kurz is
    # short and Stück a stop word
    ("Palette Palette Zahlung zahlung Größe Lieferort kurz Stück", ["Palette", "fehlt"], "t0", ["Palette", "Zahlung", "Lieferort", "Größe"]),
    ("Datum Nettowert nettowert NETTOWERT Größe Größe Abc12x abcd5 xélan", [], "t0", ["Nettowert", "Größe", "Abc12x", "abcd5", "xélan"]),
    # enough of the proposed ones occur: they stay as they are written
    ("Datum Palette Zahlung Größe Lieferort Stück", ["datum", "PALETTE", "Zahlung", "Größe", "Lieferort", "Stück"], "t1", ["datum", "PALETTE", "Zahlung", "Größe", "Lieferort", "Stück"]),
    ("", ["Datum"], "t1", []),
    ("Zahlung Zahlung Palette Lieferort", ["zahlung"], "t1", ["zahlung", "Lieferort", "Palette"]),
    ("Lieferort Palette Palette Größe", [], "t2", ["Lieferort", "Palette", "Größe"]),
]


def test_keyword_filling(spark):
    owned = [("t0", ["Zahlung", "Palette"]), ("t1", ["zahlung", "x"]), ("t2", ["Größe", "größe"])]
    stored = spark.createDataFrame(owned, "template_id string, required_keywords array<string>")
    rows = [(str(i), text, proposed, own) for i, (text, proposed, own, _) in enumerate(FILLED)]
    df = spark.createDataFrame(rows, "doc_id string, full_text string, proposed array<string>, own_template_id string")
    got = {r["doc_id"]: r["keywords"] for r in mining.fill_keywords(df, stored).collect()}
    assert got == {str(i): want for i, (*_, want) in enumerate(FILLED)}


def test_rule_cleaning(spark):
    rules = [
        corpus._rule("ok", regex=r"(\d+)"),
        corpus._rule("none"),
        corpus._rule("two", regex="(a)(b)"),
        corpus._rule("zero", "date", regex="a"),
        corpus._rule("bad", regex="(a"),
        corpus._rule("t_ok", "table", anchor="A", stop="B"),
        corpus._rule("t_half", "table", anchor="A"),
        corpus._rule("t_bad", "table", anchor="[A", stop="B"),
    ]
    checks = [corpus._check(f) for f in ("ok", "two", "t_ok", "ghost")]
    df = corpus.as_store(spark, [{"template_id": "x", "required_keywords": [], "supplier_hint": "", "doc_type": "", "keyword_quorum": 0.6, "rules": rules, "checks": checks}])
    clean = sanitise.sanitise_rules(df).first()
    assert [r["field"] for r in clean["rules"]] == ["ok", "t_ok"]
    assert [c["field"] for c in clean["checks"]] == ["ok", "t_ok"]
    assert [(d["rule_pos"], d["reason"]) for d in clean["dropped"]] == [
        (1, "no pattern"),
        (2, "capture groups must be 1, not 2"),
        (3, "capture groups must be 1, not 0"),
        (4, "invalid pattern"),
        (6, "table rule lacks anchor or stop"),
        (7, "invalid anchor pattern"),
    ]


def test_response_decoding(spark):
    raws = {
        "plain": '{"template_id": "a_v1"}',
        "fenced": '```json\n{"template_id": "b_v1", "extracted_data": {"x": {"y": 1}, "n": null, "l": [1, 2]}}\n``` trailing',
        "fence_without_end": '```\n{"template_id": "c_v1"}',
        "inner": '```json\n{"template_id": "d```_v1"}\n```',
        "broken": '{"template_id": ',
        "text": "sorry",
        "list": "[1]",
        "empty": "",
        "no_field": '{"extraction_rules": [{"regex": "(a)"}]}',
        "no_check": '{"confidence_checks": [{"gt": 1}]}',
        "quorum": '{"fingerprint": {"keyword_quorum": 1.5}}',
    }
    df = spark.createDataFrame(
        [(i, k, None, "b", "m", v) for i, (k, v) in enumerate(raws.items())], rsp.RESPONSES
    )
    got = {r["doc_id"]: r for r in rsp.decode_responses(df).collect()}
    assert {k: r["reject"] for k, r in got.items()} == {
        "plain": None, "fenced": None, "fence_without_end": None, "inner": None,
        "broken": "malformed JSON", "text": "malformed JSON", "list": "malformed JSON", "empty": "malformed JSON",
        "no_field": "rule without field", "no_check": "check without field", "quorum": "keyword_quorum outside [0, 1]",
    }
    assert got["inner"]["body"]["template_id"] == "d```_v1"
    assert got["fenced"]["body"]["extracted_data"] == {"x": '{"y":1}', "n": None, "l": "[1,2]"}
    lenient = rsp.decode_responses(df.filter("doc_id = 'empty'"), F.lit(True))
    assert templates.build_templates(lenient).first()["template_id"] == "unknown_v1"


def test_learning_round_teaches_the_next_one(spark):
    import json

    import pandas as pd

    text = "Lieferant Polarstern\nRechnungskennung 77\nBetragssumme 5,00"
    docs = spark.createDataFrame(
        [(str(i), f"in/{i}.pdf", text, text) for i in range(3)],
        "doc_id string, path string, full_text string, normalised_text string",
    )

    def responder(batch):
        raw = json.dumps(
            {
                "template_id": "polar_v1",
                "fingerprint": {"required_keywords": ["Lieferant", "nicht da"]},
                "extraction_rules": [{"field": "id", "regex": r"Rechnungskennung (\d+)"}, {"field": "x", "regex": "("}],
                "confidence_checks": [{"field": "id", "not_null": True}, {"field": "x", "not_null": True}],
                "extracted_data": {"id": "77"},
            }
        )
        n = len(batch)
        return pd.DataFrame(
            {"response_seq": batch["doc_id"].astype("int64"), "doc_id": batch["doc_id"], "existing_template_id": batch["existing_template_id"],
             "backend": ["f"] * n, "model": ["m"] * n, "raw": [raw] * n}
        )

    first = learn_round(docs, corpus.as_store(spark, []), responder)
    rows = first.results.collect()
    assert {(r["template_id"], r["route"], r["llm_used"], r["validation_passed"]) for r in rows} == {("polar_v1", "COLD_MISS", True, True)}
    learnt = first.templates.first()
    assert learnt["required_keywords"][0] == "Lieferant" and len(learnt["required_keywords"]) == 4
    assert [r["field"] for r in learnt["rules"]] == ["id"] == [c["field"] for c in learnt["checks"]]

    def never(batch):
        raise AssertionError("nothing should be asked")

    second = learn_round(docs, first.templates, never, EngineConfig(), 2)
    assert {(r["route"], r["data_json"]) for r in second.results.collect()} == {("HIT_PASS", '{"id":"77"}')}
    assert second.templates.first()["hit_count"] == 3
