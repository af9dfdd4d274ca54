"""Matching: texts, templates and the decisions they must give, on every plan."""

import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import corpus
from docloom.config import EngineConfig
from docloom.functions import fuzzy
from docloom.functions.fuzzy import partial_ratio
from docloom.operators import automaton, matching, packed
from docloom.sources.store import empty_store


def template(template_id, keywords, hint="", quorum=0.6, doc_type="invoice"):
    return {
        "template_id": template_id,
        "required_keywords": keywords,
        "supplier_hint": hint,
        "doc_type": doc_type,
        "keyword_quorum": quorum,
        "rules": [],
        "checks": [],
    }


STORE = [
    template("order_v1", ["Order:", "Unit price", "Line value", "Sales tax"], "Brightwater Mills"),
    template("twice_v1", ["Gross", "gross", "Zebra"]),
    template("none_v1", []),
    template("tie1_v1", ["alpha", "beta"]),
    template("tie2_v1", ["ALPHA", "gamma"]),
    template("strict_v1", ["one", "two", "three", "four"], "Hint Co", 1.0),
    template("loose_v1", ["one", "two", "three", "five"], "", 0.5),
    template("exact_v1", ["p1", "p2", "p3", "p4"]),
    template("third_v1", [f"q-{c}" for c in "abcdefghij"]),
    template("short_v1", ["#", "äß", "x y"]),
]
# Text; matched template, near miss, score; candidate scores other than 0 (those in brackets have no keyword hit).
CASES = [
    ("Order: 77\nUnit price 1,96\nLine value 26,08\nSales tax 7%", "order_v1", None, 1.0, {"order_v1": 1.0}, {"strict_v1": 0.0571}),
    ("Nothing here that any of them knows", None, None, 0.0571, {}, {"strict_v1": 0.0571, "order_v1": 0.0412}),
    ("", None, None, 0.0, {}, {}),
    ("alpha", None, "tie1_v1", 0.5, {"tie1_v1": 0.5, "tie2_v1": 0.5}, {"strict_v1": 0.0333, "order_v1": 0.04}),
    ("ALPHA beta gamma", "tie1_v1", None, 1.0, {"tie1_v1": 1.0, "tie2_v1": 1.0}, {"strict_v1": 0.0308, "order_v1": 0.0345}),
    ("one two three Hint Co", None, "strict_v1", 0.85, {"strict_v1": 0.85, "loose_v1": 0.75}, {"order_v1": 0.0364}),
    ("one two three", None, "strict_v1", 0.7929, {"strict_v1": 0.7929, "loose_v1": 0.75}, {"order_v1": 0.0348}),
    ("p1 p2 p3", "exact_v1", None, 0.75, {"exact_v1": 0.75}, {"strict_v1": 0.02, "order_v1": 0.0143}),
    ("q-a q-b q-c", None, "third_v1", 0.3, {"third_v1": 0.3}, {"strict_v1": 0.0364, "order_v1": 0.019}),
    ("q-a q-b", None, None, 0.2, {"third_v1": 0.2}, {"strict_v1": 0.02, "order_v1": 0.0286}),
    ("gross", None, "twice_v1", 0.6667, {"twice_v1": 0.6667}, {"strict_v1": 0.0333, "order_v1": 0.0333}),
    ("# äß x y", "short_v1", None, 1.0, {"short_v1": 1.0}, {"strict_v1": 0.0222, "order_v1": 0.0143}),
    ("Sales tax brightwater mile order:", None, "order_v1", 0.5882, {"order_v1": 0.5882}, {"strict_v1": 0.0429}),
]
TEXTS = [c[0] for c in CASES]


def matched(spark, texts, store, cfg):
    """By one of the plans; None asks for the gram join, which lists templates with a keyword hit only."""
    if cfg is None:
        return matching.match_by_grams(docs_of(spark, texts), store, EngineConfig())
    return matching.match(docs_of(spark, texts), store, cfg)


def docs_of(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, normalised_text string")


PLANS = {
    "compiled": EngineConfig(),
    "inline": EngineConfig(compiled_max_templates=0),
    "automaton": EngineConfig(inline_max_templates=3),
    "chunks": EngineConfig(inline_max_templates=3, automaton_max_templates=3),
    "grams": None,
}


@pytest.mark.parametrize("plan", PLANS)
def test_every_plan_decides_alike(spark, plan):
    rows = matched(spark, TEXTS, corpus.as_store(spark, STORE), PLANS[plan]).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        text, hit, near, score, hits, hints = CASES[int(r["doc_id"])]
        assert (r["template_id"], r["near_miss_id"]) == (hit, near), text
        if plan == "grams" and not hits:
            score, near = 0.0, None
        assert r["match_score"] == pytest.approx(score, abs=1e-4), text
        got = {k: v for k, v in dict(r["candidate_scores"]).items() if v}
        assert got == pytest.approx(hits if plan == "grams" else {**hits, **hints}, abs=1e-4), text


def test_plans_agree_on_random_texts(spark):
    rng = random.Random(5)
    words = [k for t in STORE for k in t["required_keywords"]] + ["Brightwater", "Mills", "Hint", "Co", "filler"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    store = corpus.as_store(spark, STORE)
    found = {}
    for plan, cfg in PLANS.items():
        rows = matched(spark, texts, store, cfg).collect()
        found[plan] = sorted((int(r["doc_id"]), r["template_id"] or "", r["near_miss_id"] or "") for r in rows)
    assert found["compiled"] == found["inline"] == found["automaton"] == found["chunks"] == found["grams"]


ODD = [
    template("empty_v1", ["", "alpha"]), template("emoji_v1", ["😀 x", "a😀"], "😀 Handel"), template("null_v1", [], "Hint"),
    template("over_v1", ["aaa", "aa", "a"], "aaaa"), template("case_v1", ["ÄÖ", "Straße", "İ"]), template("hint_v1", ["zz"], "aaa"),
]


@pytest.mark.parametrize("plan", ["automaton", "chunks"])
def test_automaton_equals_inline_to_the_last_digit(spark, plan):
    rng = random.Random(8)
    store = corpus.as_store(spark, STORE + ODD)
    words = [k for t in STORE + ODD for k in t["required_keywords"]] + ["Hint Co", "aaaa", "handel", "İstanbul", "x"]
    texts = ["", None, "a" * 5000] + ["".join(rng.choice([*words, " "]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    want = matched(spark, texts, store, PLANS["inline"])
    got = matched(spark, texts, store, PLANS[plan])
    key = lambda r: (int(r["doc_id"]), r["template_id"], r["match_score"], r["hit_rate"], r["near_miss_id"], r["best_template_id"])
    order = lambda rows: sorted(rows, key=lambda x: x[0])
    assert order(map(key, got.collect())) == order(map(key, want.collect()))
    maps = lambda df: {r["doc_id"]: list(r["candidate_scores"].items()) for r in df.collect()}
    assert maps(got) == maps(want)
    alone = matching.match(docs_of(spark, texts), store, PLANS[plan], candidates=False).collect()
    assert order(map(key, alone)) == order(map(key, want.collect()))
    assert all(r["candidate_scores"] is None for r in alone)
    hits = lambda cfg: sorted(map(tuple, matching.keyword_hits(docs_of(spark, texts), store, cfg).collect()), key=str)
    assert hits(PLANS[plan]) == hits(PLANS["inline"])


PACKED = EngineConfig(inline_max_templates=3, automaton_max_templates=3, packed_max_templates=2)


def test_packed_pieces_equal_inline_to_the_last_digit(spark):
    rng = random.Random(11)
    more = [template(f"long{n}_v1", ["ab" * n, "é" * n, "x" * 40, "b" * n + "ü"], "Hint Co" if n % 2 else "", 0.5) for n in range(1, 9)]
    plain = corpus.as_store(spark, STORE + ODD + more)
    # a keyword that is null counts, and is never found
    store = plain.withColumn("required_keywords", F.when(F.col("template_id") == "case_v1", F.array(F.lit("x"), F.lit(None))).otherwise(F.col("required_keywords")))
    words = [k for t in STORE + ODD + more for k in t["required_keywords"]] + ["Hint Co", "aaaa", "handel", "İstanbul", "x", "é", "hint"]
    texts = ["", None, "a" * 5000, "ab" * 999] + ["".join(rng.choice([*words, " "]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    docs = docs_of(spark, texts).repartition(3)
    key = lambda r: (int(r["doc_id"]), r["normalised_text"] and len(r["normalised_text"]), r["template_id"], r["match_score"], r["hit_rate"], r["near_miss_id"], r["best_template_id"])
    found = lambda cfg: sorted(map(key, matching.match(docs, store, cfg, candidates=False).collect()), key=lambda x: x[0])
    want = found(PLANS["automaton"])
    assert found(PACKED) == want == found(PLANS["chunks"])
    assert {r[0] for r in want} == set(range(len(texts))) and len({r[2] for r in want}) > 5


def test_packed_words_are_found_across_steps(monkeypatch):
    monkeypatch.setattr(packed, "STEP", 64)
    monkeypatch.setattr(packed, "_powers", {})
    words = ["a", "ab", "abc", "abcd", "abcde", "bcdefg", "é", "日本", "日本語テキスト", "zz"]
    rows = pa.table({
        "seq": pa.array(range(len(words)), pa.int64()), "template_id": words, "kws": [[w, w, None] for w in words],
        "hint": [""] * len(words), "quorum": [0.6] * len(words),
    })
    p = pickle.loads(pickle.dumps(packed.Packed(packed.pack(rows)))).prepare()
    rng = random.Random(2)
    texts = [None, "", "abcdefg" * 50] + ["".join(rng.choice("abcdeé日本語テ z") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    whole = pa.array(texts, pa.string()).slice(1)
    at, data = packed._bytes_of(whole)
    assert len([*packed._steps(at)]) > 100
    for a, b in packed._steps(at):
        own_at, own = packed._bytes_of(whole[a:b])
        found = p.words_in(own_at - own_at[0], own[own_at[0] : own_at[-1]])
        got = [{p.word(int(w)) for w in found[found // p.n_words == i] % p.n_words} for i in range(b - a)]
        assert got == [{w for w in words if w in t} for t in texts[1 + a : 1 + b]]


def test_packed_pieces_are_held_one_at_a_time(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.core.broadcast import Broadcast
    from pyspark.sql.readwriter import DataFrameWriter

    done = []
    for owner, name, mark in ((SparkContext, "broadcast", "held"), (DataFrameWriter, "parquet", "written"), (Broadcast, "destroy", "given up")):
        plain = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda self, *a, plain=plain, mark=mark, **b: done.append(mark) or plain(self, *a, **b))
    docs, store = docs_of(spark, TEXTS), corpus.as_store(spark, STORE)
    picked = matching.match(docs, store, PACKED, candidates=False)
    assert done.count("held") > 3
    steps = "".join(x[0] for x in done)
    assert steps[steps.index("h") :] == "hwg" * (done.count("held") - 1) + "h"
    text = picked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and text.count("ArrowEvalPython") == 1
    repeated = matching.match(docs.unionByName(docs), store, PACKED, candidates=False)
    assert repeated.count() == 2 * len(TEXTS)


def test_one_automaton_moves_nothing_and_reads_the_text_once(spark, tmp_path):
    docs_of(spark, TEXTS).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for candidates in (True, False):
        plan = matching.match(docs, corpus.as_store(spark, STORE), PLANS["automaton"], candidates)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Join" not in text and text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1


def test_rounding_as_spark_rounds(spark):
    values = [0.70005, 0.12345, 1 / 3, 0.00005, 0.99995, 2 / 3 + 0.1, 0.1 * 0.28571, 0.0] + [random.Random(1).random() for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", 4).alias("r"))
    assert all(automaton.rounded_score(r["v"]) == r["r"] for r in df.collect())


def test_quorum_failure_never_tries_the_second_best(spark):
    r = matching.match(docs_of(spark, ["one two three Hint Co"]), corpus.as_store(spark, STORE)).first()
    assert r["best_template_id"] == "strict_v1" and r["template_id"] is None
    assert r["near_miss_id"] == "strict_v1"


def test_empty_store_keeps_documents(spark):
    r = matching.match(docs_of(spark, ["x"]), empty_store(spark)).first()
    assert (r["template_id"], r["match_score"], r["candidate_scores"], r["near_miss_id"]) == (None, 0.0, {}, None)


def test_matching_shuffles_nothing_and_tests_containment_once(spark):
    for cfg in (EngineConfig(), EngineConfig(compiled_max_templates=0)):
        plan = matching.match(docs_of(spark, TEXTS), corpus.as_store(spark, STORE), cfg)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_family_match_against_brute_force(spark):
    rng = random.Random(11)
    names = ["Nordwind Handel", "Nordwind Handels GmbH", "Südwind AG", "Westpol", "Nordlicht KG", "Ostsee Fisch"]
    store = [template(f"t{i}", [], rng.choice(names + [""]), doc_type=rng.choice("ab")) for i in range(30)]
    asked = [(i, rng.choice("abc"), rng.choice(["nordwind", "Handel GmbH", "suedwind ag", "Fisch", "Polar", "Nordwind Handel"])) for i in range(40)]
    df = spark.createDataFrame(asked, "key int, doc_type string, supplier_hint string")
    got = {r["key"]: r["family_id"] for r in matching.family_match(df, corpus.as_store(spark, store)).collect()}
    for key, doc_type, hint in asked:
        best, best_ratio = None, 0
        for t in store:
            if t["doc_type"] == doc_type and t["supplier_hint"]:
                ratio = partial_ratio(hint.lower(), t["supplier_hint"].lower())
                if ratio >= 70 and ratio > best_ratio:
                    best, best_ratio = t["template_id"], ratio
        assert got[key] == best


def test_bound_passes_over_no_family():
    """Random names against a plain loop; blocks of a few names in Spark give the same (below)."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde ß\u4e2d\U0001f600") for _ in range(rng.randrange(1, 14)))
    names, asked = [word() for _ in range(150)], [word() for _ in range(60)] + [""]
    rated = 0
    for least in (0.5, 55.0, 70.0, 95.0, 100.0):
        for text, (at, ratio, n) in zip(asked, fuzzy.best_of(asked, names, least)):
            plain = [partial_ratio(text, name) for name in names]
            if max(plain) < least:
                assert at is None
            else:
                assert (at, ratio) == (plain.index(max(plain)), max(plain))
            rated += n
    assert 0 < rated < 5 * len(asked) * len(names) / 3
    assert fuzzy.best_of(["a"], [], 70.0) == [(None, 0.0, 0)] and fuzzy.best_of([], ["a"], 70.0) == []


def test_family_blocks_and_rated_share(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"{rng.choice(['Nord', 'Süd', 'West'])}{rng.choice(['wind', 'pol', 'licht'])} {i} GmbH" for i in range(60)]
    store = [template(f"t{i}", [], n, doc_type="ab"[i % 2]) for i, n in enumerate(names + names[:5])]
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["Nordwynd 1 Gmb", "lichtpol", "Qxqx", "", None, "West 33"])) for i in range(50)]
    df = spark.createDataFrame(asked, "key int, doc_type string, supplier_hint string")
    stored = corpus.as_store(spark, store)
    whole = sorted(map(tuple, matching.family_match(df, stored).collect()))
    monkeypatch.setattr(matching, "FAMILY_BLOCK", 7)
    assert sorted(map(tuple, matching.family_match(df, stored).collect())) == whole
    assert len(whole) == 50 and {r[1] is None for r in whole} == {True, False}
    ratings = matching.family_ratings(df.selectExpr("doc_type", "lower(supplier_hint) asked"), stored)
    compared, rated = ratings.agg(F.sum("compared"), F.sum("rated")).first()
    assert 0 < rated < compared / 2
    empty = matching.family_match(df, empty_store(spark)).collect()
    assert len(empty) == 50 and all(r["family_id"] is None for r in empty)


def test_long_keywords_propose_no_others(spark, monkeypatch):
    """Names that share every short gram with many others: only what a text holds is proposed for it."""
    seen = []
    through = matching.through_table
    monkeypatch.setattr(matching, "through_table", lambda df, name: seen.append(through(df, name)) or seen[-1])
    names = [f"Supplier#{i:09d}" for i in range(1200)]
    store = [template(f"t{i}", [n, f"Note for {n}"]) for i, n in enumerate(names)]
    rows = matching.match_by_grams(docs_of(spark, ["Note for Supplier#000000123, Supplier#000001111 end"]), corpus.as_store(spark, store), EngineConfig())
    assert set(rows.first()["candidate_scores"]) == {"t123", "t1111"}
    assert seen[0].groupBy("gram").count().agg(F.max("count")).first()[0] == 1


def test_families_are_rated_in_many_tasks(spark):
    df = spark.createDataFrame([(i, f"t{i % 40}", f"Name {i}") for i in range(200)], "key int, doc_type string, supplier_hint string")
    stored = corpus.as_store(spark, [template(f"x{i}", [], f"Name {i}", doc_type=f"t{i % 40}") for i in range(200)])
    ratings = matching.family_ratings(df.selectExpr("doc_type", "lower(supplier_hint) asked"), stored)
    assert ratings.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1


def test_many_ratios_at_once_equal_single_ones(monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab#0 1\u4e2d") for _ in range(n))
    names = [word(rng.choice([1, 5, 9, 9, 64, 65, 90])) for _ in range(300)]
    single = []
    monkeypatch.setattr(fuzzy, "partial_ratio", lambda a, b: single.append(1) or partial_ratio(a, b))
    for text in [word(n) for n in (1, 4, 9, 9, 64, 70)]:
        plain = [partial_ratio(text, name) for name in names]
        at, ratio, rated = fuzzy.best_of([text], names, 1.0)[0]
        assert (at, ratio) == (plain.index(max(plain)), max(plain))
        single.clear()
        short = [n for n in names if min(len(n), len(text)) <= 64]
        fuzzy.best_of([text], short, 1.0)
        assert len(single) <= 2  # the first is rated alone


def test_unhit_templates_are_told_by_their_supplier_alone(spark):
    rows = [(i, f"t{i}", [f"word{i}"] if i % 5 else [], f"Hint {i % 3}" if i % 4 else "", 0.6) for i in range(3000)]
    store = spark.createDataFrame(rows, "seq bigint, template_id string, required_keywords array<string>, supplier_hint string, keyword_quorum double")
    piece = automaton.Piece.of(automaton.match_columns(store).collect())
    looked = []
    boosts = piece.boosts
    piece.boosts = lambda own, *rest: looked.append(len(own)) or boosts(own, *rest)
    for text in ("", None, "nothing", "hint 1", "hint 2 word7;", "a " * 50):
        hits, rate, score = piece.scores(text, 0.1)
        best, near = piece.decide(text, 0.1)
        at = int(score.argmax())
        assert (best and (best["score"], -best["order"])) == ((score[at], at) if score[at] > 0 else None)
        shown = [automaton.rounded_score(float(s)) for s in score]
        assert (near["score"], -near["order"]) == (max(shown), shown.index(max(shown)))
    assert max(n for n in looked if n != 3000) < 10 and looked.count(3000) == 6


def test_hint_ratio_boost(spark):
    docs = docs_of(spark, ["keyword nordwind handel gmb h", "keyword NORDWIND HANDEL GMBH"])
    store = [template("n_v1", ["keyword", "missing"], "Nordwind Handel GmbH")]
    scores = [r[0] for r in matching.keyword_hits(docs, corpus.as_store(spark, store)).orderBy("doc_id").select(F.round("score", 6)).collect()]
    # Window "nordwind handel gmb " shares 19 of 20 characters.
    assert scores == [pytest.approx(0.5 + 0.1 * 0.95), pytest.approx(0.6)]


@pytest.mark.parametrize("plan", ["compiled", "inline", "automaton", "chunks"])
def test_repeated_documents_keep_apart(spark, plan):
    docs = spark.createDataFrame([("1", "alpha beta"), ("1", "gross"), ("1", "gross")], "doc_id string, normalised_text string")
    store = corpus.as_store(spark, STORE)
    rows = matching.match(docs, store, PLANS[plan]).collect()
    assert sorted((r["normalised_text"], r["best_template_id"]) for r in rows) == [
        ("alpha beta", "tie1_v1"), ("gross", "twice_v1"), ("gross", "twice_v1"),
    ]


def test_repeated_template_ids_are_an_error(spark):
    with pytest.raises(ValueError, match="unique"):
        matching.match(docs_of(spark, ["x"]), corpus.as_store(spark, [STORE[0], STORE[0]]))
