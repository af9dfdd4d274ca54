"""Template matching.

Default plan: the store travels as literals (after a size check), every document is scored where it
lies, and nothing is shuffled. Beyond the bound a keyword automaton reads each text once
(``match_by_automaton``, the same results); ``match_by_grams`` scores only templates with a keyword hit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions import fuzzy
from docloom.functions.exprs import let, materialise
from docloom.functions.text import fold
from docloom.operators import automaton, packed
from docloom.operators.dimension import Dimension, InlineStore, as_dimension, match_columns
from docloom.operators.joins import salted_left_join
from docloom.session import through_table

CANDIDATE = "struct<seq:bigint,template_id:string,score:double,hit_rate:double,quorum:double,hits:int>"


def keyword_flags(text: Column, keywords: Column) -> Column:
    """J1. One flag per distinct keyword: is it a substring of the case-folded text?"""
    return F.transform(keywords, lambda k: F.contains(text, k))


def score_candidates(docs: DataFrame, store: InlineStore, cfg: EngineConfig) -> DataFrame:
    """J1-J4. Adds ``_cands``: every template with its exact score, in insertion order."""
    hints = F.array(*[F.lit(h) for h in store.hints]).cast("array<string>")
    flagged = materialise(
        docs,
        _flags=let(
            fold(F.col("normalised_text")),
            lambda t: F.struct(
                keyword_flags(t, store.keywords).alias("kw"),
                F.transform(hints, lambda h: F.contains(t, h)).alias("hint"),
            ),
        ),
    )
    ratio = F.lit(None).cast("array<double>")
    if store.hints:
        # A contained hint is a ratio of 1; only texts lacking one go to Python.
        unresolved = ~F.forall(F.col("_flags.hint"), lambda f: f)
        flagged = flagged.withColumn(
            "_ratio",
            fuzzy.ratios_against(store.hints)(F.when(unresolved, fold(F.col("normalised_text")))),
        )
        ratio = F.col("_ratio")

    def candidate(t: Column) -> Column:
        count = F.size(t["kw_ids"])
        return let(
            F.size(F.filter(t["kw_ids"], lambda i: F.get(F.col("_flags.kw"), i))),
            lambda hits: let(
                F.when(count > 0, hits / count).otherwise(F.lit(0.0)),
                lambda rate: F.struct(
                    t["seq"].alias("seq"),
                    t["template_id"].alias("template_id"),
                    F.when(count > 0, F.least(F.lit(1.0), rate + boost(t["hint_id"])))
                    .otherwise(F.lit(0.0))
                    .alias("score"),
                    rate.alias("hit_rate"),
                    t["quorum"].alias("quorum"),
                    hits.alias("hits"),
                ),
            ),
        )

    def boost(hint_id: Column) -> Column:
        """J3."""
        return (
            F.when(hint_id < 0, F.lit(0.0))
            .when(F.get(F.col("_flags.hint"), hint_id), F.lit(cfg.supplier_weight))
            .otherwise(F.lit(cfg.supplier_weight) * F.coalesce(F.get(ratio, hint_id), F.lit(0.0)))
        )

    scored = flagged.withColumn("_cands", F.transform(store.templates, candidate).cast(f"array<{CANDIDATE}>"))
    return materialise(scored, _cands=F.col("_cands")).drop("_flags", "_ratio")


def best_candidate(cands: Column) -> Column:
    """J5. Highest score above 0; the first inserted wins a tie."""
    return F.array_max(
        F.transform(
            F.filter(cands, lambda c: c["score"] > 0),
            lambda c: F.struct(
                c["score"].alias("score"),
                (-c["seq"]).alias("order"),
                c["template_id"].alias("template_id"),
                c["hit_rate"].alias("hit_rate"),
                c["quorum"].alias("quorum"),
            ),
        )
    )


def near_candidate(cands: Column) -> Column:
    """J8. Highest rounded score, first inserted on a tie."""
    return F.array_max(
        F.transform(
            cands,
            lambda c: F.struct(
                F.round(c["score"], 4).alias("score"),
                (-c["seq"]).alias("order"),
                c["template_id"].alias("template_id"),
            ),
        )
    )


def candidate_map(cands: Column) -> Column:
    """J7. Template id -> score rounded to four places."""
    return F.map_from_entries(
        F.transform(cands, lambda c: F.struct(c["template_id"], F.round(c["score"], 4)))
    )


def decide(docs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """J5-J8 on ``_cands``: best, hit decision, near miss, candidate map."""
    empty = F.array().cast(f"array<{CANDIDATE}>")
    cands = F.coalesce(F.col("_cands"), empty)
    picked = materialise(
        docs,
        _m=F.struct(
            best_candidate(cands).alias("best"),
            near_candidate(cands).alias("near"),
            candidate_map(cands).alias("scores"),
        ),
    ).drop("_cands")
    kept = [c for c in picked.columns if c != "_m"]
    return decision(picked, kept, F.col("_m.best"), F.col("_m.near"), F.col("_m.scores"), cfg)


def decision(
    picked: DataFrame, kept: list[str], best: Column, near: Column, scores: Column, cfg: EngineConfig
) -> DataFrame:
    """J6, J8. The quorum is tested on the best template only, without its supplier boost."""
    score = F.coalesce(best["score"], F.lit(0.0))
    hit = F.coalesce(
        (score >= cfg.match_threshold) & (best["hit_rate"] >= best["quorum"]), F.lit(False)
    )
    return picked.select(
        *kept,
        F.when(hit, best["template_id"]).alias("template_id"),
        score.alias("match_score"),
        F.coalesce(best["hit_rate"], F.lit(0.0)).alias("hit_rate"),
        best["template_id"].alias("best_template_id"),
        F.when(~hit & (score >= cfg.near_miss_min_score), near["template_id"]).alias("near_miss_id"),
        scores.alias("candidate_scores"),
    )


def match(
    docs: DataFrame, store: DataFrame | Dimension, cfg: EngineConfig = EngineConfig(), candidates: bool = True
) -> DataFrame:
    """J9. Score every document against every template and decide.

    Without ``candidates`` a store beyond the inline bound gives the decisions alone (``candidate_scores`` is
    null): the map has as many entries per document as the store has templates.

    An empty store leaves every document with score 0, no template and an empty map. The plan depends on
    the store's size, the result doesn't: every plan scores every template exactly. (``match_by_grams``,
    which lists only templates with a keyword hit, is a different question and only asked by name.)
    """
    dim = as_dimension(store, cfg)
    if dim.compiled and dim.rows:
        return match_compiled(docs, dim, cfg)
    if dim.inline is not None:
        return decide(score_candidates(docs, dim.inline, cfg), cfg)
    return match_by_automaton(docs, dim.templates, cfg, candidates)


def match_compiled(docs: DataFrame, dim: Dimension, cfg: EngineConfig) -> DataFrame:
    """J1-J9 for a small store, one column expression per keyword and template.

    Each step is a projection of plain expressions that its successor reads more than once, so Spark
    keeps the steps apart and compiles each of them.
    """
    rows = sorted(dim.rows, key=lambda r: r["seq"])
    words = list(dict.fromkeys(k for r in rows for k in r["kws"]))
    hints = list(dict.fromkeys(r["hint"] for r in rows if r["kws"] and r["hint"]))
    kept = docs.columns
    step = docs.withColumn("_tl", fold(F.col("normalised_text")))
    step = step.select(
        *kept,
        "_tl",
        *[F.contains("_tl", F.lit(w)).cast("int").alias(f"_k{i}") for i, w in enumerate(words)],
        *[F.contains("_tl", F.lit(h)).alias(f"_s{i}") for i, h in enumerate(hints)],
    )
    if hints:
        resolved = reduce(lambda a, b: a & b, [F.col(f"_s{i}") for i in range(len(hints))])
        step = step.withColumn(
            "_ratio", fuzzy.ratios_against(hints)(F.when(~resolved, F.col("_tl")))
        )

    def boost(hint: str) -> Column:
        i = hints.index(hint)
        ratio = F.coalesce(F.get(F.col("_ratio"), F.lit(i)), F.lit(0.0))
        return F.when(F.col(f"_s{i}"), F.lit(cfg.supplier_weight)).otherwise(
            F.lit(cfg.supplier_weight) * ratio
        )

    rates, scores = [], []
    for t, r in enumerate(rows):
        if r["kws"]:
            hits = reduce(Column.__add__, [F.col(f"_k{words.index(k)}") for k in r["kws"]])
            rates.append((hits / F.lit(len(r["kws"]))).alias(f"_r{t}"))
            score = F.col(f"_r{t}") + (boost(r["hint"]) if r["hint"] else F.lit(0.0))
            scores.append(F.least(F.lit(1.0), score).alias(f"_c{t}"))
        else:
            rates.append(F.lit(0.0).alias(f"_r{t}"))
            scores.append(F.lit(0.0).alias(f"_c{t}"))
    side = [f"_s{i}" for i in range(len(hints))] + (["_ratio"] if hints else [])
    step = step.select(*kept, *side, *rates)
    step = step.select(*kept, *[f"_r{t}" for t in range(len(rows))], *scores)
    best = [
        F.when(
            F.col(f"_c{t}") > 0,
            F.struct(
                F.col(f"_c{t}").alias("score"),
                F.lit(-r["seq"]).cast("bigint").alias("order"),
                F.lit(r["template_id"]).alias("template_id"),
                F.col(f"_r{t}").alias("hit_rate"),
                F.lit(r["quorum"]).alias("quorum"),
            ),
        )
        for t, r in enumerate(rows)
    ]
    near = [
        F.struct(
            F.round(f"_c{t}", 4).alias("score"),
            F.lit(-r["seq"]).cast("bigint").alias("order"),
            F.lit(r["template_id"]).alias("template_id"),
        )
        for t, r in enumerate(rows)
    ]
    pairs = [x for t, r in enumerate(rows) for x in (F.lit(r["template_id"]), F.round(f"_c{t}", 4))]
    picked = materialise(
        step,
        _best=F.array_max(F.array(*best)),
        _near=F.array_max(F.array(*near)),
        _map=F.create_map(*pairs),
    )
    return decision(picked, kept, F.col("_best"), F.col("_near"), F.col("_map"), cfg)


def keyword_hits(
    docs: DataFrame, store: DataFrame | Dimension, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """J1-J4 in long form: hits, keyword score and final score of every (document, template)."""
    dim = as_dimension(store, cfg)
    slim = docs.select("doc_id", "normalised_text")
    if dim.inline is not None:
        scored = score_candidates(slim, dim.inline, cfg)
    else:
        scored = reduce(DataFrame.unionByName, [_with_candidates(slim, p, cfg) for p in automaton.pieces(dim.templates, cfg)])
    return scored.select("doc_id", F.inline("_cands")).select(
        "doc_id", "template_id", "hits", F.col("hit_rate").alias("keyword_score"), "score"
    )


# --- stores beyond the inline bound -----------------------------------------------------------


def _with_candidates(docs: DataFrame, piece: DataFrame, cfg: EngineConfig) -> DataFrame:
    return materialise(docs, _cands=automaton.candidates(piece, cfg)(fold(F.col("normalised_text"))))


def match_by_automaton(docs: DataFrame, templates: DataFrame, cfg: EngineConfig, candidates: bool = True) -> DataFrame:
    """Exact decisions against a store of any size, each text read once per piece of the store.

    With one piece nothing is shuffled. With several, decisions alone are made by packed pieces, which hold more. For
    candidates, documents are numbered (repeated doc_ids keep apart), each piece reports what it found by that
    number, without text, and the decision meets its document once.
    """
    none = F.lit(None).cast("map<string,double>")
    sized = automaton.sized_store(templates)
    piece, numbers = automaton.dealt(sized, cfg.automaton_max_templates, cfg.automaton_max_chars)
    parts = [sized.filter(piece == p).drop("_chars") for p in numbers]
    asked = fold(F.col("normalised_text"))
    if len(parts) == 1:
        if candidates:
            return decide(_with_candidates(docs, parts[0], cfg), cfg)
        picked = materialise(docs, _m=automaton.best_and_near(asked, parts[0], cfg))
        return decision(picked, docs.columns, F.col("_m.best"), F.col("_m.near"), none, cfg)
    if not candidates:
        piece, numbers = automaton.dealt(sized, cfg.packed_max_templates, cfg.packed_max_chars)
        picked = packed.best_and_near(docs, asked, sized, piece, numbers, cfg.supplier_weight)
        return decision(picked, docs.columns, F.col("_best"), F.col("_near"), none, cfg)
    numbered = through_table(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-docs")
    slim = numbered.select("_row", "normalised_text")
    found = (_with_candidates(slim, p, cfg).select("_row", "_cands") for p in parts)
    # the candidates of a document are as many as the store has templates, as its map has entries
    gathered = _written(found).groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("_cands"))).alias("_cands"))
    return numbered.join(decide(gathered, cfg), "_row", "left").drop("_row")


def _written(parts: Iterable[DataFrame]) -> DataFrame:
    """Each piece's findings are written before the next piece is built: the driver holds one at a time."""
    return reduce(DataFrame.unionByName, [through_table(p, "piece-scores") for p in parts])


GRAM = 4
# Lengths of the grams that keywords are filed under: each under one of the longest that it holds.
GRAM_LENGTHS = (GRAM, 8, 16, 24)
# Bits per anchor of the set by which a document's grams are sifted in its own row, and the bounds of that set.
GRAM_BITS_EACH = 16
GRAM_BITS = (1 << 16, 1 << 24)


def _grams(text: Column, n: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)) if n else F.array(F.lit(""))


def _sieve(anchors: DataFrame) -> Callable[[Column], Column]:
    """Whether a gram with such a hash may be an anchor: false only where it certainly is none."""
    least, most = GRAM_BITS
    size = min(most, max(least, 1 << (GRAM_BITS_EACH * anchors.count()).bit_length()))
    place = lambda h: F.pmod(h, F.lit(size).cast("bigint")).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h % 64)
    rows = (
        anchors.select(place(F.col("gram")).alias("h"))
        .groupBy(F.shiftright("h", 6).alias("word"))
        .agg(F.bit_or(bit(F.col("h"))).alias("bits"))
        .collect()
    )
    words = [0] * (size // 64)
    for r in rows:
        words[r["word"]] = r["bits"]
    held = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    return lambda g: F.get(held, F.shiftright(place(g), 6)).bitwiseAND(bit(place(g))) != 0


def match_by_grams(docs: DataFrame, templates: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Keyword hits by equi-join: each keyword is filed under its least shared gram of the longest length in
    ``GRAM_LENGTHS`` that it holds; of a document's grams only those that may be such anchors leave its row, as
    hashes. Candidate keywords come back to the document in one join, the only time its text moves, and are
    tested for real containment there.

    The candidate map lists the templates with at least one keyword hit; a template without any is
    not scored (it could reach at most the supplier weight).
    """
    dim = match_columns(templates)
    keywords = (
        dim.select("seq", "template_id", "quorum", "hint", F.size("kws").alias("n"), F.explode("kws").alias("kw"))
        .groupBy("kw", "template_id")
        .agg(
            F.count("*").alias("times"),
            F.first("seq").alias("seq"),
            F.first("quorum").alias("quorum"),
            F.first("hint").alias("hint"),
            F.first("n").alias("n"),
        )
    )
    distinct_kw = keywords.select("kw").distinct()
    by_length = F.array("kw")
    for n in GRAM_LENGTHS:
        by_length = F.when(F.length("kw") >= n, F.array_distinct(_grams(F.col("kw"), n))).otherwise(by_length)
    kw_grams = distinct_kw.select("kw", F.explode(by_length).alias("gram"))
    shared = kw_grams.groupBy("gram").agg(F.count("*").alias("users"))
    least = (
        kw_grams.join(shared, "gram")
        .groupBy("kw")
        .agg(F.min(F.struct("users", "gram"))["gram"].alias("gram"))
        .select("kw", F.xxhash64("gram").alias("gram"), F.length("gram").alias("length"))
    )
    filed = through_table(least.join(keywords, "kw"), "gram-anchors")
    may_be_anchor = _sieve(filed.select("gram").distinct())
    folded = docs.select("doc_id", fold(F.col("normalised_text")).alias("_tl"))
    lengths = sorted(r[0] for r in filed.select("length").distinct().collect())  # at most GRAM + 4
    grams = F.concat(
        F.array().cast("array<bigint>"),
        *[F.transform(_grams(F.col("_tl"), n), lambda g: F.xxhash64(g)) for n in lengths],
    )
    doc_grams = folded.select("doc_id", F.explode(F.array_distinct(F.filter(grams, may_be_anchor))).alias("gram"))
    proposed = (
        doc_grams.join(filed, "gram")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("seq", "template_id", "kw", "times", "n", "hint", "quorum")).alias("_kws"))
    )
    joined = materialise(docs.join(proposed, "doc_id", "left"), _tl=fold(F.col("normalised_text")))
    found = materialise(joined, _found=F.filter("_kws", lambda k: F.contains(F.col("_tl"), k["kw"])))
    about = ("seq", "template_id", "n", "hint", "quorum")
    owners = F.array_sort(F.array_distinct(F.transform("_found", lambda k: F.struct(*[k[c].alias(c) for c in about]))))

    def with_hits(t: Column) -> Column:
        own = F.filter("_found", lambda k: k["template_id"] == t["template_id"])
        hits = F.aggregate(own, F.lit(0).cast("bigint"), lambda n, k: n + k["times"])
        return F.struct(*[t[c].alias(c) for c in about], hits.alias("hits"))

    counted = materialise(found, _hits=F.transform(owners, with_hits))
    rated = counted.withColumn(
        "_ratio",
        fuzzy.row_ratios(
            F.when(F.exists("_hits", lambda h: h["hint"] != ""), F.col("_tl")),
            F.transform("_hits", lambda h: h["hint"]),
        ),
    )

    def candidate(h: Column, i: Column) -> Column:
        rate = h["hits"] / h["n"]
        boost = F.lit(cfg.supplier_weight) * F.coalesce(F.get(F.col("_ratio"), i), F.lit(0.0))
        return F.struct(
            h["seq"].alias("seq"),
            h["template_id"].alias("template_id"),
            F.least(F.lit(1.0), rate + boost).alias("score"),
            rate.alias("hit_rate"),
            h["quorum"].alias("quorum"),
            h["hits"].cast("int").alias("hits"),
        )

    scored = rated.withColumn("_cands", F.transform("_hits", candidate).cast(f"array<{CANDIDATE}>"))
    return decide(scored.drop("_hits", "_ratio", "_kws", "_found", "_tl"), cfg)


# Names of one side that a task compares at once; both sides of a document type are dealt to blocks of them.
FAMILY_BLOCK = 2_048


def family_match(
    incoming: DataFrame, templates: DataFrame, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """J10. Closest stored template of the same document type by fuzzy supplier name.

    ``incoming``: (key, doc_type, supplier_hint). Keys without a family keep nulls; the first inserted wins a tie.
    See ``family_ratings`` for how few pairs of names are rated.
    """
    asked = incoming.select("key", "doc_type", F.lower("supplier_hint").alias("asked"))
    best = (
        family_ratings(asked, templates, cfg)
        .filter("family_id is not null")
        .groupBy("doc_type", "asked")
        .agg(F.max(F.struct("ratio", "order", "family_id")).alias("best"))
    )
    return salted_left_join(asked, best, ["doc_type", "asked"], ["key"]).select(
        "key", F.col("best.family_id").alias("family_id"), F.col("best.ratio").alias("ratio")
    )


def family_ratings(asked: DataFrame, templates: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(doc_type, asked, ratio, order, family_id, compared, rated): the best of each block of stored names.

    Blocks of asked and of stored names of a type meet in one task each, a name a row; no pair becomes a row. Inside,
    ``fuzzy.best_of`` rates only names whose character counts allow the wanted ratio and at least the best so far.
    ``compared`` and ``rated`` count pairs. ``family_id`` is null where no name of the block reaches the ratio.
    """
    names = (
        templates.filter(F.coalesce("supplier_hint", F.lit("")) != "")
        .groupBy("doc_type", F.lower("supplier_hint").alias("name"))
        .agg(F.min(F.struct("seq", "template_id")).alias("first"))
    )
    wanted = asked.select("doc_type", "asked").filter("asked is not null").distinct()
    blocks = lambda df, n: df.groupBy("doc_type").agg(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK).cast("int").alias(n))
    sizes = blocks(names, "stored_blocks").join(blocks(wanted, "asked_blocks"), "doc_type")
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wanted.join(sizes, "doc_type").select(
        "doc_type", of("asked", "asked_blocks").alias("a"), every("stored_blocks").alias("s"), "asked"
    )
    right = names.join(sizes, "doc_type").select(
        "doc_type", every("asked_blocks").alias("a"), of("name", "stored_blocks").alias("s"), "name", "first.seq", "first.template_id"
    )
    least = float(cfg.family_ratio)
    best_of = fuzzy.best_of  # the function alone travels, not the module with its prepared UDFs

    def cell(some: pa.Table, stored: pa.Table) -> pa.Table:
        order = pc.sort_indices(stored["seq"])
        stored = stored.take(order)
        names, seq, ids = (stored[c].to_pylist() for c in ("name", "seq", "template_id"))
        best = best_of(some["asked"].to_pylist(), names, least)
        at = [b[0] for b in best]
        return pa.table({
            "doc_type": some["doc_type"],
            "asked": some["asked"],
            "ratio": pa.array([None if i is None else b[1] for i, b in zip(at, best)], pa.float64()),
            "order": pa.array([None if i is None else -seq[i] for i in at], pa.int64()),
            "family_id": pa.array([None if i is None else ids[i] for i in at], pa.string()),
            "compared": pa.array([len(names)] * len(at), pa.int64()),
            "rated": pa.array([b[2] for b in best], pa.int64()),
        })

    # Names are few bytes and much work: a stated number of parts, which Spark doesn't join to fewer by their size.
    cell_key = ["doc_type", "a", "s"]
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        left.repartition(parts, *cell_key).groupBy(*cell_key)
        .cogroup(right.repartition(parts, *cell_key).groupBy(*cell_key))
        .applyInArrow(cell, "doc_type string, asked string, ratio double, order bigint, family_id string, compared bigint, rated bigint")
    )
