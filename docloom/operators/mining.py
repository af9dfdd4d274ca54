"""Keyword mining (K1-K7): tokens of a document ranked by frequency over collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.exprs import let, materialise
from docloom.operators.joins import salted_left_join

# Words never mined as keywords.
STOP_WORDS = [
    "gmbh", "datum", "seite", "bitte", "sehr", "damen", "herren", "liefern",
    "artikel", "menge", "preis", "summe", "gesamt", "netto", "brutto",
    "bestellung", "lieferung", "rechnung", "auftrag", "position", "nummer",
    "anzahl", "stück", "euro", "their", "with", "from", "this", "that",
]


def token_pattern(min_len: int) -> str:
    # Fixed value: a letter (ASCII or U+00C0..U+024F), then letters or digits.
    letter = r"A-Za-zÀ-ɏ"
    return f"[{letter}][{letter}0-9]{{{min_len - 1},}}"


def present_keywords(proposed: Column, text: Column) -> Column:
    """K1. Proposed keywords that occur in the text, case-insensitive."""
    return let(
        F.lower(text),
        lambda t: F.filter(proposed, lambda k: F.contains(t, F.lower(k))),
    )


def tokens(docs: DataFrame, cfg: EngineConfig = EngineConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """K2. (doc_id, pos, token); the text itself goes no further."""
    return docs.select(
        "doc_id",
        *keep,
        F.posexplode(
            F.regexp_extract_all("full_text", F.lit(token_pattern(cfg.min_token_len)), F.lit(0))
        ).alias("pos", "token"),
    )


def without_stop_words(toks: DataFrame) -> DataFrame:
    """K3."""
    return toks.filter(~F.lower("token").isin(STOP_WORDS))


def token_frequency(toks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """K4. Per document and folded token: count, first position and the form found there."""
    return (
        toks.groupBy("doc_id", F.lower("token").alias("low"))
        .agg(
            F.count("*").alias("freq"),
            F.min(F.struct("pos", "token")).alias("_first"),
            *[F.first(c).alias(c) for c in carry],
        )
        .select("doc_id", "low", "freq", F.col("_first.pos").alias("first_pos"), F.col("_first.token").alias("token"), *carry)
    )


def keyword_owners(templates: DataFrame) -> DataFrame:
    """Distinct (template_id, folded keyword)."""
    return templates.select(
        "template_id", F.explode(F.array_distinct(F.transform("required_keywords", F.lower))).alias("low")
    )


def with_collisions(freq: DataFrame, templates: DataFrame) -> DataFrame:
    """K5, J13. Number of other templates holding exactly this keyword.

    Where ``freq`` has ``own_template_id``, that template does not count against itself. Tokens follow Zipf's law: a
    common one is in a third of all documents, so its rows are dealt to several parts of each join.
    """
    owners = keyword_owners(templates)
    users = owners.groupBy("low").agg(F.count("*").alias("_users"))
    out = salted_left_join(freq, users, ["low"], ["doc_id"])
    own = F.lit(0)
    if "own_template_id" in freq.columns:
        mine = owners.select(F.col("template_id").alias("own_template_id"), "low", F.lit(1).alias("_own"))
        out = salted_left_join(out, mine, ["own_template_id", "low"], ["doc_id"])
        own = F.coalesce("_own", F.lit(0))
    return out.withColumn("collisions", F.coalesce("_users", F.lit(0)) - own).drop("_users", "_own")


def rank_tokens(freq: DataFrame) -> DataFrame:
    """K6. Best score first; equal scores in order of first appearance."""
    scored = freq.withColumn("score", F.col("freq") / (F.lit(1.0) + F.col("collisions")))
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "first_pos")
    return scored.withColumn("rank", F.row_number().over(order))


def fill_keywords(
    proposals: DataFrame, templates: DataFrame, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """K1, K7. (doc_id, keywords, kept_count) from (doc_id, proposed, full_text[, own_template_id]).

    Only documents with too few kept keywords are tokenised; their mined tokens come back as at most
    ``target_keywords`` short rows each.
    """
    own = [c for c in ("own_template_id",) if c in proposals.columns]
    checked = materialise(
        proposals.select("doc_id", "full_text", "proposed", *own),
        kept=present_keywords(F.col("proposed"), F.col("full_text")),
    ).withColumn("needed", F.greatest(F.lit(cfg.target_keywords) - F.size("kept"), F.lit(0)))
    short = checked.filter(F.col("needed") > 0).select(
        "doc_id", "full_text", "needed", F.transform("kept", F.lower).alias("_kept_low"), *own
    )
    mined = without_stop_words(tokens(short, cfg, ("needed", "_kept_low", *own))).filter(
        ~F.array_contains("_kept_low", F.lower("token"))
    )
    ranked = rank_tokens(
        with_collisions(token_frequency(mined, ("needed", *own)), templates)
    ).filter((F.col("rank") <= cfg.target_keywords) & (F.col("rank") <= F.col("needed")))
    added = ranked.groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]
        ).alias("added")
    )
    return (
        checked.select("doc_id", "kept")
        .join(added, "doc_id", "left")
        .select(
            "doc_id",
            F.concat("kept", F.coalesce("added", F.array().cast("array<string>"))).alias("keywords"),
            F.size("kept").alias("kept_count"),
        )
    )
