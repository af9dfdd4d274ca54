"""Exact dedup by progressive refinement, with DataFrame functions only.

1. Length and prefix: every text gives its byte length and a hash of its first characters; groups of
   one are unique and done. (Prefix groups lie inside length groups, so one aggregation serves both.)
2. Full hash: only texts of groups that survive are hashed whole. Which ones do is told by a hash
   filter, sized by their count up to a bound and broadcast, so no text is ever shuffled to find groups.
3. Groups of one full hash hold equal texts; the row with the largest doc_id stays.

Texts are equal when identical after lower-casing A-Z. Null text counts as empty. A null doc_id is
smaller than any other; of repeated rows (same doc_id, same text) one stays. Empty input gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import flag, hash_filter, keep_one, row_number_source, salted_left_join
from docloom.session import through_table

PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, everything else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _coarse(text: Column, prefix_chars: int) -> Column:
    """Byte length and prefix hash; A-Z and a-z have one byte each, so the length needs no lower-casing."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(
        F.octet_length(whole).alias("n_bytes"),
        F.xxhash64(normalised(F.substring(whole, 1, prefix_chars))).alias("prefix"),
    )


def refined(
    docs: DataFrame, prefix_chars: int = PREFIX_CHARS, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One narrow row per document: doc_id, row, n_bytes, prefix, full (null: unique already), and
    the columns of ``carry``. Written to the shared folder; no text is kept."""
    coarse = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").alias("text"),
        _coarse(F.col("text"), prefix_chars).alias("coarse"),
        *[c.alias(name) for name, c in (carry or {}).items()],
    )
    survivors = coarse.groupBy("coarse").count().filter("count > 1").select("coarse")
    survivors = through_table(survivors, "exact-dedup-groups")
    flagged = flag(coarse, hash_filter(survivors, F.col("coarse")), F.col("coarse"), "_llm_flag")
    narrow = flagged.select(
        "doc_id",
        row_number_source().alias("row"),
        "coarse.n_bytes",
        "coarse.prefix",
        F.when(F.col("_llm_flag"), full_hash(F.col("text"))).alias("full"),
        *(carry or {}),
    )
    return through_table(narrow, "exact-dedup")


def _groups(rows: DataFrame) -> DataFrame:
    """Groups of two and more: full, keep (doc_id, row of the row that stays), group_size."""
    return (
        rows.filter(F.col("full").isNotNull())
        .groupBy("full")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def membership(rows: DataFrame) -> DataFrame:
    """Every row of ``refined`` with keep_id, group_size and kept. Rows without a full hash are unique: they
    stay out of the join, where they would all have one key."""
    alone = rows.filter(F.col("full").isNull()).select(
        *rows.columns,
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    hashed = rows.filter(F.col("full").isNotNull())
    joined = salted_left_join(hashed, _groups(rows), ["full"]).select(
        *rows.columns,
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
    )
    return alone.unionByName(joined)


def drop_copies(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Text is shuffled for rows of groups and the filter's false hits only: about two in a hundred of the others
    up to 8 million rows in groups; beyond that the filter stays at its bound and more of them, at most once.
    """
    members = membership(refined(docs, prefix_chars))
    contested = (
        members.filter("group_size > 1")
        .groupBy(F.col("doc_id").alias("_llm_id"), F.col("full").alias("_llm_text"))
        .agg(F.max("kept").alias("_llm_wins"))
    )
    return keep_one(docs, contested, "doc_id", full_hash)
