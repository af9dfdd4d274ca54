"""Helpers shared by the training-data operators.

Columns an operator adds for itself start with ``_llm_``, so that input columns keep their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import through_table

# A hash filter has a word of 64 bits for every four keys (16 bits a key, four of them set in one word: about
# two keys in a hundred pass by mistake), up to this many words: 32 MB as rows of two numbers.
MOST_FILTER_WORDS = 1 << 21
LEAST_FILTER_WORDS = 1 << 10
KEYS_PER_WORD = 4
# Parts that the rows of one hot key are dealt to.
SALTS = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_number_source() -> Column:
    """A number no other row of the same read has."""
    return F.monotonically_increasing_id()


@dataclass(frozen=True)
class HashFilter:
    """A Bloom filter as a table (_llm_word, _llm_bits) of at most ``words`` rows."""

    members: DataFrame
    words: int


def hash_filter(keys: DataFrame, key: Column) -> HashFilter:
    """A filter of the distinct values of ``key``, sized by their count; ``keys`` should be a written table.

    It is built by partial aggregation and never loses a key. Beyond 8 million keys its size stays and it
    lets more rows through to the exact check that follows every use.
    """
    count = keys.agg(F.count(F.lit(1))).first()[0]
    words = min(MOST_FILTER_WORDS, max(LEAST_FILTER_WORDS, -(-count // KEYS_PER_WORD)))
    h = F.xxhash64(key)
    members = keys.groupBy(_word(h, words).alias("_llm_word")).agg(F.bit_or(_mask(h)).alias("_llm_bits"))
    return HashFilter(members, words)


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(words))


def _mask(h: Column) -> Column:
    """Four bits of a word, from six bits of the hash each."""
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return reduce(Column.bitwiseOR, bits)


def flag(df: DataFrame, found: HashFilter, key: Column, name: str) -> DataFrame:
    """Add ``name``: false only where ``key`` is certainly not in the filter.

    The filter has at most MOST_FILTER_WORDS rows, so broadcasting it is safe; no row of ``df`` moves.
    """
    h = F.xxhash64(key)
    kept = df.columns
    return (
        df.withColumn("_llm_word", _word(h, found.words))
        .withColumn("_llm_mask", _mask(h))
        .join(F.broadcast(found.members), "_llm_word", "left")
        .select(
            *[F.col(_quoted(c)) for c in kept],
            F.coalesce(F.col("_llm_bits").bitwiseAND(F.col("_llm_mask")) == F.col("_llm_mask"), F.lit(False)).alias(name),
        )
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(_quoted(c)) for c in df.columns]


def salted_left_join(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left join ``side`` (one row per key), the rows of each key dealt to SALTS parts.

    A key with a third of all rows then meets its one partner row in SALTS tasks; ``side`` is
    repeated SALTS times, so it should be narrow.
    """
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    left = rows.withColumn("_llm_salt", salt)
    right = side.withColumn("_llm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_llm_salt"], "left").drop("_llm_salt")


def keep_one(
    docs: DataFrame,
    contested: DataFrame,
    doc_key: str,
    text_key: Callable[[Column], Column],
    text: str = "text",
) -> DataFrame:
    """``docs`` without the losing rows of ``contested``.

    ``contested``: one row per (``_llm_id``, ``_llm_text``) that shares a group with other rows, with
    ``_llm_wins``. ``text_key`` computes ``_llm_text`` from the text. Rows whose id isn't contested pass
    where they are; only the others (and the hash filter's few false hits) are shuffled. Of repeated
    rows (same id, same text key) one stays.
    """
    contested = through_table(contested, "contested")
    asked = docs.select(*columns_of(docs), F.col(doc_key).alias("_llm_id"))
    flagged = flag(asked, hash_filter(contested, F.col("_llm_id")), F.col("_llm_id"), "_llm_flag")
    free = flagged.filter(~F.col("_llm_flag")).select(*columns_of(docs))
    hit = flagged.filter("_llm_flag").withColumn("_llm_text", text_key(F.col(text)))
    # null-safe keys: a null id is a value like any other here
    keyed = lambda df: df.withColumn("_llm_null", F.col("_llm_id").isNull()).withColumn(
        "_llm_id", F.coalesce(F.col("_llm_id"), F.lit(0).cast("bigint"))
    )
    joined = salted_left_join(keyed(hit), keyed(contested), ["_llm_id", "_llm_null", "_llm_text"])
    lone = joined.filter(F.col("_llm_wins").isNull()).select(*columns_of(docs))
    won = (
        joined.filter("_llm_wins")
        .dropDuplicates(["_llm_id", "_llm_null", "_llm_text"])
        .select(*columns_of(docs))
    )
    return free.unionByName(lone).unionByName(won)
