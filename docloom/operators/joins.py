"""Joins that hot keys can't hold up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts that the rows of one key are dealt to.
SALTS = 16


def salted_left_join(rows: DataFrame, side: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``rows`` left join ``side`` (at most one row per key), the rows of each key dealt to SALTS parts.

    A key with a third of all rows meets its partner in SALTS tasks; rows with a null key, which meet nobody, are
    spread without bound. Parts are told by the values of ``spread``, which differ between the rows of a key: a
    task that runs again deals its rows alike. ``side`` is repeated SALTS times, so it should be narrow.
    """
    dealt = F.xxhash64(*spread)
    lone = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    left = rows.withColumn("_salt", F.when(lone, dealt).otherwise(F.pmod(dealt, F.lit(SALTS))))
    right = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
