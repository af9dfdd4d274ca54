"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, crc32 of the text, size); a keyed Feistel network over
the smallest even number of bits that holds n permutes the numbers, walking on while a value falls
outside 0..n-1. Permuted number p goes to shard p mod shards, slot p div shards. So any row's place can
be computed from its number, n, the seed and the shard count alone; shard sizes are at most one row
apart (law ``rows``), and slots are gapless.

Null text counts as no bytes; null doc_ids come first; rows equal in all sort keys are numbered in
the order of the read. Empty input gives no rows. Only narrow columns are sorted, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import row_number_source
from docloom.session import through_table

SHARDS = 24
SEED = 20_240_613
ROUNDS = 6
# Odd multipliers of the round function.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B)
LOW32 = 0xFFFFFFFF


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 32-bit key per round, drawn from the seed by the round function itself."""
    keys, state = [], seed & LOW32
    for i in range(rounds):
        state = int(_scramble(np.array([state + i + 1], dtype=np.uint64), 0)[0])
        keys.append(state)
    return keys


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    low = np.uint64(LOW32)
    x = ((x ^ np.uint64(key)) & low) * np.uint64(MULTIPLIERS[0]) & low
    x ^= x >> np.uint64(15)
    x = x * np.uint64(MULTIPLIERS[1]) & low
    return x ^ (x >> np.uint64(13))


def half_bits(n: int) -> int:
    """Half the bits of the smallest even-width domain that holds n numbers (at least two bits)."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The permutation of 0..n-1, applied to an array of row numbers."""
    half, keys = half_bits(n), round_keys(seed)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        v = out[walking]
        left, right = v >> shift, v & mask
        for key in keys:
            left, right = right, left ^ (_scramble(right, key) & mask)
        v = (left << shift) | right
        out[walking] = v
        walking = walking[v >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(narrow: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(rows with their global number ``_llm_number`` in the order of ``keys``, how many rows).

    A range exchange and local sorts; the only global step is a running sum over one count per
    partition, which is as many rows as the exchange has partitions.
    """
    parts = narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = (
        narrow.withColumn("_llm_row", row_number_source())
        .repartitionByRange(int(parts), *keys, "_llm_row")
        .sortWithinPartitions(*keys, "_llm_row")
    )
    placed = ordered.select(
        *narrow.columns,
        F.spark_partition_id().alias("_llm_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_llm_local"),
    )
    placed = through_table(placed, "row-numbers")
    counts = placed.groupBy("_llm_part").count()
    before = Window.partitionBy(F.lit(0)).orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_llm_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_llm_offset"))
    n = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    numbered = placed.join(F.broadcast(offsets), "_llm_part").select(
        *narrow.columns, (F.col("_llm_offset") + F.col("_llm_local")).alias("_llm_number")
    )
    return numbered, n


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, number, shard, slot of every row."""
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(narrow, ["doc_id", "text_crc32", "size"])
    schema = "doc_id bigint, size bigint, text_crc32 bigint, number bigint, shard int, slot bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column(b.schema.get_field_index("_llm_number")).to_numpy(zero_copy_only=False)
            p = permute(number, n, seed)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("size"),
                    b.column("text_crc32"),
                    pa.array(number, pa.int64()),
                    pa.array((p % shards).astype(np.int32)),
                    pa.array(p // shards),
                ],
                ["doc_id", "size", "text_crc32", "number", "shard", "slot"],
            )

    return numbered.mapInArrow(place, schema)
