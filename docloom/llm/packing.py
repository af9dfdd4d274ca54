"""Packing documents into sequences of at most 2,048 tokens: first-fit decreasing in random groups.

A document's ids (the byte-level vocabulary with the tokenizer file's added tokens, then the end id 1) are
cut into full pieces, which fill a sequence each, and one shorter rest. Rests are packed group by group: documents are
dealt to groups by a hash of their row number, so a group's size doesn't depend on their content; in a
group, rests go largest first into the first sequence with room, found in a tournament tree of the
sequences' free capacities. Groups hold about ``group_docs`` documents whatever the input, so they
pack in parallel and in bounded memory.

Cuts don't depend on the packing: tokenising is one map over the documents, and only a narrow row each
(length and checksums) goes through the grouping. Null text counts as empty (one id). Where a tokenizer file is
given, the strings of its added tokens in a text become their ids, as the tokenizers library has it by
default; without one they are ordinary text. Empty input gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.byte_bpe import read_ranks
from docloom.llm.common import row_number_source
from docloom.llm.pretokens import PieceCache, chunks, flat_ids, split
from docloom.session import through_table

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 2048
SEED = 77


class FirstFit:
    """Bins of one capacity; the leftmost with room is found by descending a tree of largest free rooms."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, room it had before)."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            node += free[node] < size
        before = free[node]
        free[node] = before - size
        at, node = node - self.leaves, node // 2
        while node:
            larger = max(free[2 * node], free[2 * node + 1])
            if free[node] == larger:
                break
            free[node] = larger
            node //= 2
        return at, before


def pack(sizes: list[int], capacity: int = SEQUENCE) -> tuple[list[int], list[int], int]:
    """(bin of each item, its offset there, number of bins), first-fit decreasing."""
    tree = FirstFit(max(1, len(sizes)), capacity)
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i], room = tree.place(sizes[i])
        offsets[i] = capacity - room
        used = max(used, bins[i] + 1)
    return bins, offsets, used


def _encoder(ranks: dict[bytes, int]) -> PieceCache:
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return PieceCache(lambda pieces: [encoding.encode_ordinary(p) for p in pieces])


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, matched as they stand before anything else."""
    with open(tokenizer_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} isn't matched as it stands")
    return {token["content"]: token["id"] for token in added}


class Stretches:
    """Texts cut at added tokens: the stretches between them, and the ids that stand after each."""

    def __init__(self, texts: list[str], added: dict[str, int]):
        longest_first = sorted(map(re.escape, added), key=len, reverse=True)
        pattern = re.compile(f"({'|'.join(longest_first)})") if added else None
        self.texts: list[str] = []
        self.after: dict[int, int] = {}
        self.first = [0]
        for text in texts:
            parts = pattern.split(text) if pattern and any(a in text for a in added) else [text]
            for i in range(1, len(parts), 2):
                self.after[len(self.texts) + i // 2] = added[parts[i]]
            self.texts += parts[::2]
            self.first.append(len(self.texts))

    def ids(self, flat: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text, from those of all stretches."""
        for low, high in zip(self.first, self.first[1:]):
            own = flat[bounds[low] : bounds[high]]
            cuts = [i for i in range(low, high - 1)]
            at = [int(bounds[i + 1] - bounds[low]) for i in cuts]
            yield np.insert(own, at, [self.after[i] for i in cuts]) if cuts else own


def tokenised(docs: DataFrame, ranks_path: str, sequence: int = SEQUENCE, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, doc_tokens (end id included) and the checksum of each piece of every document.

    ``ranks_path`` holds the vocabulary of the tokenizer file as ranks: the same ids, made faster.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    added = added_tokens(tokenizer_path) if tokenizer_path else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _encoder(ranks.value)
        for b in batches:
            sizes, sums = [], []
            for some in chunks(b.column("text").to_pylist()):
                cut = Stretches(some, added)
                ids, bounds = flat_ids(split(cut.texts), cache)
                for found in cut.ids(ids.astype("<u4"), bounds):
                    own = np.append(found, np.array([END_ID], dtype="<u4"))
                    sizes.append(len(own))
                    sums.append([zlib.crc32(own[k : k + sequence]) for k in range(0, len(own), sequence)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
                ["doc_id", "doc_tokens", "sums"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, doc_tokens bigint, sums array<bigint>")


def packed(
    docs: DataFrame,
    ranks_path: str,
    sequence: int = SEQUENCE,
    group_docs: int = GROUP_DOCS,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = tokenised(docs, ranks_path, sequence, tokenizer_path).withColumn("row", row_number_source())
    rows = through_table(rows, "packing-rows")
    groups = max(1, -(-rows.count() // group_docs))
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        tokens = table.column("doc_tokens").to_numpy()
        full, rest = tokens // sequence, tokens % sequence
        some = np.flatnonzero(rest)
        bins, offsets, used = pack(rest[some].tolist(), sequence)
        base = int(table.column("grp")[0].as_py()) << 32
        bin_of, offset_of = np.full(len(tokens), -1), np.zeros(len(tokens), dtype=np.int64)
        bin_of[some], offset_of[some] = base + np.array(bins, dtype=np.int64), offsets
        first_full = base + used + np.cumsum(full) - full
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "doc_tokens": table.column("doc_tokens"),
                "sums": table.column("sums"),
                "rest_sequence": pa.array(bin_of, pa.int64()),
                "rest_offset": pa.array(offset_of, pa.int64()),
                "full_sequence": pa.array(first_full, pa.int64()),
            }
        )

    schema = (
        "doc_id bigint, doc_tokens bigint, sums array<bigint>, rest_sequence bigint, rest_offset bigint, "
        "full_sequence bigint"
    )
    placed = dealt.groupBy("grp").applyInArrow(place, schema)
    start = F.col("k").cast("bigint") * sequence
    length = F.least(F.lit(sequence).cast("bigint"), F.col("doc_tokens") - start)
    return placed.select("*", F.posexplode("sums").alias("k", "ids_crc32")).select(
        "doc_id",
        start.alias("start"),
        length.alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(length == sequence, F.col("full_sequence") + F.col("k")).otherwise(F.col("rest_sequence")).alias("sequence_id"),
        F.when(length == sequence, F.lit(0).cast("bigint")).otherwise(F.col("rest_offset")).alias("offset"),
    )
