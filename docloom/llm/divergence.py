"""Source divergence audit by minimal-perfect-hash recount.

First pass: how many documents of its language hold each term, counted exactly; terms below ``MIN_DOCS`` go.
The kept terms of a language are hashed perfectly, in shards of about 2,048 (built as Spark groups, keys
stored). Second pass: shards are broadcast in pieces of at most ``PIECE_BYTES`` (measured before; more
vocabulary makes more pieces, each a map over the texts), every occurrence is looked up and verified, and a
dense array of slots per (language, source) group is incremented. A task holds at most about ``DENSE_SLOTS``
slots: beyond, it reports what it has and starts afresh. Sums, smoothed shares, distances and ranks are then
joins and aggregates over slots; shares are exact (decimal division).

Distances of all sources of a language are summed shard by shard in blocks of sources, so neither a language
with many sources nor a large vocabulary meets in one task. The rows of part `pair` are the square of a
language's number of sources, as asked.

Null text, lang and source count as ''. A group without terms has pairs (all shares equal), but no terms. A
language without kept terms has distance 0 everywhere; one with a single source has no pairs. Repeated rows
are documents of their own. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import salted_left_join
from docloom.llm.perfect_hash import SHARD_KEYS, Shards, build, hashes, shard_of
from docloom.llm.terms import LETTERS, Terms, chunked, find_terms
from docloom.session import through_table

MIN_DOCS = 30
TOP_TERMS = 50
PIECE_BYTES = 32 << 20
DENSE_SLOTS = 8 << 20
HELD_ROWS = 1 << 18
HELD_BYTES = 64 << 20
SOURCE_BLOCK = 256


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[_blank(c).alias(c) for c in ("lang", "source", "text")])


def _distinct_codes(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _documents_per_term(found: Terms, langs: pa.Array) -> pa.Table:
    """lang, term, n: texts of each language that hold the term."""
    names, lang = _distinct_codes(langs)
    width = max(1, len(found.distinct))
    pairs = np.unique(found.text_of() * width + found.code)
    keys, n = np.unique(lang[pairs // width] * width + pairs % width, return_counts=True)
    return pa.table(
        {
            "lang": pa.array(names, pa.string()).take(pa.array(keys // width)),
            "term": found.distinct.take(pa.array(keys % width)),
            "n": pa.array(n, pa.int64()),
        }
    )


def _merged(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "term"]).aggregate([("n", "sum")])
    return sums.rename_columns(["lang", "term", "n"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term of the terms in at least ``min_docs`` documents of their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for b in chunked(batch):
                held.append(_documents_per_term(find_terms(b.column("text"), LETTERS), b.column("lang")))
                if sum(t.num_rows for t in held) > HELD_ROWS or sum(t.nbytes for t in held) > HELD_BYTES:
                    held = [_merged(held)]
                    if held[0].num_rows > HELD_ROWS // 2 or held[0].nbytes > HELD_BYTES // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from _merged(held).to_batches()

    counted = _texts(docs).select("lang", "text").mapInArrow(run, "lang string, term string, n bigint")
    return (
        counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")
    )


def perfect_shards(kept: DataFrame) -> DataFrame:
    """space (the language), shards (how many it has), shard, seeds, keys (by slot), n_bytes."""
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sized = salted_left_join(kept, sizes, ["lang"])
    counted = sized.select("lang", "term", F.ceil(F.col("v") / SHARD_KEYS).cast("bigint").alias("shards"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, _ = hashes(b.column("term"))
            shard = shard_of(first, b.column("shards").to_numpy()) if b.num_rows else first.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int64())], [*b.schema.names, "shard"])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("term")
        keys = table.column("term").combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        seeds, slots = build(*hashes(keys))
        by_slot = keys.take(pa.array(np.argsort(slots))).to_pylist()
        return pa.table(
            {
                "space": table.column("lang").slice(0, 1),
                "shards": table.column("shards").slice(0, 1),
                "shard": table.column("shard").slice(0, 1),
                "seeds": pa.array([seeds], pa.list_(pa.int64())),
                "keys": pa.array([by_slot], pa.list_(pa.string())),
                "n_bytes": pa.array([keys.nbytes + 8 * len(seeds)], pa.int64()),
            }
        )

    dealt = counted.mapInArrow(place, "lang string, term string, shards bigint, shard bigint")
    schema = "space string, shards bigint, shard bigint, seeds array<bigint>, keys array<string>, n_bytes bigint"
    return dealt.groupBy("lang", "shard").applyInArrow(one, schema)


def _pieces(shards: DataFrame, limit: int) -> tuple[int, Column]:
    """How many pieces keep each within ``limit`` bytes, and the piece of a shard. One shard alone may
    exceed the limit (keys of many megabytes); it is then a piece by itself or with small ones."""
    at = F.xxhash64("space", "shard")
    total, largest, n = shards.agg(F.sum("n_bytes"), F.max("n_bytes"), F.count(F.lit(1))).first()
    pieces = max(1, -(-(total or 0) // limit))
    while True:
        piece = F.pmod(at, F.lit(pieces))
        if pieces == 1 and (total or 0) <= limit or pieces >= 64 * max(1, n):
            return pieces, piece
        most = shards.groupBy(piece.alias("p")).agg(F.sum("n_bytes").alias("s")).agg(F.max("s")).first()[0]
        if most <= max(limit, largest):
            return pieces, piece
        pieces *= 2


class _Dense:
    """Counts per (lang, source), one array of slots each, until they are reported."""

    def __init__(self, shards: Shards, limit: int):
        self.shards, self.limit, self.size = shards, limit, 0
        self.arrays: dict[tuple[str, str], np.ndarray] = {}

    def room_for(self, lang: str) -> bool:
        low, high = self.shards.span[lang]
        return not self.arrays or self.size + high - low <= self.limit

    def add(self, lang: str, source: str, slots: np.ndarray) -> None:
        low, high = self.shards.span[lang]
        if (lang, source) not in self.arrays:
            self.arrays[lang, source] = np.zeros(high - low, dtype=np.int64)
            self.size += high - low
        np.add.at(self.arrays[lang, source], slots - low, 1)

    def report(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in self.arrays.items():
            at = np.flatnonzero(counts)
            slot = at + self.shards.span[lang][0]
            shard = self.shards.shard[slot]
            base = self.shards.slot_base[self.shards.local[lang][shard]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(at), pa.string()),
                    pa.array([source] * len(at), pa.string()),
                    pa.array(shard, pa.int64()),
                    pa.array(slot - base, pa.int64()),
                    pa.array(counts[at], pa.int64()),
                ],
                ["lang", "source", "shard", "slot", "n"],
            )
        self.arrays, self.size = {}, 0


def _recount(texts: DataFrame, rows: list, limit: int) -> DataFrame:
    """lang, source, shard, slot, n: partial counts of one piece's terms, one map over the texts."""
    held = texts.sparkSession.sparkContext.broadcast(Shards.of(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = held.value
        dense = _Dense(shards, limit)
        for batch in batches:
            for b in chunked(batch):
                found = find_terms(b.column("text"), LETTERS)
                pairs = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist()))
                names = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
                group = np.array([names[p] for p in pairs], dtype=np.int64)[found.text_of()]
                order = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(len(names) + 1))
                first, second = hashes(found.distinct)
                slots = {lang: shards.find(lang, found.distinct, first, second) for lang in {p[0] for p in names}}
                for (lang, source), i in names.items():
                    own = slots[lang][found.code[order[cuts[i] : cuts[i + 1]]]]
                    own = own[own >= 0]
                    if len(own):
                        if (lang, source) not in dense.arrays and not dense.room_for(lang):
                            yield from dense.report()
                        dense.add(lang, source, own)
        yield from dense.report()

    return texts.mapInArrow(run, "lang string, source string, shard bigint, slot bigint, n bigint")


def group_counts(
    docs: DataFrame, shards: DataFrame, piece_bytes: int = PIECE_BYTES, dense_slots: int = DENSE_SLOTS
) -> DataFrame:
    """lang, source, shard, slot, n (above 0): occurrences of each kept term in each group."""
    texts = _texts(docs)
    pieces, piece = _pieces(shards, piece_bytes)
    parts = None
    for i in range(pieces):
        rows = shards.filter(piece == i).drop("n_bytes").collect()  # at most piece_bytes
        part = through_table(_recount(texts, rows, dense_slots), "divergence-counts")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact beyond 64 bits too."""
    whole = (count + 5).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", whole, (total + 5 * terms).cast("decimal(20,0)")) + 1


def _pair_distances(groups: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language."""
    sources = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).alias("blocks"))
    blocked = groups.join(sources, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")))
    rated = (
        counts.join(groups.select("lang", "source", "total", "v"), ["lang", "source"])
        .groupBy("lang", "source", "shard")  # at most a shard's slots
        .agg(F.collect_list(F.struct("slot", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))).alias("seen"))
    )
    spread = (
        blocked.join(sizes, "lang", "left")  # a language without kept terms keeps one row, without slots
        .select(
            "lang",
            "source",
            "own",
            "blocks",
            F.coalesce("shard", F.lit(-1).cast("bigint")).alias("shard"),
            F.coalesce("slots", F.lit(0).cast("bigint")).alias("slots"),
            F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))).alias("unseen"),
        )
        .join(rated, ["lang", "source", "shard"], "left")
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
        .select(
            "lang", "shard", "source", "own", "slots", "unseen",
            F.col("seen.slot").alias("slot"), F.col("seen.p").alias("p"),
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        )
    )

    def cell(table: pa.Table) -> pa.Table:
        table = table.sort_by("source")
        n = int(table.column("slots")[0].as_py())
        names, own = table.column("source").to_pylist(), table.column("own").to_numpy()
        shares = np.zeros((len(names), n), dtype=np.int64)
        for i, row in enumerate(table.select(["unseen", "slot", "p"]).to_pylist()):
            shares[i] = row["unseen"] or 0
            if row["slot"]:
                shares[i, row["slot"]] = row["p"]
        low, high = int(table.column("low")[0].as_py()), int(table.column("high")[0].as_py())
        out: dict[str, list] = {"a": [], "b": [], "value": []}
        for i in np.flatnonzero(own == low).tolist():
            with_ = np.arange(i + 1, len(names)) if low == high else np.flatnonzero(own == high)
            out["a"] += [names[i]] * len(with_)
            out["b"] += [names[j] for j in with_]
            out["value"] += np.abs(shares[with_] - shares[i]).sum(axis=1).tolist()
        size = len(out["a"])
        return pa.table(
            {
                "lang": pa.array([table.column("lang")[0].as_py()] * size, pa.string()),
                "a": pa.array(out["a"], pa.string()),
                "b": pa.array(out["b"], pa.string()),
                "value": pa.array(out["value"], pa.int64()),
            }
        )

    part = spread.groupBy("lang", "shard", "low", "high").applyInArrow(cell, "lang string, a string, b string, value bigint")
    summed = part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pair = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    both = F.explode(F.array(pair("a", "b"), pair("b", "a")))
    return summed.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    piece_bytes: int = PIECE_BYTES,
    dense_slots: int = DENSE_SLOTS,
) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources of the language (`pair`), and the
    ``top_terms`` terms that a source uses most beyond its language (`term`)."""
    shards = through_table(perfect_shards(through_table(kept_terms(docs, min_docs), "divergence-terms")), "divergence-shards")
    counts = through_table(group_counts(docs, shards, piece_bytes, dense_slots), "divergence-groups")
    sizes = shards.select(F.col("space").alias("lang"), "shard", F.size("keys").cast("bigint").alias("slots"))
    by_lang = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("lang_n"))
    zero = F.lit(0).cast("bigint")
    groups = (
        docs.select(_blank("lang").alias("lang"), _blank("source").alias("source"))
        .distinct()
        .join(sizes.groupBy("lang").agg(F.sum("slots").alias("v")), "lang", "left")
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(counts.groupBy("lang").agg(F.sum("n").alias("lang_total")), "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("v", "total", "lang_total")])
    )
    groups = through_table(groups, "divergence-sources")
    names = shards.select(F.col("space").alias("lang"), "shard", F.posexplode("keys").alias("at", "item")).select(
        "lang", "shard", F.col("at").cast("bigint").alias("slot"), "item"
    )
    p = share(F.col("n"), F.col("total"), F.col("v"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = (
        counts.join(by_lang.join(names, ["lang", "shard", "slot"]), ["lang", "shard", "slot"])
        .join(groups, ["lang", "source"])
        .select("lang", "source", "item", (p - q).alias("value"))
        .filter("value > 0")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    parts = [
        (ranked(_pair_distances(groups, counts, sizes)), "pair"),
        (ranked(terms).filter(F.col("rank") <= top_terms), "term"),
    ]
    pair, term = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for df, name in parts]
    return pair.unionByName(term)
