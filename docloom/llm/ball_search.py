"""Exact ranked lexical search with ball trees over sparse document vectors.

A document's vector holds, for each term that an item asks for, the saturated frequency
(10^9 tf) div (1000 tf + 12 m); an item's vector holds weight times occurrences. The score is their inner
product. Documents are dealt by a hash of their row number to groups of about ``GROUP_DOCS``; each group is one task's
ball tree:

- build: a node's documents are halved along the line between two far apart ones, down to ``LEAF_DOCS``; terms
  are put into blocks that live in the same part of the tree and are about equally common; a node keeps its
  centroid c and for each block b the largest distance r of a document from it there;
- bound: no document of a node scores above the sum over blocks of q_b . c_b + |q_b| r_b, raised by a margin
  above all rounding errors of its floating-point arithmetic;
- search: nodes are opened best bound first; leaves are scored in whole numbers; a subtree goes unread once
  its bound is below the item's kth best score (not equal: the smaller doc_id could win there).

Two rounds: the first searches every 16th group, and the kth scores it finds, true scores all, bound the
second from the start. Groups report k rows an item, which a window with a limit merges.

Items are asked in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_BYTES`` of text, one map over the texts
for each, with the block's terms broadcast. A task's memory is bounded by its group and the block's terms.

Null text has no terms; a document or item without terms has no score and gives no rows. Every row of the
items is an item of its own; repeated documents are ranked each. A null doc_id is smaller than any
other. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import row_number_source
from docloom.llm.terms import LETTERS_DIGITS, chunked, find_terms
from docloom.session import through_table

K = 20
GROUP_DOCS = 4096
LEAF_DOCS = 64
FIRST_ROUND = 16
BLOCK_ITEMS = 1024
BLOCK_BYTES = 4 << 20
# Fixed values of the score.
SCALE, SATURATION, LENGTH_PERCENT = 1_000_000_000, 12, 25


def document_vectors(docs: DataFrame, vocabulary: pa.StringArray | list[str]) -> DataFrame:
    """doc_id, n (terms with repeats, above 0), terms and tf: what a document holds of ``vocabulary``."""
    held = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            for b in chunked(batch):
                found = find_terms(b.column("text"), LETTERS_DIGITS)
                place = pa.compute.index_in(found.distinct, known).fill_null(-1).to_numpy().astype(np.int64)
                n = np.diff(found.bounds)
                term, text = place[found.code], found.text_of()
                key, tf = np.unique((text * len(known) + term)[term >= 0], return_counts=True)
                owner = key // max(1, len(known))
                at = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
                lists = lambda x, at=at: pa.ListArray.from_arrays(pa.array(at), pa.array(x))
                out = pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array(n, pa.int64()),
                        lists((key % max(1, len(known))).astype(np.int32)),
                        lists(tf.astype(np.int64)),
                    ],
                    ["doc_id", "n", "terms", "tf"],
                )
                yield out.filter(pa.array(n > 0))

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of a vocabulary of ``size`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "df"])

    parts = vectors.select("terms").mapInArrow(run, "term bigint, df bigint")
    out = np.zeros(size, dtype=np.int64)
    for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
        out[r["term"]] = r["df"]
    return out


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


@dataclass
class Item:
    """An item's vector: terms ascending, whole weights."""

    row: int
    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray


def item_blocks(items: DataFrame, max_items: int, max_bytes: int) -> list[DataFrame]:
    """The items (row, item_id, text) in blocks; only block numbers and sizes come to the driver."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = through_table(rows.select(row_number_source().alias("row"), "*"), "search-items")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // max_items), -(-(size or 0) // max_bytes))
    return [rows.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i) for i in range(blocks)] if n else []


def _items_of(block: DataFrame) -> tuple[list[str], list[tuple[int, int | None, Counter]]]:
    """(distinct terms, items with their terms' occurrences) of one block."""
    rows = block.collect()
    found = find_terms(pa.array([r["text"] for r in rows], pa.string()), LETTERS_DIGITS)
    items = []
    for i, r in enumerate(rows):
        own = found.code[found.bounds[i] : found.bounds[i + 1]]
        items.append((r["row"], r["item_id"], Counter(own.tolist())))
    return found.distinct.to_pylist(), items


class BallTree:
    """Sparse vectors of one group: documents in tree order, nodes as ranges of them."""

    def __init__(self, indptr: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = LEAF_DOCS):
        self.leaf = leaf
        self.order = np.arange(len(indptr) - 1)
        self.width = int(terms.max(initial=-1)) + 1
        self._indptr, self._terms, self._values = indptr, terms, values
        self._norms = np.add.reduceat(np.append(values.astype(float) ** 2, 0), indptr[:-1]) * (np.diff(indptr) > 0)
        self.nodes: list[tuple[int, int, int, int]] = []  # low, high, left, right (-1: a leaf)
        self._split(0, len(self.order))
        self._lay_out()
        self._blocks()
        self._balls()

    def _rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the documents' entries, owner of each)."""
        sizes = self._indptr[docs + 1] - self._indptr[docs]
        owner = np.repeat(np.arange(len(docs)), sizes)
        start = np.cumsum(sizes) - sizes
        return np.arange(len(owner)) - start[owner] + self._indptr[docs][owner], owner

    def _split(self, low: int, high: int) -> int:
        at = len(self.nodes)
        self.nodes.append((low, high, -1, -1))
        if high - low > self.leaf:
            docs = self.order[low:high]
            places, owner = self._rows(docs)
            terms, values = self._terms[places], self._values[places].astype(float)

            def distances(to: np.ndarray) -> np.ndarray:
                dots = np.bincount(owner, values * to[terms], minlength=len(docs))
                return self._norms[docs] - 2 * dots + to @ to

            def vector(i: int) -> np.ndarray:
                own = owner == i
                return np.bincount(terms[own], values[own], minlength=self.width)

            centre = np.bincount(terms, values, minlength=self.width) / len(docs)
            one = distances(vector(int(np.argmax(distances(centre)))))
            other = distances(vector(int(np.argmax(one))))
            middle = (high - low) // 2
            self.order[low:high] = docs[np.argsort(one - other, kind="stable")]
            left, right = self._split(low, low + middle), self._split(low + middle, high)
            self.nodes[at] = (low, high, left, right)
        return at

    def _lay_out(self) -> None:
        places, _ = self._rows(self.order)
        sizes = np.diff(self._indptr)[self.order]
        self.indptr = np.concatenate(([0], np.cumsum(sizes)))
        self.terms, self.values = self._terms[places], self._values[places]

    def _blocks(self) -> None:
        """A block per part of the tree (16 at most) and power of two of the documents that hold a term."""
        parts = [self.nodes[0]]
        while len(parts) < 16 and any(p[2] >= 0 for p in parts):
            parts = [self.nodes[x] for p in parts for x in ((p[2], p[3]) if p[2] >= 0 else ())] or parts
            if all(p[2] < 0 for p in parts):
                break
        mass = np.stack([self._sums(p[0], p[1]) for p in parts])
        common = np.log2(np.bincount(self.terms, minlength=self.width) + 1).astype(np.int64)
        _, self.block = np.unique(mass.argmax(axis=0) * 64 + common, return_inverse=True)
        self.n_blocks = int(self.block.max(initial=0)) + 1

    def _sums(self, low: int, high: int) -> np.ndarray:
        own = slice(self.indptr[low], self.indptr[high])
        return np.bincount(self.terms[own], self.values[own].astype(float), minlength=self.width)

    def _balls(self) -> None:
        """Centroids and radii, the radii rounded up: squares are widened by 10^-9 of what they were taken from."""
        self.centre = np.zeros((len(self.nodes), self.width))
        self.radius = np.zeros((len(self.nodes), self.n_blocks))
        for i, (low, high, _, _) in enumerate(self.nodes):
            c = self._sums(low, high) / (high - low)
            own = slice(self.indptr[low], self.indptr[high])
            terms, values = self.terms[own], self.values[own].astype(float)
            owner = np.repeat(np.arange(high - low), np.diff(self.indptr[low : high + 1]))
            key = owner * self.n_blocks + self.block[terms]
            sums = lambda x, key=key, n=high - low: np.bincount(key, x, minlength=n * self.n_blocks).reshape(n, -1)
            square = np.bincount(self.block, c * c, minlength=self.n_blocks)
            own_square = sums(values * values)
            apart = own_square - 2 * sums(values * c[terms]) + square + 1e-9 * (own_square + square)
            self.centre[i], self.radius[i] = c, np.sqrt(np.maximum(apart, 0).max(axis=0)) * (1 + 1e-9)

    def scores(self, low: int, high: int, query: np.ndarray) -> np.ndarray:
        """Whole scores of the documents at places ``low`` to ``high``."""
        own = slice(self.indptr[low], self.indptr[high])
        sums = np.concatenate(([0], np.cumsum(self.values[own] * query[self.terms[own]])))
        return np.diff(sums[self.indptr[low : high + 1] - self.indptr[low]])

    def top(self, terms: np.ndarray, weights: np.ndarray, rank: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score above 0 and not below ``floor``; ties by ``rank``."""
        inside = terms < self.width
        terms, weights = terms[inside], weights[inside]
        query = np.zeros(self.width, dtype=np.int64)
        query[terms] = weights
        real = weights.astype(float)
        blocks, of = np.unique(self.block[terms], return_inverse=True)
        norms = np.sqrt(np.bincount(of, real * real, minlength=len(blocks)))
        bounds = (self.centre[:, terms] @ real + self.radius[:, blocks] @ norms) * (1 + 1e-9) + 1
        place, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least = max(floor, 1)
        heap = [(-bounds[0], 0)] if len(self.order) else []
        while heap and -heap[0][0] >= least:
            low, high, left, right = self.nodes[heapq.heappop(heap)[1]]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            own = self.scores(low, high, query)
            good = np.flatnonzero(own >= least)
            if not len(good):
                continue
            place, score = np.append(place, self.order[low + good]), np.append(score, own[good])
            best = np.lexsort((rank[place], -score))[:k]
            place, score = place[best], score[best]
            if len(score) == k:
                least = max(least, int(score[-1]))
        return place, score


def _search(vectors: DataFrame, items: list[Item], floors: dict[int, int], total_terms: int, total: int, k: int) -> DataFrame:
    """item_row, doc_id, row, score: the k best of each group for each item."""
    held = vectors.sparkSession.sparkContext.broadcast((items, floors))

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        asked, known = held.value
        n = table.column("n").to_numpy()
        m = (100 - LENGTH_PERCENT) + np.array([LENGTH_PERCENT * int(x) * total // total_terms for x in n], dtype=np.int64)
        lists = table.column("terms").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        tf_lists = table.column("tf").combine_chunks()
        tf_lists = tf_lists.chunk(0) if isinstance(tf_lists, pa.ChunkedArray) else tf_lists
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        tf = tf_lists.flatten().to_numpy()
        values = SCALE * tf // (1000 * tf + SATURATION * np.repeat(m, sizes))
        tree = BallTree(np.concatenate(([0], np.cumsum(sizes))), lists.flatten().to_numpy().astype(np.int64), values)
        ids, rows = table.column("doc_id"), table.column("row").to_numpy()
        numbers = ids.fill_null(0).to_numpy()
        rank = np.empty(len(rows), dtype=np.int64)
        rank[np.lexsort((rows, numbers, np.asarray(ids.is_valid())))] = np.arange(len(rows))
        out: dict[str, list] = {"item_row": [], "place": [], "score": []}
        for item in asked:
            place, score = tree.top(item.terms, item.weights, rank, k, known.get(item.row, 0))
            out["item_row"] += [item.row] * len(place)
            out["place"] += place.tolist()
            out["score"] += score.tolist()
        at = pa.array(out["place"], pa.int64())
        return pa.table(
            {
                "item_row": pa.array(out["item_row"], pa.int64()),
                "doc_id": ids.take(at),
                "row": table.column("row").take(at),
                "score": pa.array(out["score"], pa.int64()),
            }
        )

    return vectors.groupBy("grp").applyInArrow(group, "item_row bigint, doc_id bigint, row bigint, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    group_docs: int = GROUP_DOCS,
    block_items: int = BLOCK_ITEMS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item with a score above 0."""
    spark = docs.sparkSession
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    found = spark.createDataFrame([], schema)
    for block in item_blocks(items, block_items, block_bytes):
        words, counted = _items_of(block)
        vectors = document_vectors(docs, words).withColumn("row", row_number_source())
        vectors = through_table(vectors, "search-vectors")
        total, total_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total:
            break
        df = document_frequencies(vectors, len(words))
        weights = [weight(total, int(x)) for x in df]
        asked = []
        for row, item_id, own in counted:
            terms = np.array(sorted(t for t in own if weights[t] and df[t]), dtype=np.int64)
            if len(terms):
                asked.append(Item(row, item_id, terms, np.array([weights[t] * own[t] for t in terms.tolist()], dtype=np.int64)))
        groups = max(1, -(-total // group_docs))
        dealt = vectors.filter(F.size("terms") > 0).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
        first = F.col("grp") % FIRST_ROUND == 0
        early = through_table(_search(dealt.filter(first), asked, {}, total_terms, total, k), "search-first")
        floors = {r["item_row"]: r["least"] for r in _kth(early, k).collect()}  # at most the block's items
        late = _search(dealt.filter(~first), asked, floors, total_terms, total, k)
        ids = spark.createDataFrame([(i.row, i.item_id) for i in asked], "item_row bigint, item_id bigint")
        best = _ranked(early.unionByName(late), k).join(F.broadcast(ids), "item_row")  # ids: the block's items
        found = found.unionByName(best.select("item_id", "rank", "doc_id", "score"))
    return found


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _kth(rows: DataFrame, k: int) -> DataFrame:
    """item_row, least: the kth best score of the items that have as many."""
    return _ranked(rows, k).filter(F.col("rank") == k).select("item_row", F.col("score").alias("least"))
