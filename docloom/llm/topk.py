"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers, floor(256 * x). Candidates are dealt to groups of about ``group_rows`` rows by a
hash of their row number, queries to blocks of about ``query_rows``; each (block, group) cell is one task:

- sorted access: per dimension the group's rows sorted by their component, read from the end that a query's
  sign favours, in growing strides;
- random access: rows met for the first time are scored in full;
- bound: the score of an unseen row can't exceed the sum over dimensions of weight times the component
  last read; a query stops when its kth best score is above that bound (not equal: an unseen row with the
  kth score could have the smaller id).

Cells report k rows per query, which a window with a limit merges. Ties go to the smaller vec_id, then to
the earlier row. Vectors that are null or hold null, NaN or infinite components take no part, nor do rows
without vec_id. Shorter vectors count as padded with zeros. Of repeated vec_ids every row is a candidate of
the others. Empty input gives no rows.

Scores are exact for components of any size: in doubles where they stay below 2^53, else in 64-bit
integers; rows so wide that these could overflow are scored outright in Python's integers. A score among the
k best that doesn't fit 64 bits is an error, as the result could not hold it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import row_number_source
from docloom.session import through_table

K = 5
GROUP_ROWS = 4096
QUERY_ROWS = 4096
FIRST_STRIDE = 16
DOUBLE, LONG = 1 << 53, 1 << 62


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, row, v (array<double>, to be rounded down) of the vectors that take part, written to the
    shared folder. 256 times a double is exact, and so is its floor as a double."""
    scaled = F.transform(F.col("embedding"), lambda x: x.cast("double") * 256)
    bad = F.exists(
        F.col("embedding"),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return through_table(rows.select("vec_id", row_number_source().alias("row"), scaled.alias("v")), "topk-rows")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(flat)
    return out


class SortedLists:
    """A group's rows with, per dimension, their order by that component. ``matrix``: whole numbers as doubles."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        by_id = np.lexsort((rows, ids))  # so that the earlier position wins a tie
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.values = matrix[by_id].astype(np.float64)
        self.reach = np.abs(self.values).max(axis=1, initial=0)
        self.ascending = np.argsort(self.values, axis=0, kind="stable").T.copy()

    @functools.cached_property
    def whole(self) -> np.ndarray:
        """The rows that fit 64-bit integers; zeros for the others, which are never read here."""
        return np.where(self.reach[:, None] < LONG, self.values, 0).astype(np.int64)

    def top(self, query: np.ndarray, own: int, k: int = K) -> tuple[np.ndarray, list[int]]:
        """(positions, scores) of the k best rows, without the row numbered ``own``."""
        query = query.astype(np.float64)
        cost = max(1.0, float(np.abs(query).max(initial=0))) * max(1, len(query))
        wide = self.reach * cost >= LONG
        others = self.rows != own
        place, score = self._search(query, others & ~wide, cost, k)
        found = list(zip(score.tolist(), place.tolist()))
        if (wide & others).any():
            whole = [int(x) for x in query]
            for i in np.flatnonzero(wide & others).tolist():
                found.append((sum(a * int(b) for a, b in zip(whole, self.values[i].tolist())), i))
        found = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
        for s, i in found:
            if abs(s) >= 1 << 63:
                raise OverflowError(f"a score with vec_id {self.ids[i]} does not fit 64 bits")
        return np.array([i for _, i in found], dtype=np.int64), [int(s) for s, _ in found]

    def _search(self, query: np.ndarray, wanted: np.ndarray, cost: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The threshold algorithm over the rows ``wanted``."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        seen = ~wanted
        exact = self.reach[wanted].max(initial=0) * cost < DOUBLE
        values, weights = (self.values, query) if exact else (self.whole, query.astype(np.int64) if wanted.any() else query)
        place, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=values.dtype)
        depth, stride = 0, FIRST_STRIDE
        while True:
            deeper = min(n, depth + stride)
            if len(used) and deeper < n:
                met = np.zeros(n, dtype=bool)
                for d in used:
                    order = self.ascending[d]
                    met[order[n - deeper : n - depth] if query[d] > 0 else order[depth:deeper]] = True
                last = [self.ascending[d][n - deeper if query[d] > 0 else deeper - 1] for d in used]
                parts = query[used] * self.values[last, used]
                # lists may pass wide rows, and large sums round: the bound is raised by more than that
                bound = float(parts.sum() + (0 if exact and not seen.all() and self._narrow(last, cost) else 1e-9 * np.abs(parts).sum()))
            else:  # every row is read; rows of an all-zero query score alike
                met, bound = np.ones(n, dtype=bool), -np.inf
            new = np.flatnonzero(met & ~seen)
            seen |= met
            place = np.concatenate((place, new))
            score = np.concatenate((score, values[new] @ weights))
            best = np.lexsort((place, -score))[:k]
            place, score = place[best], score[best]
            if bound == -np.inf or seen.all() or len(score) == k and score[-1] > bound:
                return place, score.astype(np.int64)
            depth, stride = deeper, 2 * stride

    def _narrow(self, rows: list[int], cost: float) -> bool:
        return bool(self.reach[rows].max() * cost < DOUBLE)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for which ``is_query`` holds."""
    rows = integer_rows(vectors)
    queries = rows.filter(is_query)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    groups = max(1, -(-size["n"] // GROUP_ROWS))
    width = max(1, size["width"] or 1)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    left = rows.select("*", deal(groups).alias("grp"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    right = queries.select("*", deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("grp"))

    def cell(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_id", "query_row", "vec_id", "row", "score")}
        if candidates.num_rows and asked.num_rows:
            lists = SortedLists(
                _matrix(candidates.column("v"), width),
                candidates.column("vec_id").to_numpy(),
                candidates.column("row").to_numpy(),
            )
            wanted = _matrix(asked.column("v"), width)
            for q, qid, qrow in zip(wanted, asked.column("vec_id").to_pylist(), asked.column("row").to_pylist()):
                place, score = lists.top(q, qrow, k)
                out["query_id"] += [qid] * len(place)
                out["query_row"] += [qrow] * len(place)
                out["vec_id"] += lists.ids[place].tolist()
                out["row"] += lists.rows[place].tolist()
                out["score"] += score
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = (
        left.groupBy("block", "grp")
        .cogroup(right.groupBy("block", "grp"))
        .applyInArrow(cell, "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint")
    )
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
