"""SimHash near-dedup with a generalised pigeonhole search.

Fingerprint: A-Z lower-cased, words between the six ASCII white-space characters, shingles of four words
(repeats included; fewer words: the whole sequence), XXH64 with seed 42 of each, bit set where more than
half of the hashes have it; no words: zero. Null text counts as empty.

Search among distinct fingerprints for pairs at most ``max_bits`` apart:
1. Bits that agree often are put next to each other (co-occurrence counts over all fingerprints) and
   the order is cut into parts.
2. A pair within d bits has, for thresholds t_i with sum(t_i + 1) = d + 1, some part i with at most
   t_i differing bits (generalised pigeonhole). Dynamic programming allots the thresholds by estimated
   cost: candidate pairs from exact distance counts within each four bits of the order, and probe rows.
3. Fingerprints meet in buckets (part, value); probes also visit the values within t_i. Candidates are
   verified with the full distance. Large buckets are cut into blocks, and each pair of blocks is a
   task of its own.
4. A bucket reports links that span its linked sets, not all pairs; components follow from them.

Empty input gives no rows; a null doc_id is ignored as a component's smallest unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import keep_one, salted_left_join
from docloom.llm.components import components
from docloom.session import through_table

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BLOCK = 4096  # fingerprints of a bucket compared in one block
SCAN = 256  # longest bucket compared by shifting instead of by search
# Cost of shuffling a row in units of verifying a candidate pair (measured: about 3 us against 15 ns).
ROW_COST = 200.0
NIBBLES = 16


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    spans = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded, however long the text
        piece = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed 64-bit number."""

    def each(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint_of(t, words) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return F.pandas_udf(each, "bigint")(text)


# --- the plan of the search ----------------------------------------------------------------------


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_order(fps: DataFrame) -> list[int]:
    """The 64 bits, correlated ones side by side. Counts come from all fingerprints; the driver gets 64 x 65."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            x = _bits(b.column("fp").to_numpy(zero_copy_only=False)).astype(np.float64)
            both += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), pa.array(both.ravel().astype(np.int64)), pa.array(np.full(4096, n))],
            ["i", "j", "c", "n"],
        )

    rows = (
        fps.mapInArrow(count, "i bigint, j bigint, c bigint, n bigint")
        .groupBy("i", "j")
        .agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
        .collect()
    )
    if not rows or not rows[0]["n"]:
        return list(range(64))
    joint = np.zeros((64, 64))
    for r in rows:
        joint[r["i"], r["j"]] = r["c"] / r["n"]
    p = np.diag(joint)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint - np.outer(p, p)) / np.outer(spread, spread))
    order = [int(np.argmax(corr.sum(axis=0)))]
    while len(order) < 64:
        left = [b for b in range(64) if b not in order]
        order.append(max(left, key=lambda b: (corr[b, order[-8:]].mean(), -b)))
    return order


def _reordered(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Bit k of the result is bit order[k]."""
    packed = np.packbits(_bits(fps)[:, order], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").ravel()


def nibble_distances(fps: DataFrame, order: list[int]) -> np.ndarray:
    """Row k: how many ordered pairs of fingerprints differ in 0..4 bits of nibble k of the order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((NIBBLES, 16), dtype=np.int64)
        for b in batches:
            x = _reordered(b.column("fp").to_numpy(zero_copy_only=False), order)
            for k in range(NIBBLES):
                total[k] += np.bincount((x >> np.uint64(4 * k)) & np.uint64(15), minlength=16)
        k, v = np.divmod(np.arange(NIBBLES * 16), 16)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(total.ravel())], ["k", "v", "c"])

    counts = np.zeros((NIBBLES, 16))
    rows = fps.mapInArrow(count, "k bigint, v bigint, c bigint").groupBy("k", "v").agg(F.sum("c").alias("c"))
    for r in rows.collect():
        counts[r["k"], r["v"]] = r["c"]
    values = np.arange(16)
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    out = np.zeros((NIBBLES, 5))
    for k in range(NIBBLES):
        pairs = np.outer(counts[k], counts[k])
        out[k] = np.bincount(distance.ravel(), weights=pairs.ravel(), minlength=5)
    return out


def plan(distances: np.ndarray, n: int, max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """(first bit, width, threshold) of each part in use; parts with threshold -1 are left out."""
    best: tuple[float, list[tuple[int, int, int]]] = (float("inf"), [])
    shares = distances / max(1.0, float(n) ** 2)
    for m in range(1, min(NIBBLES, max_bits + 1) + 1):
        cuts = [NIBBLES * i // m for i in range(m + 1)]
        costs = []
        for a, b in zip(cuts, cuts[1:]):
            within = np.array([1.0])
            for k in range(a, b):  # nibbles taken as independent for the estimate
                within = np.convolve(within, shares[k])
            width = 4 * (b - a)
            cost = {-1: 0.0}
            for t in range(0, max_bits + 1):
                pairs = float(within[: t + 1].sum()) * n * n / 2
                rows = n * (1 + sum(comb(width, d) for d in range(1, t + 1)) / 2)
                cost[t] = pairs + ROW_COST * rows
            costs.append(cost)
        # thresholds over m parts with sum(t + 1) = max_bits + 1, at least cost
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for t, extra in cost.items():
                    key = used + t + 1
                    if key <= max_bits + 1 and (key not in nxt or c + extra < nxt[key][0]):
                        nxt[key] = (c + extra, [*ts, t])
            table = nxt
        total, thresholds = table[max_bits + 1]
        if total < best[0]:
            parts = [(4 * a, 4 * (b - a), t) for a, b, t in zip(cuts, cuts[1:], thresholds) if t >= 0]
            best = (total, parts)
    return best[1]


# --- probing and verifying -----------------------------------------------------------------------


def _masks(width: int, threshold: int) -> np.ndarray:
    """All values of ``width`` bits with 1..threshold bits set."""
    level, out = np.zeros(1, dtype=np.uint64), []
    for _ in range(threshold):
        level = np.unique((level[:, None] | (np.uint64(1) << np.arange(width, dtype=np.uint64))[None, :]).ravel())
        out.append(level)
    got = np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)
    return got[got != 0]


def bucket_rows(fps: DataFrame, order: list[int], parts: list[tuple[int, int, int]]) -> DataFrame:
    """(part, value, fp): each fingerprint in its own buckets, and as a probe in the larger values nearby."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                ordered = _reordered(fp, order)
                for i, (first, width, threshold) in enumerate(parts):
                    mask = np.uint64((1 << width) - 1)
                    own = (ordered >> np.uint64(first)) & mask
                    keys, owners = [own], [fp]
                    for m in _masks(width, threshold):
                        near = own ^ m
                        up = near > own  # each pair of values is visited from its smaller one
                        keys.append(near[up])
                        owners.append(fp[up])
                    key, owner = np.concatenate(keys), np.concatenate(owners)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(key), i, dtype=np.int32)),
                            pa.array(key.view(np.int64)),
                            pa.array(owner),
                        ],
                        ["part", "value", "fp"],
                    )

    return fps.mapInArrow(emit, "part int, value bigint, fp bigint")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _uniting(a: list[int], b: list[int], parent: dict[int, int]) -> list[int]:
    """Which of the pairs join two sets that were apart so far."""

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = top(x), top(y)
        if x != y:
            parent[y] = x
            kept.append(i)
    return kept


def spanning_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within one bucket cell.

    Every member is compared with those not reached yet only, so a tight cluster costs a few passes.
    """
    left, right = [], []
    rest = fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _apart(rest, x) <= max_bits
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def links(cells: DataFrame, max_bits: int) -> DataFrame:
    """Verified links (a, b) of all bucket cells. Input is dealt and sorted by cell."""
    keys = ["part", "value", "lo", "hi"]

    def verify(k: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """k: cell number of each row, sorted."""
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(k)])))
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        short = np.repeat(sizes <= SCAN, sizes)
        ks, fs = k[short], fp[short]
        joined: dict[int, int] = {}
        for shift in range(1, SCAN):
            same = np.flatnonzero(ks[shift:] == ks[:-shift]) if shift < len(ks) else []
            if not len(same):
                break
            near = same[_apart(fs[same], fs[same + shift]) <= max_bits]
            at = _uniting(near.tolist(), (near + shift).tolist(), joined)
            left.append(fs[near[at]])
            right.append(fs[near[at] + shift])
        for s, size in zip(starts[sizes > SCAN], sizes[sizes > SCAN]):
            members = np.unique(fp[s : s + size])
            a, b = spanning_links(members, max_bits)
            left.append(a)
            right.append(b)
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "fp")]
            if carried is not None:
                cols = [np.concatenate(x) for x in zip(carried, cols)]
            change = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            cell = np.cumsum(change)
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            carried = [c[last:] for c in cols]
            if last:
                a, z = verify(cell[:last], cols[4][:last])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["a", "b"])
        if carried is not None and len(carried[0]):
            a, z = verify(np.zeros(len(carried[0]), dtype=np.int64), carried[4])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["a", "b"])

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cells.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")
    )


def cells_of(buckets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of each bucket as (part, value, lo, hi, fp): one cell, or one per pair of blocks if it is large.

    Buckets of one row have nothing to compare and go.
    """
    sizes = buckets.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    return (
        buckets.join(sizes, ["part", "value"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "part", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"
        )
    )


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` (fp, distinct) within max_bits."""
    n = fps.count()
    order = bit_order(fps)
    parts = plan(nibble_distances(fps, order), n, max_bits)
    buckets = through_table(bucket_rows(fps, order, parts), "simhash-buckets")
    return links(cells_of(buckets, block), max_bits)


# --- documents -----------------------------------------------------------------------------------


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, root (one fingerprint of the component; null where it has no other fingerprint)."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), fingerprint(F.col("text"), words).alias("fp")
    )
    rows = through_table(rows, "simhash-rows")
    fps = through_table(rows.select("fp").distinct(), "simhash-fps")
    roots = through_table(
        components(link_fingerprints(fps, max_bits)).select(F.col("v").alias("fp"), "root"), "simhash-roots"
    )
    return salted_left_join(rows, roots, ["fp"]).select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def component_ids(groups: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row of ``near_groups``."""
    groups = through_table(groups, "simhash-groups")
    smallest = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return salted_left_join(groups, smallest, ["root"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row (the smallest doc_id) of each component, all columns as they were."""
    groups = through_table(near_groups(docs, words, max_bits), "simhash-groups")
    first = (
        groups.groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("first"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
    )
    contested = (
        salted_left_join(groups, first, ["root"])
        .filter("size is not null")
        .select(
            F.col("doc_id").alias("_llm_id"),
            F.col("fp").alias("_llm_text"),
            (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("fp") == F.col("first.fp"))).alias("_llm_wins"),
        )
        .groupBy("_llm_id", "_llm_text")
        .agg(F.max("_llm_wins").alias("_llm_wins"))
    )
    return keep_one(docs, contested, "doc_id", lambda text: fingerprint(text, words))
