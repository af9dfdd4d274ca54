import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import catalog, components, simhash

from .helpers import HARD_TEXTS, as_tables, documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[top(i)] = top(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        r = top(i)
        smallest[r] = min((x for x in (smallest.get(r), d) if x is not None), default=None)
    return Counter((d, format(f, "016x"), smallest[top(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def near_copies(n, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, len(words)))] = f"v{int(rng.integers(0, 50))}"
        rows.append((1000 + i, " ".join(words)))
    return rows


def test_query_on_hard_rows(spark, tmp_path):
    rows = HARD_TEXTS + near_copies(60)
    got = catalog.op7_simhash_near_dedup(spark, as_tables(spark, tmp_path, documents(spark, rows, extra=True))).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_components(rows)


def test_query_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = catalog.op7_simhash_near_dedup(spark, sf).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_components(rows)


@settings(max_examples=60, deadline=None)
@given(
    st.permutations(range(64)),
    st.integers(0, 2**64 - 1),
    st.sets(st.integers(0, 63), max_size=4),
    st.integers(0, 2**31),
)
def test_no_pair_within_the_distance_escapes_the_plan(order, fp, flips, seed):
    """Some part in use has at most its threshold of differing bits, whatever thresholds were chosen."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 10**9))
    shares = rng.dirichlet(np.ones(5), simhash.NIBBLES) * n * n
    parts = simhash.plan(shares, n)
    assert sum(t + 1 for _, _, t in parts) == simhash.MAX_BITS + 1
    pair = np.array([fp, fp ^ sum(1 << b for b in flips)], dtype=np.uint64).view(np.int64)
    a, b = (int(x) for x in simhash._reordered(pair, list(order)))
    assert any(((a ^ b) >> first & ((1 << width) - 1)).bit_count() <= t for first, width, t in parts)


@pytest.mark.parametrize("parts", [[(0, 20, 0), (20, 20, 1), (40, 24, 1)], [(0, 32, 1), (32, 32, 2)]])
def test_probing_parts_find_the_same_components(spark, parts):
    rng = np.random.default_rng(1)
    centres = rng.integers(-(2**62), 2**62, 12)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 63, int(rng.integers(0, 6)))) for c in centres for _ in range(12)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    cells = simhash.cells_of(simhash.bucket_rows(df, list(range(64)), parts), block=7)
    roots = {r.v: r.root for r in components.components(simhash.links(cells, 4)).collect()}
    got = Counter(frozenset(f for f in fps if roots.get(f, f) == root) for root in {roots.get(f, f) for f in fps})
    groups = {f: {f} for f in fps}
    for i, f in enumerate(fps):
        for g in fps[:i]:
            if ((f ^ g) % 2**64).bit_count() <= 4 and groups[f] is not groups[g]:
                groups[f] |= groups[g]
                for x in groups[g]:
                    groups[x] = groups[f]
    assert got == Counter({frozenset(g): 1 for g in {id(x): x for x in groups.values()}.values()})


def test_bucket_cells_report_spanning_links(spark):
    fp = np.arange(400, dtype=np.int64)  # nine bits: everything is connected
    a, b = simhash.spanning_links(fp, 4)
    assert len(a) == 399 and set(a) | set(b) == set(fp.tolist())


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)] + [(5000, 5000)]
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    roots = {r.v: r.root for r in got}
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[1000 + i] for i in range(200)}) == 1
    assert roots[0] != roots[1000] and 5000 not in roots


def test_dropping_keeps_columns_and_one_of_each(spark):
    rows = HARD_TEXTS + near_copies(40)
    docs = documents(spark, rows, extra=True)
    kept = simhash.drop_near_copies(docs)
    assert kept.schema == docs.schema
    want = Counter(c for _, _, c in {k for k in brute_components(rows)})
    got = kept.collect()
    assert Counter(r.doc_id for r in got) == Counter({d: 1 for d in want})


def test_empty(spark):
    assert simhash.component_ids(simhash.near_groups(empty(spark))).collect() == []
    assert simhash.drop_near_copies(empty(spark)).collect() == []
