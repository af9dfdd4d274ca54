import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from docloom.llm import catalog, sharding

from .helpers import HARD_TEXTS, as_tables, documents, empty


@given(st.integers(1, 3000), st.integers(0, 2**32))
def test_a_permutation_for_any_count(n, seed):
    assert sorted(sharding.permute(np.arange(n), n, seed).tolist()) == list(range(n))


def test_walks_by_the_definition():
    """One value at a time with plain integers."""
    n, half, keys = 1000, sharding.half_bits(1000), sharding.round_keys(sharding.SEED)

    def scramble(x, key):
        x = ((x ^ key) % 2**32) * sharding.MULTIPLIERS[0] % 2**32
        x ^= x >> 15
        x = x * sharding.MULTIPLIERS[1] % 2**32
        return x ^ (x >> 13)

    def walk(v):
        while True:
            left, right = v >> half, v % 2**half
            for key in keys:
                left, right = right, left ^ (scramble(right, key) % 2**half)
            v = left * 2**half + right
            if v < n:
                return v

    assert sharding.permute(np.arange(n), n).tolist() == [walk(v) for v in range(n)]


def check(rows, texts):
    sizes = Counter(r.shard for r in rows)
    assert not rows or max(sizes.get(s, 0) for s in range(24)) - min(sizes.get(s, 0) for s in range(24)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_query_on_hard_rows(spark, tmp_path):
    path = as_tables(spark, tmp_path, documents(spark, extra=True))
    got = catalog.op2_sharding(spark, path).collect()
    check(got, HARD_TEXTS)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_place_follows_from_the_row_number(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs).collect()}
    ids = sorted(got)
    p = sharding.permute(np.arange(len(ids)), len(ids))
    assert [got[d] for d in ids] == [(int(x) % 24, int(x) // 24) for x in p]
    shuffled = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs.repartition(5)).collect()}
    assert shuffled == got


def test_empty_and_hot_rows(spark):
    assert sharding.assign(empty(spark)).collect() == []
    rows = [(None, "x")] * 500 + [(7, "y")] * 300
    check(sharding.assign(documents(spark, rows)).collect(), rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17])
def test_domain_holds_all_numbers(n):
    assert n <= 4 ** sharding.half_bits(n) <= max(4, 4 * n)
