import math
import random

import duckdb
import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from docloom.llm import catalog, topk

from .helpers import as_tables

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, v string"


def brute(rows, k=5):
    vectors = [
        (d, [math.floor(256 * x) for x in e])
        for d, e in rows
        if d is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for i, (q, e) in enumerate(vectors):
        if q % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(e, f)), d, j) for j, (d, f) in enumerate(vectors) if j != i)
            out += [(q, r + 1, d, -s) for r, (s, d, _) in enumerate(others[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, e, None, "r", "v") for d, e in rows], SCHEMA)


def run(spark, rows, k=5):
    got = topk.top_k(frame(spark, rows), F.pmod("vec_id", F.lit(50)) == 0, k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def exact(x):
    """A float that 32 bits hold."""
    return round(x * 1024) / 1024


@pytest.mark.parametrize("width", [1, 3, 16])
def test_random_vectors_with_ties(spark, width):
    rng = random.Random(width)
    rows = [(i, [exact(rng.choice([-1, -0.5, 0, 0.25, 0.5, rng.uniform(-1, 1)])) for _ in range(width)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_cells_merge(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 37)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = random.Random(9)
    rows = [(i, [exact(rng.gauss(0, 1)) for _ in range(8)]) for i in range(400)]
    assert run(spark, rows, 7) == brute(rows, 7)


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -1.0]), (50, None), (100, [nan, 1.0]), (150, [inf, 0.0]), (200, [None, 1.0]), (None, [1.0, 1.0]),
        (3, [0.5]), (4, []), (5, [0.0, 0.0]), (6, [1.0, -1.0]), (250, [0.0, 0.0]), (-50, [2.0, 2.0]), (7, [300000.0, 0.0]),
        (8, [0.5, 0.25]), (8, [0.5, 0.25]),
    ]
    assert run(spark, rows) == brute(rows)


def test_wide_and_mixed_vectors(spark, sf, tmp_path):
    rng = random.Random(4)
    size = lambda: rng.choice([1.0, 300.0, 300_000.0, 2.0**20])
    rows = [(i, [exact(rng.uniform(-1, 1)) * size() for _ in range(5)]) for i in range(200)]
    rows += [(1000, [0.0, 0.0, 0.0, 2.0**60, 0.0]), (1001, [2.0**90]), (1050, [0.0, 0.25]), (1101, [0.0, 2.0**12])]
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    rows = [(i, [0.0, *e[1:3], 0.0, *e[4:]] if i % 50 == 0 else e) for i, e in rows]  # queries that meet no widest component
    assert run(spark, rows) == brute(rows)
    # DuckDB's list product works in doubles, so its side gets what they hold
    small = [(i, [x if abs(x) < 30_000 else x / 2**20 for x in e]) for i, e in rows if i < 1000]
    small = [(i, [float(np.float32(x)) for x in e]) for i, e in small]
    path = as_tables(spark, tmp_path, embeddings=frame(spark, small).coalesce(1))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    assert difference(spark, con, "op1", catalog.op1_exact_top_k, catalog.ORACLES["op1_exact_top_k"], path) is None


def test_a_score_beyond_64_bits_is_an_error(spark):
    assert run(spark, [(0, [0.0, 1.0]), (1, [2.0**100, 1.0])]) == [(0, 1, 1, 65536)]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        run(spark, [(0, [1.0]), (1, [2.0**60])])


def test_bound_with_wide_rows_in_the_lists():
    rng = np.random.default_rng(2)
    values = rng.integers(-50, 50, (3000, 3)).astype(float)
    values[:5] = [[2.0**80, -(2.0**80), 0], [-(2.0**80), 0, 1], [0, 0, 2.0**80], [2.0**30, 1, -3], [0, 0, 0]]
    lists = topk.SortedLists(values, np.arange(3000), np.arange(3000))
    for query in ([1, 0, 0], [0, 0, 5], [3, 3, 0], [-2, 7, 1]):
        scores = sorted(((-sum(int(a) * int(b) for a, b in zip(query, v)), i) for i, v in enumerate(values.tolist())))
        if abs(scores[0][0]) >= 1 << 63:
            with pytest.raises(OverflowError):
                lists.top(np.array(query), -1)
        else:
            place, score = lists.top(np.array(query), -1)
            assert [(-s, p) for s, p in zip(score, place.tolist())] == scores[:5]


def test_fewer_than_k_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_bound_stops_early():
    """Where one direction stands out, unread rows are never scored."""
    rng = np.random.default_rng(0)
    values = rng.integers(-10, 10, (5000, 4))
    values[:20] += 1000
    lists = topk.SortedLists(values, np.arange(5000), np.arange(5000))
    lists.values[1000:] = np.nan  # rows that the bound leaves unread; reading one would spoil the scores
    first = lists.ascending[:, -topk.FIRST_STRIDE :]
    assert (first < 20).all()
    place, score = lists.top(np.array([1, 1, 1, 1]), -1)
    assert set(place.tolist()) <= set(range(20))
    assert score == sorted(values[:20].sum(axis=1).tolist())[::-1][:5]


def test_query_against_sql(spark, sf):
    assert difference(spark, duck(sf), "op1", catalog.op1_exact_top_k, catalog.ORACLES["op1_exact_top_k"], sf) is None
