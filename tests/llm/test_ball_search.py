import math
import random
from collections import Counter

import numpy as np
from compare import difference, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import ball_search, catalog

from .helpers import HARD_TEXTS, documents, empty
from .test_divergence import LOWER, TERM_DIGITS


def terms_of(text):
    return TERM_DIGITS.findall((text or "").translate(LOWER))


def brute(rows, items, k=20):
    docs = [(d, terms_of(t)) for d, t in rows]
    docs = [(d, Counter(t), len(t)) for d, t in docs if t]
    total, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        found = []
        for at, (d, c, n) in enumerate(docs):
            m = 75 + 25 * n * total // length
            score = sum(
                times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items()
                if t in c
            )
            if score > 0:
                found.append((-score, d is not None, d or 0, at))
        out += [(item, i + 1, docs[at][0], -s) for i, (s, _, _, at) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, rows, items, **kw):
    got = ball_search.search(documents(spark, rows, extra=True), spark.createDataFrame(items, "item_id bigint, text string, row string"), **kw)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"{lang}{i}" for lang in "ab" for i in range(40)]
    rows = []
    for i in range(n):
        own = words[:40] if i % 2 else words[40:]
        rows.append((i, " ".join(rng.choice(own[: rng.randrange(1, 40)]) for _ in range(rng.randrange(60)))))
    return rows + [(n + i, rows[3][1]) for i in range(40)]


def test_random_texts_with_copies(spark):
    rows = corpus(700)
    items = [(i, rows[7 * i][1], "x") for i in range(12)] + [(90, "a1 a1 a1 b39 unheard", "x"), (91, "a3", "x")]
    want = brute(rows, [x[:2] for x in items])
    assert run(spark, rows, items) == want
    assert run(spark, rows, items, group_docs=30, block_items=5) == want
    assert run(spark, rows, items, k=3, group_docs=100, block_bytes=300) == brute(rows, [x[:2] for x in items], 3)


def test_hard_rows(spark):
    items = [(1, "The quick BROWN fox", "x"), (2, None, "x"), (3, "", "x"), (None, "repeated row", "x"), (3, "one two 😀 é", "x"), (4, "one " * 300_000, "x")]
    want = brute(HARD_TEXTS, [x[:2] for x in items])
    assert run(spark, HARD_TEXTS, items) == want
    assert run(spark, [(1, None), (2, " ")], items) == []
    assert ball_search.search(empty(spark), spark.createDataFrame(items, "item_id bigint, text string, row string")).collect() == []
    assert run(spark, HARD_TEXTS, [(1, "x", "y")][:0] or [(1, None, "y")]) == []
    assert ball_search.search(documents(spark), spark.createDataFrame([], "item_id bigint, text string")).collect() == []


def tree_of(vectors):
    sizes = [len(v) for v in vectors]
    flat = lambda i: np.array([e[i] for v in vectors for e in v], dtype=np.int64)
    return ball_search.BallTree(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), flat(0), flat(1), leaf=3)


ENTRY = st.dictionaries(st.integers(0, 12), st.integers(1, 10**6), min_size=1, max_size=6)


@settings(max_examples=80, deadline=None)
@given(st.lists(ENTRY, min_size=1, max_size=40), st.dictionaries(st.integers(0, 15), st.integers(1, 10**7), min_size=1, max_size=8), st.integers(1, 5))
def test_tree_finds_what_a_scan_finds(vectors, query, k):
    tree = tree_of([sorted(v.items()) for v in vectors])
    terms = np.array(sorted(query), dtype=np.int64)
    weights = np.array([query[t] for t in sorted(query)], dtype=np.int64)
    place, score = tree.top(terms, weights, np.arange(len(vectors)), k)
    scores = [sum(query.get(t, 0) * x for t, x in v.items()) for v in vectors]
    want = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:k]
    assert [(-int(s), int(p)) for p, s in zip(place, score)] == want


def test_bounds_hold_and_subtrees_go_unread():
    rng = random.Random(5)
    vectors = [sorted({rng.randrange(30 * (i % 2), 30 + 30 * (i % 2)): rng.randrange(1, 10**6) for _ in range(9)}.items()) for i in range(2000)]
    tree = tree_of(vectors)
    for trial in range(20):
        query = np.zeros(60, dtype=np.int64)
        query[[rng.randrange(30) for _ in range(5)]] = 3_000
        terms = np.flatnonzero(query)
        read = []
        plain = tree.scores
        tree.scores = lambda low, high, q: (read.append(high - low), plain(low, high, q))[1]
        _, score = tree.top(terms, query[terms], np.arange(2000), 5)
        tree.scores = plain
        own = plain(0, 2000, np.append(query, 0)[: tree.width])
        assert score.tolist() == sorted(own.tolist())[::-1][:5]
        assert sum(read) <= 1100  # the half that shares no term is never opened


def test_query_against_sql(spark, sf):
    name = "op13_lexical_search"
    assert difference(spark, duck(sf), name, catalog.op13_lexical_search, catalog.ORACLES[name], sf) is None
