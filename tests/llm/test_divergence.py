import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import difference, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import catalog, divergence
from docloom.llm.perfect_hash import Shards, bucket_count, build, hashes, shard_of
from docloom.llm.terms import LETTERS, LETTERS_DIGITS, find_terms

from .helpers import DOCS, documents, empty

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERM_DIGITS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aZ09 _[`{\x7f\x80é😀ſK\n\x00"), max_size=12), max_size=8))
def test_terms_of_a_batch(texts):
    for members, pattern in ((LETTERS, TERM), (LETTERS_DIGITS, TERM_DIGITS)):
        for array in (pa.array(["x y", *texts], pa.string()).slice(1), pa.array(texts, pa.large_string())):
            found = find_terms(array, members)
            words = found.distinct.to_pylist()
            got = [[words[c] for c in found.code[a:b]] for a, b in zip(found.bounds, found.bounds[1:])]
            assert got == [pattern.findall((t or "").translate(LOWER)) for t in texts]
            assert len(set(words)) == len(words)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 2300])
def test_perfect_hash_is_minimal(n):
    keys = pa.array([f"key {i}" for i in range(n)], pa.string())
    seeds, slots = build(*hashes(keys))
    assert sorted(slots.tolist()) == list(range(n)) and len(seeds) == bucket_count(n)


def test_shards_find_their_keys_and_no_others():
    rows = []
    for space, n, shards in (("en", 900, 4), ("de", 50, 1), ("", 3, 1)):
        keys = pa.array([f"{space}{i}" for i in range(n)], pa.string())
        first, second = hashes(keys)
        place = shard_of(first, shards)
        for s in range(shards):
            own = np.flatnonzero(place == s)
            seeds, slots = build(first[own], second[own])
            by_slot = keys.take(pa.array(own[np.argsort(slots)])).to_pylist()
            if (space, s) != ("en", 2):  # a shard that is elsewhere
                rows.append({"space": space, "shards": shards, "shard": s, "seeds": seeds.tolist(), "keys": by_slot})
    held = Shards.of(rows)
    asked = pa.array([f"en{i}" for i in range(2000)] + ["de1", "x"], pa.string())
    slots = held.find("en", asked, *hashes(asked))
    stored = held.keys.to_pylist()
    present = {k for r in rows if r["space"] == "en" for k in r["keys"]}
    assert [s >= 0 for s in slots] == [a in present for a in asked.to_pylist()]
    assert all(stored[s] == a for s, a in zip(slots, asked.to_pylist()) if s >= 0)
    assert (held.find("fr", asked, *hashes(asked)) == -1).all()
    assert sorted(held.span.values()) == [(0, 3), (3, 53), (53, 53 + len(present))]


def brute(rows, min_docs, top):
    """``rows``: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({r[1:] for r in rows})
    for text, lang, source in rows:
        words = TERM.findall(text.translate(LOWER))
        held[lang].update(set(words))
        counts[lang, source].update(words)
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in held.items()}
    for lang, _ in groups:
        kept.setdefault(lang, [])

    def shares(count, lang):
        total = sum(count[t] for t in kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    out = set()
    for lang, source in groups:
        p = shares(counts[lang, source], lang)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        q = shares(whole, lang)
        pairs = []
        for other in [s for l, s in groups if l == lang and s != source]:
            r = shares(counts[lang, other], lang)
            pairs.append((-sum(abs(p[t] - r[t]) for t in p), other.encode()))
        terms = [(q[t] - p[t], t.encode()) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, *r, "x", "y", 1) for i, r in enumerate(rows)], f"doc_id int, text string, lang string, source string, slot string, total string, n int")
    got = divergence.audit(docs, **kw).collect()
    rows = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in got]
    assert len(set(rows)) == len(rows)
    return set(rows)


def sample(n=400, sources=9):
    rng = random.Random(3)
    words = ["Alpha", "beta", "Gamma", "délta", "ε", "zeta9eta", "theta", "ⅨX", "new-word", "kappa"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        text = " ".join(rng.choice(words[: 4 + i % 7]) for _ in range(rng.randrange(30)))
        rows.append((text, lang, rng.choice([None, "hot", "hot", *(f"s{j}" for j in range(sources))])))
    return rows


def test_against_plain_loops(spark):
    rows = sample()
    want = brute(rows, 20, 4)
    assert {r[2] for r in want} == {"pair", "term"}
    assert run(spark, rows, min_docs=20, top_terms=4) == want


def test_pieces_flushes_and_blocks_change_nothing(spark, monkeypatch):
    rows = sample()
    want = run(spark, rows, min_docs=3, top_terms=5)
    for name, value in (("SHARD_KEYS", 2), ("SOURCE_BLOCK", 3), ("HELD_ROWS", 4)):
        monkeypatch.setattr(divergence, name, value)
    assert run(spark, rows, min_docs=3, top_terms=5, piece_bytes=60, dense_slots=3) == want == brute(rows, 3, 5)


def test_hard_rows(spark):
    long = "word Two " * 50_000
    rows = [("", None, None), (None, None, "a"), (long, "en", "a"), ("word", "en", "b"), ("word", "en", "b"), ("1 2 3", "xx", "only")]
    assert run(spark, rows, min_docs=2) == brute(rows, 2, 50)
    assert run(spark, rows) == brute(rows, 30, 50)
    assert divergence.audit(documents(spark, extra=True)).count() > 0
    assert divergence.audit(empty(spark)).collect() == []
    assert divergence.audit(spark.createDataFrame([(1, "a b", None, None, 1)], DOCS), min_docs=1).collect() == []


def test_query_against_sql(spark, sf):
    name = "op11_source_divergence"
    assert difference(spark, duck(sf), name, catalog.op11_source_divergence, catalog.ORACLES[name], sf) is None
