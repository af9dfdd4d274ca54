import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import catalog, packing

from .helpers import HARD_TEXTS, as_tables, documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


def first_fit(sizes, capacity):
    """First-fit decreasing by looking at every bin."""
    free, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, room in enumerate(free) if room >= sizes[i]), None)
        if at is None:
            at = len(free)
            free.append(capacity)
        out[i] = (at, capacity - free[at])
        free[at] -= sizes[i]
    return out, len(free)


@given(st.lists(st.integers(1, 64), max_size=80))
def test_tournament_tree_is_first_fit_decreasing(sizes):
    bins, offsets, used = packing.pack(sizes, 64)
    assert (list(zip(bins, offsets)), used) == first_fit(sizes, 64)


def check(pieces, docs):
    """``docs``: doc_id to ids, end id included (ids with several documents only by their union)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for d, ids in docs.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            own = np.array(ids[p.start : p.start + p.length], dtype="<u4")
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(own))
            at += p.length
        assert at == len(ids)
    for inside in by_sequence.values():
        at = 0
        for p in sorted(inside, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return len(by_sequence)


def tokenizer():
    return Tokenizer.from_file(JSON)


def ids_of(t, text):
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_query_on_the_table(spark, sf):
    t = tokenizer()
    docs = {r.doc_id: ids_of(t, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = check(catalog.op5_packing(spark, sf).collect(), docs)
    tokens = sum(map(len, docs.values()))
    assert n * 2048 <= 1.02 * tokens + 2048


def test_query_on_hard_rows(spark, tmp_path):
    t = tokenizer()
    got = catalog.op5_packing(spark, as_tables(spark, tmp_path, documents(spark, extra=True))).collect()
    ids = [d for d, _ in HARD_TEXTS]
    check(got, {d: ids_of(t, x) for d, x in HARD_TEXTS if ids.count(d) == 1})
    assert sum(p.length for p in got) == sum(len(ids_of(t, x)) for _, x in HARD_TEXTS)


def test_groups_share_no_sequence(spark):
    rows = [(i, "word " * (i % 700)) for i in range(600)]
    got = packing.packed(documents(spark, rows), PATH, group_docs=50).collect()
    check(got, {})
    assert len({p.sequence_id >> 32 for p in got}) == 12
    assert sum(p.length for p in got) == sum({p.doc_id: p.doc_tokens for p in got}.values())


def test_empty_and_special_strings(spark):
    assert packing.packed(empty(spark), PATH, tokenizer_path=JSON).collect() == []
    [piece] = packing.packed(documents(spark, [(1, END)]), PATH).collect()
    assert piece.length > 2  # without the tokenizer file they are ordinary text
    t = tokenizer()
    assert ids_of(t, f"a {END} b") == [64, 220, 50256, 275, 1]
    word = "word and " * 70_000  # beyond one chunk
    texts = [END, f"a {END} b", END * 3, f"x{END}", f"{END}y ", f"{word}{END}{word}", "<|endoftext", f" {END}\n\n{END}  z", f"<|{END}|>", "", None]
    got = packing.packed(documents(spark, list(enumerate(texts)), extra=True), PATH, tokenizer_path=JSON).collect()
    check(got, {i: ids_of(t, x) for i, x in enumerate(texts)})
    assert {p.doc_id for p in got} == set(range(len(texts)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([END, "[A]", "[AB]", "a", " ", "<|", "é"]), max_size=6).map("".join), max_size=5))
def test_stretches_put_ids_where_the_tokens_were(texts):
    added = {END: 9, "[A]": 7, "[AB]": 8}
    cut = packing.Stretches(texts, added)
    sizes = [len(x) for x in cut.texts]
    flat = np.array([ord(c) + 100 for x in cut.texts for c in x], dtype=np.int64)
    got = [x.tolist() for x in cut.ids(flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))]
    names = {v: k for k, v in added.items()}
    assert ["".join(names[i] if i < 100 else chr(i - 100) for i in ids) for ids in got] == texts
    assert all(sum(i == n for i in ids) == t.count(k) for ids, t in zip(got, texts) for k, n in added.items())
