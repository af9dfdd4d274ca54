import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from docloom.llm import byte_bpe, catalog, pretokens

from .helpers import HARD_TEXTS, as_tables, documents, empty

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = [
    "'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "\xa0", "é", "ß", "1", "٣", "!", "...", "😀",
    " ", "\x1c", "中", "a", "The", "͸", "\U0002ebf5", "'S", "\r\n", "ǅ", "²", "​", "<|endoftext|>",
]


def fuzz(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.model(byte_bpe.read_ranks(PATH)))


def test_splitting_is_the_pattern():
    texts = fuzz(4000)
    found = pretokens.split(texts)
    for i, t in enumerate(texts):
        own = [found.distinct[k] for k in found.index[found.bounds[i] : found.bounds[i + 1]]]
        assert own == [m[0] for m in regex.finditer(public_tokenizers.PATTERN, t)], repr(t)


def test_ids_are_the_librarys(codec, library):
    texts = fuzz(4000, 6) + [t for _, t in HARD_TEXTS]
    assert list(codec.encode(texts)) == [library.encode_ordinary(t or "") for t in texts]


def test_decoding_is_a_round_trip(codec):
    texts = fuzz(500, 7)
    assert [codec.decode(ids).decode() for ids in codec.encode(texts)] == texts


def test_model_pieces(codec):
    ranks = byte_bpe.read_ranks(PATH)
    assert codec.processor.get_piece_size() == len(ranks) + 1
    assert all(codec.bytes_of[r] == token for token, r in ranks.items())
    assert codec.processor.get_score(18) == -17.0
    with pytest.raises(ValueError):
        byte_bpe.model({b"a": 0, b"b": 2})


def test_a_full_cache_starts_afresh(codec, library):
    cache = pretokens.PieceCache(codec.encode_pieces, limit=3)
    for t in fuzz(50, 8):
        ids, bounds = pretokens.flat_ids(pretokens.split([t]), cache)
        assert ids.tolist() == library.encode_ordinary(t)


def row(library, t):
    ids = library.encode_ordinary(t or "")
    return (
        len(ids),
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256((t or "").encode()).hexdigest(),
    )


def test_query(spark, tmp_path, library, sf):
    got = catalog.op3_byte_bpe(spark, as_tables(spark, tmp_path, documents(spark, extra=True))).collect()
    want = sorted((str(d), *row(library, t)) for d, t in HARD_TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.op3_byte_bpe(spark, sf).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == row(library, texts[r.doc_id])


def test_empty_table_and_real_outputs(spark, library):
    assert byte_bpe.digests(empty(spark), PATH).collect() == []
    got = byte_bpe.encoded(documents(spark, [(1, "Hello  world"), (2, None)]), PATH).collect()
    assert [(r.doc_id, r.ids, bytes(r.decoded)) for r in got] == [
        (1, library.encode_ordinary("Hello  world"), b"Hello  world"),
        (2, [], b""),
    ]
