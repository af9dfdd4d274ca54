"""Quality classifier: similarity-weighted voting of the nearest labelled texts in a latent-semantic space.

Terms of a text: hashed byte trigrams, hashed trigrams of its collapsed shape (case, digits, spaces, signs)
and two bucketed shares (words equal to the word before, distinct words). Term counts are damped, weighted
by inverse document frequency and normalised within each family; a truncated SVD of the labelled sample
gives the latent space. Every document is projected whole and compared with all labelled vectors, in blocks
of exact cosine products; the ``neighbours`` nearest vote with their similarity cubed.

Labelled rows are a bounded sample: at most ``per_class`` rows of each label, those with the smallest hash
of their doc_id, so the broadcast vectors have a fixed bound. The two classes are sampled alike, so the vote
isn't tilted by how often a label occurs. Labels, lang, source and doc_id are never terms.

Null text counts as empty; an empty text gets the score of its (zero) term vector. Labels that are null
are left out; a doc_id labelled twice takes the larger label; repeated rows give one vector. Without
labelled rows every score is 0.5. Empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIGRAM_BITS, SHAPE_BITS, SHARES = 11, 9, 24
FAMILIES = ((0, 2048), (2048, 2560), (2560, 2584))
TERMS = 2584
PER_CLASS = 1000
DIMENSIONS = 48
NEIGHBOURS = 9
THRESHOLD = 0.3
BLOCK = 256
FOLDS = 5
# Multipliers of the trigram hash.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def _shapes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[128:] = ord("a")
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[9:14] = 32
    return table


SHAPE = _shapes()


def _trigrams(b: np.ndarray, bits: int) -> np.ndarray:
    if len(b) < 3:
        return np.zeros(1 << bits)
    b = b.astype(np.uint32)
    m = [np.uint32(x) for x in MULTIPLIERS]
    h = (b[:-2] * m[0]) ^ (b[1:-1] * m[1]) ^ (b[2:] * m[2])
    return np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)


def _shares(raw: bytes) -> np.ndarray:
    words, out = raw.split(), np.zeros(SHARES)
    if words:
        repeated = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        distinct = len(set(words)) / len(words)
        out[min(7, int(8 * repeated))] = 1
        out[8 + min(15, int(-1.5 * math.log2(distinct)))] = 1
    return out


def terms(text: str | None) -> np.ndarray:
    """Term counts of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    shape = SHAPE[b]
    if len(shape):
        turn = np.ones(len(shape), dtype=bool)
        turn[1:] = shape[1:] != shape[:-1]
        shape = shape[turn]
    return np.concatenate([_trigrams(b, TRIGRAM_BITS), _trigrams(shape, SHAPE_BITS), _shares(raw)])


@dataclass(frozen=True)
class Model:
    """Inverse document frequencies, the mean, the projection, and the labelled vectors with their labels."""

    idf: np.ndarray
    mean: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        similar = _unit((_weighted(counts, self.idf) - self.mean) @ self.projection) @ self.vectors.T
        k = min(self.neighbours, similar.shape[1])
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        votes = (np.maximum(np.take_along_axis(similar, near, 1), 0) + 1e-6).astype(np.float64) ** 3
        return np.clip((votes * self.labels[near]).sum(axis=1) / votes.sum(axis=1), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    damped = np.log1p(counts) * idf
    return np.concatenate([_unit(damped[:, a:b]) for a, b in FAMILIES], axis=1)


def train(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """The model of a bounded sample: rows of term counts and their labels."""
    n = len(counts)
    if not n:
        return Model(np.ones(TERMS), np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), labels)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _weighted(counts, idf)
    mean = x.mean(axis=0)
    x = x - mean
    values, axes = np.linalg.eigh((x @ x.T).astype(np.float64))
    top = np.argsort(-values)[:dimensions]
    top = top[values[top] > 1e-8]
    if not len(top):  # one distinct text: every document votes alike
        top = np.argsort(-values)[:1]
    projection = (x.T @ axes[:, top] / np.sqrt(np.maximum(values[top], 1e-8))).astype(np.float32)
    return Model(idf, mean, projection, _unit(x @ projection).astype(np.float32), labels.astype(np.float64))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows outside fold 0."""
    asked = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    known = asked.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = [
        known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)
    ]
    sample = picked[0].unionByName(picked[1])

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t).astype("<f4").tobytes() for t in texts])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    # the sample has at most 2 * per_class rows of two numbers
    rows = (
        texts.join(F.broadcast(sample), "doc_id")
        .select("doc_id", "quality", F.pandas_udf(count, "binary")("text").alias("terms"))
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .collect()
    )
    counts = np.frombuffer(b"".join(r["terms"] for r in rows), dtype="<f4").reshape(-1, TERMS)
    return train(counts, np.array([r["quality"] for r in rows], dtype=np.float64))


def score(spark, text: Column, model: Model) -> Column:
    """The score of a text column; the model (a fixed bound) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            out = [
                own.scores(np.array([terms(t) for t in texts.iloc[at : at + BLOCK]], dtype=np.float32))
                for at in range(0, len(texts), BLOCK)
            ]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return F.pandas_udf(each, "double")(text)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        score(docs.sparkSession, F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored under ``threshold``."""
    return docs.filter(score(docs.sparkSession, F.col("text"), model) >= threshold)
