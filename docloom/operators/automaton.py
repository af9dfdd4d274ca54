"""Matching against large stores with a keyword automaton.

The store is dealt to measured pieces, nearly always one. A piece's distinct keywords and supplier names
become one Aho-Corasick automaton, built once and broadcast; a text is read once per piece and gives every
keyword it holds, whatever their number. Hits are then counted per template inside the row, so no pair of
document and keyword ever becomes a row, and a single piece needs no shuffle at all.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.fuzzy import partial_ratio
from docloom.operators.dimension import match_columns
from docloom.session import through_table

# Cells (documents x templates) whose candidates are built at once.
CELLS = 1 << 20
CANDIDATE_FIELDS = pa.struct(
    [
        ("seq", pa.int64()),
        ("template_id", pa.string()),
        ("score", pa.float64()),
        ("hit_rate", pa.float64()),
        ("quorum", pa.float64()),
        ("hits", pa.int32()),
    ]
)
BEST = "struct<score:double,order:bigint,template_id:string,hit_rate:double,quorum:double>"
NEAR = "struct<score:double,order:bigint,template_id:string>"
CANDIDATES = "array<struct<seq:bigint,template_id:string,score:double,hit_rate:double,quorum:double,hits:int>>"


@dataclass
class Piece:
    """Some templates in insertion order, their keywords as an automaton over word numbers."""

    automaton: ahocorasick.Automaton | None
    seq: np.ndarray
    ids: pa.StringArray
    quorum: np.ndarray
    count: np.ndarray  # keywords of each template, repeats included
    hint: np.ndarray  # word number of its supplier, -1 without one
    names: dict[int, str]  # suppliers by word number
    owners: np.ndarray  # templates by keyword, one entry per repeat
    owner_at: np.ndarray  # where each word's owners begin
    blank: int  # number of the empty keyword, -1 if there is none
    by_hint: dict[int, np.ndarray]  # templates of each supplier (-1: without one), ascending

    @classmethod
    def of(cls, rows: list[Row]) -> Piece:
        rows = sorted(rows, key=lambda r: r["seq"])
        words: dict[str, int] = {}
        pairs, hint = [], np.full(len(rows), -1)
        for t, r in enumerate(rows):
            pairs += [(words.setdefault(k, len(words)), t) for k in r["kws"] if k is not None]
            if r["kws"] and r["hint"]:  # a template without keywords never looks at its supplier
                hint[t] = words.setdefault(r["hint"], len(words))
        automaton = ahocorasick.Automaton()
        for word, i in words.items():
            if word:
                automaton.add_word(word, i)
        automaton.make_automaton()
        pairs.sort()
        by_word = np.array([w for w, _ in pairs], dtype=np.int64)
        asked = set(hint.tolist())
        by_hint = np.argsort(hint, kind="stable")
        starts = np.flatnonzero(np.diff(hint[by_hint], prepend=-2))
        return cls(
            automaton if len(automaton) else None,
            np.array([r["seq"] for r in rows], dtype=np.int64),
            pa.array([r["template_id"] for r in rows], pa.string()),
            np.array([r["quorum"] for r in rows], dtype=np.float64),
            np.array([len(r["kws"]) for r in rows], dtype=np.int64),
            hint,
            {i: w for w, i in words.items() if i in asked},
            np.array([t for _, t in pairs], dtype=np.int64),
            np.searchsorted(by_word, np.arange(len(words) + 1)),
            words.get("", -1),
            {int(hint[own[0]]): own for own in np.split(by_hint, starts[1:])} if rows else {},
        )

    def words_in(self, text: str | None) -> set[int]:
        """J1. Numbers of the words that a case-folded text contains."""
        if text is None:
            return set()
        found = {i for _, i in self.automaton.iter(text)} if self.automaton else set()
        return found | {self.blank} if self.blank >= 0 else found

    def hits(self, words: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """(templates with a hit, ascending; how many of their keywords hit)."""
        spans = [self.owners[self.owner_at[w] : self.owner_at[w + 1]] for w in words]
        return np.unique(np.concatenate(spans) if spans else np.zeros(0, dtype=np.int64), return_counts=True)

    def boosts(self, templates: np.ndarray, words: set[int], text: str | None, weight: float) -> np.ndarray:
        """J3. Each supplier is compared once per text."""
        asked = self.hint[templates]
        known = {-1: 0.0}
        for h in set(asked.tolist()) - {-1}:
            known[h] = weight if h in words else weight * (partial_ratio(self.names[h], text) / 100.0 if text else 0.0)
        return np.array([known[h] for h in asked.tolist()], dtype=np.float64)

    def scores(self, text: str | None, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """J2-J4. (hits, hit rate, score) of every template."""
        words = self.words_in(text)
        hits = np.zeros(len(self.seq), dtype=np.int64)
        own, n = self.hits(words)
        hits[own] = n
        rate = np.where(self.count > 0, hits / np.maximum(self.count, 1), 0.0)
        score = np.minimum(1.0, rate + self.boosts(np.arange(len(self.seq)), words, text, weight))
        return hits, rate, np.where(self.count > 0, score, 0.0)

    def decide(self, text: str | None, weight: float) -> tuple[dict | None, dict]:
        """J5, J8. Best and near candidate. A template more than the supplier weight (and one rounding
        step) behind the best hit rate can be neither, so its supplier is never compared. Templates without a hit
        differ by their supplier alone: the first of each stands for all."""
        words = self.words_in(text)
        own, n = self.hits(words)
        rate = n / np.maximum(self.count[own], 1)
        least = rate.max(initial=0.0) - weight - 1e-4
        if least > 0:
            keep = rate >= least
            own, rate = own[keep], rate[keep]
        else:
            hit = set(own.tolist())
            rest = [next((t for t in map(int, same) if t not in hit), None) for same in self.by_hint.values()]
            rest = np.array([t for t in rest if t is not None], dtype=np.int64)
            own, rate = np.concatenate([own, rest]), np.concatenate([rate, np.zeros(len(rest))])
            order = np.argsort(own)
            own, rate = own[order], rate[order]
        score = np.minimum(1.0, rate + self.boosts(own, words, text, weight))
        at = int(np.argmax(score))
        best = None
        if score[at] > 0:
            t = int(own[at])
            best = {
                "score": float(score[at]),
                "order": -int(self.seq[t]),
                "template_id": self.ids[t].as_py(),
                "hit_rate": float(rate[at]),
                "quorum": float(self.quorum[t]),
            }
        rounded = {s: rounded_score(s) for s in set(score.tolist())}
        shown = np.array([rounded[s] for s in score.tolist()])
        at = int(np.argmax(shown))
        t = int(own[at])
        return best, {"score": float(shown[at]), "order": -int(self.seq[t]), "template_id": self.ids[t].as_py()}


def rounded_score(score: float) -> float:
    """Four places, halves up on the shortest decimal text, as Spark rounds a double."""
    return float(decimal.Decimal(repr(score)).quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_UP))


def pieces(templates: DataFrame, cfg: EngineConfig) -> list[DataFrame]:
    """The store's matching columns in pieces within the configured bound (twice the bound for an unlucky
    hash; a single larger template is a piece by itself). Only sizes come to the driver here."""
    sized = sized_store(templates)
    piece, numbers = dealt(sized, cfg.automaton_max_templates, cfg.automaton_max_chars)
    return [sized.filter(piece == p).drop("_chars") for p in numbers]


def sized_store(templates: DataFrame) -> DataFrame:
    """The store's matching columns and their characters, written once."""
    dim = match_columns(templates)
    size = F.aggregate("kws", F.lit(0), lambda n, k: n + F.coalesce(F.length(k), F.lit(0))) + F.length("hint")
    return through_table(dim.select("*", size.cast("bigint").alias("_chars")), "store-columns")


def dealt(sized: DataFrame, most: int, most_chars: int) -> tuple[Column, list[int]]:
    """A row's piece, and the numbers of all pieces, within the bounds as ``pieces`` has them."""
    n, chars, largest = sized.agg(F.count(F.lit(1)), F.sum("_chars"), F.max("_chars")).first()
    parts = max(1, -(-n // most), -(-(chars or 0) // most_chars))
    while True:
        piece = F.pmod(F.xxhash64("template_id"), F.lit(parts))
        rows = sized.groupBy(piece.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("_chars").alias("c")).collect()
        if all(r["n"] <= 2 * most and r["c"] <= max(2 * most_chars, largest) for r in rows):
            return piece, sorted(r["p"] for r in rows)
        parts *= 2


def _held(piece: DataFrame):
    return piece.sparkSession.sparkContext.broadcast(Piece.of(piece.collect()))  # within the bound of pieces()


def candidates(piece: DataFrame, cfg: EngineConfig):
    """Arrow UDF: case-folded text -> every template of the piece with its exact score, in insertion order."""
    held, weight = _held(piece), cfg.supplier_weight

    def build(texts: list[str | None], p: Piece) -> pa.Array:
        size = len(p.seq)
        found = [p.scores(t, weight) for t in texts]
        column = lambda i, kind: pa.array(np.concatenate([f[i] for f in found]), kind)
        fields = [
            pa.array(np.tile(p.seq, len(texts))),
            p.ids.take(pa.array(np.tile(np.arange(size), len(texts)))),
            column(2, pa.float64()),
            column(1, pa.float64()),
            pa.array(np.tile(p.quorum, len(texts))),
            column(0, pa.int32()),
        ]
        rows = pa.StructArray.from_arrays(fields, fields=list(CANDIDATE_FIELDS))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), rows)

    @F.arrow_udf(CANDIDATES)
    def rated(texts: pa.Array) -> pa.Array:
        p = held.value
        step = max(1, CELLS // max(1, len(p.seq)))
        whole = texts.to_pylist()
        parts = [build(whole[i : i + step], p) for i in range(0, len(whole), step)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(CANDIDATE_FIELDS))

    return rated


def decisions(piece: DataFrame, cfg: EngineConfig):
    """Arrow UDF: case-folded text -> struct(best, near) of the piece's templates."""
    held, weight = _held(piece), cfg.supplier_weight
    near = pa.struct([("score", pa.float64()), ("order", pa.int64()), ("template_id", pa.string())])
    best = pa.struct([*near, ("hit_rate", pa.float64()), ("quorum", pa.float64())])

    @F.arrow_udf(f"struct<best:{BEST},near:{NEAR}>")
    def decided(texts: pa.Array) -> pa.Array:
        rows = [held.value.decide(t, weight) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([b for b, _ in rows], best), pa.array([n for _, n in rows], near)], names=["best", "near"]
        )

    return decided


def best_and_near(text: Column, piece: DataFrame, cfg: EngineConfig) -> Column:
    return decisions(piece, cfg)(text)
