"""Minimal perfect hashes of string sets, in shards, with the keys stored for verification.

A shard of n keys has n slots. Keys fall into buckets of about four; buckets, largest first, try seeds until
all their keys land on free slots. A look-up hashes the key, reads its bucket's seed, and compares the key
stored at the slot, so a foreign key is never taken for a member. Everything works on whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

SHARD_KEYS = 2048
BUCKET_KEYS = 4
_TRIES = 256
# The mixing constants of splitmix64.
_STEP, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def hashes(terms: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each term: the first places it, the second is displaced."""
    words = terms.to_numpy(zero_copy_only=False).astype(object)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(pd.util.hash_array(words, hash_key=key, categorize=False) for key in ("places keys 0001", "moves slots 0002"))


def shard_of(first: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    return ((first >> np.uint64(32)) % np.asarray(shards, dtype=np.uint64)).astype(np.int64)


def _bucket(first: np.ndarray, buckets: np.ndarray | int) -> np.ndarray:
    return ((first & np.uint64(0xFFFFFFFF)) % np.asarray(buckets, dtype=np.uint64)).astype(np.int64)


def _slot(second: np.ndarray, seed: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    x = second + (seed.astype(np.uint64) + np.uint64(1)) * _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return ((x ^ (x >> np.uint64(31))) % np.asarray(size, dtype=np.uint64)).astype(np.int64)


def bucket_count(keys: int) -> int:
    return -(-keys // BUCKET_KEYS)


def build(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each key) of one shard's distinct keys."""
    n = len(first)
    seeds, slots = np.zeros(bucket_count(n), dtype=np.int64), np.full(n, -1)
    if len(np.unique(np.stack((first, second)), axis=1).T) < n:
        raise ValueError("two keys share both 64-bit hashes")
    bucket = _bucket(first, len(seeds)) if n else np.zeros(0, dtype=np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(len(seeds) + 1))
    free = np.ones(n, dtype=bool)
    for b in np.argsort(-np.diff(at), kind="stable").tolist():
        own = order[at[b] : at[b + 1]]
        if not len(own):
            break
        tried = 0
        while True:
            seed = np.arange(tried, tried + _TRIES)
            place = _slot(second[own][:, None], seed[None, :], n)
            good = free[place].all(axis=0)
            if len(own) > 1:
                ranked = np.sort(place, axis=0)
                good &= (ranked[1:] != ranked[:-1]).all(axis=0)
            if good.any():
                hit = int(np.argmax(good))
                seeds[b], slots[own] = seed[hit], place[:, hit]
                free[place[:, hit]] = False
                break
            tried += _TRIES
    return seeds, slots


@dataclass
class Shards:
    """Some shards of several key spaces (one per language), side by side.

    ``local[space][shard]`` is a shard's place here, -1 for one that is elsewhere; a space's slots are contiguous.
    """

    local: dict[str, np.ndarray]
    span: dict[str, tuple[int, int]]
    sizes: np.ndarray
    slot_base: np.ndarray
    seed_base: np.ndarray
    seeds: np.ndarray
    keys: pa.StringArray
    shard: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Shards:
        """From rows (space, shards, shard, seeds, keys): ``shards`` is the number the whole space has."""
        rows = sorted(rows, key=lambda r: (r["space"], r["shard"]))
        local: dict[str, np.ndarray] = {}
        sizes = np.array([len(r["keys"]) for r in rows], dtype=np.int64)
        slot_base = np.concatenate(([0], np.cumsum(sizes)))
        span: dict[str, tuple[int, int]] = {}
        for i, r in enumerate(rows):
            local.setdefault(r["space"], np.full(r["shards"], -1))[r["shard"]] = i
            span[r["space"]] = (span.get(r["space"], (int(slot_base[i]),))[0], int(slot_base[i + 1]))
        counts = [len(r["seeds"]) for r in rows]
        flat = lambda name, kind: pa.array([x for r in rows for x in r[name]], kind)
        return cls(
            local,
            span,
            sizes,
            slot_base,
            np.concatenate(([0], np.cumsum(np.array(counts, dtype=np.int64)))),
            flat("seeds", pa.int64()).to_numpy(),
            flat("keys", pa.string()),
            np.repeat(np.array([r["shard"] for r in rows], dtype=np.int64), sizes),
        )

    def find(self, space: str, terms: pa.StringArray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each term of ``space``, -1 where it is no stored key."""
        out = np.full(len(terms), -1)
        if space not in self.local or not len(terms):
            return out
        places = self.local[space]
        at = places[shard_of(first, len(places))]
        here = np.flatnonzero(at >= 0)
        at = at[here]
        buckets = -(-self.sizes[at] // BUCKET_KEYS)
        seed = self.seeds[self.seed_base[at] + _bucket(first[here], buckets)]
        slot = self.slot_base[at] + _slot(second[here], seed, self.sizes[at])
        same = pa.compute.equal(self.keys.take(pa.array(slot)), terms.take(pa.array(here)))
        same = np.asarray(same.to_numpy(zero_copy_only=False), dtype=bool)
        out[here[same]] = slot[same]
        return out
