"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives a vector a long string of hyperplane signs. A shard keeps, for each tree, the strings of its rows in a
sorted array. A query descends every tree to its longest matching prefix, by binary search; then all trees ascend
together, one sign at a time, until the rows that share the current prefix in some tree are `budget` together. These
candidates are scored exactly, in double precision.

The budget is a share of the shard, with a least number: for directions without structure the prefix order carries little
information, and a fixed share holds recall at every size, while clustered data reach it long before. Nearness is the
inner product; a coordinate that completes every vector to the shard's largest norm makes it agree with the angle.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; shorter vectors
count as ending in zeros; fewer than k candidates are all returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm import shards

SIGNS = 24


class PrefixForest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, share: float, least: int, seed: int):
        self.ids, self.vectors = ids, vectors
        self.repeats = int(np.unique(ids, return_counts=True)[1].max(initial=1))  # rows of the commonest id
        self.budget = max(int(share * len(ids)), least)
        self.scale = max(float(np.abs(vectors).max(initial=0)), 1e-300)  # squares of huge components would overflow
        vectors = vectors / self.scale
        norms = np.einsum("ij,ij->i", vectors, vectors)
        rest = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
        self.small = vectors.astype(np.float32)
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * SIGNS)).astype(np.float32)
        strings = self._strings(np.column_stack([vectors, rest]))
        order = np.argsort(strings, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.strings = np.ascontiguousarray(np.take_along_axis(strings, order, axis=0).T)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "small"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.small = (self.vectors / self.scale).astype(np.float32)

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors.astype(np.float32) @ self.planes > 0).reshape(len(vectors), -1, SIGNS)
        return (signs * (1 << np.arange(SIGNS - 1, -1, -1))).sum(axis=2)

    def find(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        scaled = vectors / self.scale
        strings = self._strings(np.column_stack([scaled, np.zeros(len(vectors))]))
        level = np.zeros(len(ids), np.int64)
        low, high = np.zeros((len(ids), len(self.order)), np.int64), np.full((len(ids), len(self.order)), len(self.ids))
        rising = np.arange(len(ids))
        for prefix in range(SIGNS, -1, -1):  # all trees ascend one sign at a time; a query stops once its ranges fill the budget
            span = 1 << (SIGNS - prefix)
            base = strings[rising] & ~(span - 1)
            for tree, sorted_strings in enumerate(self.strings):
                low[rising, tree] = np.searchsorted(sorted_strings, base[:, tree], "left")
                high[rising, tree] = np.searchsorted(sorted_strings, base[:, tree] + span, "left")
            level[rising] = prefix
            # union of the trees' ranges under independence, as rows that several trees share count once
            share = (high[rising] - low[rising]) / len(self.ids)
            rising = rising[(1 - np.exp(np.log1p(-np.minimum(share, 1 - 1e-12)).sum(axis=1))) * len(self.ids) < self.budget]
            if not len(rising):
                break
        out = []
        seen = np.zeros(len(self.ids), bool)
        for i, own in enumerate(ids):
            seen[:] = False
            for tree in range(len(self.order)):
                seen[self.order[tree, low[i, tree] : high[i, tree]]] = True
            near = np.flatnonzero(seen & (self.ids != own))
            most = 2 * k * self.repeats
            if len(near) > 4 * most:
                rough = self.small[near] @ scaled[i].astype(np.float32)
                limit = np.partition(rough, len(rough) - most)[len(rough) - most]
                near = near[rough >= limit - 1e-4 * max(1.0, abs(float(limit)))]
            out.append(shards.top(self.ids[near], self.vectors[near] @ vectors[i], k))
        return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 64, share: float = 0.65, least: int = 32, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k largest inner products found."""
    rows = shards.usable(vectors).where(F.exists("vector", lambda v: v != 0))
    return shards.search(rows, every, k, "double", lambda ids, x: PrefixForest(ids, x, trees, share, least, seed).find)
