"""Exact top-k search by integer inner product with MaxScore.

A term is a dimension with a sign: its posting list holds the rows with such a component, by falling impact. Opposite signs
only lower a score, so a query's upper bound for a term is its weight times the list's largest impact. Terms in order of
their bounds split into essential and non-essential ones: rows found in no essential list cannot reach the current k-th
score. Essential postings are traversed; the other terms are probed, largest bound first, only for rows whose partial
score plus the bounds left is still competitive. Shards' lists are merged by score, ties to the smaller id.

Defined cases: null vectors and vectors with null or non-finite components take no part; an empty vector scores 0 with
every row; components are floored as doubles and scores are 64-bit sums, so they are exact below 2 ** 53 and 2 ** 63; shorter vectors count as ending in zeros; fewer than k candidates are all returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm import shards

BLOCK = 8  # terms that are probed together


class MaxScore:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        whole = np.abs(vectors).max(initial=0) ** 2 * vectors.shape[1] < 2**52  # then sums of products are exact as doubles
        self.columns = np.ascontiguousarray(vectors.astype(np.float64 if whole else np.int64).T)
        rows = self.columns.shape[1]
        self.postings = []
        for x in self.columns:
            up, down = np.flatnonzero(x > 0), np.flatnonzero(x < 0)
            self.postings.append((up[np.argsort(-x[up], kind="stable")], down[np.argsort(x[down], kind="stable")]))
        self.peaks = np.array([[x.max(initial=0), max(-x.min(initial=0), 0)] for x in self.columns]).reshape(-1, 2)
        self.rows = rows

    def find(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self._one(own, q.astype(self.columns.dtype), k) for own, q in zip(ids, vectors, strict=True)]

    def _one(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        side = (q < 0).astype(np.int64)
        bounds = np.abs(q) * self.peaks[np.arange(len(q)), side]
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[q[terms] != 0]
        # bounds of what comes after each term: only gains count, as losses are at most 0
        after = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)
        floor = self._floor(own, q, terms, side, k)
        essential = int(np.searchsorted(-after, -floor, "right")) if floor is not None else len(terms)
        if floor is None or floor <= 0:  # rows without any gaining term may belong to the answer
            rows = np.flatnonzero(self.ids != own)
        else:
            found = np.zeros(self.rows, bool)
            for t in terms[:essential]:
                found[self.postings[t][side[t]]] = True
            found &= self.ids != own
            rows = np.flatnonzero(found)
        score = np.zeros(len(rows), self.columns.dtype)
        for place in range(0, len(terms), BLOCK):
            block = terms[place : place + BLOCK]
            values = self.columns[block] if len(rows) == self.rows else self.columns[block[:, None], rows]
            score += q[block] @ values
            if floor is not None:
                alive = score + after[min(place + BLOCK, len(terms))] >= floor
                rows, score = rows[alive], score[alive]
                if len(rows) > k and place % (4 * BLOCK) == 0:
                    reached = self._reached(rows, q, score, k)
                    floor = floor if reached is None else max(floor, reached)  # None: too few different ids among the k rows
        return shards.top(self.ids[rows], score.astype(np.int64), k)

    def _floor(self, own: int, q: np.ndarray, terms: np.ndarray, side: np.ndarray, k: int) -> float | None:
        """The k-th best score among the heads of the strongest posting lists: a lower bound of the final k-th score."""
        heads = [self.postings[t][side[t]][: 8 * k] for t in terms[:16]]
        rows = np.unique(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
        return self._kth(rows[self.ids[rows] != own], q, k)

    def _reached(self, rows: np.ndarray, q: np.ndarray, score: np.ndarray, k: int) -> float:
        return self._kth(rows[np.argpartition(-score, k - 1)[:k]], q, k)

    def _kth(self, rows: np.ndarray, q: np.ndarray, k: int) -> float | None:
        best: dict[int, float] = {}
        for i, s in zip(self.ids[rows].tolist(), (q @ self.columns[:, rows]).tolist(), strict=True):
            best[i] = max(s, best.get(i, s))  # a repeated id counts once
        return sorted(best.values())[-k] if len(best) >= k else None


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k highest inner products of floor(scale * x)."""
    rows = shards.usable(vectors).withColumn("vector", F.transform("vector", lambda v: F.floor(v * scale).cast("double")))
    return shards.search(rows, every, k, "long", lambda ids, x: MaxScore(ids, x).find)
