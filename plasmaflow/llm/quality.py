"""Document quality by regularised quadratic discriminant analysis.

A text becomes a dozen statistics (its length, the shares of kinds of characters, word lengths, repeated words and word shingles), as
logarithms and log odds of counts, so that they are near normal. Counts are smoothed by PRIOR_WEIGHT characters or words of
usual prose: a short text, whose shares say little, is near its middle. Each class has a mean and a covariance from sums
over all labelled rows; covariances shrink towards a multiple of the identity, in units of the pooled deviations, by the
oracle-approximating share of their size and spread, and by `least_shrink` at least. The Cholesky factors are computed once; a
score is the logistic of the log prior odds and the difference of the two log densities (Mahalanobis distances and log determinants).

Defined cases: null and empty texts have statistics of zero counts and so a score; without labelled rows every score is 0.5, with
those of one class only it is the smoothed share of label 1; labels that are null or neither 0 nor 1 are not learned from; a doc_id
whose labels repeat counts once for each; a null doc_id has no label. Rows that repeat a doc_id are scored one by one. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm.common import SEPARATOR, Scratch, mix64, row_slices, shingle_hashes, utf8, word_hashes
from plasmaflow.llm.langid import held_out

#: Shares in prose: capitals, digits, marks, symbols, spaces and line ends of bytes; distinct and repeated words of words; distinct shingles.
PROSE = {"upper": 0.02, "digits": 0.002, "marks": 0.025, "symbols": 0.002, "spaces": 0.15, "lines": 0.003, "distinct_words": 0.8, "repeated_words": 0.01, "distinct_shingles": 0.95}
PRIOR_WEIGHT = 60
STATISTICS = ["length", "word_length", *PROSE]
_UPPER, _DIGIT, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK[list(b".,;:!?'\"()-")] = True
_SYMBOL[33:127] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), *np.flatnonzero(_MARK)]] = False
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _in_rows(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(hashes: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(per_row), dtype=np.uint64), per_row)
    keys = mix64(hashes + rows * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    first = np.append(True, np.diff(keys[order].view(np.int64)) != 0) if len(keys) else np.zeros(0, bool)
    return np.bincount(rows[order[first]].astype(np.int64), minlength=len(per_row))


def _odds(name: str, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + PRIOR_WEIGHT * PROSE[name]) / (whole - part + PRIOR_WEIGHT * (1 - PROSE[name])))


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text data[at[i]:at[i+1]]."""
    size = np.diff(at)
    words, per_row = word_hashes(data, at)
    shingles, n_shingles = shingle_hashes(words, per_row, 3)
    ends = np.cumsum(per_row)
    same = np.append(False, words[1:] == words[:-1]) if len(words) else np.zeros(0, bool)
    same[(ends - per_row)[per_row > 0]] = False
    spaces = _in_rows(SEPARATOR[data], at)
    kinds = {"upper": _UPPER, "digits": _DIGIT, "marks": _MARK, "symbols": _SYMBOL, "lines": _LINE}
    parts = {name: (_in_rows(kind[data], at), size) for name, kind in kinds.items()}
    parts |= {"spaces": (spaces, size), "distinct_words": (_distinct(words, per_row), per_row), "repeated_words": (_in_rows(same, np.append(0, ends)), per_row), "distinct_shingles": (_distinct(shingles, n_shingles), n_shingles)}
    columns = [np.log(size + 20), np.log((size - spaces + 12) / (per_row + 2)), *(_odds(name, *parts[name]) for name in PROSE)]
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x (the values of STATISTICS) of every row of docs(doc_id, text), from the whole text."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            parts = [statistics(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in row_slices(at)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parts).reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and constants; `odds` is the log of the prior odds. Without means only the odds count."""

    odds: float
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.odds)
        for sign, mean, factor, constant in zip((-1, 1), self.means, self.factors, self.constants, strict=False):
            logit += sign * (constant - 0.5 * np.square((x - mean) @ factor.T).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By label the number, sum and sum of outer products of x, over rows(label, x)."""
    d = len(STATISTICS)

    def run(batches):
        for batch in batches:
            labels, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for label in np.unique(labels):
                own = np.column_stack([np.ones(int((labels == label).sum())), x[labels == label]])
                yield pa.RecordBatch.from_arrays([pa.array([int(label)], pa.int32()), pa.array([(own.T @ own).reshape(-1)], pa.list_(pa.float64()))], ["label", "sums"])

    sums = rows.select(F.col("label").cast("int"), "x").mapInArrow(run, "label int, sums array<double>")
    out: dict[int, np.ndarray] = {}
    for r in sums.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("total")).collect():
        out.setdefault(r["label"], np.zeros((d + 1) * (d + 1)))[r["pos"]] = r["total"]
    tables = {label: flat.reshape(d + 1, d + 1) for label, flat in out.items()}
    return {label: (t[0, 0], t[0, 1:], t[1:, 1:]) for label, t in tables.items()}


def shrunk(covariance: np.ndarray, n: float, least: float) -> np.ndarray:
    """The covariance of n rows, moved towards its mean variance by the oracle-approximating share or `least`, the larger."""
    d = len(covariance)
    trace, square = np.trace(covariance), float((covariance**2).sum())
    spread = square - trace**2 / d
    share = 1.0 if spread <= 0 else min(1.0, ((1 - 2 / d) * square + trace**2) / ((n + 1 - 2 / d) * spread))
    share = max(share, least)
    return (1 - share) * covariance + share * max(trace / d, 1e-9) * np.eye(d)


def fit(rows: DataFrame, least_shrink: float = 0.1) -> Discriminant:
    """Learn from rows(label, x); label 1 is the better class."""
    found = moments(rows)
    n = [found[label][0] if label in found else 0 for label in (0, 1)]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        return Discriminant(odds, [], [], [])
    means = [found[label][1] / found[label][0] for label in (0, 1)]
    covariances = [found[label][2] / found[label][0] - np.outer(m, m) for label, m in zip((0, 1), means, strict=True)]
    pooled = sum(count * c for count, c in zip(n, covariances, strict=True)) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, constants = [], []
    for count, covariance in zip(n, covariances, strict=True):
        lower = np.linalg.cholesky(shrunk(covariance / np.outer(scale, scale), count, least_shrink))
        factors.append(np.linalg.inv(lower) / scale)
        constants.append(-float(np.log(np.diag(lower)).sum()))
    return Discriminant(odds, means, factors, constants)


def rate(docs: DataFrame, labels: DataFrame, least: float = 0.7, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of `least` on) of every row of docs(doc_id, text), learned from
    labels(doc_id, quality) of the rows that are not held out."""
    seen = Scratch(docs.sparkSession, "quality").cut(with_statistics(docs), "statistics")
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~held_out())
    model = fit(seen.join(known, "doc_id"), **fitting)

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= least).astype(np.int32))], ["doc_id", "score", "predicted"])

    return seen.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")
