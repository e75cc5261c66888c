"""Language ID by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to `order` bytes with the counts of the bytes that followed. A byte costs
log2 of its share in the longest context that has seen it, plus an escape for each longer context that has not (method C,
with exclusion of the bytes that the longer context would have coded). The statistics are frozen before scoring, so a
text's code length under a language is exact and does not depend on what else was scored.

As the statistics are frozen, the cost of every byte sequence that any language knows is resolved once into a table with
one column a language; scoring a text is then a table lookup a byte, with escapes only for unknown sequences.

Fitting: at most about `rows_per_language` labelled rows a language (a seeded hash threshold keeps the expected number at
the bound); `least` over 1 drops rarer sequences of over three bytes, which changes code lengths and is off by default. Every text is scored whole, in bounded slices.

Defined cases: null, empty or letterless texts give `und` with score 0; with no labelled rows every text is `und`; ties go
to the smaller language code; a null doc_id is never held out and never learned from. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm.common import SLICE_BYTES, row_slices, utf8

PAD = 10  # texts begin as if after line ends


def _padded(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with `order` line ends before each, and the places of the rows' own bytes."""
    rows = len(at) - 1
    own = np.ones(len(data) + rows * order, bool)
    heads = (at[:-1] + order * np.arange(rows))[:, None] + np.arange(order)
    own[heads.reshape(-1)] = False
    out = np.full(len(own), PAD, np.uint8)
    out[own] = data
    return out, np.flatnonzero(own)


def _grams(padded: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes that end at each place, as numbers."""
    key = np.zeros(len(places), np.uint64)
    for back in range(length - 1, -1, -1):
        key <<= np.uint64(8)
        key |= padded[places - back]
    return key


def count_grams(docs: DataFrame, order: int, least: int = 1) -> DataFrame:
    """lang, length, gram, count over docs(lang, text), for all sequences of 1 to order + 1 bytes."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                data, at = utf8(batch.column(1).filter(pa.array(langs == lang)))
                for i, j in row_slices(at):
                    padded, places = _padded(data[at[i] : at[j]], at[i : j + 1] - at[i], order)
                    grams = _grams(padded, places, order + 1)
                    counts = None
                    for length in range(order + 1, 0, -1):
                        if length <= order:
                            grams = grams & np.uint64((1 << (8 * length)) - 1)
                        grams, back = np.unique(grams, return_inverse=True)
                        counts = np.bincount(back, weights=counts).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(grams)), pa.array(np.full(len(grams), length, np.int32)), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "length", "gram", "n"]
                        )

    found = docs.select("lang", "text").mapInArrow(run, "lang string, length int, gram long, n long")
    return found.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).where(F.expr(f"length <= 3 or n >= {least}"))


class HashIndex:
    """Open-addressing lookup from 64-bit keys to their row numbers, over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(4 * len(keys) + 1)))))
        size = 1 << int(np.uint64(64) - self.shift)
        self.mask = size - 1
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo = np.arange(len(keys))
        slots = self._slot(keys)
        while len(todo):
            free = self.rows[slots] < 0
            self.rows[slots[free]] = todo[free]  # of several for one slot the last one stays
            won = free & (self.rows[slots] == todo)
            self.keys[slots[won]] = keys[todo[won]]
            todo, slots = todo[~won], (slots[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where unknown."""
        slots = self._slot(keys)
        out = self.rows[slots]
        odd = np.flatnonzero((self.keys[slots] != keys) & (out >= 0))
        while len(odd):
            slots[odd] = (slots[odd] + 1) & self.mask
            out[odd] = self.rows[slots[odd]]
            odd = odd[(self.keys[slots[odd]] != keys[odd]) & (out[odd] >= 0)]
        return out


class PPM:
    """Resolved code lengths: for each sequence length a key list with one cost column a language."""

    def __init__(self, order: int, langs: list[str], counted: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]):
        """counted: by language and length, sorted sequences and their counts."""
        self.order, self.langs = order, langs
        self.grams: list[np.ndarray] = [np.arange(256, dtype=np.uint64)]
        self.costs: list[np.ndarray] = [np.zeros((256, len(langs)), np.float32)]
        self.contexts: list[np.ndarray] = [np.zeros(1, np.uint64)]
        self.escapes: list[np.ndarray] = [np.zeros((1, len(langs)), np.float32)]
        for length in range(1, order + 2):
            below = np.uint64((1 << (8 * (length - 1))) - 1)
            own = {k: counted[k].get(length, (np.zeros(0, np.uint64), np.zeros(0, np.int64))) for k in langs}
            grams = self.grams[0] if length == 1 else np.unique(np.concatenate([g for g, _ in own.values()] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(grams >> np.uint64(8))
            costs = np.full((len(grams), len(langs)), 8.0) if length == 1 else self.costs[-1][np.searchsorted(self.grams[-1], grams & below)].astype(float)
            escapes = np.zeros((len(contexts), len(langs)))
            for column, lang in enumerate(langs):
                g, n = own[lang]
                if not len(g):
                    continue
                heads, first = np.unique(g >> np.uint64(8), return_index=True)
                total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(g)))
                each = np.repeat(np.arange(len(heads)), kinds)
                escape = np.log2(total + kinds) - np.log2(kinds)
                if length == 1:
                    free = 256 - kinds[0]
                    escape = escape + (np.log2(free) if free else 0.0)
                    costs[:, column] = 0.0
                else:
                    lower_g, lower_n = counted[lang][length - 1]
                    taken = np.add.reduceat(lower_n[np.searchsorted(lower_g, g & below)], first)
                    suffix = heads & np.uint64((1 << (8 * (length - 2))) - 1)
                    sums = self._sums(counted[lang][length - 1], suffix)
                    escape = escape + np.log2(np.maximum(sums - taken, 0.5)) - np.log2(sums)
                place = np.searchsorted(contexts, heads)
                escapes[place, column] = escape
                costs[:, column] += escapes[np.searchsorted(contexts, grams >> np.uint64(8)), column]
                costs[np.searchsorted(grams, g), column] = np.log2(total + kinds)[each] - np.log2(n)
            if length == 1:
                self.costs[0] = costs.astype(np.float32)
            else:
                self.grams.append(grams)
                self.costs.append(costs.astype(np.float32))
                self.contexts.append(contexts)
                self.escapes.append(escapes.astype(np.float32))

    @staticmethod
    def _sums(level: tuple[np.ndarray, np.ndarray], suffix: np.ndarray) -> np.ndarray:
        """Total plus kinds of the contexts `suffix` in a level."""
        g, n = level
        heads, first = np.unique(g >> np.uint64(8), return_index=True)
        both = np.add.reduceat(n, first) + np.diff(np.append(first, len(g)))
        return both[np.searchsorted(heads, suffix)]

    def prepare(self) -> "PPM":
        self.by_gram = [None, *(HashIndex(g) for g in self.grams[1:])]
        self.by_context = [None, *(HashIndex(c) for c in self.contexts[1:])]
        return self

    def bits(self, padded: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Code length of each place's byte, a column a language."""
        out = np.zeros((len(places), len(self.langs)), np.float32)
        todo = slice(None)
        keys = _grams(padded, places, self.order + 1)
        for level in range(self.order, 0, -1):
            rows = self.by_gram[level].find(keys)
            known = rows >= 0
            lost = np.flatnonzero(~known)
            if isinstance(todo, slice):
                out[known] = self.costs[level][rows[known]]
                todo = lost
            else:
                out[todo[known]] += self.costs[level][rows[known]]
                todo = todo[lost]
            if not len(todo):
                return out
            rows = self.by_context[level].find(keys[lost] >> np.uint64(8))
            seen = rows >= 0
            out[todo[seen]] += self.escapes[level][rows[seen]]
            keys = keys[lost] & np.uint64((1 << (8 * level)) - 1)
        out[todo] += self.costs[0][keys.astype(np.int64)]
        return out

    def text_bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each row, a column a language; long rows go in pieces that carry their context."""
        total = np.zeros((len(at) - 1, len(self.langs)))
        for i, j in row_slices(at, SLICE_BYTES // 4):
            padded, places = _padded(data[at[i] : at[j]], at[i : j + 1] - at[i], self.order)
            for begin in range(0, len(places), SLICE_BYTES // 4):
                some = places[begin : begin + SLICE_BYTES // 4]
                bits = self.bits(padded, some)
                if j == i + 1:
                    total[i] += bits.sum(axis=0, dtype=np.float64)
                else:
                    filled = np.flatnonzero(at[i:j] < at[i + 1 : j + 1])
                    if len(filled):
                        total[i + filled] = np.add.reduceat(bits, at[i + filled] - at[i], axis=0, dtype=np.float64)
        return total


def fit(docs: DataFrame, order: int = 4, rows_per_language: int = 1000, least: int = 1, seed: int = 7) -> PPM:
    """Learn from docs(doc_id, text, lang); the model's size is bounded by the sample."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return PPM(order, [], {})
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, rows_per_language / n)])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    langs = sorted(sizes)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    table = count_grams(labelled.where(drawn < F.element_at(share, F.col("lang"))), order, least)
    # columns of numbers through Arrow: rows of Python objects would take the driver ten times as much
    table = table.select((F.element_at(number, F.col("lang")) * (order + 2) + F.col("length")).alias("level"), "gram", "n").toArrow()
    levels, grams, counts = (table.column(c).to_numpy() for c in ("level", "gram", "n"))
    counted: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for level in np.unique(levels):
        part = np.flatnonzero(levels == level)
        part = part[np.argsort(grams[part])]
        counted.setdefault(langs[level // (order + 2)], {})[int(level % (order + 2))] = (grams[part].astype(np.int64).view(np.uint64), counts[part].astype(np.int64))
    return PPM(order, sorted(counted), counted)


def predict(docs: DataFrame, model: PPM, keep: list[str] | None = None) -> DataFrame:
    """doc_id, has_letters, lang_pred, score (the winner's posterior at equal priors, six decimals), bits_per_byte of every row
    of docs(doc_id, text), and its columns `keep`."""
    others = list(keep or [])

    def run(batches):
        ready = model.prepare() if model.langs else None
        for batch in batches:
            data, at = utf8(batch.column(1))
            n = len(at) - 1
            letters = np.array(batch.column(2).to_pylist(), bool)
            names, score, rate = ["und"] * n, np.zeros(n), np.zeros(n)
            if ready is not None and n:
                bits = ready.text_bits(data, at)
                best = bits.argmin(axis=1)
                least = bits[np.arange(n), best]
                score = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0).round(6)
                rate = (least / np.maximum(np.diff(at), 1)).round(6)
                names = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            found = [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(found + batch.columns[3:], ["doc_id", "has_letters", "lang_pred", "score", "bits_per_byte", *others])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letters")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), letters, *(F.col(c).alias(f"{c}__") for c in others))
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return source.mapInArrow(run, f"doc_id long, has_letters boolean, lang_pred string, score double, bits_per_byte double{kinds}")


def held_out() -> F.Column:
    """Whether a row's label is kept from learning: crc32 of its doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """Fit on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score, bits_per_byte."""
    model = fit(docs.where(~held_out()), **fitting)
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
