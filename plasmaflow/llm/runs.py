"""Periodic runs of words: stretches that repeat a period at least `times` times over at least `least` words.

Words are appended one by one to a suffix automaton whose suffix links form a link-cut tree. Each preferred path of the
tree holds the states with one last occurrence; appending a word accesses the path of the new prefix and so meets its
segments, each with a previous end and a longest length. Where the distance from the previous to the new end is within
that length, the text ends in a square of this distance; the length gives its first word, and comparing words forward gives
its last one. As the previous end is the last one, the distance is the smallest period.

The automaton reads only stretches that may hold a run. A run of period q repeats each of its short word shingles q words
later, so all its shingles but those of its first period have a previous occurrence at most q before; a stretch of m such
shingles holds runs of a period of at most (m + width - 1) / (times - 1) words. Texts without such a stretch have no run.
Equal words have equal hashes, so hashes may only add stretches; the automaton compares the words themselves.

Every text is one task's work: time is n log n in its words, memory about 200 bytes a word of its largest stretch.

Defined cases: null and empty texts have no words and no run, and collapse to the empty text; rows that repeat a doc_id are
judged one by one; a null doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = "struct<start: bigint, length: bigint, period: bigint>"
#: Text bytes of one result batch, or one text.
BATCH_BYTES = 16 << 20
NEVER = np.int64(1) << 62


def stretches(words: list[bytes], least: int, times: int) -> list[tuple[int, int]]:
    """Disjoint ranges [low, high) of words outside of which no run has a word."""
    width = max((least - least // times) // 2, 1)
    shortest = least - least // times - width + 1
    if len(words) < max(least, width):
        return []
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    last = len(words) - width + 1
    shingles = np.zeros(last, np.uint64)
    for k in range(width):
        shingles *= np.uint64(0x9E3779B97F4A7C15)
        shingles += each[k : k + last]
    ordered = np.sort(shingles)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(shingles, kind="stable")
    again = np.flatnonzero(shingles[order[1:]] == shingles[order[:-1]])
    back = np.full(last, NEVER)
    back[order[again + 1]] = order[again + 1] - order[again]
    while True:
        alive = np.diff(np.concatenate([[0], (back < NEVER).view(np.int8), [0]]))
        begins, ends = np.flatnonzero(alive > 0), np.flatnonzero(alive < 0)
        sizes = ends - begins
        most = np.where(sizes < shortest, 0, (sizes + width - 1) // (times - 1))
        far = np.zeros(last, np.int64)
        far[begins], far[ends[ends < last]] = most, 0
        inside = np.repeat(most, sizes)
        places = np.flatnonzero(back < NEVER)
        gone = places[back[places] > inside]
        if not len(gone):
            break
        back[gone] = NEVER
    out: list[tuple[int, int]] = []
    for low, high, q in zip((begins - most).tolist(), (ends + width - 1).tolist(), most.tolist(), strict=True):
        low = max(low, 0)
        if out and low <= out[-1][1]:
            out[-1] = (min(low, out[-1][0]), high)
            while len(out) > 1 and out[-1][0] <= out[-2][1]:
                top = out.pop()
                out[-1] = (min(top[0], out[-1][0]), top[1])
        else:
            out.append((low, high))
    return out


class LinkedAutomaton:
    """Suffix automaton of a growing word sequence; its suffix links are a link-cut tree whose preferred paths have one last end.

    State 1 is the root, 0 is none. A path's last end (1-based) is kept at the root of its splay tree. Most states have one
    transition, kept in two arrays; further ones are in dictionaries."""

    def __init__(self):
        self.size, self.link, self.symbol, self.target, self.more = [0, 0], [0, 0], [-1, -1], [0, 0], {}
        self.up, self.left, self.right, self.end = [0, 0], [0, 0], [0, 0], [0, 0]
        self.last, self.n = 1, 0

    def _state(self, size: int) -> int:
        for column, value in ((self.size, size), (self.link, 0), (self.symbol, -1), (self.target, 0), (self.up, 0), (self.left, 0), (self.right, 0), (self.end, 0)):
            column.append(value)
        return len(self.size) - 1

    def _next(self, state: int, word: int) -> int:
        if self.symbol[state] == word:
            return self.target[state]
        return self.more[state].get(word, 0) if state in self.more else 0

    def _connect(self, state: int, word: int, to: int) -> None:
        if self.symbol[state] in (-1, word):
            self.symbol[state], self.target[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def append(self, word: int) -> list[tuple[int, int]]:
        """Add a word; (distance to the previous end, longest length) of each segment of the new prefix's path, longest first."""
        self.n += 1
        size, link, symbol, more = self.size, self.link, self.symbol, self.more
        new, p = self._state(self.n), self.last
        while p and symbol[p] != word and not (p in more and word in more[p]):
            self._connect(p, word, new)
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = self._next(p, word)
            link[new] = q if size[p] + 1 == size[q] else self._split(p, word, q)
        self.up[new] = link[new]
        self.last = new
        return self._access(new)

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for its strings of up to size[p] + 1 words, right above q on q's path: both had the same ends so far."""
        copy = self._state(self.size[p] + 1)
        self.symbol[copy], self.target[copy], self.link[copy] = self.symbol[q], self.target[q], self.link[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p and self._next(p, word) == q:
            self._connect(p, word, copy)
            p = self.link[p]
        self.link[q] = copy
        self._splay(q)
        above = self.left[copy] = self.left[q]
        if above:
            self.up[above] = copy
        self.left[q], self.up[copy] = copy, q
        return copy

    def _access(self, x: int) -> list[tuple[int, int]]:
        """Make the path from the root to x one path that ends here; what its segments were before."""
        up, right, end, size, now = self.up, self.right, self.end, self.size, self.n
        met, below = [], 0
        while x:
            self._splay(x)
            before = end[x]
            if before:
                met.append((now - before, size[x]))
            if right[x]:
                end[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        end[below] = now
        return met

    def _rotate(self, x: int, y: int, z: int) -> None:
        """x over its parent y, whose parent (or path parent) is z."""
        up, left, right = self.up, self.left, self.right
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner:
            up[inner] = y
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        up[y], up[x] = x, z

    def _splay(self, x: int) -> None:
        up, left, right, end = self.up, self.left, self.right, self.end
        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if not z or (left[z] != y and right[z] != y):
                end[x] = end[y]
                self._rotate(x, y, z)
                return
            end[x] = end[z]  # the last of these is the root's
            w = up[z]
            if (left[z] == y) == (left[y] == x):
                self._rotate(y, z, w)
                self._rotate(x, y, w)
            else:
                self._rotate(x, y, z)
                self._rotate(x, z, w)


def runs_of(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in words, by start, then period."""
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    automaton, ended, found, n = LinkedAutomaton(), {}, [], len(ids)
    for i, word in enumerate(ids):
        for period, longest in automaton.append(word):
            if longest < (times - 1) * period or ended.get(period, -1) >= i:
                continue
            stop = i + 1
            while stop < n and ids[stop] == ids[stop - period]:
                stop += 1
            ended[period] = stop - 1
            start = i + 1 - longest - period
            if stop - start >= least:
                found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def judge(words: list[bytes], least: int = 24, times: int = 3) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """The runs of words, and the words without what repeats a run's first period."""
    runs = [(low + start, length, period) for low, high in stretches(words, least, times) for start, length, period in runs_of(words[low:high], least, times)]
    if not runs:
        return [], words
    kept, at = [], 0
    for low, high in sorted((start + period, start + length) for start, length, period in runs):
        if low > at:
            kept += words[at:low]
        at = max(at, high)
    return runs, kept + words[at:]


def find_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the words that repeat no run's first
    period, joined by a space) of every row of docs(doc_id, text). A run has at least `least` words and `times` periods."""
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            counts, runs, kept, size, first = [], [], [], 0, 0
            for i in range(len(texts)):
                words = (texts[i].as_py() or b"").split()
                own, rest = judge(words, least, times)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                kept.append(b" ".join(rest))
                size += len(kept[-1])
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([ids[first : i + 1], pa.array(counts, pa.int64()), pa.array(runs, pa.list_(kind)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                    counts, runs, kept, size, first = [], [], [], 0, i + 1

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period, ties to the smallest start, then period; null if there is none."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which a tenth of the texts, drawn by the crc32 of their ids, repeat a period from some word on."""
    word = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    drawn = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    split = drawn.withColumn("words", F.when(F.col("h") % 10 == 0, word)).withColumn("n", F.size("words"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")).cast("int")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.transform(F.sequence(F.lit(0), F.expr("n - a - 1")), lambda i: F.get("words", F.col("a") + i % F.col("p")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row a document of find_runs: the number of runs, the best run, and hashes of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", best_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
