"""Phrase collocations by level-wise counting with broadcast double-array tries.

Words that occur often enough get numbers, the commonest first, and the texts are stored once as arrays of these numbers, with 0 for
rare words and where pieces end. For phrases of k words a trie of candidates is broadcast: numpy advances the states of all
positions together, one digit of one word after another, and bincounts the accepting states; the counts of all tasks are summed.
The same walk yields the candidates of k + 1 words: places where a candidate starts and the next one starts a word later (a
phrase is never more frequent than its parts), with the word that follows; a task sums them into sorted arrays, which
meet in blocks by a hash of their keys, and those below the least frequency go before they are named.

What is broadcast has a checked size: beyond MOST_WORDS numbered words or MOST_CANDIDATES candidates of a level, several tables
or tries are made and used one after another, each within the bound. No task holds more than one of them, FLUSH keys and one block.

Defined cases: null and empty texts have no words; a null lang counts as `und`; doc_id is not read, so rows that repeat count each
time; extra columns are ignored; an empty table or one without a frequent phrase gives no row.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.llm.common import Scratch, mix64, row_slices, utf8

#: A-Z to lower case, piece ends to line ends, tabs to spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Numbered words that a worker's table holds, and candidates that a trie holds.
MOST_WORDS = 500_000
MOST_CANDIDATES = 500_000
#: Keys that a task gathers before it sums and passes them on.
FLUSH = 2_000_000
#: Words of the corpus for each block in which keys meet.
BLOCK_WORDS = 1 << 18
#: A word's number is spelled in digits, so that a trie node has few children close together.
DIGIT = 256
LONGEST = 4
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
NO_LANG = "und"


def tokens(text: bytes) -> list[bytes]:
    """The words of a text and b"\\n" between its pieces; b"" where separators meet."""
    return text.translate(FOLD).replace(b"\n", b" \n ").split(b" ")


def _by_lang(batch: pa.RecordBatch):
    """(lang, text bytes) for slices of a (lang, text) batch; the texts of a slice are parted by line ends."""
    langs = np.array(batch.column(0).to_pylist(), object)
    for lang in dict.fromkeys(langs.tolist()):
        data, at = utf8(batch.column(1).filter(pa.array(langs == lang)))
        for i, j in row_slices(at):
            yield lang, b"\n".join(data[at[k] : at[k + 1]].tobytes() for k in range(i, j))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n over docs(lang, text); the row without a word has the number of all."""

    def table(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs, words, n = [], [], []
        for lang, own in counts.items():
            langs += [lang] * (len(own) + 1)
            words += [*own, None]
            n += [*own.values(), sum(own.values())]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    def run(batches):
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in _by_lang(batch):
                own = counts.setdefault(lang, Counter())
                own.update(tokens(text))
                own.pop(b"", None)
                own.pop(b"\n", None)
                if sum(map(len, counts.values())) > FLUSH // 4:
                    yield table(counts)
                    counts = {}
        yield table(counts)

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class DoubleArray:
    """A trie of number sequences: from state s the digit d leads to base[s] + d if check there is s. State 0 is none."""

    def __init__(self, phrases: np.ndarray, words: int):
        """phrases: a row each, of word numbers from 1 to `words`; after it `accepts` has the state of each row."""
        self.digits = 1
        while DIGIT**self.digits <= words:
            self.digits += 1
        spelled = np.stack([phrases // DIGIT**p % DIGIT for p in range(self.digits - 1, -1, -1)], axis=2).reshape(len(phrases), phrases.shape[1] * self.digits)
        order = np.lexsort(spelled.T[::-1]) if len(phrases) else np.zeros(0, np.int64)
        spelled = spelled[order]
        self.base, self.check = np.zeros(4 * DIGIT, np.int32), np.full(4 * DIGIT, -1, np.int32)
        self.free = np.ones(4 * DIGIT, bool)
        self.free[: DIGIT + 2] = False  # 0 is no state, 1 the root; no base is below 2
        states = np.ones(len(spelled), np.int64)
        for column in range(spelled.shape[1]):
            states = self._level(states, spelled[:, column].astype(np.int64))
        self.accepts = np.zeros(len(phrases), np.int64)
        self.accepts[order] = states
        self.used = int(np.flatnonzero(self.check >= 0).max(initial=1)) + 1
        length = int(self.base.max(initial=0)) + DIGIT + 1
        self.base, self.check = (np.pad(x, (0, max(0, length - len(x))), constant_values=c)[:length] for x, c in ((self.base, 0), (self.check, -1)))
        del self.free

    def _grow(self, length: int) -> None:
        if length > len(self.free):
            more = max(length, 2 * len(self.free)) - len(self.free)
            self.base, self.check, self.free = np.pad(self.base, (0, more)), np.pad(self.check, (0, more), constant_values=-1), np.pad(self.free, (0, more), constant_values=True)

    def _level(self, parents: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Children of sorted (parent, digit) rows; the new state of each row."""
        if not len(parents):
            return parents
        fresh = np.append(True, (parents[1:] != parents[:-1]) | (digits[1:] != digits[:-1]))
        p, d = parents[fresh], digits[fresh]
        heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        kinds = np.diff(np.append(heads, len(p)))
        base, cursor, size = np.zeros(len(heads), np.int64), DIGIT + 2, 0
        for k in np.argsort(-kinds, kind="stable"):
            if kinds[k] == 1:
                break
            own = d[heads[k] : heads[k] + kinds[k]]
            if size != kinds[k]:
                size, cursor = kinds[k], DIGIT + 2 if kinds[k] < 8 else cursor
            base[k], cursor = self._fit(own, cursor)
            self.free[base[k] + own] = False
        single = np.flatnonzero(kinds == 1)
        if len(single):
            places = np.flatnonzero(self.free)[: len(single)]
            if len(places) < len(single):
                self._grow(len(self.free) + len(single))
                places = np.flatnonzero(self.free)[: len(single)]
            self.free[places] = False
            base[single] = places - d[heads[single]]
        child = np.repeat(base, kinds) + d
        self.base[p[heads]] = base
        self.check[child] = p
        return child[np.cumsum(fresh) - 1]

    def _fit(self, own: np.ndarray, cursor: int) -> tuple[int, int]:
        """The first base from the cursor on at which all digits fall on free places, and where the next search begins."""
        width = 32
        while True:
            self._grow(cursor + width + 2 * DIGIT)
            places = cursor + np.flatnonzero(self.free[cursor : cursor + width])
            if len(places):
                fits = self.free[places[:, None] + (own - own[0])].all(axis=1)
                if fits.any():
                    place = int(places[int(fits.argmax())])
                    return place - int(own[0]), place if len(places) < 3 * width // 4 else cursor
            cursor += width
            width = min(4 * width, 2048)

    def spell(self, words: int) -> np.ndarray:
        """The digits of the numbers 0 to words, a row each place, the highest first."""
        return np.stack([np.arange(words + 1) // DIGIT**p % DIGIT for p in range(self.digits - 1, -1, -1)]).astype(np.int32)


def advance(base: np.ndarray, check: np.ndarray, spelled: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The state after the k words from each position on, 0 where they are no path; a position for each word that has k - 1 after it."""
    n = max(len(ids) - k + 1, 0)
    state = np.where(ids[:n] > 0, 1, 0).astype(np.int32)
    for word in range(k):
        at = ids[word : word + n]
        for digit in spelled:
            to = base[state] + digit[at]
            state = np.where((check[to] == state) & (state > 0) & (at > 0), to, 0)
    return state


PACKED = "kind int, block int, keys binary, sums binary"


def _packed(kind: int, keys: np.ndarray, sums: np.ndarray, blocks: int):
    """Batches of one row a block of summed keys."""
    block = (mix64(keys.view(np.uint64)) >> np.uint64(32)).astype(np.int64) * blocks >> 32
    order = np.argsort(block, kind="stable")
    block, keys, sums = block[order], keys[order], sums[order]
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(keys))
    spans = list(zip(cuts.tolist(), ends.tolist(), strict=False))
    for i in range(0, len(spans), 256):
        some = spans[i : i + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(some), pa.int32()), pa.array([int(block[a]) for a, _ in some], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in some], pa.binary()), pa.array([sums[a:b].tobytes() for a, b in some], pa.binary())],
            ["kind", "block", "keys", "sums"],
        )


def summed(packed: DataFrame, least: int) -> DataFrame:
    """kind, key, n of the keys whose sums reach `least`."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()])
        sums = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist()])
        order = np.argsort(keys)
        keys, sums = keys[order], sums[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(sums, first)
        kept = total >= least
        return pa.table([pa.array(np.full(int(kept.sum()), table.column("kind")[0].as_py(), np.int32)), pa.array(keys[first[kept]]), pa.array(total[kept])], ["kind", "key", "n"])

    return packed.groupBy("kind", "block").applyInArrow(run, "kind int, key long, n long")


def walk(encoded: DataFrame, k: int, blocks: int, trie=None, suffixes: bool = True) -> DataFrame:
    """Packed sums over encoded(ids): of kind 0 the occurrences of each accepting state of the trie (a broadcast of base, check, digits and
    used states; none: each word is a state), of kind 1 state << 32 | next word, where the phrase that starts a word later is a candidate too."""

    def run(batches):
        counts, keys, held = None, [], 0
        parts = trie.value if trie is not None else None
        for batch in batches:
            for row in batch.column(0):
                ids = np.frombuffer(row.as_py(), np.int32)
                if parts is None:
                    state = ids
                else:
                    base, check, spelled, used = parts
                    state = advance(base, check, spelled, ids, k)
                    if counts is None:
                        counts = np.zeros(used, np.int64)
                    counts += np.bincount(state, minlength=used)
                n = len(ids) - k
                if k < LONGEST and n > 0:
                    on = (state[:n] > 0) & (ids[k:] > 0)
                    if suffixes:
                        on &= state[1 : n + 1] > 0
                    keys.append((state[:n][on].astype(np.int64) << 32) | ids[k:][on])
                    held += len(keys[-1])
                    if held > FLUSH:
                        yield from _packed(1, *np.unique(np.concatenate(keys), return_counts=True), blocks)
                        keys, held = [], 0
        if held:
            yield from _packed(1, *np.unique(np.concatenate(keys), return_counts=True), blocks)
        if counts is not None:
            counts[0] = 0
            found = np.flatnonzero(counts)
            yield from _packed(0, found, counts[found], blocks)

    return encoded.mapInArrow(run, PACKED)


def encode(docs: DataFrame, tables: list) -> DataFrame:
    """ids: int32 numbers of the words of docs(lang, text), 0 for rare words and where pieces and texts end; a row a slice of texts of a lang."""
    alone = len(tables) == 1

    def run(batches):
        def number(k: int) -> dict[str, dict[bytes, int]]:
            out: dict[str, dict[bytes, int]] = {}
            for lang, word, i in zip(*tables[k].value, strict=True):
                out.setdefault(lang, {})[word] = i
            return out

        kept = number(0) if alone else {}
        for batch in batches:
            slices = [(lang, tokens(text)) for lang, text in _by_lang(batch)]
            rows = [np.fromiter(map(len, words), np.int64, len(words)).clip(0, 1).astype(np.int32) - 1 for _, words in slices]  # -1: no word
            for k in range(len(tables)):
                table = kept if alone else number(k)
                for (lang, words), ids in zip(slices, rows, strict=True):
                    found = np.fromiter(map(table.get(lang, {}).get, words, repeat(0)), np.int32, len(words))
                    ids[found > 0] = found[found > 0]
            yield pa.RecordBatch.from_arrays([pa.array([ids[ids >= 0].tobytes() for ids in rows], pa.binary())], ["ids"])

    return docs.mapInArrow(run, "ids binary")


def _parts(rows: int, most: int) -> int:
    return max(-(-rows // most), 1)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, contained: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` phrases of two to four words that occur at least `least` times.

    a is a phrase's number of occurrences within pieces, l and r those of the two parts of its weakest cut, score floor(2000000 a / (l + r)) there, n
    the lang's number of words. Phrases inside a longer one that has at least `contained` per cent of their occurrences go."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = scratch.cut(count_words(docs).where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    common, totals = counted.where("word is not null"), counted.where("word is null").select("lang", "n")
    blocks, width = _parts(totals.agg(F.sum("n")).first()[0] or 0, BLOCK_WORDS), _parts(common.count(), MOST_WORDS)

    # numbers: the commonest words first within a part of the table, parts one after another
    tables, vocabulary, given = [], None, 0
    for k in range(width):
        part = common.where(F.pmod(F.xxhash64("lang", "word"), F.lit(width)) == k).toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
        ids = range(given + 1, given + 1 + part.num_rows)
        given += part.num_rows
        tables.append(spark.sparkContext.broadcast((part.column("lang").to_pylist(), [w.encode() for w in part.column("word").to_pylist()], list(ids))))
        named = spark.createDataFrame(part.append_column("id", pa.array(ids, pa.int64())))
        vocabulary = named if vocabulary is None else vocabulary.union(named)
    vocabulary = scratch.cut(vocabulary.select("lang", "word", "n", "id"), "vocabulary")
    encoded = scratch.cut(encode(docs, tables), "encoded")
    while tables:  # what a stored table was made with is not read again
        tables.pop().destroy()

    found = [vocabulary.select(F.col("id").alias("w1"), *_none(1), F.col("n").alias("f"))]
    # a word is a state of its own
    parents = vocabulary.select(F.lit(0).alias("trie"), F.col("id").alias("state"), F.col("id").alias("w1"))
    sums = scratch.cut(summed(walk(encoded, 1, blocks), least).withColumn("trie", F.lit(0)), "sums")
    for k in range(2, LONGEST + 1):
        longer = sums.where("kind = 1").select("trie", F.shiftright("key", 32).alias("state"), F.expr("key & 4294967295").alias(f"w{k}"))
        candidates = scratch.cut(longer.join(parents, ["trie", "state"]).select(WORDS[:k]), "candidates")
        shards = _parts(candidates.count(), MOST_CANDIDATES)
        parents, sums = None, None
        for shard in range(shards):
            part = candidates.where(F.pmod(F.xxhash64("w1", "w2"), F.lit(shards)) == shard).toArrow()
            phrases = np.stack([part.column(w).to_numpy() for w in WORDS[:k]], axis=1)
            trie = DoubleArray(phrases, given)
            handle = spark.sparkContext.broadcast((trie.base, trie.check, trie.spell(given), trie.used))
            some = scratch.cut(summed(walk(encoded, k, blocks, handle, shards == 1), least).withColumn("trie", F.lit(shard)), "sums")
            handle.destroy()
            named = scratch.cut(spark.createDataFrame(part.append_column("state", pa.array(trie.accepts))).select(F.lit(shard).alias("trie"), "state", *WORDS[:k]), "parents")
            parents, sums = (named, some) if parents is None else (parents.union(named), sums.union(some))
        hits = sums.where("kind = 0").select("trie", F.col("key").alias("state"), F.col("n").alias("f"))
        found.append(parents.join(hits, ["trie", "state"]).select(*WORDS[:k], *_none(k), "f"))
    frequent = scratch.cut(reduce(DataFrame.union, found), "frequent")
    return ranked(frequent, vocabulary, totals, top, contained)


def ranked(frequent: DataFrame, vocabulary: DataFrame, totals: DataFrame, top: int, contained: int) -> DataFrame:
    """The result of `collocations` from frequent(w1, .., w4, f), vocabulary(lang, word, id) and totals(lang, n)."""
    words = F.array(*WORDS)
    phrases = frequent.where("w2 > 0").withColumn("m", F.when(F.col("w4") > 0, 4).when(F.col("w3") > 0, 3).otherwise(2))

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("cut"), words.alias("all"))
    cuts = cuts.select(*WORDS, "f", "cut", *_span("all", F.lit(0), F.col("cut"), "x"), *_span("all", F.col("cut"), F.lit(LONGEST), "y"))
    for side, name in (("x", "l"), ("y", "r")):
        cuts = cuts.join(frequent.select(*[F.col(w).alias(f"{side}{w}") for w in WORDS], F.col("f").alias(name)), [f"{side}{w}" for w in WORDS])
    score = F.expr("cast(2000000 as decimal(20, 0)) * cast(f as decimal(18, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))").cast("long")
    weakest = cuts.groupBy(*WORDS, "f").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("at"))

    spans = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s")) for s in range(2, LONGEST) for o in range(LONGEST - s + 1)])
    inner = phrases.where("m > 2").select("f", "m", words.alias("all"), F.explode(spans).alias("span")).where("span.s < m and span.o + span.s <= m")
    around = inner.select("f", *_span("all", F.col("span.o"), F.col("span.s"), "")).groupBy(*WORDS).agg(F.max("f").alias("around"))
    kept = weakest.join(around, WORDS, "left").where(F.expr(f"around is null or cast(around as decimal(20, 0)) * 100 < cast(f as decimal(20, 0)) * {contained}"))

    for i, w in enumerate(WORDS):
        named = vocabulary.select(F.col("id").alias(w), F.col("word").alias(f"word{i}"), *(["lang"] if i == 0 else []))
        kept = kept.join(named, w, "left" if i > 1 else "inner")
    lines = kept.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(LONGEST)]).alias("phrase"), F.col("f").alias("a"), "at.l", "at.r", "at.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = lines.withColumn("place", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("place") <= top)
    best = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _none(k: int) -> list:
    return [F.lit(0).cast("long").alias(w) for w in WORDS[k:]]


def _span(words: str, start, length, prefix: str) -> list:
    """The columns prefix + w1, .. of `length` words from `start` on, 0 behind them."""
    return [F.when(F.lit(i) < length, F.coalesce(F.get(words, (start + i).cast("int")), F.lit(0))).otherwise(0).cast("long").alias(f"{prefix}{w}") for i, w in enumerate(WORDS)]
