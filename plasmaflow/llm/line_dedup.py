"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words (white-space separated, lower-cased). A line goes if an earlier line of the corpus, in order
of (doc_id, text hash, line number), has a Jaccard similarity of `percent` / 100 or more; so the first of every group of
equal lines stays, unless it resembles a still earlier one.

Words are ordered by rarity: a word's class is the logarithm of a count of all words by hash, and words of a class stand in
hash order, so that a word becomes one number and a line a sorted array. Two similar lines share a word within the first
n - ceil(n * percent / 100) + 1 of the longer and the (fewer) words that the shorter one's length asks for (prefix filter).
The join on such words keeps pairs whose lengths (length filter), places of the shared word (positional filter) and bitmaps
(an upper bound of the overlap) still allow the similarity; full sets then decide. Lines of equal sets are one line before
the join, with their first occurrence.

A large group of alike lines never makes all its pairs: in a crowded group of lines of about one length that share a prefix
word, the earliest is proposed to all others, and only lines that the filters part from it are joined with the rest. A line
whose proposals all fail on full sets is joined with every line afterwards.

Defined cases: lines without words stay; null texts stay null, empty ones empty; rows that repeat doc_id and text are one
document, so they get the same result; a null doc_id sorts first; all columns of the input come back unchanged but text,
n_lines and n_removed, which are the operator's own. Words are compared by 64 bits of their hash.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.llm.common import Scratch

SKETCH_BITS = 20
#: Lines of about one length that share a prefix word, beyond which the earliest goes first; it only plans the work.
CROWDED = 64
#: Most rows of a few numbers each that are broadcast (under 32 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
PLAIN_LISTS = "spark.sql.parquet.writeLegacyFormat"
RARE_BLANKS = "\t\x0b\f\r"


@contextlib.contextmanager
def _plain_lists(spark: SparkSession):
    """Parquet lists are written without a group around each element, which takes a third less time."""
    before = spark.conf.get(PLAIN_LISTS, "false")
    spark.conf.set(PLAIN_LISTS, "true")
    try:
        yield
    finally:
        spark.conf.set(PLAIN_LISTS, before)


def _bucket(word_hash: Column) -> Column:
    return word_hash.bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)).cast("int")


def _small(df: DataFrame, rows: Column | None = None) -> DataFrame:
    """df as the side of a join: broadcast if its counted rows are few; `rows` is what a row with a list counts for."""
    counted = df.count() if rows is None else df.agg(F.sum(rows)).first()[0] or 0
    return F.broadcast(df) if counted <= BROADCAST_ROWS else df


def _spaced(text: Column) -> Column:
    """The text with a space for any other blank inside lines; only texts with rare blanks are rewritten."""
    rare = F.lit(False)
    for blank in RARE_BLANKS:
        rare = rare | text.contains(blank)
    return F.when(rare, F.translate(text, RARE_BLANKS, " " * len(RARE_BLANKS))).otherwise(text)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, the line's set as two numbers and its distinct words as sorted hashes, for lines with words."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(_spaced(F.col("text")), "\n").alias("lines"))  # a text is hashed once, not for each line
    lines = texts.select("doc_id", "text_hash", F.posexplode_outer("lines").alias("line_no", "line")).where(F.trim("line") != "")  # outer: else a filter splits each text once more
    hashes = F.array_distinct(F.transform(F.split(F.lower("line"), " "), lambda w: F.xxhash64(w)))
    words = F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))  # blanks in a row or at an end leave empty words
    lines = lines.select("doc_id", "text_hash", "line_no", words.alias("words"))
    return lines.select("doc_id", "text_hash", "line_no", F.xxhash64("words").alias("id"), F.xxhash64(F.lit(1), "words").alias("id2"), "words")


def rarity_classes(lines: DataFrame, scratch: Scratch) -> Column:
    """A scalar array: for each hash bucket the logarithm of its number of words in lines.words, as a byte so that caches hold it."""
    counts = lines.select(F.explode("words").alias("word")).select(_bucket(F.col("word")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = lines.sparkSession.range(1 << SKETCH_BITS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    logs = scratch.cut(counts.union(every).groupBy("bucket").agg(F.length(F.bin(F.max("n"))).cast("byte").alias("log")), "classes")
    rows = F.sort_array(F.collect_list(F.struct("bucket", "log")))  # 2 ** SKETCH_BITS rows of a few bytes
    return logs.agg(rows.getField("log").alias("classes")).scalar()


def _ordered(words: Column, classes: Column) -> Column:
    """The words as sorted numbers: rarity class, then hash."""

    def key(h: Column) -> Column:
        return F.coalesce(F.shiftleft(F.get(classes, _bucket(h)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))

    return F.sort_array(F.transform(words, key))  # the coalesce declares numbers that are never null: a primitive sort


def _key(x: Column) -> Column:
    """A prefix word as 32 bits, which propose a few more candidates and move less; odd if more than CROWDED lines may hold it."""
    return F.when(x >= (CROWDED + 1).bit_length() << 56, F.hash(x).bitwiseOR(F.lit(1))).otherwise(F.hash(x).bitwiseAND(F.lit(-2)))


def _bitmaps(lines: DataFrame) -> DataFrame:
    """id, id2 and 128 bits that the words set: two sets' bits differ in no more places than the sets differ in words."""
    word = F.col("word")
    bit = F.call_function("shiftleft", F.expr("1L"), F.shiftrightunsigned(word, 40).bitwiseAND(F.lit(63)).cast("int"))
    high = F.shiftrightunsigned(word, 46).bitwiseAND(F.lit(1)) == 1
    bits = lines.select("id", "id2", F.explode("words").alias("word")).select("id", "id2", F.when(high, F.expr("0L")).otherwise(bit).alias("low"), F.when(high, bit).otherwise(F.expr("0L")).alias("high"))
    return bits.groupBy("id", "id2").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))


def _postings(first: DataFrame, percent: int) -> DataFrame:
    """A row for each prefix word of each line; `shape` packs the number of the line's words, the word's place and `index`: whether it
    is within the prefix that the shorter line of a pair needs."""
    sure = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))  # noqa: E731  columns that can't be null let both sides of a join share their exchange
    post = first.select(
        sure("id", "long").alias("id"), F.coalesce("at.doc_id", F.expr("-9223372036854775808L")).alias("doc"), sure("n", "int").alias("n"), sure("low", "long").alias("low"), sure("high", "long").alias("high"),
        F.posexplode("prefix").alias("place", "word"),
    )
    index = f"place <= n - cast((2 * {percent} * n + {99 + percent}) div {100 + percent} as int)"
    shape = F.expr(f"shiftleft(cast(n as long), 32) | shiftleft(cast(place as long), 1) | if({index}, 1L, 0L)")
    return post.select("id", "doc", shape.alias("shape"), "low", "high", sure("word", "int").alias("word"))


def _n(shape: str) -> str:
    return f"cast(shiftright({shape}, 32) as int)"


def _fits(a: str, percent: int) -> str:
    """The prefix, length, positional and bitmap filters between a posting and the one whose fields begin with `a`."""
    n, an = _n("shape"), _n(f"{a}shape")
    left, aleft = (f"({m} - cast(shiftright({s}, 1) & 2147483647 as int))" for m, s in ((n, "shape"), (an, f"{a}shape")))
    overlap = f"cast(({percent} * ({n} + {an}) + {99 + percent}) div {100 + percent} as int)"
    return (
        f"{a}id <> id and ({n} <= {an} and shape & 1 = 1 or {an} <= {n} and {a}shape & 1 = 1) and 100 * least({n}, {an}) >= {percent} * greatest({n}, {an})"
        f" and least({left}, {aleft}) >= {overlap} and bit_count(low ^ {a}low) + bit_count(high ^ {a}high) <= {n} + {an} - 2 * {overlap}"
    )


POSTING = ("id", "doc", "shape", "low", "high")


def _proposals(post: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """word, id, a_id: postings of crowded groups (word, span) with the group's earliest line, where the filters allow the pair."""
    group = ["word", "span"]
    post = post.where("word & 1 = 1")
    crowded = post.groupBy(*group).agg(F.count(F.lit(1)).alias("lines"), F.min("doc").alias("doc")).where(f"lines > {CROWDED}")
    crowded = scratch.cut(crowded.select(*group, F.col("doc").alias("least")), "crowded")
    inside = post.join(_small(crowded), group)
    top = inside.where("doc = least").groupBy(*group).agg(F.min(F.struct("id", *POSTING[1:])).alias("top"))
    return inside.join(top, group).where(_fits("top.", percent)).select("word", "id", F.col("top.id").alias("a_id"))


def duplicate_lines(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, line_no of every line that an earlier one resembles."""
    scratch = scratch or Scratch(docs.sparkSession, "line_dedup")
    docs = docs.select("doc_id", "text").where("text is not null")
    with _plain_lists(docs.sparkSession):  # a dictionary page that holds a split's words keeps the hashes small on disk
        lines = scratch.cut(hashed_lines(docs), "lines", **{"parquet.dictionary.page.size": str(8 << 20)})
    prefix = F.slice("ordered", F.lit(1), F.expr(f"n - cast((n * {percent} + 99) div 100 as int) + 1"))
    keyed = lines.withColumn("classes", rarity_classes(lines, scratch))
    keyed = keyed.select("id", "id2", F.struct("doc_id", "text_hash", "line_no").alias("at"), F.size("words").alias("n"), _ordered(F.col("words"), F.col("classes")).alias("ordered"))
    keyed = keyed.select("id", "id2", "at", "n", F.transform(prefix, _key).alias("prefix"))
    first = keyed.groupBy("id", "id2").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    first = scratch.cut(first.join(_bitmaps(lines), ["id", "id2"]), "first")

    post = _postings(first, percent)
    span = F.floor(F.log(1.25, F.expr(_n("shape")))).cast("int").alias("span")
    proposed = scratch.cut(_proposals(post.select("*", span), percent, scratch), "proposed")
    dealt = post.repartition("word")  # one exchange, which both sides of the join read
    lone = dealt.join(_small(proposed.select("word", "id", F.lit(True).alias("done"))), ["word", "id"], "left").where("done is null")
    as_earlier = ["word", *(F.col(c).alias(f"a_{c}") for c in POSTING)]
    others = lone.join(dealt.select(*as_earlier), "word").where(f"a_doc <= doc and {_fits('a_', percent)}")
    pairs = scratch.cut(others.select("a_id", "id").union(proposed.select("a_id", "id")).distinct(), "pairs")
    removed = scratch.cut(_later(lines, first, pairs, percent, scratch), "removed")

    open_ = scratch.cut(proposed.select("id").distinct().join(removed.select("id").distinct(), "id", "left_anti"), "open")
    if not open_.isEmpty():
        some = _postings(first.join(_small(open_), "id", "left_semi"), percent)
        found = post.select(*as_earlier).join(_small(some), "word").where(f"a_doc <= doc and {_fits('a_', percent)}")
        removed = scratch.cut(removed.union(_later(lines, first, scratch.cut(found.select("a_id", "id").distinct(), "found"), percent, scratch)).distinct(), "removed")

    places = lines.select("doc_id", "text_hash", "line_no", "id", "id2")
    states = first.select("id", "id2", F.col("at").alias("first")).join(removed.withColumn("similar", F.lit(True)), ["id", "id2"], "left")
    marked = places.join(scratch.cut(states, "states"), ["id", "id2"])  # the lines that repeat most may be split between tasks
    return marked.where("similar or struct(doc_id, text_hash, line_no) <> first").select("doc_id", "text_hash", "line_no")


def _later(lines: DataFrame, first: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """id, id2 of the later line of each pair (a_id, id) whose full sets have the similarity."""
    ids = scratch.cut(pairs.select(F.col("a_id").alias("id")).union(pairs.select("id")).distinct(), "ids")
    wanted = first.join(_small(ids), "id", "left_semi").select("id", "id2", "at")
    sets = lines.join(_small(ids), "id", "left_semi").select("id", "id2", "words").dropDuplicates(["id", "id2"])
    found = scratch.cut(sets.join(wanted, ["id", "id2"]), "sets")
    a = found.select(F.col("id").alias("a_id"), F.col("id2").alias("a_id2"), F.col("at").alias("a_at"), F.col("words").alias("a_words"))
    both = F.size(F.array_intersect("words", "a_words"))
    alike = pairs.join(found, "id").join(a, "a_id").where(100 * both >= percent * (F.size("words") + F.size("a_words") - both))
    late = F.col("at") > F.col("a_at")
    return alike.select(F.when(late, F.col("id")).otherwise(F.col("a_id")).alias("id"), F.when(late, F.col("id2")).otherwise(F.col("a_id2")).alias("id2")).distinct()


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the duplicate lines taken out of text, and n_lines and n_removed (both null for a null text)."""
    scratch = Scratch(docs.sparkSession, "line_dedup")
    gone = duplicate_lines(docs, percent, scratch).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    gone = scratch.cut(gone, "gone")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    joined = rows.join(_small(gone, F.size("gone") + 1), F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    text, lines = F.col("row.text"), F.split("row.text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")  # by hash, so that a long text's lines are not searched one by one
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(F.array(lines), lambda own: F.transform(places, lambda i: F.get(own, i)))[0], "\n"))
    n_removed = F.when(text.isNotNull(), F.coalesce(F.size("gone"), F.lit(0)))
    columns = [kept.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own]
    return joined.select(*columns, F.when(text.isNotNull(), F.size(lines)).alias("n_lines"), n_removed.alias("n_removed"))
