"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of the lengths of frequent pre-tokens, broadcast to every worker; tier two is each
worker's own cache, which the library fills on a miss. Pre-tokens are never shuffled: a text's count is the sum of its
pre-tokens' lengths. The table comes from a bounded sample of rows (about `sample_rows`, by a seeded hash) and only
changes the speed, never a count. Null texts count as empty; extra columns are ignored; a row's doc_id may be null or repeat.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm import pretokens

CACHE_BYTES = 64 << 20  # of a worker's pre-tokens, as estimated


class Lengths(dict):
    """Pre-token to number of tokens: the frequent ones for good, others until the cache is full."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.frequent, self.held = pretokens.processor(path), frequent, 0

    def __missing__(self, piece: str) -> int:
        self.held += 130 + 2 * len(piece)
        if self.held > CACHE_BYTES:
            self.clear()
            self.update(self.frequent)
            self.held = 0
        n = self[piece] = len(pretokens.encode(self.model, piece))
        return n


_lengths: dict[tuple, Lengths] = {}  # a worker's caches, kept from task to task


def frequent_lengths(docs: DataFrame, path: str, sample_rows: int, entries: int, seed: int) -> dict[str, int]:
    """The `entries` most frequent pre-tokens of about `sample_rows` rows, with their lengths."""
    total = docs.count()
    if not total:
        return {}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / total) * (1 << 30)))

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(pretokens.split((text or "").replace(pretokens.SPACE, " ")))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    seen: Counter[str] = Counter()
    for batch in docs.where(drawn).select(F.col("text").cast("string")).mapInArrow(run, "piece string, n long").toArrow().to_batches():
        for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[piece] += n
    model = pretokens.processor(path)
    return {p: len(pretokens.encode(model, p)) for p, _ in seen.most_common(entries)}


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, sample_rows: int = 500, entries: int = 20_000, seed: int = 11) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text)."""
    pretokens.check(path)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_rows, entries, seed))

    def run(batches):
        key = (path, table.id if hasattr(table, "id") else id(table))
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = Lengths(path, table.value)
        length = _lengths[key].__getitem__
        for batch in batches:
            sizes = [sum(map(length, pretokens.split((t or "").replace(pretokens.SPACE, " ")))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
