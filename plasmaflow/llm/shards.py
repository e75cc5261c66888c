"""Vectors dealt into shards of a fixed size, whose indexes are built once and stored; queries stream past them.

Rows go to shards by a hash of their id, so a third of all rows with one vector spreads evenly. A shard's index is one stored
row; the table's vectors are shuffled once, to build it. The query set is stated (rows whose id is divisible by a number):
it is broadcast in groups of a fixed size in bytes, each of which is one pass over the stored indexes, so that neither rows nor queries
are copied by a shuffle. A task takes its shards one after another and keeps the best k of each query of the group, which is
all that it sends on. Shards and groups depend on the table alone: a cluster's number of partitions changes no answer."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.llm.common import Scratch

SHARD_ROWS = 8192
#: Bytes of query vectors that are broadcast at a time, and queries that a shard answers at a time.
QUERY_BYTES = 32 << 20
QUERY_BLOCK = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of rows that are not null and whose components are all finite."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """List column as a matrix; shorter vectors end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(int(lengths.max(initial=0)), 1) if width is None else width
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fits = within < width
    out[rows[fits], within[fits]] = flat[fits]
    return out


def build(rows: DataFrame, shards: int, width: int, engine: Callable[[np.ndarray, np.ndarray], Callable]) -> DataFrame:
    """engine: a row a shard of rows(vec_id, vector), the pickled search function of engine(ids, vectors)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        find = engine(table.column("vec_id").to_numpy(), matrix(table.column("vector").combine_chunks(), width))
        return pa.table([pa.array([pickle.dumps(find)], pa.binary())], ["engine"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, "engine binary")


def search(rows: DataFrame, every: int, k: int, score_type: str, engine: Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray, int], list[tuple[np.ndarray, np.ndarray]]]]) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row of rows(vec_id, vector) whose vec_id is divisible by `every`.

    engine(ids, vectors) indexes one shard and can be pickled; it takes query ids, query vectors and k, and gives for each query
    the shard's best ids and scores without the query's own id. Ties go to the smaller vec_id. An id that repeats is one
    query or candidate, at its best score."""
    asked = F.col("vec_id") % every == 0
    total, queried, width = rows.agg(F.count(F.lit(1)), F.count(F.when(asked, 1)), F.max(F.size("vector"))).first()
    shards, width = max(-(-total // SHARD_ROWS), 1), max(width or 1, 1)
    groups = max(-(-queried * (8 * width + 8) // QUERY_BYTES), 1)
    kind = pa.int64() if score_type == "long" else pa.float64()
    scratch = Scratch(rows.sparkSession, "shards")
    index = scratch.cut(build(rows, shards, width, engine), "index")
    queries = rows.where(asked).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)))

    def ask(group: int) -> DataFrame:
        own = queries.where(F.col("part") == group).select("vec_id", "vector").toArrow().combine_chunks()
        ids, vectors = own.column("vec_id").to_numpy(), own.column("vector").combine_chunks()
        sent = rows.sparkSession.sparkContext.broadcast((ids, matrix(vectors, width) if len(ids) else np.zeros((0, width))))

        def run(batches):
            ids, vectors = sent.value
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
            for batch in batches:
                for row in batch.column(0):
                    find = pickle.loads(row.as_buffer())
                    for i in range(0, len(ids), QUERY_BLOCK):
                        for j, found in enumerate(find(ids[i : i + QUERY_BLOCK], vectors[i : i + QUERY_BLOCK], k), i):
                            before = best[j]
                            best[j] = found if before is None else top(np.concatenate([before[0], found[0]]), np.concatenate([before[1], found[1]]), k)
            some = [(q, *b) for q, b in zip(ids, best, strict=True) if b is not None and len(b[0])]
            if some:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _ in some], [len(x) for _, x, _ in some])), pa.array(np.concatenate([x for _, x, _ in some])), pa.array(np.concatenate([x for _, _, x in some]), kind)],
                    ["query_id", "vec_id", "score"],
                )

        return index.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")

    found = reduce(DataFrame.union, [ask(g) for g in range(groups)])
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of different ids, ties to the smaller id; an id that repeats counts at its best score."""
    width = 4 * k
    while True:
        some = np.arange(len(scores))
        if len(scores) > width:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - width)[len(scores) - width])
        order = some[np.lexsort((ids[some], -scores[some]))]
        own = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
        if len(own) == k or len(some) == len(scores):
            return ids[own], scores[own]
        width *= 4
