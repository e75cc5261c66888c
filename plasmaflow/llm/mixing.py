"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow network routes words from
patterns to the quotas of their sources; a pattern's words can be taken in passes, each dearer than the last (convex
repetition costs), so nothing repeats before it must and repeats are spread evenly. The network has one node a pattern and
a source and is solved on the driver; the documents never leave the cluster.

Selection: within a pattern documents stand in seeded hash order, dealt to buckets of about `bucket_docs`. A pass hands
consecutive stretches of that order to the sources that the flow names. Buckets inside a stretch go whole; only buckets
that hold a stretch's end are filled document by document, in hash order, taking whatever still fits.

Defined cases: null texts have size 0 and are never taken; null membership or a null source is a source of its own, last in
order; an empty table gives an empty result; rows that repeat a doc_id and text are taken separately, apart by a
counter-free hash of their columns (equal rows share a bucket and are filled in turn); extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm.common import Scratch

#: Buckets of a pattern, whose totals the driver sees; beyond it a bucket holds more documents.
MOST_BUCKETS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words for each source: weights repeat over the sources by code point (null last); shares of total_share of all
    words; a source stops at `most` times its own size and the excess is shared again by weight."""
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, out, open_ = total_share * sum(sizes.values()), {}, list(names)
    while open_:
        each = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if each * weight[k] > most * sizes[k]]
        if not over:
            return out | {k: each * weight[k] for k in open_}
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.remove(k)
    return out


class Network:
    """Arcs with room, and maximum flows over what room is left."""

    def __init__(self, nodes: int):
        self.head: list[int] = []  # arc a ^ 1 is the reverse of arc a
        self.room: list[int] = []
        self.leaving: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, tail: int, head: int, room: int) -> int:
        self.head.extend((head, tail))
        self.room.extend((room, 0))
        a = len(self.head) - 2
        self.leaving[tail].append(a)
        self.leaving[head].append(a + 1)
        return a

    def _depths(self, start: int, end: int) -> list[int]:
        depth, front = [-1] * len(self.leaving), [start]
        depth[start] = 0
        while front and depth[end] < 0:
            after = []
            for u in front:
                for a in self.leaving[u]:
                    if self.room[a] and depth[self.head[a]] < 0:
                        depth[self.head[a]] = depth[u] + 1
                        after.append(self.head[a])
            front = after
        return depth

    def fill(self, start: int, end: int) -> None:
        """Add flow until no path is left: all shortest paths of a length at once, then longer ones."""
        head, room, leaving = self.head, self.room, self.leaving
        while (depth := self._depths(start, end))[end] >= 0:
            turn, path, u = [0] * len(leaving), [], start
            while True:
                if u == end:
                    amount = min(room[a] for a in path)
                    for a in path:
                        room[a] -= amount
                        room[a ^ 1] += amount
                    full = next(k for k, a in enumerate(path) if not room[a])
                    u = head[path[full] ^ 1]
                    del path[full:]
                while turn[u] < len(leaving[u]) and not (room[a := leaving[u][turn[u]]] and depth[head[a]] == depth[u] + 1):
                    turn[u] += 1
                if turn[u] < len(leaving[u]):
                    path.append(leaving[u][turn[u]])
                    u = head[path[-1]]
                elif path:
                    u = head[path.pop() ^ 1]
                    turn[u] += 1
                else:
                    break


def min_cost_flow(patterns: list[tuple[str | None, ...]], size: list[int], quota: dict[str | None, int], passes: int) -> list[dict[tuple[str | None, int], int]]:
    """For each pattern the words routed to (source, pass), as many as quotas and words allow and at the least cost.

    Pass r of a pattern costs r a word; all of a pattern's passes hold its size each. As only the arcs that leave the start have a
    cost, a cheapest path costs as much as its first arc: a maximum flow over the first passes, extended by the second ones and so on,
    is one of least cost. The arcs are few a pattern, and all shortest paths are filled at once."""
    n, sources = len(patterns), list(quota)
    start, end, source_node = n, n + 1, {s: n + 2 + i for i, s in enumerate(sources)}
    net = Network(n + 2 + len(sources))
    supply = [net.arc(start, i, 0) for i in range(n)]
    routes = [{s: net.arc(i, source_node[s], passes * size[i]) for s in patterns[i]} for i in range(n)]
    for s in sources:
        net.arc(source_node[s], end, quota[s])
    for _ in range(passes):
        for a, words in zip(supply, size, strict=True):
            net.room[a] += words
        net.fill(start, end)
    out = []
    for i in range(n):
        total = net.room[supply[i] ^ 1]
        used = [min(max(total - r * size[i], 0), size[i]) for r in range(passes)]
        wanted = {s: net.room[a ^ 1] for s, a in routes[i].items()}
        split: dict[tuple[str | None, int], int] = {}
        for r in range(passes):
            room = used[r]
            for s in wanted:
                part = min(room, wanted[s])
                if part:
                    split[s, r] = part
                    wanted[s] -= part
                    room -= part
        out.append(split)
    return out


def _stretches(split: dict[tuple[str | None, int], int], passes: int) -> list[tuple[int, str | None, int, int]]:
    """(pass, source, begin, end) in words of the pattern's order."""
    out = []
    for r in range(passes):
        at = 0
        for (s, own), words in split.items():
            if own == r:
                out.append((r, s, at, at + words))
                at += words
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total_share: float = 1.5, passes: int = 2, seed: int = 17, bucket_docs: int = 1000) -> DataFrame:
    """doc_id, row_key, size, source_size, target, taken for each row of docs(doc_id, text, source or sources array).

    source_size and target are those of the row's first source; taken counts words over all passes."""
    spark = docs.sparkSession
    held = "sources" in docs.columns and docs.schema["sources"].dataType.typeName() == "array"  # any other column of that name is an extra one
    members = F.col("sources") if held else F.array("source")
    members = F.when(F.size(members) > 0, F.array_sort(F.array_distinct(members))).otherwise(F.array(F.lit(None).cast("string")))
    order = F.xxhash64("doc_id", "text", F.lit(seed))
    slim = Scratch(spark, "mixing").cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), members.cast("array<string>").alias("members"), word_count().alias("size"), order.alias("place"), F.xxhash64("doc_id", "text").alias("row_key")), "sizes")
    seen = slim.groupBy("members").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")).collect()
    rows = sorted(seen, key=lambda r: [(m is None, m or "") for m in r["members"]])
    patterns = [tuple(r["members"]) for r in rows]
    sizes: dict[str | None, int] = {}
    for p, r in zip(patterns, rows, strict=True):
        for s in p:
            sizes[s] = sizes.get(s, 0) + r["words"]
    wanted = targets(sizes, weights, total_share, float(passes))
    flows = min_cost_flow(patterns, [r["words"] for r in rows], {s: round(t) for s, t in wanted.items()}, passes)

    plan = [(list(p), i, min(max(1, r["docs"] // bucket_docs), MOST_BUCKETS), p[0], sizes[p[0]], float(wanted[p[0]])) for i, (p, r) in enumerate(zip(patterns, rows, strict=True))]
    plan_df = spark.createDataFrame(plan, "members array<string>, pattern int, buckets int, source string, source_size long, target double")
    bucket = F.floor(F.shiftrightunsigned("place", 1) / F.lit(float(1 << 63)) * F.col("buckets")).cast("int")
    keyed = slim.withColumn("m", F.to_json("members")).join(F.broadcast(plan_df.withColumn("m", F.to_json("members")).drop("members")), "m").withColumn("bucket", F.least(bucket, F.col("buckets") - 1))
    totals = keyed.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")).toPandas()  # at most MOST_BUCKETS rows a pattern

    whole: list[tuple[int, int, int]] = []  # pattern, bucket, passes that take it whole
    cuts: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (pattern, bucket) to (pass, words to take inside)
    for i, part in totals.sort_values(["pattern", "bucket"]).groupby("pattern"):
        ends = part["words"].cumsum().tolist()
        taken = {b: [] for b in part["bucket"].tolist()}
        for r, _, begin, end in _stretches(flows[int(i)], passes):
            for b, e, w in zip(part["bucket"].tolist(), ends, part["words"].tolist(), strict=True):
                inside = min(end, e) - max(begin, e - w)
                if inside > 0:
                    taken[b].append((r, inside, w))
        for b, parts in taken.items():
            by_pass: dict[int, list[int]] = {}
            for r, inside, w in parts:
                by_pass.setdefault(r, []).append(inside)
            full = sum(1 for r, each in by_pass.items() if len(each) == 1 and each[0] == parts[0][2])
            rest = [(r, inside) for r, each in sorted(by_pass.items()) for inside in each if not (len(each) == 1 and inside == parts[0][2])]
            whole.append((int(i), int(b), full))
            if rest:
                cuts[int(i), int(b)] = rest
    schema = "pattern int, bucket int, full int, cut boolean"
    decided = F.broadcast(spark.createDataFrame([(i, b, f, (i, b) in cuts) for i, b, f in whole], schema))
    dealt = keyed.join(decided, ["pattern", "bucket"])
    fields = ["doc_id", "row_key", "size", "source_size", "target"]
    easy = dealt.where(~F.col("cut")).select(*fields, (F.col("size") * F.col("full")).alias("taken"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "doc_id"], kind="stable").reset_index(drop=True)
        key = int(group["pattern"].iloc[0]), int(group["bucket"].iloc[0])
        taken = group["size"] * group["full"]
        size = group["size"].tolist()
        by_pass: dict[int, list[int]] = {}
        for r, words in cuts[key]:
            by_pass.setdefault(r, []).append(words)
        extra = [0] * len(size)
        for quotas in by_pass.values():
            free = set(range(len(size)))
            for words in quotas:  # a pass takes a document at most once
                for at in sorted(free):
                    if 0 < size[at] <= words:
                        words -= size[at]
                        extra[at] += size[at]
                        free.discard(at)
        return group.assign(taken=taken + extra)[[*fields, "taken"]]

    hard = dealt.where("cut").groupBy("pattern", "bucket").applyInPandas(fill, "doc_id long, row_key long, size long, source_size long, target double, taken long")
    return easy.unionByName(hard)
