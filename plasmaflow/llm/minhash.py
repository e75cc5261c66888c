"""MinHash near-dedup: circulant MinHash signatures, banding, exact Jaccard verification, connected components.

Two permutations make every signature coordinate: sigma scatters the shingles over a circle of 2**20 places, and coordinate
k is the smallest value of pi on the shingle's place shifted circularly by k, so a shingle's contribution to all
coordinates is one contiguous slice of pi. Equal bands only propose pairs; a link needs the exact Jaccard on full sets.

No pair list grows with the square of a group: equal sets become one node first; each bucket then proposes only the pairs
with its leader (the member that meets most others); components of the verified links are contracted, and only bucket
members that are still in different components are compared further, where 1024 finer coordinates are as close as a pair
at the threshold would have them.

Defined cases: null or wordless texts have an empty set and stay alone; rows that repeat a doc_id are one node of the links, so
that each brings what its own text resembles into one component; a null doc_id is in nobody's way: it never becomes a component_id while a group has another id, and alone it is kept.
Columns beyond doc_id and text are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm.common import Scratch, mix64, row_slices, shingle_hashes, utf8, word_hashes

CIRCLE_BITS = 20
FINE_WORDS = 16


class CirculantMinHash:
    """Signatures of `bands * rows` coordinates, hashed to one 64-bit value a band."""

    def __init__(self, bands: int, rows: int, seed: int):
        self.bands, self.rows = bands, rows
        pi = np.random.default_rng(seed).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        self.shifted = sliding_window_view(np.concatenate([pi, pi[: bands * rows - 1]]), bands * rows)
        self.sigma = np.uint64(mix64(np.array([seed + 1], np.uint64))[0])
        self.weights = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (mix64(shingles ^ self.sigma) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
        least = self.shifted[places[:4096]].min(axis=0)
        for i in range(4096, len(places), 4096):
            np.minimum(least, self.shifted[places[i : i + 4096]].min(axis=0), out=least)
        return least

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        grouped = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        return mix64((grouped * self.weights).sum(axis=2, dtype=np.uint64) + mix64(np.arange(self.bands, dtype=np.uint64))).view(np.int64)


def _sets(text: pa.Array, width: int):
    """For each row its sorted distinct shingle hashes."""
    data, at = utf8(text)
    for i, j in row_slices(at):
        hashes, counts = shingle_hashes(*word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i]), width)
        ends = np.cumsum(counts)
        for begin, end in zip(ends - counts, ends, strict=True):
            yield np.unique(hashes[begin:end])


def sketch(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, two 64-bit halves of the set's identity, and the band keys (empty without shingles)."""

    def run(batches):
        maker = CirculantMinHash(bands, rows, seed)
        for batch in batches:
            sizes, halves, signatures = [], [], []
            for own in _sets(batch.column(1), width):
                sizes.append(len(own))
                halves.append((own.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(own)) if len(own) else np.uint64(0)))
                if len(own):
                    signatures.append(maker.signature(own))
            keys = maker.band_keys(np.array(signatures, np.uint32).reshape(len(signatures), -1)).reshape(-1) if signatures else np.zeros(0, np.int64)
            n = np.array(sizes, np.int64)
            ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
            half = np.array(halves, np.uint64).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()), lists], ["doc_id", "n_shingles", "set_a", "set_b", "band_keys"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, band_keys array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, n, set_a and the sorted shingle hashes as binary, for each row of docs(node, text)."""

    def run(batches):
        for batch in batches:
            sets = list(_sets(batch.column(1), width))
            half = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(half), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set_a", "shingles"])

    return docs.mapInArrow(run, "node long, set_a long, shingles binary")


def fine_bits(sets: DataFrame, seed: int) -> DataFrame:
    """node and the lowest bit of each of 1024 circulant coordinates, as columns f0 to f15: two nodes' bits agree in a share of (1 + J) / 2."""

    def run(batches):
        maker = CirculantMinHash(1, 64 * FINE_WORDS, seed + 1)
        for batch in batches:
            bits = [np.packbits((maker.signature(np.frombuffer(x.as_py(), np.uint64)) & 1).astype(bool)).view(np.int64) for x in batch.column(1)]
            table = np.array(bits, np.int64).reshape(-1, FINE_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i].copy()) for i in range(FINE_WORDS))], ["node", *(f"f{i}" for i in range(FINE_WORDS))])

    return sets.select("node", "shingles").mapInArrow(run, "node long, " + ", ".join(f"f{i} long" for i in range(FINE_WORDS)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (p, q) if len(p) < len(q) else (q, p)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[place] == small).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b"))
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and the smallest node reachable over the links (a, b), by label propagation with pointer jumping.

    Every round is cut to the shared folder; messages are pre-aggregated before their shuffle."""
    both = scratch.cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        moved = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("jump"))
        after = scratch.cut(moved.join(far, "near", "left").select("node", F.least("near", F.coalesce("jump", "near")).alias("label"), (F.least("near", F.coalesce("jump", "near")) < F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, seed: int = 1, fine: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    With 40 bands of 6 coordinates a pair at exactly 0.8 is missed with probability 5e-6, closer pairs less often. `fine` leaves out
    open pairs by their finer coordinates, which loses a pair at 0.8 with probability 1e-5; without it all open pairs of a bucket are
    verified on their full sets."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows_of = scratch.cut(sketch(docs, width, bands, rows, seed), "sketch")
    filled = rows_of.where("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    nodes = filled.groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("band_keys").alias("band_keys"))
    band = nodes.select(F.explode("band_keys").alias("band"), "node", F.col("n_shingles").cast("int").alias("n"), "set_a")
    band = scratch.cut(band, "bands")
    crowded = band.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = scratch.cut(band.join(crowded, "band"), "met")
    weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = met.join(weight, "node")
    leader = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n")).alias("top")).select("band", (-F.col("top.minus")).alias("a"), F.col("top.n").alias("n_a"))
    fits = f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)"
    stars = scratch.cut(met.join(leader, "band").where(f"node <> a and {fits}").select("a", F.col("node").alias("b")).distinct(), "stars")

    wanted = met.select("node", "set_a").distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    text = text.join(wanted.select("node").distinct(), "node", "left_semi")
    sets = scratch.cut(shingle_sets(text, width).join(wanted, ["node", "set_a"], "left_semi").dropDuplicates(["node", "set_a"]), "sets")
    links = scratch.cut(verified(stars, sets, percent).distinct(), "links")
    labels = components(links, scratch)

    labelled = met.join(labels, "node", "left").select("band", "node", "n", F.coalesce("label", "node").alias("label"))
    split = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    open_ = scratch.cut(labelled.join(split, "band"), "open")
    words = FINE_WORDS if fine else 0
    own_bands = open_.groupBy("node").agg(F.collect_set("band").alias("bands"))
    open_ = open_.join(own_bands, "node")
    if fine:
        open_ = open_.join(fine_bits(sets.join(open_.select("node").distinct(), "node", "left_semi"), seed).dropDuplicates(["node"]), "node")
    open_ = scratch.cut(open_, "fine")
    other = open_.select("band", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"), F.col("bands").alias("bands_a"), *(F.col(f"f{i}").alias(f"g{i}") for i in range(words)))
    # a pair that shares several bands counts in the least of them; bits that may differ between a pair at the threshold, with 4.2 standard deviations to spare (a loss of 1e-5)
    total, apart = 64 * FINE_WORDS, (1 - percent / 100) / 2
    limit = int(total * apart + 4.2 * (total * apart * (1 - apart)) ** 0.5)
    differ = " + ".join(["0", *(f"bit_count(f{i} ^ g{i})" for i in range(words))])
    rest = open_.join(other, "band").where(f"label_a < label and {fits} and {differ} <= {limit} and band = array_min(array_intersect(bands, bands_a))").select("a", F.col("node").alias("b")).distinct()
    more = scratch.cut(verified(rest.join(stars, ["a", "b"], "left_anti"), sets, percent).distinct(), "links")
    if not more.isEmpty():
        labels = components(links.union(more), scratch)

    named = nodes.select(*key, "node").join(labels, "node", "left").select(*key, F.coalesce("label", "node").alias("label"))
    out = rows_of.join(named, key, "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
