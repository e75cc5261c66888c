"""UMI families: grouping, clustering, consensus and their summaries.

The core is one shuffle: conditional sums for each allele by (sample, site, umi), with map-side partial sums, so that no
list of reads is ever collected and a hot site spreads over its UMIs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.functions import dna
from plasmaflow.operators.lineage import cut, drop

SITE = ["sample_id", "chrom", "pos", "ref"]
FAMILY = [*SITE, "umi"]


def families(reads: DataFrame, min_quality: int = 20, share: float = 0.6, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """One row a family: family_size (all reads), reads by strand, alt and ref reads, the consensus allele (null below
    `share` of the weight of reads with quality >= min_quality), its mean quality and agreement.

    Ties go to the alphabetically first allele. With `parts` the reads are dealt by family over so many tasks before they are summed: a
    read is narrower than the sums of its family, and a task holds the sums of its own families only, however large a split of the input."""
    keys = keys or [*FAMILY, *[c for c in ("af_milli", "context") if c in reads.columns]]
    reads = reads.repartition(parts, *keys) if parts else reads
    good = F.col("quality") >= min_quality
    weight = dna.phred_weight("quality")
    sums: list[Column] = []
    for base in dna.BASES:
        own = good & (F.col("alt") == base)
        sums += [F.sum(F.when(own, weight)).alias(f"w_{base}"), F.count(F.when(own, 1)).alias(f"n_{base}"), F.sum(F.when(own, F.col("quality"))).alias(f"q_{base}")]
    out = reads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("family_size"),
        F.count(F.when(F.col("strand") == "+", 1)).alias("forward"),
        F.count(F.when(F.col("strand") == "-", 1)).alias("backward"),
        F.count(F.when(F.col("alt") != F.col("ref"), 1)).alias("alt_reads"),
        F.count(F.when(F.col("alt") == F.col("ref"), 1)).alias("ref_reads"),
        F.avg("quality").alias("mean_quality"),
        *sums,
    )
    ranked = [F.struct(F.coalesce(f"w_{b}", F.lit(0).cast("decimal(20,6)")).alias("w"), F.lit(-i).alias("minus"), F.lit(b).alias("allele"), (F.col(f"q_{b}") / F.col(f"n_{b}")).alias("q")) for i, b in enumerate(sorted(dna.BASES))]
    out = out.withColumn("best", F.greatest(*ranked)).withColumn("total", sum((F.coalesce(f"w_{b}", F.lit(0).cast("decimal(20,6)")) for b in dna.BASES), F.lit(0).cast("decimal(20,6)")))
    agreement = F.when(F.col("total") > 0, F.col("best.w").cast("double") / F.col("total").cast("double"))
    out = out.withColumn("consensus_agreement", agreement)
    agreed = F.col("consensus_agreement") >= share
    return out.withColumn("allele", F.when(agreed, F.col("best.allele"))).withColumn("consensus_quality", F.when(agreed, F.col("best.q"))).drop("best", "total", *(f"{k}_{b}" for b in dna.BASES for k in "wnq"))


def filter_family_size(fams: DataFrame, least: int = 3, most: int = 1000) -> DataFrame:
    """Drop families under `least` reads; larger ones than `most` count as `most`."""
    return fams.where(F.col("family_size") >= least).withColumn("family_size", F.least("family_size", F.lit(most)))


def cap_reads(reads: DataFrame, read_id: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most `most` reads a family, drawn by a keyed hash of the read's id."""
    order = W.partitionBy(*FAMILY).orderBy(F.xxhash64(*read_id, F.lit(seed)), *read_id)
    return reads.withColumn("draw__", F.row_number().over(order)).where(F.col("draw__") <= most).drop("draw__")


def consensus_counts(fams: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return fams.where("allele is not null").groupBy(*(keys or SITE), "allele").agg(F.count(F.lit(1)).alias("consensus_count"))


def family_size_histogram(fams: DataFrame) -> DataFrame:
    return fams.groupBy("family_size").agg(F.count(F.lit(1)).alias("n_families"))


def efficiency(fams: DataFrame, least: int = 3, most: int = 1000) -> DataFrame:
    """Counts, consensus rate and sizes, before any size filter; one row."""
    sizes = fams.groupBy("family_size").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("family_size").alias("mean_distinct_family_size"))
    return fams.agg(
        F.count(F.lit(1)).alias("total_families"),
        F.count("allele").alias("consensus_families"),
        (F.count("allele") / F.count(F.lit(1))).alias("consensus_rate"),
        F.sum("family_size").alias("total_reads"),
        F.avg("family_size").alias("mean_family_size"),
        F.count(F.when(F.col("family_size") < least, 1)).alias("families_below_threshold"),
        F.count(F.when(F.col("family_size") > most, 1)).alias("families_above_threshold"),
    ).join(F.broadcast(sizes))


def consensus_sequence(reads: DataFrame, keys: list[str], sequence: str = "sequence") -> DataFrame:
    """Majority base at each position of a family's reads (ties to the first base), and all bases counted."""
    bases = reads.select(*keys, F.posexplode(F.filter(F.split(F.col(sequence), ""), lambda b: b != "")).alias("at", "base"))
    counts = bases.groupBy(*keys, "at", "base").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys, "at").agg(F.max_by("base", F.struct("n", -F.ascii("base"))).alias("base"), F.sum("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "base")))
    return best.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["base"]), "").alias("consensus"), F.sum("n").alias("n_bases"))


def locus_summary(reads: DataFrame, least: int = 2) -> DataFrame:
    """Per sample and locus over families of `least` reads or more: alt reads, reads, families, mean and largest size."""
    fams = reads.groupBy("sample_id", "chrom", "pos", "umi").agg(F.count(F.lit(1)).alias("family_size"), F.count(F.when(F.col("alt") != F.col("ref"), 1)).alias("alts"))
    return fams.where(F.col("family_size") >= least).groupBy("sample_id", "chrom", "pos").agg(
        F.sum("alts").alias("alt_count"), F.sum("family_size").alias("total_count"), F.count(F.lit(1)).alias("family_count"), F.avg("family_size").alias("mean_family_size"), F.max("family_size").alias("max_family_size"))


def locus_sizes(reads: DataFrame, least: int = 2) -> DataFrame:
    """Per sample and locus the sizes of its families of `least` reads or more and how many have each: as many entries as there are sizes."""
    fams = reads.groupBy("sample_id", "chrom", "pos", "umi").agg(F.count(F.lit(1)).alias("family_size")).where(F.col("family_size") >= least)
    sizes = fams.groupBy("sample_id", "chrom", "pos", "family_size").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("sample_id", "chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("family_size", "n"))).alias("sizes"))


def unsent(table: DataFrame) -> DataFrame:
    """A table with rows for each UMI is never broadcast: stored or shuffled, it is a tenth of its size in memory or less, so Spark would take it for small."""
    return table.hint("merge")


def umi_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy(*FAMILY).agg(F.count(F.lit(1)).alias("n"))


def masked(umi: str, distance: int) -> Column:
    """All forms of a UMI with `distance` positions masked; one without letters if it has no more than these."""
    forms = F.array(F.struct(F.col(umi).alias("text"), F.lit(0).alias("last")))
    n = F.length(umi)
    for _ in range(distance):
        hide = lambda f: F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i > f["last"]), lambda i: F.struct(F.overlay(f["text"], F.lit("*"), i, F.lit(1)).alias("text"), i.alias("last")))
        forms = F.flatten(F.transform(forms, hide))
    return F.when(n > distance, F.transform(forms, lambda f: f["text"])).when(F.col(umi).isNotNull(), F.array(F.repeat(F.lit("*"), n)))


def mask_groups(umis: DataFrame, distance: int = 1, keys: list[str] | None = None) -> DataFrame:
    """keys, umi, mask: UMIs that agree on a mask differ in the masked places only, so a group has at most 5 ** distance of them."""
    return umis.where("umi is not null").select(*(keys or SITE), "umi", F.explode(masked("umi", distance)).alias("mask"))


def neighbours(umis: DataFrame, distance: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Pairs (umi, other) with umi < other of equal length and Hamming distance 1 to `distance`, at the same site; umis has a row a UMI.

    Candidates share a form with `distance` masked positions, so a site with any number of UMIs never compares more than a handful at
    a time. They meet by one hash of site and form; a pair at distance `distance` meets once."""
    keys = keys or SITE
    known = umis.where(" and ".join(f"`{k}` is not null" for k in keys))
    keyed = mask_groups(known, distance, keys).select(*keys, "umi", F.xxhash64(*keys, "mask").alias("h"))
    a, b = keyed.alias("a"), unsent(keyed).alias("b")
    # sites are compared after the join, so that it sorts by the hash alone
    same = [F.nullif(F.col(f"a.{k}"), F.col(f"b.{k}")).isNull() for k in keys]
    near = dna.hamming("a.umi", "b.umi") <= distance
    pairs = a.join(b, [F.col("a.h") == F.col("b.h"), F.col("a.umi") < F.col("b.umi"), near, *same]).select(*(F.col(f"a.{k}") for k in keys), F.col("a.umi"), F.col("b.umi").alias("other"))
    return pairs if distance == 1 else pairs.distinct()


def distances(umis: DataFrame, keys: list[str] | None = None, slices: int = 32) -> DataFrame:
    """keys, umi, other, distance: every ordered pair of a site's UMIs, itself included, with its Hamming distance; umis has a row a UMI.

    The job is quadratic in a site's UMIs. One side is dealt into `slices` of each site, the other is sent to all of them, so that a large
    site is not one task; nothing is collected, the pairs are streamed."""
    keys = keys or SITE
    umis = cut(umis.select(*keys, "umi"))
    one = umis.select(*keys, "umi", F.pmod(F.xxhash64("umi"), F.lit(slices)).alias("slice__"))
    other = umis.select(*keys, F.col("umi").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice__"))
    return one.join(unsent(other), [*keys, "slice__"]).select(*keys, "umi", "other", dna.hamming("umi", "other").cast("long").alias("distance"))


def both_ways(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair (umi, other) and its mirror image."""
    ways = F.array(F.struct("umi", "other"), F.struct(F.col("other").alias("umi"), F.col("umi").alias("other")))
    return pairs.select(*keys, F.inline(ways))


def cross_length_pairs(umis: DataFrame, distance: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Pairs of different length within Levenshtein `distance`, by shared deletion variants."""
    keys = keys or SITE

    def shorter(variants: Column) -> Column:
        one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))
        return F.array_distinct(F.concat(variants, F.flatten(F.transform(variants, one))))

    variants = F.array("umi")
    for _ in range(distance):
        variants = shorter(variants)
    keyed = umis.select(*keys, "umi", F.explode(variants).alias("variant"))
    other = keyed.select(*keys, "variant", F.col("umi").alias("other"))
    close = (F.length("umi") < F.length("other")) & (F.levenshtein("umi", "other") <= distance)
    return keyed.join(unsent(other), [*keys, "variant"]).where(close).select(*keys, "umi", "other").distinct()


def cluster_components(umis: DataFrame, pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, umi and cluster: the smallest UMI of its connected component, by label propagation with pointer jumping."""
    keys = keys or SITE
    both = cut(both_ways(pairs, keys))
    labels = cut(umis.select(*keys, "umi").distinct().withColumn("cluster", F.col("umi")))
    while True:
        other = labels.select(*keys, F.col("umi").alias("other"), F.col("cluster").alias("theirs"))
        heard = both.join(unsent(other), [*keys, "other"]).groupBy(*keys, "umi").agg(F.min("theirs").alias("theirs"))
        near = labels.join(unsent(heard), [*keys, "umi"], "left").select(*keys, "umi", F.col("cluster").alias("was"), F.least("cluster", F.coalesce("theirs", "cluster")).alias("near"))
        jump = labels.select(*keys, F.col("umi").alias("near"), F.col("cluster").alias("far"))
        after = cut(near.join(unsent(jump), [*keys, "near"], "left").select(*keys, "umi", F.least("near", F.coalesce("far", "near")).alias("cluster"), "was"))
        drop(labels)
        labels = after.select(*keys, "umi", "cluster")
        if after.where("cluster < was").isEmpty():
            return labels


def cluster_greedy(counts: DataFrame, pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, umi and cluster (its seed). Seeds in order of (count desc, umi) absorb every neighbour not yet taken.

    A UMI is a seed once all its neighbours of higher priority are known to be absorbed, and absorbed once one of them is a
    seed; it then belongs to the first such seed. This decides whole fronts a round and equals the one-by-one result."""
    keys = keys or SITE
    ranked = counts.select(*keys, "umi", F.struct((-F.col("n")).alias("minus"), F.col("umi").alias("u")).alias("rank"))
    both = both_ways(pairs, keys)
    other = ranked.select(*keys, F.col("umi").alias("other"), F.col("rank").alias("their_rank"))
    before = cut(both.join(unsent(ranked), [*keys, "umi"]).join(unsent(other), [*keys, "other"]).where("their_rank < rank").select(*keys, "umi", "other", "their_rank"))
    state = cut(ranked.select(*keys, "umi", F.lit(None).cast("string").alias("seed")))
    while True:
        theirs = state.select(*keys, F.col("umi").alias("other"), F.col("seed").alias("their_seed"))
        seen = before.join(unsent(theirs), [*keys, "other"]).groupBy(*keys, "umi").agg(
            F.count(F.when(F.col("their_seed").isNull(), 1)).alias("open"),
            F.min(F.when(F.col("their_seed") == F.col("other"), F.col("their_rank"))).alias("first"),
            F.min(F.when(F.col("their_seed").isNull(), F.col("their_rank"))).alias("undecided"),
        )
        # absorbed by the first seed once no undecided neighbour of higher priority than that seed remains
        sure = F.col("first").isNotNull() & (F.col("undecided").isNull() | (F.col("first") < F.col("undecided")))
        seed = F.coalesce("seed", F.when(sure, F.col("first.u")), F.when(F.col("first").isNull() & (F.coalesce("open", F.lit(0)) == 0), F.col("umi")))
        after = cut(state.join(unsent(seen), [*keys, "umi"], "left").select(*keys, "umi", seed.alias("seed")))
        drop(state)
        state = after
        if state.where("seed is null").isEmpty():
            return state.withColumnRenamed("seed", "cluster")


def cluster_fast(counts: DataFrame, distance: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Greedy clusters among equal lengths, then clusters of different lengths joined by Levenshtein distance."""
    keys = keys or SITE
    greedy = cluster_greedy(counts, neighbours(counts, distance, keys), keys)
    seeds = greedy.select(*keys, F.col("cluster").alias("umi")).distinct()
    merged = cluster_components(seeds, cross_length_pairs(seeds, distance, keys), keys)
    return greedy.join(unsent(merged.select(*keys, F.col("umi").alias("cluster"), F.col("cluster").alias("merged"))), [*keys, "cluster"]).select(*keys, "umi", F.col("merged").alias("cluster"))


def cluster_stats(clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    sizes = clusters.groupBy(*(keys or SITE), "cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n_umis"), F.avg("size").alias("mean_cluster_size"), F.max("size").alias("max_cluster_size"))


def clustered_reads(reads: DataFrame, clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Reads with their UMI replaced by its cluster, ready for `families`."""
    keys = keys or SITE
    return reads.join(clusters.select(*keys, "umi", "cluster"), [*keys, "umi"]).drop("umi").withColumnRenamed("cluster", "umi")
