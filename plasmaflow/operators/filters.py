"""Variant and read filters as column expressions; a filter whose inputs are missing passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plasmaflow.functions import tails


def depth_filter(df: DataFrame, min_alt: int = 2, min_depth: int = 10) -> DataFrame:
    """depth_filter and depth_filter_reason; too few alt reads is named before too little depth."""
    reason = F.when(F.col("alt_count") < min_alt, "insufficient_alt_count").when(F.col("total_depth") < min_depth, "insufficient_total_depth")
    return df.withColumn("depth_filter_reason", reason).withColumn("depth_filter", F.col("depth_filter_reason").isNull())


def from_lists(df: DataFrame, margin: int = 10, read_length: int = 150) -> DataFrame:
    """The sums that the filters need, from a variant's lists quality_scores and read_positions where df has these."""
    if "quality_scores" in df.columns:
        total = F.aggregate(F.col("quality_scores").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
        df = df.withColumn("n_qualities", F.size("quality_scores")).withColumn("site_quality", F.when(F.col("n_qualities") > 0, total / F.col("n_qualities")))
    if "read_positions" in df.columns:
        near = F.size(F.filter("read_positions", lambda p: (p <= margin) | (p >= read_length - margin)))
        df = df.withColumn("n_positions", F.size("read_positions")).withColumn("near_ends", near)
    return df.drop("quality_scores", "read_positions")


def quality_filter(df: DataFrame, least: float = 20.0) -> DataFrame:
    """By site_quality, the mean of n_qualities base qualities."""
    df = from_lists(df)
    reason = F.when(F.col("n_qualities") == 0, "no_quality_scores").when(F.col("site_quality") < least, "low_quality")
    return df.withColumn("quality_filter_reason", reason).withColumn("quality_filter", F.col("quality_filter_reason").isNull())


def strand_bias_filter(df: DataFrame, alpha: float = 0.01, extreme: float = 0.95, least: int = 4) -> DataFrame:
    """Fails if Fisher's p of (ref, alt) x (forward, reverse) is under alpha and the alt reads are nearly all on one strand; keeps strand_p and strand_odds."""
    counts = ["ref_forward", "ref_reverse", "alt_forward", "alt_reverse"]
    out = df.withColumn("strand", tails.fisher_test(*counts))
    out = out.withColumn("strand_p", F.col("strand.p_value")).withColumn("strand_odds", F.col("strand.odds_ratio")).drop("strand")
    alts = F.col("alt_forward") + F.col("alt_reverse")
    total = alts + F.col("ref_forward") + F.col("ref_reverse")
    share = F.when(alts > 0, F.col("alt_forward") / alts)
    biased = (F.col("strand_p") < alpha) & ((share > extreme) | (share < 1 - extreme))
    reason = F.when(total < least, "insufficient_data_for_strand_test").when(biased, "strand_bias")
    return out.withColumn("strand_bias_filter_reason", reason).withColumn("strand_bias_filter", F.coalesce(F.col("strand_bias_filter_reason") != "strand_bias", F.lit(True)))


def end_repair_filter(df: DataFrame, read_length: int = 150, margin: int = 10, alpha: float = 0.05) -> DataFrame:
    """For G>T and C>A: fails if more of the n_positions read positions are near the read ends (near_ends) than chance allows, and over twice the
    expected number."""
    df = from_lists(df, margin, read_length)
    pattern = F.concat("ref", F.lit(">"), "alt").isin("G>T", "C>A") & (F.col("n_positions") > 0)
    share = 2 * margin / read_length
    out = df.withColumn("near__", F.when(pattern, F.col("near_ends"))).withColumn("of__", F.when(pattern, F.col("n_positions")))
    out = out.withColumn("end_repair_p", tails.binom_greater(F.col("near__"), F.col("of__"), F.lit(share)))
    bad = pattern & (F.col("end_repair_p") < alpha) & (F.col("near_ends") > 2 * share * F.col("n_positions"))
    reason = F.when(bad, "end_repair_artifact")
    return out.drop("near__", "of__").withColumn("end_repair_filter_reason", reason).withColumn("end_repair_filter", reason.isNull())


FILTERS = ["depth_filter", "quality_filter", "strand_bias_filter", "end_repair_filter"]


def all_filters(df: DataFrame) -> DataFrame:
    """The four filters, all_filters_passed, and the numbers applied, passed and failed."""
    out = end_repair_filter(strand_bias_filter(quality_filter(depth_filter(from_lists(df)))))
    passed = sum((F.col(f).cast("int") for f in FILTERS), F.lit(0))
    return out.withColumn("n_applied", F.lit(len(FILTERS))).withColumn("n_passed", passed).withColumn("n_failed", F.lit(len(FILTERS)) - passed).withColumn("all_filters_passed", passed == len(FILTERS))


def failed_names(df: DataFrame) -> Column:
    return F.array_compact(F.array(*(F.when(~F.col(f), F.lit(f)) for f in FILTERS)))


def filter_report(df: DataFrame) -> DataFrame:
    """Per filter the passed and failed numbers and the pass rate."""
    long = df.select(*(F.col(f).cast("int").alias(f) for f in FILTERS)).unpivot([], FILTERS, "filter", "passed")
    return long.groupBy("filter").agg(F.sum("passed").alias("n_passed"), F.sum(1 - F.col("passed")).alias("n_failed"), F.avg("passed").alias("pass_rate"))


def reason_histogram(df: DataFrame) -> DataFrame:
    long = df.select(*(F.col(f"{f}_reason") for f in FILTERS)).unpivot([], [f"{f}_reason" for f in FILTERS], "filter", "reason")
    return long.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def end_repair_flag(position: str = "read_position", margin: int = 10, read_length: int = 150) -> Column:
    return F.concat("ref", F.lit(">"), "alt").isin("G>T", "C>A") & ((F.col(position) <= margin) | (F.col(position) >= read_length - margin))


def collapsed_passes(fams: DataFrame, min_quality: float = 20.0, min_agreement: float = 0.6) -> DataFrame:
    quality = F.coalesce(F.col("mean_quality") >= min_quality, F.lit(False))
    agreement = F.coalesce(F.col("consensus_agreement") >= min_agreement, F.lit(False))
    return fams.withColumn("passes_quality", quality).withColumn("passes_consensus", agreement).withColumn("is_variant", quality & agreement & F.coalesce(F.col("allele") != F.col("ref"), F.lit(False)))


def dynamic_thresholds(fams: DataFrame, configured: int = 3) -> DataFrame:
    """One row: quality threshold max(10, int(0.8 mean quality)), least family size max(1, min(configured, upper median / 2))."""
    sizes = fams.agg(F.avg("mean_quality").alias("q"), F.expr("percentile_disc(0.5) within group (order by family_size desc)").alias("m"))
    return sizes.select(F.greatest(F.lit(10), F.floor(0.8 * F.col("q"))).cast("int").alias("min_quality"), F.greatest(F.lit(1), F.least(F.lit(configured), F.floor(F.col("m") / 2))).cast("int").alias("min_family_size"))


def perturb_grid(fams: DataFrame, factors: tuple[float, ...] = (0.8, 0.9, 1.1, 1.2)) -> DataFrame:
    """kind, factor, n_families and the mean size, quality and background rate, quality and variant rate with one of them scaled and clipped: sizes
    cut to whole reads in 1 to 1000, qualities to 0 to 40, rates (if fams has background_rate) to 1e-6 to 1e-2. One scan, conditional sums."""
    clip = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    scaled = {
        "family_size": lambda f: clip(F.floor(F.col("family_size") * f), 1, 1000).cast("double"),
        "quality": lambda f: clip(F.col("mean_quality") * f, 0.0, 40.0),
        "background_rate": lambda f: clip(F.col("background_rate") * f, 1e-6, 1e-2),
    }
    kinds = [k for k in scaled if k != "background_rate" or k in fams.columns]
    plain = {"family_size": F.col("family_size").cast("double"), "quality": F.col("mean_quality"), "background_rate": F.col("background_rate") if "background_rate" in fams.columns else F.lit(None).cast("double")}
    sums = {"n": F.count(F.lit(1)), "variant_rate": F.avg(F.col("is_variant").cast("int")), "good": F.avg((plain["quality"] >= 20).cast("int"))} | {k: F.avg(c) for k, c in plain.items()}
    for i, f in enumerate(factors):
        sums |= {f"{k}_{i}": F.avg(scaled[k](f)) for k in kinds} | {f"good_{i}": F.avg((scaled["quality"](f) >= 20).cast("int"))}
    row = fams.agg(*(c.alias(k) for k, c in sums.items()))
    own = lambda k, kind, i: F.col(f"{k}_{i}" if k == kind or (k == "good" and kind == "quality") else k)
    cells = [
        F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("factor"), F.col("n").alias("n_families"), own("family_size", kind, i).alias("mean_size"), own("quality", kind, i).alias("mean_quality"),
                 own("background_rate", kind, i).alias("mean_background"), own("good", kind, i).alias("quality_rate"), "variant_rate")
        for kind in kinds for i, f in enumerate(factors)
    ]
    return row.select(F.inline(F.array(*cells)))
