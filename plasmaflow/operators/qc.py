"""Quality control and strata: aggregates over families, sites, runs and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.operators import quantiles

SITE = ["chrom", "pos", "ref"]


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def percentile(column: str, q: float) -> Column:
    return F.expr(f"percentile({column}, {q!r})")


def distribution(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    sums = df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.min(column).alias("least"), F.max(column).alias("most"))
    return quantiles.attach(sums, quantiles.exact(df, column, {"median": 0.5, "q25": 0.25, "q75": 0.75}, by), by)


def family_size_stats(fams: DataFrame) -> DataFrame:
    """Distribution of family sizes with population skewness and excess kurtosis."""
    return fams.agg(
        F.count(F.lit(1)).alias("n_families"), F.avg("family_size").alias("mean"), percentile("family_size", 0.5).alias("median"), F.stddev_pop("family_size").alias("sd"),
        F.min("family_size").alias("least"), F.max("family_size").alias("most"), percentile("family_size", 0.25).alias("q25"), percentile("family_size", 0.75).alias("q75"),
        F.skewness("family_size").alias("skew"), F.kurtosis("family_size").alias("kurtosis"))


def size_issues(stats: DataFrame) -> DataFrame:
    flags = [(F.col("mean") < 2, "low_mean_family_size"), (F.col("median") < 2, "low_median_family_size"), (F.col("skew") > 3, "highly_skewed")]
    return stats.withColumn("issues", F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in flags))))


def depth_metrics(counts: DataFrame, low: int = 100) -> DataFrame:
    """Over per-site depths: sum, mean, median, extremes, sample sd, sites under `low`, cv, and the share within twice the median."""
    depths = counts.groupBy(*SITE).agg(F.sum("consensus_count").alias("depth"))
    median = depths.agg(percentile("depth", 0.5).alias("m"))
    return depths.join(F.broadcast(median)).agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum("depth").alias("total_depth"), F.avg("depth").alias("mean_depth"), F.max("m").alias("median_depth"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"),
        F.stddev_samp("depth").alias("sd_depth"), F.count(F.when(F.col("depth") < low, 1)).alias("low_sites"), (F.stddev_samp("depth") / F.avg("depth")).alias("cv"),
        rate((F.col("depth") >= F.col("m") / 2) & (F.col("depth") <= F.col("m") * 2)).alias("uniformity"))


def consensus_efficiency(fams: DataFrame, least: int = 3, most: int = 1000) -> DataFrame:
    size = F.col("family_size")
    inside = (size >= least) & (size <= most)
    return fams.agg(F.count(F.lit(1)).alias("n_families"), F.count(F.when(size < least, 1)).alias("n_below"), F.count(F.when(size > most, 1)).alias("n_above"), rate(size < least).alias("share_below"), rate(size > most).alias("share_above"), F.count(F.when(inside, 1)).alias("n_effective"), rate(inside).alias("share_effective"))


def site_qc(fams: DataFrame, least_families: int = 10, least_rate: float = 0.8, least_depth: int = 100) -> DataFrame:
    """Every site's families, consensus rate, mean size, depth, alleles and deepest allele, the failed criteria and the verdict."""
    whole = fams.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n_families"), F.avg(F.col("allele").isNotNull().cast("int")).alias("consensus_rate"), F.avg("family_size").alias("mean_size"), F.count("allele").alias("depth"))
    alleles = fams.where("allele is not null").groupBy(*SITE, "allele").agg(F.count(F.lit(1)).alias("n")).groupBy(*SITE).agg(F.count(F.lit(1)).alias("n_alleles"), F.max("n").alias("max_allele_depth"))
    out = whole.join(alleles, SITE, "left").fillna(0, ["n_alleles", "max_allele_depth"])
    failed = F.array_compact(F.array(F.when(F.col("n_families") < least_families, F.lit("families")), F.when(F.col("consensus_rate") < least_rate, F.lit("consensus")), F.when(F.col("depth") < least_depth, F.lit("depth"))))
    return out.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)


def sample_guardrails(fams: DataFrame, contamination: DataFrame, least_families: int = 1000, most_contamination: float = 0.05, least_rate: float = 0.8, least_depth: int = 100) -> DataFrame:
    """Per sample: families, consensus rate, mean depth of its sites, contamination; `failed` names all missed limits and gives quality_score.

    Too few families and contamination make a sample invalid (failed_criteria); a low consensus rate or depth only warns (warnings)."""
    sites = fams.groupBy("sample_id", *SITE).agg(F.count("allele").alias("depth"), F.count(F.lit(1)).alias("families"))
    sample = sites.groupBy("sample_id").agg(F.sum("families").alias("n_families"), (F.sum("depth") / F.sum("families")).alias("consensus_rate"), F.avg("depth").alias("mean_depth"))
    out = sample.join(contamination.select("sample_id", "contamination"), "sample_id", "left").fillna(0.0, ["contamination"])
    checks = [(F.col("n_families") < least_families, "families"), (F.col("contamination") > most_contamination, "contamination"), (F.col("consensus_rate") < least_rate, "consensus"), (F.col("mean_depth") < least_depth, "depth")]
    failed = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks)))
    criteria = F.array_compact(F.array(
        F.when(checks[0][0], F.format_string(f"insufficient_total_families: %d < {least_families}", "n_families")),
        F.when(checks[1][0], F.format_string(f"high_contamination: %.4f > {most_contamination}", "contamination"))))
    warnings = F.array_compact(F.array(
        F.when(checks[2][0], F.format_string(f"low_consensus_rate: %.4f < {least_rate}", "consensus_rate")),
        F.when(checks[3][0], F.format_string(f"low_mean_depth: %.1f < {least_depth}", "mean_depth"))))
    out = out.withColumn("failed", F.array_join(failed, ",")).withColumn("quality_score", 1 - F.size(failed) / len(checks))
    return out.withColumn("failed_criteria", criteria).withColumn("warnings", warnings).withColumn("sample_valid", F.size("failed_criteria") == 0)


def mini_qc(loci: DataFrame) -> DataFrame:
    return loci.agg(F.avg("total_count").alias("coverage"), (1 - F.avg("mean_family_size") / F.max("max_family_size")).alias("duplication"), F.count(F.lit(1)).alias("n_loci"), F.sum("family_count").alias("n_families"))


def lod_grid(collapsed: DataFrame, by: list[str]) -> DataFrame:
    return collapsed.groupBy(*by).agg(rate(F.col("alt_reads") > 0).alias("detection_rate"), F.avg("alt_reads").alias("mean_alt"))


def detection_matrix(runs: DataFrame) -> DataFrame:
    d = F.col("detected").cast("double")
    return runs.groupBy("allele_fraction", "umi_depth").agg(F.round(F.avg(d), 4).alias("rate"), F.round(F.stddev_samp(d), 4).alias("sd"), F.count(F.lit(1)).alias("n"))


def run_summary(tested: DataFrame, by: list[str]) -> DataFrame:
    """By setting the mean, median and sample sd of p and effect, and the mean and sd of the alt count and the depth."""
    names = [("p_value", "p"), ("effect_size", "effect"), ("alt_count", "alt"), ("total_depth", "depth")]
    out = tested.groupBy(*by).agg(*(f(c).alias(f"{k}_{n}") for c, n in names for f, k in ((F.avg, "mean"), (F.stddev_samp, "sd"))))
    for c, n in names[:2]:
        out = quantiles.attach(out, quantiles.exact(tested, c, {f"median_{n}": 0.5}, by), by)
    return out


def detection_heatmap(runs: DataFrame, depths: list[int]) -> DataFrame:
    return runs.groupBy("allele_fraction").pivot("umi_depth", depths).agg(rate(F.col("detected")))


def stratified_power(runs: DataFrame, by: list[str], replicate: str = "replicate_id") -> DataFrame:
    each = runs.groupBy(*by, replicate).agg(rate(F.col("detected")).alias("r"))
    return each.groupBy(*by).agg(F.avg("r").alias("power"), F.stddev_pop("r").alias("sd"), F.count(F.lit(1)).alias("n_replicates"))


def umi_vs_read_af(reads: DataFrame, fams: DataFrame) -> DataFrame:
    """Per sample the allele fraction by reads and by molecules, and whether the latter is under half of the former."""
    r = reads.groupBy("sample_id").agg(rate(F.col("alt") != F.col("ref")).alias("read_af"))
    f = fams.where("allele is not null").groupBy("sample_id").agg(rate(F.col("allele") != F.col("ref")).alias("umi_af"))
    return r.join(f, "sample_id").withColumn("suspicious", F.col("umi_af") < 0.5 * F.col("read_af"))


def job_success(jobs: DataFrame) -> DataFrame:
    done, failed = F.count(F.when(F.col("status") == "completed", 1)), F.count(F.when(F.col("status") == "failed", 1))
    return jobs.agg(F.count(F.lit(1)).alias("n_jobs"), done.alias("n_completed"), failed.alias("n_failed"), (done / (done + failed)).alias("success_rate"), F.avg(F.when(F.col("status") == "completed", F.col("duration_s"))).alias("mean_duration"))


def hourly_status(jobs: DataFrame) -> DataFrame:
    """Counts by hour and status; the same for batch and streaming frames."""
    return jobs.groupBy(F.window("created_at", "1 hour").alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "status", "n")


def rank_models(scores: DataFrame) -> DataFrame:
    """Models by falling AUC to six decimals (few rows); equal ones share a place."""
    return scores.withColumn("place", F.rank().over(W.orderBy(F.desc(F.round("auc", 6))))).withColumn("best", F.col("place") == 1)
