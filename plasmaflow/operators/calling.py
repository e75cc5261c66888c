"""Calls: sample and variant tests against the background, and their combination."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.functions import tails
from plasmaflow.operators import errors, multiple, quantiles
from plasmaflow.operators.lineage import cut


def sample_counts(fams: DataFrame) -> DataFrame:
    """Per sample the variant and all families, mean quality and agreement."""
    return fams.groupBy("sample_id").agg(F.count(F.when(F.col("is_variant"), 1)).alias("n_variants"), F.count(F.lit(1)).alias("n_total"), F.avg("mean_quality").alias("mean_quality"), F.avg("consensus_agreement").alias("mean_consensus"))


def provenance(df: DataFrame, settings: dict) -> DataFrame:
    """df with the settings as columns and config_hash, the SHA-256 of their JSON with sorted keys."""
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()
    return df.withColumns({k: F.lit(v) for k, v in settings.items()} | {"config_hash": F.lit(digest)})


def call_samples(fams: DataFrame, rate: DataFrame, test: str = "poisson", alpha: float = 0.05, method: str = "bh") -> DataFrame:
    """A test of each sample's variant families against n_total * mean error rate (rate: one row, error_rate)."""
    counts = sample_counts(fams).join(F.broadcast(rate.select(F.avg("error_rate").alias("rate"))))
    counts = cut(counts).withColumn("expected_variants", F.col("n_total") * F.col("rate")).withColumn("variant_fraction", F.col("n_variants") / F.col("n_total"))
    counts = counts.withColumn("fold_change", F.when(F.col("expected_variants") > 0, F.col("n_variants") / F.col("expected_variants")))
    if test == "poisson":
        tested = counts.withColumn("p_value", tails.poisson_two_sided("n_variants", "expected_variants"))
    else:
        tested = counts.withColumn("p_value", tails.binom_two_sided("n_variants", "n_total", "rate"))
    out = multiple.adjust(cut(tested), "p_value", method=method, alpha=alpha)
    return provenance(out.drop("rate"), {"test_type": test, "alpha": alpha, "fdr_method": method})


def test_variants(variants: DataFrame, rates: DataFrame, test: str = "poisson", alternative: str = "greater", alpha: float = 0.05, method: str = "bh") -> DataFrame:
    """Rows (site_key, context, alt_count, total_depth) tested against their context's rate: expected, p_value, effect_size, p_adjusted, significant.

    The binomial test also gives the Clopper-Pearson bounds ci_lower and ci_upper of the alternative; its effect is a log odds ratio."""
    valid = variants.where("alt_count >= 0 and total_depth > 0 and alt_count <= total_depth")
    rated = cut(errors.join_context_rate(valid, rates)).withColumn("expected", F.col("total_depth") * F.col("expected_rate"))
    if test == "poisson":
        tail = {"greater": tails.poisson_greater, "less": tails.poisson_less, "two-sided": tails.poisson_two_sided}[alternative]
        tested = rated.withColumn("p_value", tail("alt_count", "expected"))
        effect = F.log(F.col("alt_count") + 1e-8) - F.log(F.col("expected") + 1e-8)
    else:
        tested = rated.withColumn("test", tails.binomial_test[alternative]("alt_count", "total_depth", "expected_rate"))
        tested = tested.select("*", "test.*").drop("test")
        tiny, p, q = 1e-12, F.col("alt_count") / F.col("total_depth"), F.col("expected_rate")
        logit = lambda x: F.log(x + tiny) - F.log(1 - x + tiny)
        effect = F.when((q > tiny) & (q < 1 - tiny), logit(p) - logit(q)).otherwise(F.least(F.greatest(p / (q + tiny), F.lit(tiny)), F.lit(1e12)))
    out = multiple.adjust(cut(tested.withColumn("effect_size", effect)), "p_value", method=method, alpha=alpha)
    return out.withColumn("significant_uncorrected", F.col("p_value") <= alpha)


def call_beta_binomial(loci: DataFrame, params: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per locus (alt_count, total_count): tail p with the locus' alpha and beta (the mean parameters where it has none), signed
    z, q and call."""
    mean = params.agg(F.avg("alpha").alias("alpha_mean"), F.avg("beta").alias("beta_mean"))
    joined = loci.join(params, ["chrom", "pos"], "left").join(F.broadcast(mean))
    joined = joined.withColumn("alpha", F.coalesce("alpha", "alpha_mean")).withColumn("beta", F.coalesce("beta", "beta_mean")).drop("alpha_mean", "beta_mean")
    tested = cut(joined).withColumn("depth", F.greatest("total_count", F.lit(1)))
    tested = tested.withColumn("p_value", tails.beta_binomial_sf("alt_count", "depth", "alpha", "beta"))
    sign = F.when(F.col("alt_count") / F.col("depth") >= F.col("alpha") / (F.col("alpha") + F.col("beta")), 1.0).otherwise(-1.0)
    tested = tested.withColumn("z", sign * F.abs(tails.norm_isf(F.col("p_value") / 2)))
    return multiple.adjust(cut(tested), "p_value", alpha=alpha)


def stouffer(loci: DataFrame, by: str = "sample_id") -> DataFrame:
    """Depth-weighted z of a patient's loci and its upper tail."""
    out = loci.groupBy(by).agg((F.sum(F.sqrt("depth") * F.col("z")) / F.sqrt(F.sum("depth"))).alias("z"))
    return out.withColumn("p_value", tails.norm_sf("z"))


def fisher_combine(loci: DataFrame, by: list[str]) -> DataFrame:
    """-2 sum(ln p) with 2n degrees of freedom; p is floored at 1e-300."""
    out = loci.groupBy(*by).agg((-2 * F.sum(F.log(F.greatest("p_value", F.lit(1e-300))))).alias("statistic"), (2 * F.count("p_value")).alias("df"))
    return out.withColumn("combined_p", tails.chi2_sf("statistic", "df"))


def detection_power(calls: DataFrame, effect: float = 0.01, alpha: float = 0.05) -> DataFrame:
    """calls with the power to detect an allele fraction of `effect` above the background at each sample's own number of families."""
    wanted = cut(calls.withColumn("expected_found", F.col("expected_variants") + effect * F.col("n_total")))
    return wanted.withColumn("power", tails.poisson_power("expected_variants", "expected_found", alpha))


def signed_z(calls: DataFrame) -> DataFrame:
    """Sample calls with z, the normal quantile of their p with the sign of the excess, and depth, its weight in `stouffer`."""
    sign = F.when(F.col("n_variants") >= F.col("expected_variants"), 1.0).otherwise(-1.0)
    return calls.withColumn("z", sign * F.abs(tails.norm_isf(F.col("p_value") / 2))).withColumn("depth", F.col("n_total"))


def call_summary(calls: DataFrame) -> DataFrame:
    """One row: positives, tests, least p, and the global tests over rows(z, depth, p_value): depth-weighted z with its upper tail, Fisher's statistic and p."""
    out = calls.agg(
        F.count(F.when(F.col("significant"), 1)).alias("n_positive"), F.count(F.lit(1)).alias("n_total"), F.min("p_value").alias("min_p"),
        (F.sum(F.sqrt("depth") * F.col("z")) / F.sqrt(F.sum("depth"))).alias("stouffer_z"),
        (-2 * F.sum(F.log(F.greatest("p_value", F.lit(1e-300))))).alias("fisher_stat"), (2 * F.count("p_value")).alias("df"))
    return out.withColumn("stouffer_p", tails.norm_sf("stouffer_z")).withColumn("fisher_p", tails.chi2_sf("fisher_stat", "df")).drop("df")


def summarise_tests(tested: DataFrame, test: str = "poisson", method: str = "bh", alpha: float = 0.05) -> DataFrame:
    """One row over tested variants: numbers of tests and findings, median, least and largest p, median q, and the mean, median and largest finite effect."""
    rows = cut(tested.select("p_value", "p_adjusted", "significant", "significant_uncorrected", F.when(F.abs(F.col("effect_size")) < float("inf"), F.col("effect_size")).alias("effect")))
    out = rows.agg(
        F.count(F.lit(1)).alias("n_tests"), F.count(F.when(F.col("significant"), 1)).alias("n_significant"), F.count(F.when(F.col("significant_uncorrected"), 1)).alias("n_uncorrected"),
        F.min("p_value").alias("min_p"), F.max("p_value").alias("max_p"), F.avg("effect").alias("mean_effect"), F.max("effect").alias("max_effect"))
    for column, name in (("p_value", "median_p"), ("p_adjusted", "median_q"), ("effect", "median_effect")):
        out = out.join(F.broadcast(quantiles.exact(rows, column, {name: 0.5})))
    return out.withColumns({"test_type": F.lit(test), "fdr_method": F.lit(method), "alpha": F.lit(alpha)})
