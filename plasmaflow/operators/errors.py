"""Background error models and trinucleotide contexts. All tables here are small (contexts), except where reads are counted."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.functions import dna, tails

DEFAULT_RATE, UNKNOWN_MUTATION_RATE = 1e-4, 1e-6


def context_error_rates(counts: DataFrame, legacy_denominator: bool = False) -> DataFrame:
    """context, mutation, rate from rows (context, ref, allele, consensus_count): count of each mutation over all counts of its
    normalised context. legacy_denominator leaves reference counts of purine-centred contexts out, for comparison."""
    rows = counts.select(dna.normal_context("context").alias("context"), dna.normal_base("context", "ref").alias("ref"), dna.normal_base("context", "allele").alias("allele"), "consensus_count", dna.purine_centred("context").alias("purine"))
    mutated = F.col("allele") != F.col("ref")
    counted = F.when(mutated | ~F.lit(legacy_denominator) | ~F.col("purine"), F.col("consensus_count"))
    totals = rows.groupBy("context", F.when(mutated, F.concat("ref", F.lit(">"), "allele")).alias("mutation")).agg(F.sum("consensus_count").alias("n"), F.sum(counted).alias("m"))
    whole = F.sum("m").over(W.partitionBy("context"))
    return totals.withColumn("rate", F.col("n") / whole).where("mutation is not null").select("context", "mutation", "rate")


def background_error_mean(counts: DataFrame, least: int = 100) -> DataFrame:
    rows = counts.where((F.col("consensus_count") >= least) & (F.col("allele") != F.col("ref")))
    mutation = F.concat(dna.normal_base("context", "ref"), F.lit(">"), dna.normal_base("context", "allele"))
    return rows.groupBy(dna.normal_context("context").alias("context"), mutation.alias("mutation")).agg(F.avg(1 / F.col("consensus_count")).alias("rate"))


def negative_controls(fams: DataFrame, most: float = 1e-4, af: str = "allele_fraction") -> DataFrame:
    """Rows with an allele fraction up to `most`; if there are none, those at the smallest one."""
    limits = fams.agg(F.count(F.when(F.col(af) <= most, 1)).alias("controls"), F.min(af).alias("least"))
    joined = fams.join(F.broadcast(limits))
    return joined.where(F.when(F.col("controls") > 0, F.col(af) <= most).otherwise(F.col(af) == F.col("least"))).drop("controls", "least")


def fit_error_model(controls: DataFrame, by: str = "context") -> DataFrame:
    """Variant rate of negative-control families by context, with a 95 % interval (exact Beta quantiles of k of n)."""
    return error_rates(controls.groupBy(by).agg(F.count(F.lit(1)).alias("n_observations"), F.count(F.when(F.col("is_variant"), 1)).alias("k")))


def error_rates(fitted: DataFrame) -> DataFrame:
    """`fit_error_model` of families that are counted already: rows with k variants of n_observations."""
    rate = F.col("k") / F.col("n_observations")
    low, high = tails.beta_ppf(F.lit(0.025), F.col("k") + 0.5, F.col("n_observations") - F.col("k") + 0.5), tails.beta_ppf(F.lit(0.975), F.col("k") + 0.5, F.col("n_observations") - F.col("k") + 0.5)
    many = F.col("n_observations") > 10
    return fitted.withColumn("error_rate", rate).withColumn("ci_lower", F.when(many, F.least(low, "error_rate")).otherwise(rate * 0.5)).withColumn("ci_upper", F.when(many, F.greatest(high, "error_rate")).otherwise(rate * 2.0))


def bayes_error_model(controls: DataFrame, by: str = "context", a: float = 1.0, b: float = 10.0) -> DataFrame:
    fitted = controls.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_variant"), 1)).alias("k"))
    p, q = F.col("k") + a, F.col("n") - F.col("k") + b
    return fitted.withColumn("mean", p / (p + q)).withColumn("sd", F.sqrt(p * q / ((p + q) * (p + q) * (p + q + 1)))).withColumn("ci_lower", tails.beta_ppf(F.lit(0.025), p, q)).withColumn("ci_upper", tails.beta_ppf(F.lit(0.975), p, q)).withColumn("median", tails.beta_ppf(F.lit(0.5), p, q)).withColumn("mode", F.when((p > 1) & (q > 1), (p - 1) / (p + q - 2)).otherwise(p / (p + q)))


def wilson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson interval of k of n; (0, 1) without trials."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    p = k / n
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(centre - spread, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(centre + spread, F.lit(1.0))).otherwise(1.0)


def beta_binomial_moments(loci: DataFrame, vaf: Column) -> DataFrame:
    """One row alpha, beta from the mean and sample variance of VAF (variance at least 1e-6; 1000 where moments don't fit)."""
    m = loci.agg(F.avg(vaf).alias("m"), F.greatest(F.coalesce(F.var_samp(vaf), F.lit(0.0)), F.lit(1e-6)).alias("v"))
    common = F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    common = F.when(common <= 0, 1000.0).otherwise(common)
    return m.select((F.col("m") * common).alias("alpha"), ((1 - F.col("m")) * common).alias("beta"))


def error_profile(rates: DataFrame) -> DataFrame:
    """Per context the sum and largest rate and number of mutations, beside mean, median, sd, least and largest of all rates."""
    each = rates.groupBy("context").agg(F.sum("rate").alias("total_rate"), F.max("rate").alias("max_rate"), F.count(F.lit(1)).alias("n_mutations"))
    whole = rates.agg(F.avg("rate").alias("mean_rate"), F.expr("percentile(rate, 0.5)").alias("median_rate"), F.stddev_pop("rate").alias("sd_rate"), F.min("rate").alias("least_rate"), F.max("rate").alias("most_rate"))
    return each.join(F.broadcast(whole))


def context_summary(rates: DataFrame) -> DataFrame:
    """Per context the total rate, number of mutation types, transition and transversion rates and their ratio (null without transversions)."""
    kind = dna.mutation_type(F.substring("mutation", 1, 1), F.substring("mutation", 3, 1))
    out = rates.withColumn("kind", kind).groupBy("context").agg(
        F.sum("rate").alias("total_rate"), F.count(F.lit(1)).alias("n_types"),
        F.coalesce(F.sum(F.when(F.col("kind") == "transition", F.col("rate"))), F.lit(0.0)).alias("transition_rate"),
        F.coalesce(F.sum(F.when(F.col("kind") == "transversion", F.col("rate"))), F.lit(0.0)).alias("transversion_rate"))
    return out.withColumn("ti_tv", F.when(F.col("transversion_rate") > 0, F.col("transition_rate") / F.col("transversion_rate")))


def context_enrichment(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """Observed mutated counts by context against rate times depth."""
    seen = counts.groupBy(dna.normal_context("context").alias("context")).agg(F.sum("consensus_count").alias("depth"), F.sum(F.when(F.col("allele") != F.col("ref"), F.col("consensus_count")).otherwise(0)).alias("observed"))
    each = rates.groupBy("context").agg(F.sum("rate").alias("rate"))
    out = seen.join(F.broadcast(each), "context", "left").withColumn("expected", F.coalesce("rate", F.lit(DEFAULT_RATE)) * F.col("depth"))
    return out.withColumn("enrichment", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")))


def context_thresholds(rates: DataFrame, depth: float) -> DataFrame:
    each = rates.groupBy("context").agg(F.sum("rate").alias("rate")).withColumn("expected", F.col("rate") * depth)
    return each.withColumn("threshold", F.col("expected") + 3 * F.sqrt("expected"))


def join_context_rate(variants: DataFrame, rates: DataFrame) -> DataFrame:
    """expected_rate by context; 1e-4 where unknown or outside [0, 1]."""
    each = rates.select("context", F.col("rate").alias("found"))
    rate = F.coalesce("found", F.lit(DEFAULT_RATE))
    return variants.join(F.broadcast(each), "context", "left").withColumn("expected_rate", F.when((rate < 0) | (rate > 1), DEFAULT_RATE).otherwise(rate)).drop("found")


def join_context_mutation_rate(variants: DataFrame, rates: DataFrame) -> DataFrame:
    """expected_rate by normalised context and mutation: 1e-6 for an unseen mutation of a known context, 1e-4 for an unknown context."""
    keyed = variants.withColumn("key_context", dna.normal_context("context")).withColumn("key_mutation", F.concat(dna.normal_base("context", "ref"), F.lit(">"), dna.normal_base("context", "alt")))
    each = rates.select(F.col("context").alias("key_context"), F.col("mutation").alias("key_mutation"), "rate")
    known = rates.select(F.col("context").alias("key_context")).distinct().withColumn("known", F.lit(True))
    out = keyed.join(F.broadcast(each), ["key_context", "key_mutation"], "left").join(F.broadcast(known), "key_context", "left")
    return out.withColumn("expected_rate", F.coalesce("rate", F.when(F.col("known"), UNKNOWN_MUTATION_RATE).otherwise(DEFAULT_RATE))).drop("rate", "known", "key_context", "key_mutation")


def contamination_estimate(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per sample the share of rows whose VAF at their site is 0.1 % to 5 %, at most 0.1."""
    vaf = F.col("consensus_count") / F.sum("consensus_count").over(W.partitionBy(*keys))
    rows = counts.withColumn("vaf", vaf)
    low = F.count(F.when((F.col("allele") != F.col("ref")) & F.col("vaf").between(0.001, 0.05), 1))
    return rows.groupBy("sample_id").agg(low.alias("n_low"), F.count(F.lit(1)).alias("n_rows"), F.least(low / F.count(F.lit(1)), F.lit(0.1)).alias("contamination"))
