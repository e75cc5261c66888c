"""Limits of blank, detection and quantification over tables of detection runs (allele_fraction, umi_depth, replicate_id, detected)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.operators import errors, multiple


def hit_rates(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rate by (depth, AF) with a normal 95 % interval clipped to [0, 1]."""
    by = by or ["umi_depth"]
    d = F.col("detected").cast("double")
    out = runs.groupBy(*by, "allele_fraction").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("detected").cast("int")).alias("k"), F.avg(d).alias("rate"), F.stddev_samp(d).alias("sd"))
    half = 1.96 * F.coalesce("sd", F.lit(0.0)) / F.sqrt("n")
    return out.withColumn("ci_lower", F.greatest(F.col("rate") - half, F.lit(0.0))).withColumn("ci_upper", F.least(F.col("rate") + half, F.lit(1.0)))


def detection_probability(runs: DataFrame, by: list[str]) -> DataFrame:
    out = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("detected").cast("int")).alias("k"))
    low, high = errors.wilson(F.col("k"), F.col("n"))
    return out.withColumn("rate", F.col("k") / F.col("n")).withColumn("ci_lower", low).withColumn("ci_upper", high)


def lob_percentile(runs: DataFrame, by: list[str], q: float = 0.95) -> DataFrame:
    """Percentile, mean and sd of the detections per blank run (AF = 0)."""
    each = runs.where("allele_fraction = 0").groupBy(*by).agg(F.sum(F.col("detected").cast("int")).alias("n"))
    return each.agg(F.expr(f"percentile(n, {q!r})").alias("lob"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count(F.lit(1)).alias("n_runs"))


def lob_false_positives(runs: DataFrame) -> DataFrame:
    """False-positive rate of blanks by depth; the limit of blank is its upper normal bound."""
    out = runs.where("allele_fraction = 0").groupBy("umi_depth").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("detected").cast("int")).alias("fp_rate"))
    half = 1.96 * F.sqrt(F.col("fp_rate") * (1 - F.col("fp_rate")) / F.col("n"))
    return out.withColumn("ci_lower", F.greatest(F.col("fp_rate") - half, F.lit(0.0))).withColumn("lob", F.least(F.col("fp_rate") + half, F.lit(1.0)))


def lod_interpolated(curve: DataFrame, target: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """AF at which the isotonic curve reaches `target`; bounds from the interval's curves. Never reached: twice the largest AF,
    and an open upper bound (null)."""
    by = by or ["umi_depth"]
    out = None
    for column, name in (("rate", "lod"), ("ci_upper", "lower"), ("ci_lower", "upper")):
        iso = multiple.isotonic(curve, by, "allele_fraction", column, "iso")
        before = W.partitionBy(*by).orderBy("allele_fraction")
        steps = iso.withColumn("x0", F.lag("allele_fraction").over(before)).withColumn("y0", F.lag("iso").over(before))
        at = F.when(F.col("y0").isNull(), F.col("allele_fraction")).otherwise(F.col("x0") + (target - F.col("y0")) / (F.col("iso") - F.col("y0")) * (F.col("allele_fraction") - F.col("x0")))
        found = steps.groupBy(*by).agg(F.min(F.when((F.col("iso") >= target) & (F.col("y0").isNull() | (F.col("y0") < target)), at)).alias(name), F.max("allele_fraction").alias("largest"))
        out = found if out is None else out.join(found.drop("largest"), by)
    reached = F.col("lod").isNotNull()
    return out.select(*by, F.coalesce("lod", 2 * F.col("largest")).alias("lod"), F.when(reached, F.col("lower")).otherwise(F.col("largest")).alias("ci_lower"), F.when(reached, F.col("upper")).alias("ci_upper"), reached.alias("reached"))


def lod_first_hit(curve: DataFrame, target: float = 0.95, by: list[str] | None = None) -> DataFrame:
    return curve.groupBy(*(by or ["umi_depth"])).agg(F.coalesce(F.min(F.when(F.col("rate") >= target, F.col("allele_fraction"))), F.max("allele_fraction")).alias("lod"))


def lod_logistic(curve: DataFrame, target: float = 0.95, by: str = "umi_depth") -> DataFrame:
    """Least-squares logistic of rate on log10 AF (AF > 0), solved for `target`. Where the slope isn't positive, AF is interpolated
    (or extended) linearly over the rates; a single point gives its AF, equal rates none. A group is one curve's points."""

    def between(points: pd.DataFrame) -> float | None:
        means = points.groupby("rate")["allele_fraction"].mean()
        x, y = means.index.to_numpy(float), means.to_numpy(float)
        if len(x) < 2:
            return float(y[0]) if len(points) == 1 else None
        i = int(np.clip(np.searchsorted(x, target), 1, len(x) - 1))
        return float(y[i - 1] + (target - x[i - 1]) / (x[i] - x[i - 1]) * (y[i] - y[i - 1]))

    def fit(points: pd.DataFrame) -> pd.DataFrame:
        x, y = np.log10(points["allele_fraction"].to_numpy(float)), points["rate"].to_numpy(float)
        lod = None
        if len(np.unique(x)) >= 2:
            logit = np.log(np.clip(y, 1e-3, 1 - 1e-3) / (1 - np.clip(y, 1e-3, 1 - 1e-3)))
            slope, shift = np.polyfit(x, logit, 1)
            for _ in range(100):  # Gauss-Newton with halved steps
                p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -500, 500)))
                g = p * (1 - p)
                step = np.linalg.lstsq(np.column_stack([g * x, g]), y - p, rcond=None)[0]
                scale = 1.0
                while scale > 1e-6 and ((y - 1 / (1 + np.exp(-np.clip((slope + scale * step[0]) * x + shift + scale * step[1], -500, 500)))) ** 2).sum() > ((y - p) ** 2).sum():
                    scale /= 2
                slope, shift = slope + scale * step[0], shift + scale * step[1]
                if np.abs(scale * step).max() < 1e-10:
                    break
            lod = float(10 ** ((np.log(target / (1 - target)) - shift) / slope)) if slope > 0 else None
        lod = between(points) if lod is None or not np.isfinite(lod) else lod
        return pd.DataFrame({by: points[by].iloc[:1], "lod": [lod]})

    kind = curve.schema[by].dataType.simpleString()
    return curve.where("allele_fraction > 0").select(by, "allele_fraction", "rate").groupBy(by).applyInPandas(fit, f"{by} {kind}, lod double")


def loq_cv(runs: DataFrame, estimate: str, most_cv: float = 0.2, most_error: float | None = None) -> DataFrame:
    """Lowest AF whose estimates' cv (and, by another limit, absolute error) is small enough, by depth."""
    each = runs.where("allele_fraction > 0").groupBy("umi_depth", "allele_fraction").agg(F.avg(estimate).alias("m"), F.stddev_pop(estimate).alias("sd"), F.avg(F.abs(F.col(estimate) - F.col("allele_fraction"))).alias("error"))
    cv = F.when(F.col("m") > 0, F.col("sd") / F.col("m"))
    out = [F.min(F.when(cv <= most_cv, F.col("allele_fraction"))).alias("loq_cv")]
    if most_error is not None:
        out.append(F.min(F.when(F.col("error") <= most_error, F.col("allele_fraction"))).alias("loq_error"))
    return each.groupBy("umi_depth").agg(*out)


def lod_monotonic(lods: DataFrame) -> DataFrame:
    """Whether LoD never rises with depth, the correlation with depth and whether it is under -0.5, and the range (few rows)."""
    rises = lods.withColumn("before", F.lag("lod").over(W.orderBy("umi_depth")))
    return rises.agg((F.max(F.when(F.col("lod") > F.col("before"), 1).otherwise(0)) == 0).alias("monotonic"), F.corr("umi_depth", "lod").alias("correlation"), F.min("lod").alias("least"), F.max("lod").alias("most")).withColumn("trend_ok", F.col("correlation") < -0.5)


def lod_depth_trend(lods: DataFrame) -> DataFrame:
    x, y = F.log10("umi_depth"), F.log10("lod")
    return lods.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def sensitivity_at(curve: DataFrame, af: float = 0.001, required: float = 0.95, by: list[str] | None = None) -> DataFrame:
    out = multiple.interpolate(curve, by or ["umi_depth"], "allele_fraction", "rate", af)
    return out.withColumnRenamed("value", "sensitivity").withColumn("meets", F.col("sensitivity") >= required)


def lod_summary(lods: DataFrame, lobs: DataFrame) -> DataFrame:
    return lods.join(lobs, "umi_depth", "full_outer")
