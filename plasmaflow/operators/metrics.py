"""Calibration, bootstrap, validation and conformal intervals."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plasmaflow.functions import tails
from plasmaflow.operators import multiple, quantiles
from plasmaflow.operators.lineage import cut


def bin_index(value: str, bins: int = 10) -> Column:
    """Bin of equal width with numpy's edges, [low, high), the last one closed."""
    edges = np.linspace(0, 1, bins + 1)
    return sum((F.col(value) >= float(e)).cast("int") for e in edges[1:-1])


def calibration_bins(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10, by: list[str] | None = None) -> DataFrame:
    return df.where(F.col(score).isNotNull()).withColumn("bin", bin_index(score, bins)).groupBy(*(by or []), "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("event_rate"), F.avg(score).alias("confidence"))


def calibration_error(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Expected and largest calibration error, and whether the former is under 0.05."""
    table = calibration_bins(df, score, label, bins, by)
    gap = F.abs(F.col("event_rate") - F.col("confidence"))
    out = table.groupBy(*(by or [])).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("max_error"), F.count(F.lit(1)).alias("n_bins"))
    return out.withColumn("well_calibrated", F.col("ece") < 0.05)


def calibration_strata(df: DataFrame, by: list[str], score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """A row a stratum: ece, max_error and the accuracies, confidences and counts of all bins (low, high], 0 where a bin is empty.

    A score of 0 is in no bin but counts for the shares; one group-by, arrays of `bins` values."""
    edges = np.linspace(0, 1, bins + 1)
    place = F.when(F.col(score) > 0, sum((F.col(score) > float(e)).cast("int") for e in edges[1:-1]))
    cells = df.where(F.col(score).isNotNull()).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("accuracy"), F.avg(score).alias("confidence"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("accuracy") - F.col("confidence")))
    found = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct("accuracy", "confidence", "n").alias("v")))))  # at most `bins` entries
    out = cells.groupBy(*by).agg(F.coalesce(F.sum(gap * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_error"), found.alias("m"))
    each = lambda field, zero: F.array(*(F.coalesce(F.col("m")[i][field], zero) for i in range(bins)))
    return out.select(*by, "ece", "max_error", each("accuracy", F.lit(0.0)).alias("accuracies"), each("confidence", F.lit(0.0)).alias("confidences"), each("n", F.lit(0)).alias("counts"))


def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def _auc(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    below = np.cumsum(neg) - neg / 2
    total = pos.sum() * neg.sum()
    return float((pos * below).sum() / total) if total else 0.5


def _ap(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    p, n = pos[::-1], neg[::-1]
    tp, fp = np.cumsum(p), np.cumsum(n)
    return float((p * tp / np.maximum(tp + fp, 1)).sum() / tp[-1]) if tp[-1] else 0.0


def bootstrap_metric(df: DataFrame, replicates: int = 1000, seed: int = 0, score: str = "score", label: str = "label", digits: int = 4) -> DataFrame:
    """replicate, auc, average_precision of resampled rows. The cluster reduces rows to counts by score (rounded to `digits`, so at
    most 10 ** digits + 1 of them); a replicate is one multinomial draw over these counts."""
    counts = df.groupBy(F.round(score, digits).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")).where("s is not null").toPandas().sort_values("s")
    s, cells = counts["s"].to_numpy(float), np.concatenate([counts["pos"].to_numpy(np.int64), counts["neg"].to_numpy(np.int64)])
    total = int(cells.sum())

    def draw(batches):
        for batch in batches:
            rows = []
            for b in batch["id"]:
                sample = np.random.default_rng([seed, int(b)]).multinomial(total, cells / max(total, 1)) if total else cells
                rows.append((int(b), _auc(s, sample[: len(s)], sample[len(s) :]), _ap(s, sample[: len(s)], sample[len(s) :]) if len(s) else 0.0))
            yield pd.DataFrame(rows, columns=["replicate", "auc", "average_precision"])

    return df.sparkSession.range(replicates, numPartitions=8).mapInPandas(draw, "replicate long, auc double, average_precision double")


def interval(replicates: DataFrame, value: str, estimate: float | None = None, mass: float = 0.95) -> DataFrame:
    """Mean, sd, percentile interval, and with an estimate the basic (reverse percentile) interval and bias."""
    low, high = (1 - mass) / 2, (1 + mass) / 2
    out = replicates.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, {low!r})").alias("lower"), F.expr(f"percentile({value}, {high!r})").alias("upper"))
    if estimate is None:
        return out
    return out.withColumn("basic_lower", 2 * F.lit(estimate) - F.col("upper")).withColumn("basic_upper", 2 * F.lit(estimate) - F.col("lower")).withColumn("bias", F.col("mean") - estimate)


#: Statistics of a bootstrap: from the rows' weights to named aggregate Columns, so that they run in the engine.
Statistics = Callable[[Column], dict[str, Column]]


def weighted_means(**values: Column | str) -> Statistics:
    """The weighted mean of each value; nulls don't count."""
    columns = {n: (F.col(v) if isinstance(v, str) else v).cast("double") for n, v in values.items()}
    return lambda w: {n: F.sum(w * v) / F.sum(F.when(v.isNotNull(), w)) for n, v in columns.items()}


def family_statistics(w: Column) -> dict[str, Column]:
    """Variant rate, mean family size and mean quality of families."""
    return weighted_means(variant_rate=F.col("is_variant").cast("int"), mean_family_size="family_size", mean_quality="mean_quality")(w)


def poisson_weight(*keys: Column | str, most: int = 12) -> Column:
    """A Poisson(1) draw from a hash of the keys: the number of limits of the distribution below a uniform number."""
    u = F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53)
    limits = np.cumsum([np.exp(-1) / np.prod(np.arange(1.0, k + 1)) for k in range(most)])
    return sum(((u >= float(x)).cast("int") for x in limits), F.lit(0))


def bootstrap(df: DataFrame, keys: list[str], statistics: Statistics = family_statistics, replicates: int = 100, seed: int = 0) -> DataFrame:
    """replicate and its statistics over resampled rows, whose weights are Poisson(1) draws from (row key, seed, replicate).

    A row meets all replicates where it is read; partial sums leave each task as one row a replicate. No Python worker."""
    rows = df.withColumn("h__", F.xxhash64(*keys, F.lit(seed))).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = rows.withColumn("w__", poisson_weight("h__", "replicate")).where("w__ > 0")
    return drawn.groupBy("replicate").agg(*(c.alias(n) for n, c in statistics(F.col("w__")).items()))


def robustness(replicates: DataFrame, mass: float = 0.95) -> DataFrame:
    """metric, mean, sd, ci_lower, ci_upper, cv, n over the statistics of `bootstrap` (a row a replicate); cv is 0 at a mean of 0."""
    names = [c for c in replicates.columns if c != "replicate"]
    long = replicates.select("replicate", *(F.col(n).cast("double").alias(n) for n in names)).unpivot("replicate", names, "metric", "value")
    low, high = (1 - mass) / 2, (1 + mass) / 2
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.expr(f"percentile(value, {low!r})").alias("ci_lower"), F.expr(f"percentile(value, {high!r})").alias("ci_upper"), F.count("value").alias("n"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.abs(F.col("mean"))).otherwise(0.0))


def proportion_interval(df: DataFrame, above: Column, alpha: float = 0.05) -> DataFrame:
    """Share of rows above a threshold with the interval of its resampling distribution: exact Beta quantiles of k of n."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(above, 1)).alias("k"))
    k, rest = F.col("k") + 0.5, F.col("n") - F.col("k") + 0.5
    return counts.withColumn("share", F.col("k") / F.col("n")).withColumn("lower", tails.beta_ppf(F.lit(alpha / 2), k, rest)).withColumn("upper", tails.beta_ppf(F.lit(1 - alpha / 2), k, rest))


def keyed_number(*keys: str, seed: int = 0) -> Column:
    """A number below 2 ** 32 from the MD5 of the keys and the seed, which any SQL engine can repeat."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """fold 0 to k - 1 by a keyed hash within each label: no ordering of a whole class, sizes equal up to chance."""
    return df.withColumn("fold", (keyed_number(key, label, seed=seed) % k).cast("int"))


def cv_scores(df: DataFrame, folds: str, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], k: int, parallelism: int = 4, threshold: float = 0.5) -> DataFrame:
    """A row a fold: auc, average_precision, accuracy (score > threshold), sizes and class counts, of a model fitted on the other folds.

    fit_predict(train, test) is the model factory; it gives score and label. df is computed once, folds are fitted side by side, and the
    metrics of all folds come from one table."""
    rows = cut(df)

    def one(fold: int) -> DataFrame:
        return cut(fit_predict(rows.where(F.col(folds) != fold), rows.where(F.col(folds) == fold)).select(F.lit(fold).alias("fold"), "score", "label"))

    with ThreadPoolExecutor(max(1, min(parallelism, k))) as pool:
        scored = reduce(DataFrame.union, list(pool.map(inheritable_thread_target(df.sparkSession)(one), range(k))))
    total = rows.count()
    sizes = scored.groupBy("fold").agg(
        F.avg(((F.col("score") > threshold) == (F.col("label") == 1)).cast("int")).alias("accuracy"), (total - F.count(F.lit(1))).alias("n_train"), F.count(F.lit(1)).alias("n_test"),
        F.count(F.when(F.col("label") == 1, 1)).alias("n_positive"), F.count(F.when(F.col("label") == 0, 1)).alias("n_negative"))
    return multiple.roc_auc(scored, by=["fold"]).join(multiple.average_precision(scored, by=["fold"]), "fold").join(sizes, "fold")


def cv_summary(folds: DataFrame, mass: float = 0.95) -> DataFrame:
    """metric, mean, sd (of the folds), the t interval of the mean, and n_folds."""
    names = ["auc", "average_precision", "accuracy"]
    out = folds.unpivot("fold", names, "metric", "value").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.stddev_samp("value").alias("s"), F.count("value").alias("n_folds"))
    half = tails.t_quantile(F.lit((1 + mass) / 2), F.col("n_folds") - 1) * F.col("s") / F.sqrt("n_folds")
    return out.withColumn("half", F.when(F.col("n_folds") > 1, half)).select("metric", "mean", "sd", (F.col("mean") - F.col("half")).alias("ci_lower"), (F.col("mean") + F.col("half")).alias("ci_upper"), "n_folds")


def compare_models(folds: DataFrame) -> DataFrame:
    """Paired t of each pair of models over fold scores (model, fold, score)."""
    a, b = folds.select("fold", F.col("model").alias("a"), F.col("score").alias("x")), folds.select("fold", F.col("model").alias("b"), F.col("score").alias("y"))
    d = F.col("x") - F.col("y")
    out = a.join(b, "fold").where("a < b").groupBy("a", "b").agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("t", F.when(F.col("sd") > 0, F.col("mean_difference") / (F.col("sd") / F.sqrt("n"))))


def conformal(calibration: DataFrame, test: DataFrame, alpha: float = 0.1, score: str = "score", label: str = "label") -> DataFrame:
    """Test rows with score plus and minus the calibration rows' (1 - alpha) quantile of absolute errors, clipped to [0, 1]."""
    q = quantiles.exact(calibration.select(F.abs(F.col(label) - F.col(score)).alias("error")), "error", {"q": 1 - alpha})
    return test.join(F.broadcast(q)).withColumn("lower", F.greatest(F.col(score) - F.col("q"), F.lit(0.0))).withColumn("upper", F.least(F.col(score) + F.col("q"), F.lit(1.0)))


def detection(calls: DataFrame, truth_above: float = 0.001) -> DataFrame:
    """One row over calls: auc, average_precision, brier, detected and all cases, and the calibration bins as an array by bin.

    The score is variant_fraction, else ml_probability, else 1 - p_value, by the columns there are; a case has an allele_fraction above
    `truth_above`. Without allele_fraction no row is positive, and all rows count as cases."""
    score = next(F.col(c) if c != "p_value" else 1 - F.col(c) for c in ("variant_fraction", "ml_probability", "p_value") if c in calls.columns)
    known = "allele_fraction" in calls.columns
    truth = (F.col("allele_fraction") > truth_above).cast("int") if known else F.lit(0)
    found = F.col("significant") if "significant" in calls.columns else F.lit(False)
    rows = cut(calls.select(score.cast("double").alias("score"), truth.alias("label"), F.coalesce(found, F.lit(False)).alias("found")))
    case = (F.col("label") == 1) if known else F.lit(True)
    counts = rows.agg(F.count(F.when(F.col("found") & case, 1)).alias("detected_cases"), F.count(F.when(case, 1)).alias("total_cases"))
    bins = calibration_bins(rows).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "event_rate", "confidence"))).alias("calibration"))  # ten entries
    parts = (multiple.average_precision(rows), brier(rows), counts, bins)
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts, multiple.roc_auc(rows))


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """feature, mi with the label, over quantile bins of each feature."""
    rows, out = cut(df.select(*features, label)), None
    for f in features:
        cuts = quantiles.exact(rows, f, {f"q{i}": i / bins for i in range(1, bins)}).first()
        binned = rows.select(sum((F.col(f) > float(c)).cast("int") for c in cuts).alias("x"), F.col(label).alias("y"))
        cells = binned.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
        xs, ys = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
        total = cells.agg(F.sum("n").alias("t"))
        p = F.col("n") / F.col("t")
        row = cells.join(xs, "x").join(ys, "y").join(F.broadcast(total)).agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi")).withColumn("feature", F.lit(f))
        out = row if out is None else out.unionByName(row)
    return out.select("feature", "mi")


def lod_bootstrap(runs: DataFrame, target: float = 0.95, replicates: int = 100, seed: int = 0) -> DataFrame:
    """Per depth the median and 95 % interval of the LoD over resampled runs: the cluster reduces runs to (depth, AF, n, k); a
    replicate redraws the cells of one depth as a multinomial."""
    cells = runs.groupBy("umi_depth", "allele_fraction").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("detected").cast("int")).alias("k"))

    def draw(group: pd.DataFrame) -> pd.DataFrame:  # one depth's few points
        group = group.sort_values("allele_fraction")
        af, n, k = (group[c].to_numpy() for c in ("allele_fraction", "n", "k"))
        counts = np.concatenate([k, n - k])
        depth, out = int(group["umi_depth"].iloc[0]), []
        for b in range(replicates):
            sample = np.random.default_rng([seed, depth, b]).multinomial(counts.sum(), counts / counts.sum())
            hits, misses = sample[: len(af)], sample[len(af) :]
            rate = np.maximum.accumulate(hits / np.maximum(hits + misses, 1))
            i = int(np.argmax(rate >= target)) if (rate >= target).any() else -1
            out.append(2 * af[-1] if i < 0 else af[0] if i == 0 else af[i - 1] + (target - rate[i - 1]) / (rate[i] - rate[i - 1]) * (af[i] - af[i - 1]))
        return pd.DataFrame({"umi_depth": [depth], "lod": [float(np.median(out))], "ci_lower": [float(np.percentile(out, 2.5))], "ci_upper": [float(np.percentile(out, 97.5))]})

    return cells.groupBy("umi_depth").applyInPandas(draw, "umi_depth int, lod double, ci_lower double, ci_upper double")
