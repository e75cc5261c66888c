"""Multiple testing, p-value calibration and curves over ranks.

No window ever orders raw rows of a whole table: values are first counted by distinct value, and a value's rank is the
running count, which also treats ties rightly. Distinct values go through a two-pass running sum: ranges between quantiles,
totals of the ranges, offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.functions import tails
from plasmaflow.operators import quantiles
from plasmaflow.operators.lineage import cut
from plasmaflow.operators.quantiles import distinct_counts, placed


def _side(df: DataFrame, by: list[str]) -> DataFrame:
    """A table of a row (without `by`) or of some rows a group: broadcast only where its size doesn't grow with the groups."""
    return df if by else F.broadcast(df)


def running(df: DataFrame, value: str, by: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df with running sums of columns along `value` (sums: new column to source), within `by`.

    Buckets of the value range carry partial totals, so that even without `by` no task sees every row."""
    spread = placed(df, value, by, descending)
    totals = spread.groupBy(*by, "bucket__").agg(*(F.sum(c).alias(f"{k}__t") for k, c in sums.items()))
    before = W.partitionBy(*by).orderBy("bucket__").rowsBetween(W.unboundedPreceding, -1)  # at most BUCKETS rows a group
    offsets = totals.select(*by, "bucket__", *(F.coalesce(F.sum(f"{k}__t").over(before), F.lit(0)).alias(f"{k}__o") for k in sums))
    inside = W.partitionBy(*by, "bucket__").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(W.unboundedPreceding, 0)
    out = spread.join(_side(offsets, by), [*by, "bucket__"])
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"{k}__o") + F.sum(c).over(inside))
    return out.drop("bucket__", *(f"{k}__o" for k in sums))


def _extreme(df: DataFrame, value: str, by: list[str], source: str, name: str, largest: bool) -> DataFrame:
    """Running maximum of `source` from small values up, or running minimum from large values down."""
    pick = F.max if largest else F.min
    spread = placed(df, value, by, not largest)
    totals = spread.groupBy(*by, "bucket__").agg(pick(source).alias("t__"))
    offsets = totals.select(*by, "bucket__", pick("t__").over(W.partitionBy(*by).orderBy("bucket__").rowsBetween(W.unboundedPreceding, -1)).alias("o__"))
    inside = W.partitionBy(*by, "bucket__").orderBy(F.asc(value) if largest else F.desc(value)).rowsBetween(W.unboundedPreceding, 0)
    out = spread.join(_side(offsets, by), [*by, "bucket__"]).withColumn(name, pick(source).over(inside))
    best = F.greatest if largest else F.least
    return out.withColumn(name, best(F.col(name), F.coalesce("o__", name))).drop("bucket__", "o__")


def adjust(df: DataFrame, p: str = "p_value", by: list[str] | None = None, method: str = "bh", alpha: float = 0.05) -> DataFrame:
    """df with p_adjusted and significant; method: bh (step-up), holm, bonferroni or none, within `by`. Null p stay null."""
    by = by or []
    counts = cut(distinct_counts(df, p, by))
    tests = counts.groupBy(*by).agg(F.sum("n").alias("m__"))
    counts = counts.join(tests, by) if by else counts.join(F.broadcast(tests))
    if method == "bh":
        ranked = cut(running(counts, p, by, {"rank__": "n"}).withColumn("raw__", F.col(p) * F.col("m__") / F.col("rank__")))
        adjusted = _extreme(ranked, p, by, "raw__", "p_adjusted", largest=False)
    elif method == "holm":
        ranked = cut(running(counts, p, by, {"rank__": "n"}).withColumn("raw__", F.col(p) * (F.col("m__") - (F.col("rank__") - F.col("n")))))
        adjusted = _extreme(ranked, p, by, "raw__", "p_adjusted", largest=True)
    elif method == "bonferroni":
        adjusted = counts.withColumn("p_adjusted", F.col(p) * F.col("m__"))
    else:
        adjusted = counts.withColumn("p_adjusted", F.col(p))
    table = adjusted.select(*(F.col(b).alias(f"{b}__") for b in by), F.col(p).alias("p__"), F.least("p_adjusted", F.lit(1.0)).alias("p_adjusted"))
    match = [df[b].eqNullSafe(table[f"{b}__"]) for b in by] + [df[p] == table["p__"]]
    return df.join(table, match, "left").drop("p__", *(f"{b}__" for b in by)).withColumn("significant", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)))


def qq_points(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Distinct p with the expected quantile of its last rank, i / (n + 1)."""
    counts = cut(distinct_counts(df, p, []))
    ranked = running(counts, p, [], {"rank": "n"}).join(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return ranked.select(F.col(p).alias("observed"), "rank", (F.col("rank") / (F.col("total") + 1)).alias("expected"))


def inflation(df: DataFrame, p: str = "p_value") -> DataFrame:
    return quantiles.exact(df, p, {"m": 0.5}).select((F.col("m") / 0.5).alias("inflation"))


def ks_uniform(df: DataFrame, p: str = "p_value", alphas: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """One row: n, the KS distance from U(0, 1), its asymptotic p, and the observed rate at each alpha."""
    counts = cut(distinct_counts(df, p, []))
    whole = counts.agg(F.sum("n").alias("total"), *((F.sum(F.when(F.col(p) <= a, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"rate_{i}") for i, a in enumerate(alphas)))
    ranked = running(counts, p, [], {"rank": "n"}).join(F.broadcast(whole))
    gap = F.greatest(F.col("rank") / F.col("total") - F.col(p), F.col(p) - (F.col("rank") - F.col("n")) / F.col("total"))
    out = ranked.agg(F.max("total").alias("n"), F.max(gap).alias("distance"), *(F.max(f"rate_{i}").alias(f"rate_{i}") for i in range(len(alphas))))
    return out.withColumn("ks_p", tails.kolmogorov_sf("distance", "n"))


def _labelled(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    counts = cut(distinct_counts(df.where(F.col(label).isNotNull()), score, by, {"pos": F.sum(F.col(label).cast("long"))}).withColumn("neg", F.col("n") - F.col("pos")))
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return counts.join(totals, by) if by else counts.join(F.broadcast(totals))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Rank AUC with ties counted half; 0.5 for a single class."""
    by = by or []
    ranked = running(_labelled(df, score, label, by), score, by, {"below": "neg"})
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    pairs = F.max("all_pos") * F.max("all_neg")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, won / pairs).otherwise(0.5).alias("auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Sum of precision times step in recall; the mean label without positives."""
    by = by or []
    ranked = running(_labelled(df, score, label, by), score, by, {"tp": "pos", "fp": "neg"}, descending=True)
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return ranked.groupBy(*by).agg(F.when(F.max("all_pos") > 0, steps / F.max("all_pos")).otherwise(0.0).alias("average_precision"))


def threshold_table(df: DataFrame, thresholds: list[float], score: str = "score", label: str = "label", inclusive: bool = True) -> DataFrame:
    """tp, fp, positives and negatives at each threshold: scores are counted by the number of thresholds they pass, once."""
    ts = sorted(thresholds)
    passed = sum(((F.col(score) >= t) if inclusive else (F.col(score) > t)).cast("int") for t in ts)
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(passed.alias("passed")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "place int, threshold double")
    totals = counts.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    joined = grid.join(F.broadcast(counts), F.col("passed") >= F.col("place"), "left").groupBy("place", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    return joined.join(F.broadcast(totals)).drop("place")


def roc_pr_curve(df: DataFrame, points: int = 20, score: str = "score", label: str = "label") -> DataFrame:
    t = threshold_table(df, [i / (points - 1) for i in range(points)], score, label)
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp = F.col("tp"), F.col("fp")
    return t.select("threshold", ratio(tp, F.col("positives")).alias("tpr"), ratio(fp, F.col("negatives")).alias("fpr"), ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("positives")).alias("recall"))


def threshold_sweep(df: DataFrame, metric: str = "f1", score: str = "score", label: str = "label") -> DataFrame:
    """The best of 50 thresholds from 0.01 to 0.99 (score > t; the first of equals), 0.5 if none scores above 0."""
    t = threshold_table(df, [0.01 + 0.02 * i for i in range(50)], score, label, inclusive=False)
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    value = {"f1": f1, "precision": precision, "recall": recall}[metric]
    best = t.withColumn("value", F.round(value, 12)).agg(F.max(F.struct("value", (-F.col("threshold")).alias("minus"))).alias("b"))
    return best.select(F.when(F.col("b.value") > 0, -F.col("b.minus")).otherwise(0.5).alias("threshold"), F.col("b.value").alias("value"))


def threshold_unlabelled(df: DataFrame, alpha: float = 0.05, metric: str = "f1", score: str = "score") -> DataFrame:
    q = 1 - 2 * alpha if metric == "f1" else 1 - alpha
    return quantiles.exact(df, score, {"threshold": q})


def hpdi(samples: DataFrame, by: list[str], value: str, mass: float = 0.95) -> DataFrame:
    """Shortest interval of each group that holds ceil(mass * n) values; the first of equals.

    A distinct value starts an interval at its first rank; the value at the rank where it ends is the least one whose last rank is
    not below it: a running minimum over ranges of ranks, so that no task orders a whole group."""
    ranked = cut(running(distinct_counts(samples, value, by), value, by, {"last__": "n"}))
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("all__"))
    sized = ranked.join(sizes, by).withColumn("k__", F.greatest(F.ceil(F.round(F.col("all__") * mass, 9)), F.lit(1)))
    stop = F.col("last__") - F.col("n") + F.col("k__")
    ends = ranked.select(*by, (2 * F.col("last__") + 1).alias("at__"), F.col(value).alias("end__"), F.lit(None).cast(ranked.schema[value].dataType).alias("lower"))
    starts = sized.where(stop <= F.col("all__")).select(*by, (2 * stop).alias("at__"), F.lit(None).cast(ranked.schema[value].dataType).alias("end__"), F.col(value).alias("lower"))
    spans = _extreme(ends.union(starts), "at__", by, "end__", "upper", largest=False).where("lower is not null")
    return spans.groupBy(*by).agg(F.min(F.struct((F.col("upper") - F.col("lower")).alias("width"), "lower", "upper")).alias("best")).select(*by, "best.lower", "best.upper")


def credible_interval(samples: DataFrame, by: list[str], value: str, mass: float = 0.95) -> DataFrame:
    low = (1 - mass) / 2
    return quantiles.attach(samples.groupBy(*by).agg(F.avg(value).alias("mean")), quantiles.exact(samples, value, {"median": 0.5, "lower": low, "upper": 1 - low}, by), by)


def isotonic(curve: DataFrame, by: list[str], x: str, y: str, name: str | None = None) -> DataFrame:
    """Running maximum of y along x, within a curve (a few points a group)."""
    return curve.withColumn(name or y, F.max(y).over(W.partitionBy(*by).orderBy(x).rowsBetween(W.unboundedPreceding, 0)))


def interpolate(curve: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """Value of y at x = at on each sorted curve, linear between points and level beyond the ends; of equal x the last counts."""
    group = curve.groupBy(*by)
    below = F.max(F.when(F.col(x) <= at, F.struct(x, y)))
    above = F.min(F.when(F.col(x) > at, F.struct(x, y)))
    ends = group.agg(below.alias("b"), above.alias("a"))
    slope = (F.col(f"a.{y}") - F.col(f"b.{y}")) / (F.col(f"a.{x}") - F.col(f"b.{x}"))
    value = F.when(F.col("b").isNull(), F.col(f"a.{y}")).when(F.col("a").isNull(), F.col(f"b.{y}")).otherwise(F.col(f"b.{y}") + slope * (at - F.col(f"b.{x}")))
    return ends.select(*by, value.alias("value"))
