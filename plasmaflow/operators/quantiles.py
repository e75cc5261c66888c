"""Values by rank without one task for a group: counts of distinct values, ranges between approximate quantiles, exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.operators.lineage import cut

#: Ranges of values at least, and at most; between them a range has about RANGE_ROWS distinct values.
BUCKETS, MOST_BUCKETS, RANGE_ROWS = 64, 4096, 1_000_000


def distinct_counts(df: DataFrame, value: str, by: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in (extra or {}).items()))


def attach(df: DataFrame, side: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of side, a row a group; null groups match. Without `by` side is one row and broadcast."""
    if not by:
        return df.join(F.broadcast(side))
    named = side.select(*(F.col(b).alias(f"{b}__k") for b in by), *(c for c in side.columns if c not in by))
    match = [df[b].eqNullSafe(named[f"{b}__k"]) for b in by]
    return df.join(named, match).drop(*(f"{b}__k" for b in by))


def placed(df: DataFrame, value: str, by: list[str], reverse: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """df with bucket__: `buckets` ranges between quantiles of the values within `by`, so that values that pile up still spread."""
    limits = df.groupBy(*by).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], max(1000, 10 * buckets)).alias("limits__"))
    bucket = F.size(F.filter("limits__", lambda c: c < F.col(value)))
    return attach(df, limits, by).withColumn("bucket__", -bucket if reverse else bucket).drop("limits__")


def exact(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by, and for each name the value at that share of the sorted values, linear between its two neighbours; nulls don't count.

    A first pass sums distinct values in ranges, which tells the ranges that hold the wanted ranks; only these are ordered.
    Groups without values give no row; without `by` there is one row, of nulls if there is no value."""
    by = by or []
    counts = cut(distinct_counts(df.select(*by, F.col(value).cast("double").alias("v__")), "v__", by))
    ranges = placed(counts, "v__", by, buckets=min(MOST_BUCKETS, max(BUCKETS, counts.count() // RANGE_ROWS)))
    before = W.partitionBy(*by).orderBy("bucket__").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    totals = ranges.groupBy(*by, "bucket__").agg(F.sum("n").alias("t__"))
    totals = totals.select("*", F.coalesce(F.sum("t__").over(before), F.lit(0)).alias("b__"), F.sum("t__").over(W.partitionBy(*by)).alias("all__"))
    wanted = []
    for name, q in shares.items():
        place = (F.col("all__") - 1) * F.lit(float(q))
        low = F.floor(place)
        wanted.append(F.struct(F.lit(name).alias("name"), low.alias("rank"), (1 - (place - low)).alias("weight")))
        wanted.append(F.struct(F.lit(name).alias("name"), F.ceil(place).alias("rank"), F.when(F.ceil(place) > low, place - low).otherwise(0.0).alias("weight")))
    here = F.filter(F.array(*wanted), lambda w: (w["rank"] >= F.col("b__")) & (w["rank"] < F.col("b__") + F.col("t__")))
    spots = cut(totals.withColumn("wanted__", here).where(F.size("wanted__") > 0).select(*by, "bucket__", "b__", "wanted__"))
    inside = attach(ranges, spots, [*by, "bucket__"])
    end = F.col("b__") + F.sum("n").over(W.partitionBy(*by, "bucket__").orderBy("v__").rowsBetween(W.unboundedPreceding, 0))
    hits = inside.withColumn("end__", end).select(*by, "v__", F.explode(F.filter("wanted__", lambda w: (w["rank"] < F.col("end__")) & (w["rank"] >= F.col("end__") - F.col("n")))).alias("w"))
    return hits.groupBy(*by).agg(*(F.sum(F.when(F.col("w.name") == name, F.col("w.weight") * F.col("v__"))).alias(name) for name in shares))
