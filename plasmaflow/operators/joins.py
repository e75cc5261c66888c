"""Joins and set operations between result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def target_summary(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """Each target site (chrom, pos, ref, target) with the families of its target allele and of all alleles; 0 where absent."""
    seen = counts.groupBy("chrom", "pos", "ref", "allele").agg(F.sum("consensus_count").alias("n"))
    joined = sites.join(seen, ["chrom", "pos", "ref"], "left")
    return joined.groupBy("chrom", "pos", "ref", "target").agg(F.coalesce(F.sum(F.when(F.col("allele") == F.col("target"), F.col("n"))), F.lit(0)).alias("alt_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_depth"))


def contamination_overlap(signatures: DataFrame, most: float = 0.1) -> DataFrame:
    """Per sample the number of its distinct variants found in other samples, summed over those, and its share of the sample's rows.

    Each variant counts its samples once, so no pair of samples is built: it adds (samples - 1) to each of them."""
    rows = signatures.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    distinct = signatures.select("sample_id", "v").distinct()
    others = distinct.groupBy("v").agg((F.count(F.lit(1)) - 1).alias("others"))
    shared = distinct.join(others, "v").groupBy("sample_id").agg(F.sum("others").alias("shared")).where("shared > 0")
    return shared.join(rows, "sample_id").select("sample_id", "shared", F.least(F.col("shared") / F.col("n"), F.lit(most)).alias("contamination"))


def manifest_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are missing, unexpected or changed between two manifests."""
    a, b = before.select(F.col(key), F.col(value).alias("a")), after.select(F.col(key), F.col(value).alias("b"))
    joined = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full_outer")
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return joined.select(key, status.alias("status")).where("status is not null")


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with their side; repeated rows count."""
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


def union_prefixed(tables: dict[str, DataFrame], key: str, name: str) -> DataFrame:
    """Tables under one another, with `name` made of each one's prefix and key."""
    out = None
    for prefix, df in tables.items():
        part = df.withColumn(name, F.concat(F.lit(prefix), F.col(key).cast("string"))).drop(key)
        out = part if out is None else out.unionByName(part)
    return out


def dense_grid(df: DataFrame, axes: list[str], value: str, aggregate: str = "avg") -> DataFrame:
    """Every combination of the axes' values with the aggregated value, 0 where there is none. Axes are short lists of settings."""
    grid = None
    for axis in axes:
        values = df.select(axis).distinct()
        grid = values if grid is None else grid.join(F.broadcast(values))
    cells = df.groupBy(*axes).agg(F.expr(f"{aggregate}({value})").alias(value))
    return grid.join(cells, axes, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def latest_by_key(results: DataFrame, key: str, value: str, offset: str) -> DataFrame:
    """The newest value of each key."""
    return results.groupBy(key).agg(F.max_by(value, offset).alias(value), F.max(offset).alias(offset))
