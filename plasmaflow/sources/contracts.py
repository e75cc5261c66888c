"""Table contracts: rules as SQL conditions, checked in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """rule, n_bad: rows that don't satisfy each rule (unknown counts as bad), from one scan."""
    bad = df.agg(*(F.count(F.when(~F.coalesce(F.expr(c), F.lit(False)), 1)).alias(n) for n, c in rules))
    return bad.unpivot([], [n for n, _ in rules], "rule", "n_bad")


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy all rules, and the others with the names of the rules they break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules)))
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def enforce(df: DataFrame, rules: Rules) -> DataFrame:
    """df, failing at run time on the first row that breaks a rule."""
    checks = [F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"rule {n} is broken")).cast("boolean")) for n, c in rules]
    return df.where(F.forall(F.array(*checks), lambda x: x))


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their contract's types, null where a value doesn't fit; other columns stay."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage(fams: DataFrame, min_size: int = 3, min_observations: int = 10) -> DataFrame:
    """kind, item, n, passed: every context needs `min_observations` families, every family `min_size` reads (those that have them, and those that don't)."""
    size = F.col("family_size") >= min_size
    contexts = fams.groupBy(F.lit("context").alias("kind"), F.col("context").alias("item")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= min_observations).alias("passed"))
    return contexts.union(fams.groupBy(F.lit("family_size").alias("kind"), F.when(size, "enough").otherwise("too_small").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(size).alias("passed")))


def fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """Row count and order-free hash sums of all columns, doubles rounded: equal tables have equal fingerprints."""
    rounded = [F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    hashed = df.select(F.xxhash64(*rounded).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))
