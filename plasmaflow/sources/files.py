"""Tables in and out: Parquet, CSV, nested JSON, error models, manifests of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays and structs as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns)).write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json_documents(df: DataFrame, path: str, keys: list[str], rows: str = "rows", mode: str = "errorifexists") -> None:
    """One JSON document for each combination of keys, its other columns nested as a list (a document's rows must fit a task)."""
    others = [c for c in df.columns if c not in keys]
    nested = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*others))).alias(rows))
    nested.select(F.to_json(F.struct(*keys, rows)).alias("value")).write.mode(mode).text(path)


def rates_from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """context, mutation, rate of error-model documents {context: {mutation: rate}}."""
    parsed = documents.select(F.from_json(column, "map<string, map<string, string>>").alias("m"))
    by_context = parsed.select(F.explode("m").alias("context", "inner"))
    return by_context.select("context", F.explode("inner").alias("mutation", "raw")).select("context", "mutation", F.col("raw").try_cast("double").alias("rate")).where("rate is not null")


def contamination_pairs(matrix: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """source, target, rate of rows keyed 'source->target'; other keys and values are skipped."""
    parts = F.split(key, "->", 2)
    return matrix.where(F.col(key).contains("->")).select(parts[0].alias("source"), parts[1].alias("target"), F.col(value).cast("string").try_cast("double").alias("rate")).where("rate is not null")


def hash_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256 of every stored file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
