"""A corpus pipeline of five stages, each calling one of the training-data operators on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plasmaflow.llm import common, dropout, langid, line_dedup, minhash, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of some length whose best language needs more bits a byte than this is no language that was learned.
MOST_BITS_PER_BYTE = 6.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of over 64 bytes that no learned language explains, go; lang becomes the predicted one."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model, keep=[c for c in COLUMNS if c not in ("doc_id", "lang")])
    known = (F.col("lang_pred") != "und") & ((F.col("bits_per_byte") <= MOST_BITS_PER_BYTE) | (F.octet_length("text") <= 64))
    return found.where(known).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line resembles go; documents that lose all their lines with words go with them."""
    out = line_dedup.dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row: its doc_id, or the row's number by doc_id (nulls last) and text if ids are missing or repeat."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return common.Scratch(docs.sparkSession, "pipeline").cut(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "keyed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity of 0.8 or more) stays."""
    rows = keyed(docs)
    found = minhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), width=5, percent=80)
    return rows.join(found.where("not kept").select(F.col("doc_id").alias("key")), "key", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a document that it takes twice as two rows."""
    rows = keyed(docs)
    taken = mixing.mix(rows.withColumn("doc_id", F.col("key")).drop("key")).where("taken > 0").select(F.col("doc_id").alias("key"), F.expr("cast(taken div size as int)").alias("times"))
    return rows.join(taken, "key").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "times"))).select(COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of a seeded merge-dropout segmentation that decodes to the text."""
    import public_tokenizers

    return dropout.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]

#: Learned language models, MinHash banding and seeded choices have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and reread; what a stage wrote besides goes once its output is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = common.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with common.freed():
            docs = kept.cut(stage(spark, docs, sf_dir), name)
    return docs
