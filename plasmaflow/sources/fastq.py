"""FASTQ text as a DataFrame: framing by line number within each file, decoding, and per-UMI families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plasmaflow.functions import dna
from plasmaflow.operators.lineage import cut

#: Lines that one task frames.
LINES = 1_000_000


def read_fastq(spark: SparkSession, path: str, max_reads: int | None = None) -> DataFrame:
    """file, record_idx, read_id, sequence, umi, quality_scores, mean_quality, sequence_length for each record of FASTQ files (plain
    or .gz; large plain files are split, so a line's number is its place in its block after the lines of the blocks before).

    Records with an empty line, without '@' or '+' in their places, or cut short are left out; '@' elsewhere is a quality."""
    lines = spark.read.option("wholetext", False).text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"), F.monotonically_increasing_id().alias("at"))
    blocks = cut(lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    files = cut(blocks.select("file").distinct().select("file", F.monotonically_increasing_id().alias("file_no")))
    blocks = blocks.select("file", "block", (F.col("first") - earlier).alias("origin")).join(files, "file")
    numbered = lines.join(cut(blocks), ["file", "block"])  # a row a split: broadcast if Spark finds it small enough
    numbered = numbered.withColumn("i", F.col("at") - F.col("origin")).select("file_no", F.floor(F.col("i") / 4).alias("record_idx"), (F.col("i") % 4).cast("int").alias("k"), "value")
    # a record's lines are dealt to one of so many tasks by the number of lines: texts can't be summed in a hash table, and sorting a whole split for it takes much memory
    record = numbered.repartition(max(spark.sparkContext.defaultParallelism, -(-total // LINES)), "file_no", "record_idx").groupBy("file_no", "record_idx")
    line = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    rows = record.agg(line(0).alias("header"), line(1).alias("sequence"), line(2).alias("plus"), line(3).alias("quality")).join(files, "file_no")
    rows = rows.where("header like '@%' and plus like '+%' and length(header) > 1 and length(sequence) > 0 and length(quality) > 0")
    if max_reads is not None:
        rows = rows.where(F.col("record_idx") < max_reads)
    scores = dna.phred_decode("quality")
    return rows.select(
        "file", "record_idx", F.expr("substring(header, 2)").alias("read_id"), "sequence", dna.umi_from_header("header").alias("umi"), scores.alias("quality_scores"),
        (F.aggregate(scores, F.lit(0), lambda a, v: a + v) / F.length("quality")).alias("mean_quality"), F.length("sequence").alias("sequence_length"))


def profile(records: DataFrame, first: int | None = 1000) -> DataFrame:
    rows = records if first is None else records.where(F.col("record_idx") < first)
    valid = F.length("sequence") == F.size("quality_scores")
    return rows.agg(F.count(F.lit(1)).alias("total_reads"), F.count(F.when(valid, 1)).alias("valid_reads"), F.count("umi").alias("umi_reads"), F.avg("sequence_length").alias("mean_length"), F.avg("mean_quality").alias("mean_quality"))


def umi_format(headers: DataFrame, header: str = "read_id") -> DataFrame:
    """The commonest header form, ties to the alphabetically first."""
    form = F.when(F.col(header).rlike(dna.UMI_PATTERNS[0]), "UMI:").when(F.col(header).rlike(dna.UMI_PATTERNS[1]), "_UMI_").when(F.col(header).rlike(dna.UMI_PATTERNS[2]), ":UMI").otherwise("none")
    return headers.groupBy(form.alias("format")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "format").limit(1)


def best_read_families(records: DataFrame, least_quality: float = 20.0) -> DataFrame:
    """umi, family_size, the sequence of the read with the highest mean quality (the first of equals), pooled mean quality, pass."""
    out = records.where("umi is not null").groupBy("umi").agg(
        F.count(F.lit(1)).alias("family_size"), F.max_by("sequence", F.struct(F.col("mean_quality"), -F.col("record_idx"))).alias("consensus_sequence"),
        (F.sum(F.col("mean_quality") * F.size("quality_scores")) / F.sum(F.size("quality_scores"))).alias("mean_quality"))
    return out.withColumn("passes_quality", F.col("mean_quality") >= least_quality)


def record() -> Column:
    """The four FASTQ lines of a read as one text."""
    header = F.concat(F.lit("@"), F.concat_ws("_", F.lit("READ"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(" UMI:"), "umi")
    return F.concat_ws("\n", header, F.col("umi").alias("s"), F.lit("+"), F.repeat(F.char(F.col("quality") + 33), 6))


def as_records(reads: DataFrame) -> DataFrame:
    """FASTQ lines (one record a row, four lines) of a reads table, for writing as text."""
    return reads.select(record().alias("value"))
