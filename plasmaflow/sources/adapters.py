"""Entity views over the star-schema test tables, as SQL that Spark and DuckDB both run ({name} stands for a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sample_id,
       CASE sample_id % 5 WHEN 0 THEN 0 ELSE t END AS af_milli,
       CONCAT('chr', CAST(site % 22 + 1 AS STRING)) AS chrom,
       1000 * (site + 1) AS pos,
       SUBSTR('ACGT', ref_i + 1, 1) AS ref,
       CASE WHEN (fam_h < t AND e20 >= 2) OR (fam_h >= t AND e20 = 0)
            THEN SUBSTR('ACGT', (ref_i + 1 + site % 3) % 4 + 1, 1)
            ELSE SUBSTR('ACGT', ref_i + 1, 1) END AS alt,
       CONCAT(SUBSTR('ACGT', kl + 1, 1), SUBSTR('ACGT', kh + 1, 1), SUBSTR('ACGT', kl + 1, 1),
              SUBSTR('ACGT', (kl + kh) % 4 + 1, 1), SUBSTR('ACGT', kh + 1, 1),
              SUBSTR('ACGT', CASE WHEN e9 = 0 THEN 2 + l_linenumber % 3 ELSE 1 END, 1)) AS umi,
       quality, strand, read_position,
       CONCAT(SUBSTR('ACGT', CAST(FLOOR(site / 4) AS INT) % 4 + 1, 1), SUBSTR('ACGT', ref_i + 1, 1),
              SUBSTR('ACGT', CAST(FLOOR(site / 16) AS INT) % 4 + 1, 1)) AS context
FROM (SELECT b.*, site % 4 AS ref_i,
             CASE sample_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 200 WHEN 2 THEN 60 WHEN 3 THEN 20 ELSE 5 END AS t,
             CAST(FLOOR(k / 4) AS INT) AS kh, k % 4 AS kl,
             CAST(((l_partkey * 6 + k) * 37) % 1000 AS INT) AS fam_h
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(l_partkey % 50 AS INT) AS sample_id,
                   CAST(FLOOR(l_partkey / 50) AS INT) AS site,
                   CAST(l_orderkey % 6 AS INT) AS k,
                   CAST((l_orderkey + l_linenumber) % 9 AS INT) AS e9,
                   CAST((l_orderkey * 7 + l_linenumber) % 20 AS INT) AS e20,
                   CAST(l_quantity AS INT) AS quality,
                   CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
                   CAST(l_orderkey % 150 AS INT) + 1 AS read_position
            FROM {lineitem}) b) c
"""

DETECTION_RUNS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       ROUND(l_discount, 2) AS allele_fraction,
       CAST(ROUND(1000 * (l_tax * 100 + 1)) AS INT) AS umi_depth,
       CAST(l_suppkey % 20 AS INT) AS replicate_id,
       (l_quantity * l_discount * 20 > l_linenumber * 3) AS detected
FROM {lineitem}
"""

SCORED = """
SELECT o_orderkey AS id, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS score,
       CASE WHEN (o_orderkey * 104729) % 1000 < (o_orderkey * 7919) % 1000 THEN 1 ELSE 0 END AS label
FROM {orders}
"""

JOB_LOG = """
SELECT event_id AS job_id, ts AS created_at, value AS duration_s,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status
FROM {events}
"""


#: A table under this size in fewer files than there are cores is dealt over them before costly expressions: its row groups alone
#: would keep most cores idle.
SMALL_BYTES = 256 << 20
#: Parquet bytes of a table (about a quarter of a million reads) that one task groups.
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES and len(df.inputFiles()) < cores else df


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks for a grouping of a table's rows whose groups are about as many as its rows: one for PART_BYTES of the table, all cores at least."""
    size = int(str(table(spark, sf_dir, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READS, lineitem=dealt(table(spark, sf_dir, "lineitem")))


def detection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTION_RUNS, lineitem=table(spark, sf_dir, "lineitem"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED, orders=table(spark, sf_dir, "orders"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOB_LOG, events=table(spark, sf_dir, "events"))


def duck(sql: str) -> str:
    """The same view for DuckDB."""
    return sql.format(lineitem="lineitem", orders="orders", events="events").strip()
