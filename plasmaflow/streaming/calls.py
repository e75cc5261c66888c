"""Structured Streaming: messages of samples in, calls, running totals, metrics and dead letters out; hourly counts with a watermark.

A message holds reads of one sample, all of it or whole families of it: key = sample_id, value = JSON {sample_id, timestamp,
sample_data: {reads: [...]}, config: {...}}.
Every micro-batch runs the batch operators on its exploded reads; the error rate is a small reference table, and the scope
of the false-discovery rate is one message. Samples whose messages fall into several micro-batches are summed: by `totals` in what the
stream has written, or while it runs by `running_totals`, a second stream that keeps each sample's sums in its state.

The whole method is a chain of streams over topics: `count_to_topic` parses and collapses the messages and puts counts and dead letters on
topics, `background` sums the counts from which `error_model` is fitted, and `call_to_topic` tests each sample's running sums against
the model and puts a result with its metrics on a topic, which `results` reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plasmaflow.functions import tails
from plasmaflow.operators import errors as error_models
from plasmaflow.operators import filters, umi
from plasmaflow.streaming import topic

READ = "chrom string, pos int, ref string, alt string, umi string, quality int, strand string, read_position int"
#: What the error model needs of a read besides: its sample's allele fraction in thousandths and its context; null in messages without them.
MODEL = "af_milli int, context string"
MESSAGE = f"sample_id int, timestamp string, sample_data struct<reads: array<struct<{', '.join(f.replace(' ', ': ') for f in f'{READ}, {MODEL}'.split(', '))}>>>, config struct<min_quality: int, min_family_size: int, alpha: double>"
#: Thresholds where a message's config names none.
DEFAULTS = {"min_quality": 20, "min_family_size": 3, "alpha": 0.05}

#: Numbers that `batch_counts` gives: all reads; of the families of the least size or more their reads, those with a consensus other
#: than the reference, those of them whose mean quality passes too, and all.
SUMS = ["n_received", "n_reads", "n_variants", "n_passed", "n_total"]
COUNTS = f"sample_id int, alpha double, af_milli int, context string, {', '.join(f'{c} long' for c in SUMS)}"
#: The value of a result: counts, the test of n_passed against the model, and the metrics.
RESULT = """status string, sample_id int, run_id string, timestamp timestamp, alpha double, n_reads long, n_variants long, n_total long,
expected_variants double, fold_change double, p_value double, p_adjusted double, significant boolean,
metrics struct<n_reads: long, n_variants_detected: long, variant_detection_rate: double, mean_allele_fraction: double>,
error_model struct<rate: double, n_observations: long>"""
#: Reads that a message holds on average at most; families stay whole.
MESSAGE_READS = 5_000


def kafka_source(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100, starting: str = "earliest") -> DataFrame:
    """key, value of a topic; needs Spark's Kafka package on the cluster."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("maxOffsetsPerTrigger", per_trigger).load()
    return stream.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def file_source(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def topic_source(spark: SparkSession, path: str, starting: str = "earliest", group: str | None = None) -> DataFrame:
    """key, value of a topic in a shared folder: the same use as `kafka_source`, without a broker."""
    topic.register(spark)
    stream = spark.readStream.format("topic").option("path", path).option("startingOffsets", starting)
    return (stream.option("group", group) if group else stream).load().select("key", "value")


def to_messages(reads: DataFrame, most: int = MESSAGE_READS, model: bool = False) -> DataFrame:
    """key, value: messages of about `most` reads of a sample or fewer, dealt by families, for any sink that takes key and value; with
    `model` the reads hold what the error model needs."""
    fields = [f.split(" ")[0] for f in (f"{READ}, {MODEL}" if model else READ).split(", ")]
    sizes = reads.groupBy("sample_id").agg(F.ceil(F.count(F.lit(1)) / most).alias("chunks"))
    dealt = reads.join(sizes, "sample_id").withColumn("chunk", F.pmod(F.xxhash64(*umi.FAMILY), F.col("chunks")))
    listed = dealt.groupBy("sample_id", "chunk").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("reads"))
    return listed.select(F.col("sample_id").cast("string").alias("key"), F.to_json(F.struct("sample_id", F.struct("reads").alias("sample_data"))).alias("value"))


def publish(messages: DataFrame, sink: str, checkpoint: str, **options: str):
    """Start a stream that writes key and value to a sink: "kafka" (kafka.bootstrap.servers, topic), "topic" (path) or files ("json", path)."""
    topic.register(messages.sparkSession)
    out = messages.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return out.writeStream.format(sink).options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exploded reads with their message's thresholds as columns, and dead letters (key, value, error)."""
    parsed = messages.withColumn("m", F.from_json("value", MESSAGE))
    error = F.when(F.col("m.sample_id").isNull(), "no sample_id or no JSON").when(F.coalesce(F.size("m.sample_data.reads"), F.lit(0)) <= 0, "no reads")
    good = parsed.where(error.isNull()).select(F.col("m.sample_id").alias("sample_id"), *(F.coalesce(F.col(f"m.config.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()), F.explode("m.sample_data.reads").alias("r"))
    return good.select("sample_id", *DEFAULTS, "r.*"), parsed.select("key", "value", error.alias("error")).where("error is not null")


def batch_calls(reads: DataFrame, error_rate: float) -> DataFrame:
    """One row a sample: reads, variant and all families, rate, p and verdict, with the message's own thresholds."""
    keys = [*umi.FAMILY, *DEFAULTS]
    # reads under the message's threshold keep counting for the family's size: their quality is set to 0
    shaped = reads.withColumn("quality", F.when(F.col("quality") >= F.col("min_quality"), F.col("quality")).otherwise(0))
    fams = umi.families(shaped, min_quality=1, keys=keys).where(F.col("family_size") >= F.col("min_family_size"))
    fams = filters.collapsed_passes(fams, min_quality=0.0)
    out = fams.groupBy("sample_id", "alpha").agg(F.sum("family_size").alias("n_reads"), F.count(F.when(F.col("is_variant"), 1)).alias("n_variants"), F.count(F.lit(1)).alias("n_total"))
    return _tested(out, error_rate)


def totals(results: DataFrame, error_rate: float) -> DataFrame:
    """One row a sample of the rows that micro-batches gave for it: sums of the counts, with rate, p and verdict of the sums."""
    out = results.groupBy("sample_id", "alpha").agg(*(F.sum(c).alias(c) for c in ("n_reads", "n_variants", "n_total")))
    return _tested(out, error_rate)


def _tested(out: DataFrame, error_rate: float) -> DataFrame:
    out = out.withColumn("variant_rate", F.col("n_variants") / F.col("n_total")).withColumn("expected", F.col("n_total") * F.lit(error_rate))
    return out.withColumn("p_value", tails.poisson_two_sided("n_variants", "expected")).withColumn("significant", F.col("p_value") <= F.col("alpha"))


def run(messages: DataFrame, error_rate: float, results: str, errors: str, checkpoint: str, trigger: dict | None = None, call: Callable[[DataFrame, float], DataFrame] = batch_calls):
    """Start the stream: results and dead letters as Parquet by batch_id, overwritten when a batch is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good, bad = parse(batch)
        call(good, error_rate).write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{errors}/batch_id={batch_id}")
        batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def batch_counts(reads: DataFrame) -> DataFrame:
    """A row a sample, alpha, allele fraction and context with the numbers of `SUMS`, with the message's own thresholds: sums of them give
    the sample's totals, and those of the negative controls the error model."""
    keys = [*umi.FAMILY, *DEFAULTS, "af_milli", "context"]
    fams = filters.collapsed_passes(umi.families(reads, min_quality=F.col("min_quality"), keys=keys), min_quality=F.col("min_quality"))
    large = F.col("family_size") >= F.col("min_family_size")
    sums = {
        "n_received": F.sum("family_size"),
        "n_reads": F.sum(F.when(large, F.col("family_size")).otherwise(0)),
        "n_variants": F.count(F.when(large & F.col("passes_consensus") & (F.col("allele") != F.col("ref")), 1)),
        "n_passed": F.count(F.when(large & F.col("is_variant"), 1)),
        "n_total": F.count(F.when(large, 1)),
    }
    return fams.groupBy("sample_id", "alpha", "af_milli", "context").agg(*(sums[c].alias(c) for c in SUMS))


def _put(rows: DataFrame, path: str, producer: str, batch_id: int) -> None:
    topic.register(rows.sparkSession)
    rows.write.format("topic").option("path", path).option("producer", producer).option("batchId", str(batch_id)).mode("append").save()


def count_to_topic(messages: DataFrame, error_rate: float | None, path: str, checkpoint: str, producer: str = "calls", trigger: dict | None = None, errors: str | None = None):
    """Start a stream that puts each micro-batch's counts on a topic: key = sample_id, value = JSON of a row of `batch_counts`; and dead
    letters on the topic `errors`, if given: value = JSON of status, error, timestamp, input_key.

    A micro-batch that is repeated has the same number, so a topic takes it once. Nothing is tested here, so `error_rate` is not used:
    `call_to_topic` tests the sums against the fitted model."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = parse(batch)  # the source is read again for the dead letters: a batch may be too large to keep
        _put(batch_counts(good).select(F.col("sample_id").cast("string").alias("key"), F.to_json(F.struct(F.col("*"))).alias("value")), path, producer, batch_id)
        if errors:
            error = F.struct(F.lit("error").alias("status"), "error", F.current_timestamp().alias("timestamp"), F.col("key").alias("input_key"))
            _put(bad.select("key", F.to_json(error).alias("value")), errors, producer, batch_id)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _parsed_counts(counts: DataFrame) -> DataFrame:
    return counts.select(F.from_json("value", COUNTS).alias("c")).select("c.*")


def running_totals(counts: DataFrame) -> DataFrame:
    """sample_id, alpha and the sums of a stream of counts (key, value as from `count_to_topic`), with af_weight, the sum of the families'
    allele fractions in thousandths: the state holds one row a sample."""
    weight = F.sum(F.col("n_total") * F.col("af_milli")).alias("af_weight")
    return _parsed_counts(counts).groupBy("sample_id", "alpha").agg(*(F.sum(c).alias(c) for c in SUMS), weight)


def background(counts: DataFrame) -> DataFrame:
    """af_milli, context and the sums of a stream of counts, of all samples together, for `upsert`: what `error_model` is fitted from."""
    return _parsed_counts(counts).groupBy("af_milli", "context").agg(F.sum("n_passed").alias("n_passed"), F.sum("n_total").alias("n_total"))


def error_model(spark: SparkSession, path: str) -> DataFrame:
    """The error model (`errors.fit_error_model`) of all families whose sums `upsert` wrote to path: those of negative controls, or of the
    smallest allele fraction where there are none."""
    sums = latest(spark, path, ["af_milli", "context"]).where("n_total > 0").withColumn("allele_fraction", F.col("af_milli") / 1000)
    controls = error_models.negative_controls(sums)
    return error_models.error_rates(controls.groupBy("context").agg(F.sum("n_total").alias("n_observations"), F.sum("n_passed").alias("k")))


def tested(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Rows (alpha, n_total, metrics) tested against the model's mean rate. The false-discovery rate is that of one sample's test; without
    controls the rate is that of an unknown context."""
    rate = model.agg(F.coalesce(F.avg("error_rate"), F.lit(error_models.DEFAULT_RATE)).alias("rate"), F.coalesce(F.sum("n_observations"), F.lit(0)).alias("n_observations"))
    out = rows.drop("error_model").join(F.broadcast(rate.select(F.struct("rate", "n_observations").alias("error_model"))))
    found = F.col("metrics.n_variants_detected")
    out = out.withColumn("expected_variants", F.col("n_total") * F.col("error_model.rate")).withColumn("fold_change", F.when(F.col("expected_variants") > 0, found / F.col("expected_variants")))
    out = out.withColumn("p_value", tails.poisson_two_sided(found, "expected_variants")).withColumn("p_adjusted", F.col("p_value"))
    return out.withColumn("significant", F.col("p_adjusted") <= F.col("alpha"))


def sample_calls(sums: DataFrame, model: DataFrame) -> DataFrame:
    """Running sums of samples with their metrics, `tested`: the columns of `RESULT` but status, run_id and timestamp."""
    share = lambda x: F.when(F.col("n_total") > 0, x / F.col("n_total"))
    metrics = F.struct(F.col("n_received").alias("n_reads"), F.col("n_passed").alias("n_variants_detected"), F.coalesce(share(F.col("n_passed")), F.lit(0.0)).alias("variant_detection_rate"), share(F.col("af_weight") / 1000).alias("mean_allele_fraction"))
    return tested(sums.withColumn("metrics", metrics).drop("n_received", "n_passed", "af_weight"), model)


def call_to_topic(totals: DataFrame, model: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, producer: str = "results", trigger: dict | None = None):
    """Start a stream that puts a result for each sample whose `running_totals` change on a topic: key = sample_id, value = JSON of `RESULT`.

    `model` is asked for the error model in each micro-batch, so let the stream of the `background` go first. A result is of the sums and the
    model of its micro-batch; `results` revises those that were given before the model changed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        called = sample_calls(batch, model(batch.sparkSession)).withColumns({"status": F.lit("completed"), "run_id": F.lit(f"{producer}_{batch_id}"), "timestamp": F.current_timestamp()})
        _put(called.select(F.col("sample_id").cast("string").alias("key"), F.to_json(F.struct(F.col("*"))).alias("value")), path, producer, batch_id)

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def results(spark: SparkSession, path: str, model: DataFrame | None = None) -> DataFrame:
    """The latest result of each sample and alpha on a topic of results; with a model they are tested again against it."""
    topic.register(spark)
    rows = spark.read.format("topic").option("path", path).load().select(F.from_json("value", RESULT).alias("r"), "offset")
    last = rows.groupBy("r.sample_id", "r.alpha").agg(F.max_by("r", "offset").alias("r")).select("r.*")
    return last if model is None else tested(last, model).select(*last.columns)


def upsert(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a stream in update mode: the changed rows of a micro-batch as Parquet by batch_id, overwritten when it is repeated; see `latest`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key of what `upsert` wrote, open windows and running sums included."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("v")).select(*keys, "v.*")


def hourly_status(jobs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and status of a stream of jobs; rows later than the watermark are dropped. In append mode an hour appears once it is
    past the watermark; with `upsert` and `latest` the open hours are there too."""
    return jobs.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "status", "n")
