"""Queries over files, FASTQ, streams and learned models. Files and streams are derived from the given tables by Spark."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plasmaflow.functions import dna
from plasmaflow.operators import metrics, ml
from plasmaflow.operators.lineage import cut, freed, shared
from plasmaflow.plans import core, scores
from plasmaflow.plans.registry import query
from plasmaflow.sources import adapters, fastq, files
from plasmaflow.streaming import calls, topic


def _folder(spark) -> str:
    return f"{shared(spark)}/{uuid.uuid4().hex}"


def _records(s, d, **k):
    path = _folder(s)
    fastq.as_records(core.reads(s, d)).write.text(path)
    return fastq.read_fastq(s, path, **k)


R = core.READS
query("fastq_scan", R + " SELECT umi, umi AS sequence, CAST(quality AS DOUBLE) AS mean_quality, 6 AS sequence_length, COUNT(*) AS n FROM reads GROUP BY ALL")(
    lambda s, d: _records(s, d).groupBy("umi", "sequence", "mean_quality", "sequence_length").agg(F.count(F.lit(1)).alias("n")))
def _lanes(s, d):
    """Records in files of 5,000 orders each, in order; the first hundred records of every file."""
    path, keys = _folder(s), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quality"]
    rows = core.reads(s, d).withColumn("lane", F.floor(F.col("l_orderkey") / 5000)).repartition("lane").sortWithinPartitions("lane", *keys)
    rows.select("lane", fastq.record().alias("value")).write.partitionBy("lane").text(path)
    return fastq.read_fastq(s, path, max_reads=100)


query("fastq_max_reads", R + " SELECT umi, COUNT(*) AS n FROM (SELECT umi, ROW_NUMBER() OVER (PARTITION BY l_orderkey // 5000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, quality) AS i FROM reads) WHERE i <= 100 GROUP BY ALL")(lambda s, d: _lanes(s, d).groupBy("umi").agg(F.count(F.lit(1)).alias("n")))
query("fastq_profile", R + " SELECT COUNT(*) AS total_reads, COUNT(*) AS valid_reads, COUNT(umi) AS umi_reads, CAST(6 AS DOUBLE) AS mean_length, ROUND(AVG(quality), 6) AS mean_quality FROM reads")(lambda s, d: fastq.profile(_records(s, d), None))
query("umi_format_detect", R + " SELECT 'UMI:' AS format, COUNT(*) AS n FROM reads")(lambda s, d: fastq.umi_format(_records(s, d)))
query("consensus_best_read", R + " SELECT umi, COUNT(*) AS family_size, umi AS consensus_sequence, ROUND(AVG(quality), 6) AS mean_quality, AVG(quality) >= 20 AS passes_quality FROM reads GROUP BY ALL")(lambda s, d: fastq.best_read_families(_records(s, d)))
query("umi_from_header", R + " SELECT umi, COUNT(*) AS n FROM reads GROUP BY ALL")(lambda s, d: core.reads(s, d).select(dna.umi_from_header(F.concat(F.lit("@r UMI:"), "umi")).alias("umi")).groupBy("umi").agg(F.count(F.lit(1)).alias("n")))
query("phred_decode", R + " SELECT quality AS q, COUNT(*) AS n FROM reads GROUP BY ALL")(lambda s, d: core.reads(s, d).select(dna.phred_decode(F.char(F.col("quality") + 33))[0].alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("n")))
query("phred_weight", R + " SELECT quality, CAST(CAST(POW(10, quality / 10.0) AS DECIMAL(20,6)) AS DOUBLE) AS w FROM reads GROUP BY ALL")(lambda s, d: core.reads(s, d).select("quality", dna.phred_weight("quality").cast("double").alias("w")).distinct())
query("reverse_complement", R + " SELECT DISTINCT umi, TRANSLATE(umi, 'ACGT', 'TGCA') AS complement, REVERSE(TRANSLATE(umi, 'ACGT', 'TGCA')) AS reverse_complement FROM reads")(lambda s, d: core.reads(s, d).select("umi", dna.complement("umi").alias("complement"), dna.reverse_complement("umi").alias("reverse_complement")).distinct())
query("complement", R + " SELECT DISTINCT umi, TRANSLATE(umi, 'ACGT', 'TGCA') AS complement FROM reads")(lambda s, d: core.reads(s, d).select("umi", dna.complement("umi").alias("complement")).distinct())
query("normalize_context", R + f" SELECT DISTINCT context, ref, alt, {core.NORMAL} AS n_context, {core.NREF} AS n_ref, {core.NALLELE.replace('allele', 'alt')} AS n_alt FROM reads")(lambda s, d: core.reads(s, d).select("context", "ref", "alt", dna.normal_context("context").alias("n_context"), dna.normal_base("context", "ref").alias("n_ref"), dna.normal_base("context", "alt").alias("n_alt")).distinct())
query("mutation_type", R + " SELECT ref, alt, CASE WHEN ref || alt IN ('AG', 'GA', 'CT', 'TC') THEN 'transition' ELSE 'transversion' END AS kind, COUNT(*) AS n FROM reads WHERE ref <> alt GROUP BY ALL")(lambda s, d: core.reads(s, d).where("ref <> alt").groupBy("ref", "alt", dna.mutation_type("ref", "alt").alias("kind")).agg(F.count(F.lit(1)).alias("n")))
query("extract_context", R + " SELECT umi, read_position % 6 AS at, CASE WHEN read_position % 6 BETWEEN 1 AND 4 THEN SUBSTR(umi, read_position % 6, 3) END AS context, COUNT(*) AS n FROM reads GROUP BY ALL")(lambda s, d: core.reads(s, d).withColumn("at", F.col("read_position") % 6).select("umi", "at", dna.extract_context("umi", "at").alias("context")).groupBy("umi", "at", "context").agg(F.count(F.lit(1)).alias("n")))


def _round_trip(write, read):
    def run(s, d):
        path = _folder(s)
        write(core.fams(s, d).select(*core.KEYS, "family_size", "allele"), path)
        return read(s, path)

    return run


FAMS = core.FAMS + " SELECT sample_id, chrom, pos, ref, umi, family_size, allele FROM fams"
query("parquet_io", FAMS)(_round_trip(lambda df, p: files.write_parquet(df, p, ["sample_id"]), lambda s, p: s.read.parquet(p)))
query("csv_io", FAMS)(_round_trip(files.write_csv, lambda s, p: files.read_csv(s, p, "sample_id int, chrom string, pos int, ref string, umi string, family_size long, allele string")))
query("json_doc_sink", core.FAMS + " SELECT sample_id, COUNT(*) AS n FROM fams GROUP BY ALL")(_round_trip(
    lambda df, p: files.write_json_documents(df, p, ["sample_id"]), lambda s, p: s.read.text(p).select(F.from_json("value", "sample_id int, rows array<struct<umi: string>>").alias("j")).select("j.sample_id", F.size("j.rows").cast("long").alias("n"))))
query("artifact_hash_manifest")(_round_trip(lambda df, p: files.write_parquet(df, p, ["sample_id"]), lambda s, p: files.hash_manifest(s, p, "*.parquet").agg(F.count_distinct("path").alias("n_files"), F.min(F.length("sha256")).alias("digits"))))
query("error_model_io", core.RATES + " SELECT context, mutation, ROUND(rate, 6) AS rate FROM rates")(
    lambda s, d: files.rates_from_json(core.rates(s, d).groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("mutation", F.col("rate").cast("string")))).alias("m")).select(F.to_json(F.map_from_arrays(F.array("context"), F.array("m"))).alias("value"))))
query("contamination_matrix_io", R + " SELECT chrom AS source, ref AS target, CAST(COUNT(*) AS DOUBLE) AS rate FROM reads GROUP BY ALL")(lambda s, d: files.contamination_pairs(core.reads(s, d).groupBy(F.concat_ws("->", "chrom", "ref").alias("key")).agg(F.count(F.lit(1)).alias("value"))))


# streams: messages are written as files, read by a file stream, and compared with the batch result
def _stream(s, d, change=None):
    path = _folder(s)
    messages = calls.to_messages(core.reads(s, d))
    (messages.withColumn("value", F.expr(change)) if change else messages).write.json(f"{path}/in")
    calls.run(calls.file_source(s, f"{path}/in"), 0.002, f"{path}/out", f"{path}/errors", f"{path}/state").awaitTermination()
    return path


def _running(s, d):
    """Messages go through a topic to a stream of counts, and these through another topic to a stream that sums the background of the error
    model and to one that keeps each sample's sums, tests them against the model and puts results on a topic."""
    path = _folder(s)
    calls.to_messages(core.reads(s, d), model=True).write.json(f"{path}/in")
    calls.publish(calls.file_source(s, f"{path}/in"), "topic", f"{path}/state1", path=f"{path}/messages").awaitTermination()
    calls.count_to_topic(calls.topic_source(s, f"{path}/messages"), None, f"{path}/counts", f"{path}/state2", errors=f"{path}/errors").awaitTermination()
    calls.upsert(calls.background(calls.topic_source(s, f"{path}/counts")), f"{path}/background", f"{path}/state3").awaitTermination()
    totals = calls.running_totals(calls.topic_source(s, f"{path}/counts"))
    calls.call_to_topic(totals, lambda spark: calls.error_model(spark, f"{path}/background"), f"{path}/results", f"{path}/state4").awaitTermination()
    return calls.results(s, f"{path}/results").where("n_total > 0")


BROKEN = "if(cast(key as int) % 3 = 0, '{', value)"
STRICT = """concat(substring(value, 1, length(value) - 1), ', "config": {"min_family_size": 5}}')"""
STREAM = core.FAMS + ", c AS (SELECT sample_id, COUNT(*) FILTER (COALESCE(consensus_agreement >= 0.6 AND allele <> ref, FALSE)) AS n_variants, COUNT(*) AS n_total, CAST(SUM(family_size) AS BIGINT) AS n_reads FROM fams WHERE family_size >= 3 GROUP BY ALL)"
query("stream_calls", STREAM + " SELECT sample_id, n_reads, n_variants, n_total FROM c")(lambda s, d: _running(s, d).select("sample_id", "n_reads", "n_variants", "n_total"))
query("stream_sample_metrics", STREAM + " SELECT sample_id, n_reads, n_variants, ROUND(n_variants / n_total, 6) AS variant_rate FROM c")(lambda s, d: calls.totals(s.read.parquet(f"{_stream(s, d)}/out"), 0.002).select("sample_id", "n_reads", "n_variants", "variant_rate"))
query("stream_dead_letter", R + " SELECT DISTINCT CAST(sample_id AS VARCHAR) AS key, 'no sample_id or no JSON' AS error FROM reads WHERE sample_id % 3 = 0")(lambda s, d: s.read.parquet(f"{_stream(s, d, BROKEN)}/errors").select("key", "error").distinct())


def _ingest(s, d):
    """The messages are published by a stream to a folder of JSON lines and read back from it."""
    path = _folder(s)
    calls.to_messages(core.reads(s, d)).write.json(f"{path}/in")
    calls.publish(calls.file_source(s, f"{path}/in"), "json", f"{path}/state", path=f"{path}/topic").awaitTermination()
    return s.read.schema("key string, value string").json(f"{path}/topic").select("key").distinct()


query("stream_ingest", R + " SELECT DISTINCT CAST(sample_id AS VARCHAR) AS key FROM reads")(_ingest)
query("stream_microbatch", STREAM + " SELECT COUNT(*) AS n_samples, CAST(SUM(n_variants) AS BIGINT) AS n_variants FROM c")(lambda s, d: calls.totals(s.read.parquet(f"{_stream(s, d)}/out"), 0.002).agg(F.count(F.lit(1)).alias("n_samples"), F.sum("n_variants").alias("n_variants")))
query("stream_config_override", STREAM.replace("WHERE family_size >= 3", "WHERE family_size >= 5") + " SELECT sample_id, n_variants, n_total FROM c")(lambda s, d: calls.totals(s.read.parquet(f"{_stream(s, d, STRICT)}/out"), 0.002).select("sample_id", "n_variants", "n_total"))


def _topic(s, d):
    """Messages published to a topic by key, read back as a stream from its earliest offset."""
    path = _folder(s)
    calls.to_messages(core.reads(s, d)).write.json(f"{path}/in")
    calls.publish(calls.file_source(s, f"{path}/in"), "topic", f"{path}/state", path=f"{path}/topic").awaitTermination()
    back = s.readStream.format("topic").option("path", f"{path}/topic").load()
    back.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state2").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.schema(topic.SCHEMA).parquet(f"{path}/out")
    return rows.groupBy("key").agg(F.count_distinct("partition").alias("n_partitions"), F.sum(F.size(F.from_json("value", calls.MESSAGE)["sample_data"]["reads"])).alias("n_reads"))


query("kafka_source_sink", R + " SELECT CAST(sample_id AS VARCHAR) AS key, 1 AS n_partitions, COUNT(*) AS n_reads FROM reads GROUP BY ALL")(_topic)


def _hourly(s, d):
    path = _folder(s)
    adapters.job_log(s, d).select("created_at", "status").repartitionByRange(4, "created_at").write.parquet(f"{path}/in")
    stream = s.readStream.schema("created_at timestamp, status string").parquet(f"{path}/in")
    calls.upsert(calls.hourly_status(stream), f"{path}/out", f"{path}/state").awaitTermination()
    return calls.latest(s, f"{path}/out", ["hour", "status"])


query("stream_hourly_status", f"WITH jobs AS ({adapters.duck(adapters.JOB_LOG)}) SELECT DATE_TRUNC('hour', created_at) AS hour, status, COUNT(*) AS n FROM jobs GROUP BY ALL")(_hourly)


# learned calling over family features; the queries fit smaller forests and fewer rounds than the library's defaults
SIZES = {"trees": 20, "depth": 5, "rounds": 10, "round_depth": 3}


def _train(df, kind):
    return ml.train(df, kind, **SIZES)


def _rows(s, d):
    """The families are stored once, as narrow as they are: statistics, features and every pass of a fit read them from there."""
    stored = cut(core.collapsed(s, d).select(*core.KEYS, (F.col("af_milli") >= 60).cast("int").alias("label"), "is_variant", "allele_fraction", *ml.BASIC))
    return ml.features(stored).select(*core.KEYS, "label", "is_variant", *ml.BASIC, *ml.DERIVED)


def _split(s, d):
    return ml.split(ml.assembled(_rows(s, d)), core.KEYS)


def _scores(s, d, kind):
    a, b = _split(s, d)
    return ml.probability(_train(a, kind), b).select(*core.KEYS, "label", "score")


C = core.COLLAPSED
query("ml_features", C + " SELECT sample_id, chrom, pos, ref, umi, ROUND(family_size / (mean_quality + 1), 6) AS size_per_quality, ROUND(LN(1 + family_size), 6) AS log_size, ROUND(SQRT(mean_quality), 6) AS root_quality, ROUND(family_size * mean_quality, 6) AS size_quality FROM collapsed")(lambda s, d: _rows(s, d).select(*core.KEYS, "size_per_quality", "log_size", "root_quality", "size_quality"))
query("interaction_features", C + ", z AS (SELECT AVG(family_size) AS m, STDDEV_POP(family_size) AS sd FROM collapsed) SELECT sample_id, chrom, pos, ref, umi, ROUND((family_size - m) / (sd + 1e-8), 6) AS size_z, ROUND(mean_quality / family_size, 6) AS quality_per_size, ROUND(COALESCE(consensus_agreement, 0) / family_size, 6) AS agreement_per_size FROM collapsed, z")(lambda s, d: _rows(s, d).select(*core.KEYS, "size_z", "quality_per_size", "agreement_per_size"))
query("ml_select_anova")(lambda s, d: s.createDataFrame([(int(i),) for i in ml.select_anova(ml.assembled(_rows(s, d)), 4)], "feature int"))
MI = C + ", l AS (SELECT *, CAST(af_milli >= 60 AS INT) AS y, COALESCE(consensus_agreement, 0) AS agreement FROM collapsed)" + "".join(
    f", {f}_q AS (SELECT QUANTILE_CONT({f}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM l), {f}_c AS (SELECT LEN(LIST_FILTER(q, lambda v: {f} > v)) AS x, y, COUNT(*) AS n FROM l, {f}_q GROUP BY ALL), {f}_m AS (SELECT n, SUM(n) OVER (PARTITION BY x) AS nx, SUM(n) OVER (PARTITION BY y) AS ny, SUM(n) OVER () AS t FROM {f}_c)"
    for f in ("family_size", "mean_quality", "agreement")) + " " + " UNION ALL ".join(f"SELECT '{'consensus_agreement' if f == 'agreement' else f}' AS feature, ROUND(SUM(n / t * LN(n * t / (nx * ny))), 6) AS mi FROM {f}_m" for f in ("family_size", "mean_quality", "agreement"))
query("ml_select_mi", MI)(lambda s, d: metrics.mutual_information(_rows(s, d), ["family_size", "mean_quality", "consensus_agreement"], "label"))
query("ml_scale", C + ", z AS (SELECT *, COALESCE(consensus_agreement, 0) AS a FROM collapsed), m AS (SELECT " + ", ".join(f"AVG({f}) AS m_{f}, STDDEV_SAMP({f}) AS s_{f}" for f in ("family_size", "mean_quality", "a")) + " FROM z) SELECT sample_id, chrom, pos, ref, umi, ROUND((family_size - m_family_size) / s_family_size, 6) AS family_size, ROUND((mean_quality - m_mean_quality) / s_mean_quality, 6) AS mean_quality, ROUND((a - m_a) / s_a, 6) AS consensus_agreement FROM z, m")(
    lambda s, d: ml.scaled(ml.assembled(_rows(s, d))).withColumn("z", vector_to_array("scaled")).select(*core.KEYS, *(F.col("z")[i].alias(n) for i, n in enumerate(ml.BASIC))))
query("ml_class_weight", C + ", r AS (SELECT AVG(CAST(is_variant AS INT)) AS share FROM collapsed) SELECT is_variant, ROUND(CASE WHEN share < 0.01 AND share > 0 AND is_variant THEN 1 / share ELSE 1 END, 6) AS weight, COUNT(*) AS n FROM collapsed, r GROUP BY ALL")(lambda s, d: ml.class_weight(core.collapsed(s, d).withColumn("label", F.col("is_variant").cast("int"))).groupBy("is_variant", "weight").agg(F.count(F.lit(1)).alias("n")))
for _kind in ("rf", "gbt", "lr", "svm"):
    query(f"ml_{_kind}")(lambda s, d, k=_kind: _scores(s, d, k))


def _ensemble(s, d):
    a, b = _split(s, d)
    folds = cut(metrics.stratified_folds(a, "umi", "label", 3).select("label", "features", "fold"))

    def auc(kind):
        with freed():  # each kind's copy of the rows and its scores
            return metrics.cv_scores(folds, "fold", lambda x, y: ml.probability(_train(x, kind), y), 3).agg(F.avg("auc")).first()[0]

    return ml.ensemble({k: (_train(a, k), auc(k)) for k in ("rf", "gbt", "lr")}, b).select(*core.KEYS, "label", "score")


query("ml_ensemble")(_ensemble)
query("ml_call", adapters_sql := f"WITH scored AS ({adapters.duck(adapters.SCORED)}), m AS (SELECT MEDIAN(score) AS threshold FROM scored) SELECT id, score > threshold AS is_call, ROUND(1 - score, 6) AS p_value FROM scored, m")(lambda s, d: ml.call(adapters.scored(s, d)).select("id", "is_call", "p_value"))
query("ml_eval", scores.AUC + """, pr AS (SELECT label, CAST(score > 0.5 AS INT) AS pred FROM scored), k AS (SELECT l, COUNT(*) FILTER (label = l) AS n, COUNT(*) FILTER (label = l AND pred = l) AS tp, COUNT(*) FILTER (pred = l) AS pp FROM pr, (VALUES (0), (1)) v(l) GROUP BY l)
 SELECT ANY_VALUE(auc) AS auc, ANY_VALUE(average_precision) AS average_precision, ROUND(SUM(n * tp / pp) / SUM(n), 6) AS precision, ROUND(SUM(tp) / SUM(n), 6) AS recall, ROUND(SUM(n * (2.0 * tp / (n + pp))) / SUM(n), 6) AS f1 FROM k, m""")(lambda s, d: s.createDataFrame([tuple(ml.evaluate(adapters.scored(s, d)).values())], "auc double, average_precision double, precision double, recall double, f1 double"))
query("ml_importance")(lambda s, d: (lambda a: ml.importance(s, {"rf": (_train(a, "rf"), 1.0), "gbt": (_train(a, "gbt"), 1.0)}, ml.BASIC + ml.DERIVED))(cut(_split(s, d)[0])))
SPLIT = "CAST('0x' || SUBSTR(MD5(CONCAT_WS('|', sample_id, chrom, pos, ref, umi, '0')), 1, 8) AS BIGINT) % 1000 < 800"
query("ml_train_val_split", core.FAMS + f" SELECT COUNT(*) FILTER ({SPLIT}) AS n_train, COUNT(*) FILTER (NOT ({SPLIT})) AS n_validation FROM fams")(lambda s, d: (lambda ab: ab[0].agg(F.count(F.lit(1)).alias("n_train")).join(F.broadcast(ab[1].agg(F.count(F.lit(1)).alias("n_validation")))))(ml.split(core.fams(s, d), core.KEYS)))


def _saved_call(s, d):
    """A caller is fitted, saved and loaded; a table and a stream of the validation rows are scored with it and compared row by row."""
    path, threshold = _folder(s), 0.5
    rows = core.collapsed(s, d).withColumn("label", (F.col("af_milli") >= 60).cast("int")).select(*core.KEYS, "label", "allele_fraction", *ml.BASIC)
    train, test = ml.split(cut(rows), core.KEYS)
    ml.save(ml.fit_caller(train, "lr"), f"{path}/model")
    model = ml.load(f"{path}/model")
    test.write.parquet(f"{path}/in")
    stream = s.readStream.schema(test.schema).parquet(f"{path}/in")
    ml.call_families(model, stream, threshold).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    table, streamed = (x.select(*core.KEYS, "is_call", F.round("score", 9).alias("score")) for x in (ml.call_families(model, test, threshold), s.read.parquet(f"{path}/out")))
    same = table.withColumnsRenamed({"is_call": "c", "score": "p"}).join(streamed, core.KEYS, "full").where("c <=> is_call and p <=> score and p between 0 and 1 and c = (p > 0.5)")
    return same.agg(F.count(F.lit(1)).alias("n_same"))


query("ml_saved_call", C + f" SELECT COUNT(*) AS n_same FROM collapsed WHERE NOT ({SPLIT})")(_saved_call)
_cv = lambda s, d: metrics.cv_scores(metrics.stratified_folds(ml.assembled(_rows(s, d)), "umi", "label", 5), "fold", lambda a, b: ml.probability(_train(a, "lr"), b), 5)
query("cv_scores")(_cv)
FOLDS = C + ", f AS (SELECT CAST(af_milli >= 60 AS INT) AS label, CAST(CAST('0x' || SUBSTR(MD5(CONCAT_WS('|', umi, CAST(af_milli >= 60 AS INT), '0')), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM collapsed)"
query("cv_sizes", FOLDS + " SELECT fold, (SELECT COUNT(*) FROM f) - COUNT(*) AS n_train, COUNT(*) AS n_test, COUNT(*) FILTER (label = 1) AS n_positive, COUNT(*) FILTER (label = 0) AS n_negative FROM f GROUP BY fold")(lambda s, d: _cv(s, d).select("fold", "n_train", "n_test", "n_positive", "n_negative"))
query("cv_summary")(lambda s, d: metrics.cv_summary(_cv(s, d)))
