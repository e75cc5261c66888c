"""Topics with offsets and keys, restarts, repeated batches, running totals and complete windows."""

import time

import pytest
from pyspark.sql import functions as F

from plasmaflow.operators import ml
from plasmaflow.streaming import calls, topic


def put(spark, path, rows, batch=None):
    topic.register(spark)
    writer = spark.createDataFrame(rows, "key string, value string").coalesce(1).write.format("topic").option("path", path).mode("append")
    (writer.option("producer", "p").option("batchId", batch) if batch else writer).save()


def read(spark, path):
    topic.register(spark)
    return sorted((tuple(r) for r in spark.read.format("topic").option("path", path).load().collect()), key=lambda r: (r[2], r[3]))


def pump(spark, path, out, state, **options):
    topic.register(spark)
    stream = spark.readStream.format("topic").option("path", path).options(**options).load()
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def test_topic_keeps_keys_together_in_order(spark, tmp_path):
    path = f"{tmp_path}/t"
    for start in (0, 50):
        put(spark, path, [(f"k{i % 7}", f"{i:03d}") for i in range(start, start + 50)])
    put(spark, path, [(None, None)])
    rows = read(spark, path)
    assert len(rows) == 101 and len({(r[2], r[3]) for r in rows if r[0]}) == 100
    for key in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[3])
        assert len({r[2] for r in own}) == 1 and [r[1] for r in own] == sorted(r[1] for r in own)
    assert [(r[1], r[2]) for r in rows if r[0] is None] == [(None, 0)]


def test_topic_restarts_and_starts_late(spark, tmp_path):
    path, out, state = f"{tmp_path}/t", f"{tmp_path}/out", f"{tmp_path}/state"
    put(spark, path, [("a", "1"), ("b", "2")])
    pump(spark, path, out, state, group="g").awaitTermination()
    put(spark, path, [("a", "3")])
    pump(spark, path, out, state, group="g").awaitTermination()
    rows = spark.read.schema(topic.SCHEMA).parquet(out)
    assert sorted(r["value"] for r in rows.collect()) == ["1", "2", "3"]
    kept = topic.committed(path, "g")
    assert kept is None or all(kept[p] <= n for p, n in topic.Folder(path).ends().items())
    late = calls.topic_source(spark, path, "latest").writeStream.format("parquet").option("path", f"{tmp_path}/late").option("checkpointLocation", f"{tmp_path}/state2").trigger(processingTime="0 seconds").start()
    try:
        for _ in range(100):  # its first offsets are those of its first batch
            if late.lastProgress is not None or late.recentProgress:
                break
            time.sleep(0.1)
        time.sleep(2)
        put(spark, path, [("c", "4")])
        for _ in range(100):
            late.processAllAvailable()
            if spark.read.schema("key string, value string").parquet(f"{tmp_path}/late").count():
                break
            time.sleep(0.1)
    finally:
        late.stop()
    assert [r["value"] for r in spark.read.schema("key string, value string").parquet(f"{tmp_path}/late").collect()] == ["4"]


def test_a_repeated_batch_is_taken_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    for batch in ("0", "1", "1", "0"):
        put(spark, path, [("a", batch)], batch)
    assert [r[1] for r in read(spark, path)] == ["0", "1"]  # in the order of their offsets
    folder = topic.Folder(path)
    with pytest.raises(RuntimeError):
        folder.manifests = lambda: []  # another producer committed meanwhile
        folder.commit([], "q", "0")


def test_running_totals_survive_a_restart(spark, sf, tmp_path):
    from plasmaflow.plans import core

    messages = calls.to_messages(core.reads(spark, sf), most=20).withColumn("half", F.pmod(F.hash("value"), F.lit(2)))
    want = {(r["sample_id"], r["n_reads"], r["n_variants"], r["n_total"]) for r in calls.totals(calls.batch_calls(calls.parse(calls.to_messages(core.reads(spark, sf)))[0], 0.002), 0.002).collect()}
    for half in (0, 1):  # the streams stop after the first half and go on from their checkpoints
        messages.where(F.col("half") == half).drop("half").coalesce(2).write.mode("append").json(f"{tmp_path}/in")
        calls.count_to_topic(calls.file_source(spark, f"{tmp_path}/in", 1), 0.002, f"{tmp_path}/counts", f"{tmp_path}/s1").awaitTermination()
        calls.upsert(calls.running_totals(calls.topic_source(spark, f"{tmp_path}/counts")), f"{tmp_path}/totals", f"{tmp_path}/s2").awaitTermination()
    rows = calls.latest(spark, f"{tmp_path}/totals", ["sample_id", "alpha"]).collect()
    assert {(r["sample_id"], r["n_reads"], r["n_variants"], r["n_total"]) for r in rows} == want and len(rows) == 50


def test_open_hours_are_counted_and_late_rows_are_not(spark, tmp_path):
    schema = "created_at timestamp, status string"

    def add(*times):
        spark.createDataFrame([(t, "ok") for t in times], "t string, status string").select(F.to_timestamp("t").alias("created_at"), "status").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        calls.upsert(calls.hourly_status(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    add("2024-01-01 10:10:00", "2024-01-01 10:50:00")
    add("2024-01-01 10:20:00", "2024-01-01 15:00:00")
    add("2024-01-01 10:30:00", "2024-01-01 15:30:00")  # the first is later than the watermark
    rows = calls.latest(spark, f"{tmp_path}/out", ["hour", "status"]).select(F.hour("hour").alias("h"), "n").collect()
    assert sorted(map(tuple, rows)) == [(10, 3), (15, 2)]


def test_a_saved_caller_has_the_features_of_the_batch(spark, sf, tmp_path):
    from plasmaflow.plans import core

    fams = core.collapsed(spark, sf).withColumn("label", (F.col("af_milli") >= 60).cast("int")).cache()
    ml.save(ml.fit_caller(fams, "rf"), f"{tmp_path}/model")
    model = ml.load(f"{tmp_path}/model")
    a = ml.features(fams).select(*core.KEYS, *ml.DERIVED).orderBy(*core.KEYS).collect()
    b = model.stages[0].transform(fams).select(*core.KEYS, *ml.DERIVED).orderBy(*core.KEYS).collect()
    assert len(a) == len(b) and all(x[5:] == pytest.approx(y[5:]) for x, y in zip(a, b, strict=True))
    called = ml.call_families(model, fams, 0.3)
    assert called.where("is_call <> (score > 0.3) or abs(1 - score - p_value) > 1e-12").count() == 0 and set(fams.columns) <= set(called.columns)
    fams.unpersist()


def test_stream_calls_runs_every_step(spark, sf):
    from plasmaflow.plans import core, rest
    from plasmaflow.plans.registry import QUERIES

    got = {r["sample_id"]: r for r in rest._running(spark, sf).collect()}
    want = {r["sample_id"]: r for r in QUERIES["call_mrd"](spark, sf).collect()}  # the batch fits its model from the same controls
    n_reads = {r["sample_id"]: r["n"] for r in core.reads(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == set(want) and len(got) == 50
    for i, r in got.items():
        m, w = r["metrics"], want[i]
        assert (m["n_variants_detected"], r["n_total"], m["n_reads"]) == (w["n_variants"], w["n_total"], n_reads[i]) and r["status"] == "completed"
        assert r["expected_variants"] == pytest.approx(w["expected_variants"], abs=1e-6) and r["p_value"] == pytest.approx(w["p_value"], abs=1e-6)
        assert r["p_adjusted"] == r["p_value"] and r["significant"] == (r["p_value"] <= 0.05)
        assert m["variant_detection_rate"] == pytest.approx(w["n_variants"] / w["n_total"]) and m["mean_allele_fraction"] == pytest.approx([0, 0.2, 0.06, 0.02, 0.005][i % 5])
    assert any(r["significant"] for r in got.values()) and not all(r["significant"] for r in got.values())


def test_results_after_a_restart_and_dead_letters(spark, sf, tmp_path):
    from plasmaflow.plans import core

    def step():
        calls.count_to_topic(calls.file_source(spark, f"{tmp_path}/in", 1), None, f"{tmp_path}/counts", f"{tmp_path}/s1", errors=f"{tmp_path}/errors").awaitTermination()
        calls.upsert(calls.background(calls.topic_source(spark, f"{tmp_path}/counts")), f"{tmp_path}/background", f"{tmp_path}/s2").awaitTermination()
        totals = calls.running_totals(calls.topic_source(spark, f"{tmp_path}/counts"))
        calls.call_to_topic(totals, lambda s: calls.error_model(s, f"{tmp_path}/background"), f"{tmp_path}/results", f"{tmp_path}/s3").awaitTermination()
        given = {r["sample_id"]: r for r in calls.results(spark, f"{tmp_path}/results").collect()}
        return given, {r["sample_id"]: r for r in calls.results(spark, f"{tmp_path}/results", calls.error_model(spark, f"{tmp_path}/background")).collect()}

    reads = core.reads(spark, sf).where("sample_id < 10")
    messages = calls.to_messages(reads, most=20, model=True).withColumn("half", F.pmod(F.hash("value"), F.lit(2)))
    broken = spark.createDataFrame([("x", "{", 0), ("y", '{"sample_id": 7, "sample_data": {"reads": []}}', 0)], "key string, value string, half int")
    for half in (0, 1):  # the streams stop after the first half and go on from their checkpoints
        messages.union(broken).where(F.col("half") == half).drop("half").coalesce(2).write.mode("append").json(f"{tmp_path}/in")
        given, got = step()
    assert len(read(spark, f"{tmp_path}/results")) > len(got) == 10  # results of both halves, the latest of a sample counts
    whole = calls.batch_counts(calls.parse(messages)[0]).groupBy("sample_id").agg(*(F.sum(c).alias(c) for c in calls.SUMS)).collect()
    assert {(r["sample_id"], r["n_reads"], r["n_variants"], r["n_total"], r["n_passed"], r["n_received"]) for r in whole} == {(i, r["n_reads"], r["n_variants"], r["n_total"], r["metrics"]["n_variants_detected"], r["metrics"]["n_reads"]) for i, r in got.items()}
    rate = core.collapsed(spark, sf).where("sample_id in (0, 5)").groupBy("context").agg(F.avg(F.col("is_variant").cast("int")).alias("r")).agg(F.avg("r")).first()[0]
    assert given[8]["error_model"]["rate"] != pytest.approx(rate)  # it has reads in the first half only, when the model was another
    assert all(r["error_model"]["rate"] == pytest.approx(rate) and r["expected_variants"] == pytest.approx(rate * r["n_total"]) for r in got.values())
    assert all(r == given[i] for i, r in got.items() if given[i]["run_id"] == "results_1")
    letters = spark.createDataFrame([(r[1],) for r in read(spark, f"{tmp_path}/errors")], "value string").select(F.from_json("value", "status string, error string, timestamp timestamp, input_key string").alias("e")).select("e.*").collect()
    assert sorted((r["status"], r["error"], r["input_key"]) for r in letters) == [("error", "no reads", "y"), ("error", "no sample_id or no JSON", "x")] and all(r["timestamp"] for r in letters)


def test_calls_without_controls(spark):
    sums = "sample_id int, alpha double, n_received long, n_reads long, n_variants long, n_passed long, n_total long, af_weight long"
    model = spark.createDataFrame([], "context string, n_observations long, error_rate double")
    rows = {r["sample_id"]: r for r in calls.sample_calls(spark.createDataFrame([(1, 0.05, 99, 90, 4, 4, 10, None), (2, 0.05, 4, 0, 0, 0, 0, None)], sums), model).collect()}
    assert rows[1]["error_model"]["rate"] == 1e-4 and rows[1]["expected_variants"] == pytest.approx(1e-3) and rows[1]["significant"]
    assert rows[2]["p_value"] == 1 and not rows[2]["significant"] and rows[2]["metrics"]["variant_detection_rate"] == 0  # no family is large enough


def test_the_model_is_fitted_from_the_smallest_fraction_without_controls(spark, tmp_path):
    spark.createDataFrame([(20, "ACG", 1, 10), (20, "TCG", 3, 10), (200, "ACG", 9, 10), (5, "ACG", 0, 0)], "af_milli int, context string, n_passed long, n_total long").write.parquet(f"{tmp_path}/b/batch_id=0")
    spark.createDataFrame([(20, "ACG", 2, 20)], "af_milli int, context string, n_passed long, n_total long").write.parquet(f"{tmp_path}/b/batch_id=1")
    rates = {r["context"]: (r["n_observations"], r["error_rate"]) for r in calls.error_model(spark, f"{tmp_path}/b").collect()}
    assert rates == {"ACG": (20, 0.1), "TCG": (10, 0.3)}
