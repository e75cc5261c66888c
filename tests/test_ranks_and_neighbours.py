"""Exact quantiles, shortest intervals, masked-key neighbours, exact tests, bootstraps and folds against direct computation."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plasmaflow.functions import special, tails
from plasmaflow.operators import calling, filters, metrics, multiple, quantiles, umi


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 500), (None, 333)) for v in np.round(rng.lognormal(0, 3, n), 1)]
    rows += [("c", None), ("d", None)] + [("e", 7.0)] * 50
    return spark.createDataFrame(rows, "g string, v double"), rows


def test_exact_quantiles(values):
    df, rows = values
    shares = {"low": 0.025, "median": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}
    found = {r["g"]: r for r in quantiles.exact(df, "v", shares, ["g"]).collect()}
    assert set(found) == {"a", "b", "c", None, "e"}
    for g, r in found.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert [r[n] for n in shares] == pytest.approx(np.quantile(own, list(shares.values())))
    row = quantiles.exact(df, "v", shares).first()
    assert [row[n] for n in shares] == pytest.approx(np.quantile([v for _, v in rows if v is not None], list(shares.values())))
    assert quantiles.exact(df.where("v > 1e9"), "v", {"m": 0.5}).first()["m"] is None


def test_quantiles_order_only_the_ranges_they_need(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    counts = quantiles.distinct_counts(df, "v", [])
    sizes = [r["count"] for r in quantiles.placed(counts, "v", []).groupBy("bucket__").count().collect()]
    assert len(sizes) == quantiles.BUCKETS and max(sizes) < 1000
    assert quantiles.exact(df, "v", {"m": 0.5}).first()["m"] == 9999.5


@pytest.mark.parametrize("mass", [0.1, 0.5, 0.8, 0.95, 1.0])
def test_hpdi_matches_a_scan_of_sorted_values(values, mass):
    df, rows = values
    found = {r["g"]: (r["lower"], r["upper"]) for r in multiple.hpdi(df.where("g is not null"), ["g"], "v", mass).collect()}
    for g in ("a", "b", "c", "e"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        k = max(math.ceil(round(len(own) * mass, 9)), 1)
        assert found[g] == min(((own[i], own[i + k - 1]) for i in range(len(own) - k + 1)), key=lambda s: (s[1] - s[0], s[0]))


def brute_pairs(umis, distance):
    return {(a, b) for a, b in itertools.combinations(sorted(umis), 2) if len(a) == len(b) and 0 < sum(x != y for x, y in zip(a, b, strict=True)) <= distance}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_neighbours_match_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    umis = {"".join(rng.choice(list("ACGTN"), int(n))) for n in rng.integers(1, 7, 300)} | {"", "A", "AC"}
    df = spark.createDataFrame([(1, u) for u in umis] + [(2, "AAAA"), (2, "AAAT"), (2, None), (None, "AAAA"), (None, "AAAT")], "s int, umi string")
    found = umi.neighbours(df, distance, ["s"]).collect()
    assert len(found) == len(set(found))
    assert {(r["umi"], r["other"]) for r in found if r["s"] == 1} == brute_pairs(umis, distance)
    assert [(r["umi"], r["other"]) for r in found if r["s"] == 2] == [("AAAA", "AAAT")] and not [r for r in found if r["s"] is None]


def test_a_site_with_many_umis_has_small_candidate_groups(spark):
    site = spark.range(200_000).select(F.lit(1).alias("s"), F.translate(F.lpad(F.conv((F.col("id") * 7919 % 16_777_216).cast("string"), 10, 4), 12, "0"), "0123", "ACGT").alias("umi"))
    groups = umi.mask_groups(site, 1, ["s"]).groupBy("s", "mask").count()
    assert groups.agg(F.max("count")).first()[0] <= 5
    own = [r["umi"] for r in site.collect()]
    seen = set(own)
    expected = sum(u[:i] + c + u[i + 1 :] in seen for u in own for i in range(12) for c in "ACGT" if c > u[i])
    assert umi.neighbours(site, 1, ["s"]).count() == expected > 1000


def test_exact_tests_give_bounds_and_odds(spark):
    low, high = special.clopper_pearson(np.array([0, 5, 10]), np.array([10, 10, 10]))
    assert low == pytest.approx([0, 0.187086, 0.691503], abs=1e-6) and high == pytest.approx([0.308497, 0.812914, 1], abs=1e-6)
    rng = np.random.default_rng(0)
    k, n = rng.integers(1, 40, 50), np.full(50, 60)
    low, top = special.clopper_pearson(k, n, "greater")
    assert special.binom_sf(k, n, low) == pytest.approx(np.full(50, 0.05)) and (top == 1).all()
    rows = spark.createDataFrame([(5, 10, 0.5), (None, 10, 0.5)], "k int, n int, p double").select(tails.binomial_test["two-sided"]("k", "n", "p").alias("t")).collect()
    assert rows[0]["t"]["p_value"] == pytest.approx(1.0) and rows[0]["t"]["ci_lower"] == pytest.approx(0.187086, abs=1e-6) and rows[1]["t"]["p_value"] is None
    table = spark.createDataFrame([(8, 2, 1, 5), (3, 0, 2, 4), (0, 0, 2, 3)], "a int, b int, c int, d int").select(tails.fisher_test("a", "b", "c", "d").alias("t")).collect()
    assert table[0]["t"]["odds_ratio"] == pytest.approx(20.0) and table[0]["t"]["p_value"] == pytest.approx(0.034965, abs=1e-6)
    assert table[1]["t"]["odds_ratio"] == math.inf and table[2]["t"]["odds_ratio"] is None and table[2]["t"]["p_value"] == 1


def test_filters_take_lists_or_sums(spark):
    row = ("G", "T", 3, 12, [30, 10], 3, 0, 5, 4, [1, 2, 149])
    df = spark.createDataFrame([row], "ref string, alt string, alt_count int, total_depth int, quality_scores array<int>, alt_forward int, alt_reverse int, ref_forward int, ref_reverse int, read_positions array<int>")
    out = filters.all_filters(df).first()
    assert (out["site_quality"], out["n_positions"], out["near_ends"], out["end_repair_filter"], out["quality_filter"]) == (20.0, 3, 3, False, True)
    assert filters.all_filters(filters.from_lists(df)).first() == out


def test_global_tests_of_a_run(spark):
    rows = spark.createDataFrame([(4, 9, 0.01, 2.0, True), (1, 16, 0.2, 0.5, False), (0, 25, 0.9, -0.1, False)], "n int, depth int, p_value double, z double, significant boolean")
    out = calling.call_summary(rows).first()
    z = (3 * 2.0 + 4 * 0.5 - 5 * 0.1) / math.sqrt(50)
    assert out["stouffer_z"] == pytest.approx(z) and out["stouffer_p"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
    assert out["fisher_stat"] == pytest.approx(-2 * math.log(0.01 * 0.2 * 0.9)) and (out["n_positive"], out["n_total"]) == (1, 3)


def test_bootstrap_statistics_are_columns(spark):
    df = spark.range(4000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    draws = metrics.bootstrap(df, ["id"], lambda w: {"rows": F.sum(w), "mean": F.sum(w * F.col("x")) / F.sum(w)}, replicates=200, seed=4)
    assert "Python" not in draws._jdf.queryExecution().toString()
    got = {r["metric"]: r for r in metrics.robustness(draws).collect()}
    assert got["rows"]["mean"] == pytest.approx(4000, rel=0.01) and got["rows"]["sd"] == pytest.approx(math.sqrt(4000), rel=0.2)
    assert got["mean"]["mean"] == pytest.approx(4.5, abs=0.02) and got["mean"]["sd"] == pytest.approx(math.sqrt(8.25 / 4000), rel=0.2)
    assert got["mean"]["cv"] == pytest.approx(got["mean"]["sd"] / got["mean"]["mean"]) and got["mean"]["ci_lower"] < 4.5 < got["mean"]["ci_upper"]
    again = metrics.bootstrap(df.repartition(13), ["id"], lambda w: {"rows": F.sum(w)}, replicates=200, seed=4)
    assert {tuple(r) for r in again.collect()} == {(r["replicate"], r["rows"]) for r in draws.collect()}
    weights = spark.range(50_000).select(metrics.poisson_weight("id").alias("w")).groupBy("w").count().collect()
    assert {r["w"]: r["count"] / 50_000 for r in weights}[2] == pytest.approx(math.exp(-1) / 2, abs=0.01)


def test_folds_and_their_summary(spark):
    assert special.t_quantile(np.array([0.975, 0.975, 0.5]), np.array([4.0, 100.0, 3.0])) == pytest.approx([2.776445, 1.983972, 0.0], abs=1e-5)
    df = spark.range(600).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 7 / 7.0).alias("x"))
    folds = metrics.stratified_folds(df, "id", "label", 4)
    scored = metrics.cv_scores(folds, "fold", lambda train, test: test.withColumn("score", F.col("label") * 0.6 + F.col("x") * 0.1), 4)
    rows = scored.orderBy("fold").collect()
    assert [r["fold"] for r in rows] == [0, 1, 2, 3] and all(r["auc"] == r["accuracy"] == 1 for r in rows)
    assert sum(r["n_positive"] for r in rows) == 200 and sum(r["n_negative"] for r in rows) == 400 and all(r["n_train"] + r["n_test"] == 600 for r in rows)
    summary = {r["metric"]: r for r in metrics.cv_summary(spark.createDataFrame([(i, v, v, 1.0) for i, v in enumerate((0.7, 0.8, 0.9))], "fold int, auc double, average_precision double, accuracy double")).collect()}
    half = 4.302653 * 0.1 / math.sqrt(3)
    assert (summary["auc"]["mean"], summary["auc"]["sd"]) == (pytest.approx(0.8), pytest.approx(math.sqrt(0.02 / 3)))
    assert (summary["auc"]["ci_lower"], summary["auc"]["ci_upper"]) == (pytest.approx(0.8 - half, abs=1e-5), pytest.approx(0.8 + half, abs=1e-5))


def test_detection_metrics_fall_back(spark):
    calls = spark.createDataFrame([(0.0, 0.1, 0.4, 0.9, False), (0.01, 0.3, 0.2, 0.01, True), (0.02, 0.2, 0.9, 0.02, True)], "allele_fraction double, variant_fraction double, ml_probability double, p_value double, significant boolean")
    out = metrics.detection(calls).first()
    assert (out["auc"], out["detected_cases"], out["total_cases"]) == (1.0, 2, 2) and out["brier"] == pytest.approx((0.01 + 0.49 + 0.64) / 3)
    assert metrics.detection(calls.drop("variant_fraction")).first()["auc"] == 0.5
    assert metrics.detection(calls.drop("variant_fraction", "ml_probability")).first()["brier"] == pytest.approx((0.01 + 0.0001 + 0.0004) / 3)
    assert metrics.detection(calls.drop("allele_fraction")).first()["total_cases"] == 3


def test_scratch_tables_go(spark):
    from plasmaflow.operators import lineage

    with lineage.freed():
        table = lineage.cut(spark.range(10))
        assert table.count() == 10
        folder = table.inputFiles()[0].rpartition("/")[0]
        other = spark.range(3)
        lineage.drop(other)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_umi_tables_are_not_broadcast(spark):
    counts = spark.createDataFrame([(1, "chr1", 5, "A", u, n) for u, n in (("AAAAAA", 5), ("AAAAAC", 2), ("AAAAA", 3), ("GGGGGG", 1))], "sample_id int, chrom string, pos int, ref string, umi string, n long")
    clusters = umi.cluster_fast(counts)
    for df in (umi.neighbours(counts), umi.cross_length_pairs(counts), clusters):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["umi"], r["cluster"]) for r in clusters.collect()} == {("AAAAAA", "AAAAA"), ("AAAAAC", "AAAAA"), ("AAAAA", "AAAAA"), ("GGGGGG", "GGGGGG")}


def test_distances_hold_every_pair(spark):
    from plasmaflow.plans.registry import ORACLES

    assert "<=" not in ORACLES["umi_hamming"].rpartition("FROM u a")[2]
    umis = [(g, "".join(u)) for g in (1, 2) for u in itertools.product("ACG", repeat=3)]
    found = umi.distances(spark.createDataFrame(umis, "sample_id int, umi string"), ["sample_id"]).collect()
    expected = [(g, a, b, sum(x != y for x, y in zip(a, b, strict=True))) for g, a in umis for h, b in umis if g == h]
    assert sorted(tuple(r) for r in found) == sorted(expected)


def test_families_are_summed_where_their_reads_are_dealt(spark, sf):
    from plasmaflow.plans import core
    from plasmaflow.sources import adapters

    reads = adapters.reads(spark, sf)
    dealt = umi.families(reads, parts=7)
    assert dealt.rdd.getNumPartitions() == 7
    assert dealt.exceptAll(umi.families(reads)).isEmpty() and dealt.count() == umi.families(reads).count()
    plan = core.fams(spark, sf)._jdf.queryExecution().executedPlan().toString()
    aggregate = plan[plan.index("HashAggregate") :]
    assert aggregate.index("partial_") < aggregate.index("Exchange hashpartitioning(sample_id")  # both halves above the one exchange


def test_model_rows_read_families_that_are_stored(spark, sf):
    from plasmaflow.plans import core, rest

    train, test = rest._split(spark, sf)
    for df in (train, test):
        assert not any(f.endswith("lineitem.parquet") for f in df.inputFiles())
    assert train.count() + test.count() == core.collapsed(spark, sf).count()


def test_fastq_records_are_framed_by_so_many_lines_a_task(spark, tmp_path, monkeypatch):
    from plasmaflow.sources import fastq

    for name, n in (("a", 30), ("b", 20)):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{name}{i} UMI:ACGTAC\nAC{'G' * (i % 3)}\n+\n@@{'I' * (i % 3)}\n" for i in range(n)))
    monkeypatch.setattr(fastq, "LINES", 8, raising=False)
    records = fastq.read_fastq(spark, str(tmp_path))
    assert records.rdd.getNumPartitions() == 25  # 200 lines
    found = {(r["file"][-7], r["record_idx"], r["read_id"].split(" ")[0], len(r["sequence"])) for r in records.collect()}
    assert found == {(name, i, f"{name}{i}", 2 + i % 3) for name, n in (("a", 30), ("b", 20)) for i in range(n)}


def test_topic_holds_few_bytes(tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from plasmaflow.streaming import topic

    monkeypatch.setattr(topic, "HELD_CHARS", 1000, raising=False)
    rows = [{"key": str(i % 5), "value": f"{i:03d}" * 50} for i in range(60)] + [{"key": None, "value": None}]
    folder = topic.Folder(str(tmp_path))
    folder.commit([folder.write(iter(rows), 4)], "p", "0")
    for f in (tmp_path / "data").iterdir():
        meta = pq.ParquetFile(f).metadata
        assert all(0 < meta.row_group(g).num_rows <= 7 for g in range(meta.num_row_groups))
    back = [(r["key"], r["value"], s.partition, r["offset"]) for s in folder.segments({}, folder.ends()) for b in folder.read(s) for r in b.to_pylist()]
    assert sorted((k or "", v or "") for k, v, _, _ in back) == sorted((r["key"] or "", r["value"] or "") for r in rows)
    for p in range(4):
        own = [r for r in back if r[2] == p]
        assert [r[3] for r in own] == list(range(len(own)))
        for key in {r[0] for r in own}:
            assert [r[1] for r in own if r[0] == key] == [r["value"] for r in rows if r["key"] == key]
    late = [r["offset"] for s in folder.segments({"0": 3}, folder.ends()) if s.partition == 0 for b in folder.read(s) for r in b.to_pylist()]
    assert late == list(range(3, folder.ends()["0"]))
