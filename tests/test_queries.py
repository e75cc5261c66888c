"""A spread of registered queries against their SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from plasmaflow.plans.registry import ORACLES, QUERIES

SOME = ["umi_group_exact", "consensus_allele", "umi_neighbor_join", "context_error_rates", "strand_bias_filter", "site_qc", "bh_fdr", "holm", "roc_auc", "lod95_interp", "calibration_ece", "fastq_scan", "stream_calls", "hourly_status", "schema_contract", "contamination_overlap", "call_mrd",
        "test_variants", "call_betabinom", "beta_interval", "rank_models", "qq_points", "ks_uniform", "average_precision", "stream_ingest", "stream_dead_letter", "stream_microbatch", "stream_config_override", "stream_sample_metrics",
        "umi_cluster_cc", "fisher_combine", "join_error_params", "poisson_tail", "binom_2s", "perturb_grid", "lod_summary", "manifest_diff",
        "umi_cluster_greedy", "umi_cluster_repr", "umi_cluster_fast", "umi_hamming", "stouffer", "norm_isf_z", "call_summary", "test_summary", "detection_power_col", "stream_hourly_status", "kafka_source_sink", "fisher_2x2", "binom_tail", "variant_filter_all",
        "ml_saved_call", "ml_select_mi", "ml_scale", "ml_eval", "ml_train_val_split", "cv_sizes", "stratified_folds", "detection_metrics_calls", "calibration_by_stratum", "clinical_guardrails", "coverage_rules", "provenance_cols", "fastq_max_reads",
        "run_stat_summary", "hpdi", "credible_interval", "conformal_interval"]


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return round(float(v), 5) + 0.0 if not math.isnan(float(v)) else "nan"


@pytest.mark.parametrize("name", SOME)
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert found == expected


def test_flagship_flags_the_strong_group(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_basic_interval_is_around_the_average_precision(spark, sf):
    row, value = QUERIES["bootstrap_basic_ci"](spark, sf).first(), QUERIES["average_precision"](spark, sf).first()[0]
    assert value != 0.5
    assert row["mean"] - row["bias"] == pytest.approx(value) and row["basic_lower"] + row["upper"] == pytest.approx(2 * value)


def test_values_that_pile_up_spread_over_buckets(spark):
    from pyspark.sql import functions as F

    from plasmaflow.operators import multiple, quantiles

    df = spark.range(4000).select((F.pow(F.lit(10.0), -F.col("id") / 20)).alias("p"), F.lit(1).alias("n"))
    sizes = [r["count"] for r in quantiles.placed(df, "p", []).groupBy("bucket__").count().collect()]
    assert len(sizes) == quantiles.BUCKETS and max(sizes) < 200
    ranked = {r["p"]: r["rank"] for r in multiple.running(df, "p", [], {"rank": "n"}).collect()}
    assert [ranked[p] for p in sorted(ranked)] == list(range(1, 4001))


def test_detection_power_and_the_fallback_of_the_logistic(spark):
    import numpy as np

    from plasmaflow.functions import special
    from plasmaflow.operators import limits

    found = special.poisson_power(np.array([1.0, 100.0]), np.array([4.0, 130.0]))
    assert found[0] == pytest.approx(1 - sum(math.exp(-4) * 4**k / math.factorial(k) for k in range(4)))  # the 95 % quantile at 1 is 3
    assert found[1] == pytest.approx(0.5 * (1 + math.erf((30 - 1.6448536 * 10) / math.sqrt(130) / math.sqrt(2))), abs=1e-6)
    flat = spark.createDataFrame([(1, 0.01, 0.9), (1, 0.1, 0.5), (2, 0.02, 0.4)], "umi_depth int, allele_fraction double, rate double")
    got = {r["umi_depth"]: r["lod"] for r in limits.lod_logistic(flat, 0.7).collect()}
    assert got[1] == pytest.approx(0.055) and got[2] == 0.02
