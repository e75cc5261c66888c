"""Queries over detection runs, scores, p-values and jobs: limits, metrics, calibration, multiple testing, time buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from plasmaflow.operators import calling, errors, joins, limits, metrics, multiple, qc, quantiles
from plasmaflow.operators.lineage import cut
from plasmaflow.plans import core
from plasmaflow.plans.registry import query
from plasmaflow.sources import adapters

RUNS = f"WITH runs AS ({adapters.duck(adapters.DETECTION_RUNS)})"
SCORED = f"WITH scored AS ({adapters.duck(adapters.SCORED)})"
JOBS = f"WITH jobs AS ({adapters.duck(adapters.JOB_LOG)})"
D = "CAST(detected AS INT)"
runs, scored, jobs = adapters.detection_runs, adapters.scored, adapters.job_log


def pvals(s, d):
    return scored(s, d).select("id", F.col("score").alias("p_value"))


query("detection_matrix", RUNS + f" SELECT allele_fraction, umi_depth, ROUND(AVG({D}), 4) AS rate, ROUND(STDDEV_SAMP({D}), 4) AS sd, COUNT(*) AS n FROM runs GROUP BY ALL")(lambda s, d: qc.detection_matrix(runs(s, d)))
query("sim_quality_filter", RUNS + " SELECT allele_fraction, umi_depth, ROUND(AVG(CAST(umi_depth >= 3000 AS INT)), 6) AS depth_ok, ROUND(AVG(CAST(umi_depth * allele_fraction >= 200 AS INT)), 6) AS alt_ok FROM runs GROUP BY ALL")(lambda s, d: runs(s, d).groupBy("allele_fraction", "umi_depth").agg(qc.rate(F.col("umi_depth") >= 3000).alias("depth_ok"), qc.rate(F.col("umi_depth") * F.col("allele_fraction") >= 200).alias("alt_ok")))
query("run_af_summary", RUNS + " SELECT umi_depth, ROUND(AVG(allele_fraction), 6) AS mean_af, ROUND(MEDIAN(allele_fraction), 6) AS median_af, ROUND(STDDEV_SAMP(allele_fraction), 6) AS sd_af FROM runs GROUP BY ALL")(lambda s, d: runs(s, d).groupBy("umi_depth").agg(F.avg("allele_fraction").alias("mean_af"), qc.percentile("allele_fraction", 0.5).alias("median_af"), F.stddev_samp("allele_fraction").alias("sd_af")))
RSUM = core.TESTV + ", af AS (SELECT DISTINCT sample_id, af_milli FROM fams), e AS (SELECT af_milli, total_depth, p, alt_count, LN(alt_count + 1e-8) - LN(lam + 1e-8) AS effect FROM tv JOIN af USING (sample_id))"


def _run_summary(s, d):
    fams = cut(core.fams(s, d))
    tested = calling.test_variants(*core.site_tests(fams)).join(fams.select("sample_id", "af_milli").distinct(), "sample_id")
    return qc.run_summary(cut(tested.select("af_milli", "total_depth", "alt_count", "p_value", "effect_size")), ["af_milli", "total_depth"])


query("run_stat_summary", RSUM + " SELECT af_milli, total_depth, ROUND(AVG(p), 6) AS mean_p, ROUND(MEDIAN(p), 6) AS median_p, ROUND(STDDEV_SAMP(p), 6) AS sd_p, ROUND(AVG(effect), 6) AS mean_effect, ROUND(MEDIAN(effect), 6) AS median_effect, ROUND(STDDEV_SAMP(effect), 6) AS sd_effect, ROUND(AVG(alt_count), 6) AS mean_alt, ROUND(STDDEV_SAMP(alt_count), 6) AS sd_alt, ROUND(AVG(total_depth), 6) AS mean_depth, ROUND(STDDEV_SAMP(total_depth), 6) AS sd_depth FROM e GROUP BY ALL")(_run_summary)
query("run_qc_metrics", RUNS + f" SELECT allele_fraction, NULL::INT AS umi_depth, COUNT(*) AS n, ROUND(AVG({D}), 6) AS rate FROM runs GROUP BY allele_fraction UNION ALL SELECT NULL, umi_depth, COUNT(*), ROUND(AVG({D}), 6) FROM runs GROUP BY umi_depth UNION ALL SELECT NULL, NULL, COUNT(*), ROUND(AVG({D}), 6) FROM runs")(
    lambda s, d: runs(s, d).groupingSets([["allele_fraction"], ["umi_depth"], []], "allele_fraction", "umi_depth").agg(F.count(F.lit(1)).alias("n"), qc.rate(F.col("detected")).alias("rate")))
DEPTHS = [1000 * i for i in range(1, 10)]
query("detection_heatmap", RUNS + " SELECT allele_fraction, " + ", ".join(f"ROUND(AVG({D}) FILTER (umi_depth = {x}), 6) AS d{x}" for x in DEPTHS) + " FROM runs GROUP BY ALL")(lambda s, d: (lambda p: p.select("allele_fraction", *(F.col(str(x)).alias(f"d{x}") for x in DEPTHS)))(qc.detection_heatmap(runs(s, d), DEPTHS)))
query("stratified_power", RUNS + f", e AS (SELECT umi_depth, allele_fraction, replicate_id, AVG({D}) AS r FROM runs GROUP BY ALL) SELECT umi_depth, allele_fraction, ROUND(AVG(r), 6) AS power, ROUND(STDDEV_POP(r), 6) AS sd, COUNT(*) AS n_replicates FROM e GROUP BY ALL")(lambda s, d: qc.stratified_power(runs(s, d), ["umi_depth", "allele_fraction"]))
SENS = RUNS + f", e AS (SELECT replicate_id % 4 AS rate_id, allele_fraction AS af, umi_depth AS dp, replicate_id, SUM({D}) AS k, GREATEST(1, CAST(FLOOR(0.8 * allele_fraction * umi_depth / 100) AS INT)) AS want FROM runs GROUP BY ALL), x AS (SELECT *, LEAST(1.0, k / want) AS sens, GREATEST(k - want, 0) / dp AS fp FROM e)"


def _sens(s, d):
    e = runs(s, d).groupBy((F.col("replicate_id") % 4).alias("rate_id"), "allele_fraction", "umi_depth", "replicate_id").agg(F.sum(F.col("detected").cast("int")).alias("k"))
    e = e.withColumn("want", F.greatest(F.lit(1), F.floor(0.8 * F.col("allele_fraction") * F.col("umi_depth") / 100).cast("int")))
    e = e.withColumn("sens", F.least(F.lit(1.0), F.col("k") / F.col("want"))).withColumn("fp", F.greatest(F.col("k") - F.col("want"), F.lit(0)) / F.col("umi_depth"))
    return e


query("sensitivity_by_rate", SENS + " SELECT rate_id, af AS allele_fraction, dp AS umi_depth, ROUND(AVG(sens), 6) AS sensitivity, ROUND(STDDEV_POP(sens), 6) AS sd, ROUND(AVG(fp), 6) AS fp_rate FROM x GROUP BY ALL")(lambda s, d: _sens(s, d).groupBy("rate_id", "allele_fraction", "umi_depth").agg(F.avg("sens").alias("sensitivity"), F.stddev_pop("sens").alias("sd"), F.avg("fp").alias("fp_rate")))
query("dense_grid", SENS + ", ax AS (SELECT * FROM (SELECT DISTINCT rate_id FROM x), (SELECT DISTINCT af FROM x), (SELECT DISTINCT dp FROM x)) SELECT ax.rate_id, ax.af AS allele_fraction, ax.dp AS umi_depth, ROUND(COALESCE(AVG(sens), 0), 6) AS sens FROM ax LEFT JOIN x ON x.rate_id = ax.rate_id AND x.af = ax.af AND x.dp = ax.dp GROUP BY ALL")(lambda s, d: joins.dense_grid(_sens(s, d), ["rate_id", "allele_fraction", "umi_depth"], "sens"))
query("fp_by_contamination", RUNS + f" SELECT replicate_id AS rate, ROUND(AVG({D}), 6) AS fp_rate FROM runs WHERE allele_fraction = 0 GROUP BY ALL")(lambda s, d: runs(s, d).where("allele_fraction = 0").groupBy(F.col("replicate_id").alias("rate")).agg(qc.rate(F.col("detected")).alias("fp_rate")))

CURVE = RUNS + f""", c0 AS (SELECT umi_depth, allele_fraction, COUNT(*) AS n, CAST(SUM({D}) AS BIGINT) AS k, AVG({D}) AS rate, STDDEV_SAMP({D}) AS sd FROM runs GROUP BY ALL),
 curve AS (SELECT *, GREATEST(rate - 1.96 * COALESCE(sd, 0) / SQRT(n), 0) AS lo, LEAST(rate + 1.96 * COALESCE(sd, 0) / SQRT(n), 1) AS hi FROM c0)"""
curve = lambda s, d: limits.hit_rates(runs(s, d))
query("hit_rate_curve", CURVE + " SELECT umi_depth, allele_fraction, n, k, ROUND(rate, 6) AS rate, ROUND(lo, 6) AS ci_lower, ROUND(hi, 6) AS ci_upper FROM curve")(lambda s, d: curve(s, d).drop("sd"))
W = "z * SQRT(k / n * (1 - k / n) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)"
query("detection_probability_ci", CURVE + f" SELECT umi_depth, allele_fraction, n, k, ROUND(k / n, 6) AS rate, ROUND(GREATEST((k / n + z * z / (2 * n)) / (1 + z * z / n) - {W}, 0), 6) AS ci_lower, ROUND(LEAST((k / n + z * z / (2 * n)) / (1 + z * z / n) + {W}, 1), 6) AS ci_upper FROM (SELECT *, 1.959963984540054 AS z FROM curve)")(lambda s, d: limits.detection_probability(runs(s, d), ["umi_depth", "allele_fraction"]))
query("isotonic_curve", CURVE + " SELECT umi_depth, allele_fraction, ROUND(MAX(rate) OVER (PARTITION BY umi_depth ORDER BY allele_fraction), 6) AS rate FROM curve")(lambda s, d: multiple.isotonic(curve(s, d), ["umi_depth"], "allele_fraction", "rate").select("umi_depth", "allele_fraction", "rate"))


def _lod_sql(col: str, name: str) -> str:
    return f"""{name} AS (SELECT umi_depth, MIN(CASE WHEN y >= 0.6 AND (y0 IS NULL OR y0 < 0.6) THEN CASE WHEN y0 IS NULL THEN x ELSE x0 + (0.6 - y0) / (y - y0) * (x - x0) END END) AS v, MAX(x) AS largest
 FROM (SELECT *, LAG(x) OVER w AS x0, LAG(y) OVER w AS y0 FROM (SELECT umi_depth, allele_fraction AS x, MAX({col}) OVER (PARTITION BY umi_depth ORDER BY allele_fraction) AS y FROM curve) WINDOW w AS (PARTITION BY umi_depth ORDER BY x)) GROUP BY ALL)"""


LOD = CURVE + ", " + ", ".join([_lod_sql("rate", "l1"), _lod_sql("hi", "l2"), _lod_sql("lo", "l3")]) + ", lods AS (SELECT umi_depth, COALESCE(l1.v, 2 * l1.largest) AS lod, CASE WHEN l1.v IS NULL THEN l1.largest ELSE l2.v END AS a, CASE WHEN l1.v IS NOT NULL THEN l3.v END AS b, l1.v IS NOT NULL AS reached FROM l1 JOIN l2 USING (umi_depth) JOIN l3 USING (umi_depth))"
lods = lambda s, d: limits.lod_interpolated(curve(s, d), 0.6)
query("lod95_interp", LOD + " SELECT umi_depth, ROUND(lod, 6) AS lod, ROUND(a, 6) AS ci_lower, ROUND(b, 6) AS ci_upper, reached FROM lods")(lods)
query("lod_first_hit", CURVE + " SELECT umi_depth, ROUND(COALESCE(MIN(allele_fraction) FILTER (rate >= 0.6), MAX(allele_fraction)), 6) AS lod FROM curve GROUP BY ALL")(lambda s, d: limits.lod_first_hit(curve(s, d), 0.6))
query("lod_logistic")(lambda s, d: limits.lod_logistic(curve(s, d), 0.8))
query("lod_bootstrap")(lambda s, d: metrics.lod_bootstrap(runs(s, d), 0.6))
query("lod_monotonic", LOD + ", o AS (SELECT *, LAG(lod) OVER (ORDER BY umi_depth) AS p FROM lods) SELECT COALESCE(MAX(CAST(lod > p AS INT)), 0) = 0 AS monotonic, ROUND(CORR(umi_depth, lod), 6) AS correlation, ROUND(MIN(lod), 6) AS least, ROUND(MAX(lod), 6) AS most, CORR(umi_depth, lod) < -0.5 AS trend_ok FROM o")(lambda s, d: limits.lod_monotonic(lods(s, d)))
query("lod_depth_trend", LOD + " SELECT ROUND(REGR_SLOPE(LOG10(lod), LOG10(umi_depth)), 6) AS slope, ROUND(REGR_INTERCEPT(LOG10(lod), LOG10(umi_depth)), 6) AS intercept FROM lods")(lambda s, d: limits.lod_depth_trend(lods(s, d)))
LOB = f", lb AS (SELECT umi_depth, COUNT(*) AS n, AVG({D}) AS fp FROM runs WHERE allele_fraction = 0 GROUP BY ALL), lobs AS (SELECT *, GREATEST(fp - 1.96 * SQRT(fp * (1 - fp) / n), 0) AS lo, LEAST(fp + 1.96 * SQRT(fp * (1 - fp) / n), 1) AS lob FROM lb)"
query("lob_fp_rate", RUNS + LOB + " SELECT umi_depth, n, ROUND(fp, 6) AS fp_rate, ROUND(lo, 6) AS ci_lower, ROUND(lob, 6) AS lob FROM lobs")(lambda s, d: limits.lob_false_positives(runs(s, d)))
query("lob_percentile", RUNS + f", e AS (SELECT umi_depth, replicate_id, SUM({D}) AS n FROM runs WHERE allele_fraction = 0 GROUP BY ALL) SELECT ROUND(QUANTILE_CONT(n, 0.95), 6) AS lob, ROUND(AVG(n), 6) AS mean, ROUND(STDDEV_POP(n), 6) AS sd, COUNT(*) AS n_runs FROM e")(lambda s, d: limits.lob_percentile(runs(s, d), ["umi_depth", "replicate_id"]))
query("lod_summary", LOD + LOB + " SELECT COALESCE(a.umi_depth, b.umi_depth) AS umi_depth, ROUND(lod, 6) AS lod, ROUND(lob, 6) AS lob FROM lods a FULL JOIN lobs b ON a.umi_depth = b.umi_depth")(lambda s, d: limits.lod_summary(lods(s, d).select("umi_depth", "lod"), limits.lob_false_positives(runs(s, d)).select("umi_depth", "lob")))
query("lod50_proxy", CURVE + " SELECT umi_depth, allele_fraction, ROUND(0.5 * rate, 6) AS lod50, ROUND(0.75 * rate, 6) AS lod95 FROM curve")(lambda s, d: curve(s, d).select("umi_depth", "allele_fraction", (0.5 * F.col("rate")).alias("lod50"), (1.5 * 0.5 * F.col("rate")).alias("lod95")))
INTERP = CURVE + ", nb AS (SELECT umi_depth, MAX(STRUCT_PACK(x := allele_fraction, y := rate)) FILTER (allele_fraction <= 0.035) AS b, MIN(STRUCT_PACK(x := allele_fraction, y := rate)) FILTER (allele_fraction > 0.035) AS a FROM curve GROUP BY ALL), iv AS (SELECT umi_depth, CASE WHEN b IS NULL THEN a.y WHEN a IS NULL THEN b.y ELSE b.y + (a.y - b.y) / (a.x - b.x) * (0.035 - b.x) END AS v FROM nb)"
query("interp_lookup", INTERP + " SELECT umi_depth, ROUND(v, 6) AS value FROM iv")(lambda s, d: multiple.interpolate(curve(s, d), ["umi_depth"], "allele_fraction", "rate", 0.035))
query("sensitivity_at_af", INTERP + " SELECT umi_depth, ROUND(v, 6) AS sensitivity, v >= 0.4 AS meets FROM iv")(lambda s, d: limits.sensitivity_at(curve(s, d), 0.035, 0.4))
LOQ = RUNS + f", e AS (SELECT umi_depth, allele_fraction AS af, replicate_id, AVG({D}) * 0.12 AS est FROM runs GROUP BY ALL), g AS (SELECT umi_depth, af, AVG(est) AS m, STDDEV_POP(est) AS sd, AVG(ABS(est - af)) AS err FROM e WHERE af > 0 GROUP BY ALL)"
query("loq_cv", LOQ + " SELECT umi_depth, MIN(CASE WHEN m > 0 AND sd / m <= 0.2 THEN af END) AS loq_cv, MIN(CASE WHEN err <= 0.02 THEN af END) AS loq_error FROM g GROUP BY ALL")(lambda s, d: limits.loq_cv(runs(s, d).groupBy("umi_depth", "allele_fraction", "replicate_id").agg((F.avg(F.col("detected").cast("int")) * 0.12).alias("estimate")), "estimate", 0.2, 0.02))

# p-values
BH = SCORED + ", t AS (SELECT id, score AS p, COUNT(*) OVER () AS m, COUNT(*) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk, RANK() OVER (ORDER BY score) AS r1 FROM scored)"
query("bh_fdr", BH + " SELECT id, ROUND(LEAST(1, MIN(p * m / rk) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjusted FROM t")(lambda s, d: multiple.adjust(pvals(s, d)).select("id", "p_adjusted"))
query("holm", BH + " SELECT id, ROUND(LEAST(1, MAX(p * (m - r1 + 1)) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjusted FROM t")(lambda s, d: multiple.adjust(pvals(s, d), method="holm").select("id", "p_adjusted"))
query("bonferroni", BH + " SELECT id, ROUND(LEAST(1, p * m), 6) AS p_adjusted FROM t")(lambda s, d: multiple.adjust(pvals(s, d), method="bonferroni").select("id", "p_adjusted"))
query("qq_points", BH + " SELECT DISTINCT p AS observed, CAST(rk AS BIGINT) AS rank, ROUND(rk / (m + 1), 6) AS expected FROM t")(lambda s, d: multiple.qq_points(pvals(s, d)))
query("inflation", SCORED + " SELECT ROUND(MEDIAN(score) / 0.5, 6) AS inflation FROM scored")(lambda s, d: multiple.inflation(pvals(s, d)))
query("ks_uniform", BH + " SELECT MAX(m) AS n, ROUND(MAX(GREATEST(rk / m - p, p - (r1 - 1) / m)), 6) AS distance, ROUND(AVG(CAST(p <= 0.01 AS INT)), 6) AS rate_0, ROUND(AVG(CAST(p <= 0.05 AS INT)), 6) AS rate_1, ROUND(AVG(CAST(p <= 0.1 AS INT)), 6) AS rate_2, ROUND(AVG(CAST(p <= 0.2 AS INT)), 6) AS rate_3 FROM t")(lambda s, d: multiple.ks_uniform(pvals(s, d)).drop("ks_p"))
query("ks_uniform_p")(lambda s, d: multiple.ks_uniform(pvals(s, d)))

# scores
AUC = SCORED + ", g AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY ALL), c AS (SELECT *, SUM(neg) OVER (ORDER BY score) AS below, SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp FROM g), m AS (SELECT ROUND(SUM(pos * (below - neg / 2)) / (SUM(pos) * SUM(neg)), 6) AS auc, ROUND(SUM(pos * tp / (tp + fp)) / SUM(pos), 6) AS average_precision FROM c)"
query("roc_auc", AUC + " SELECT auc FROM m")(lambda s, d: multiple.roc_auc(scored(s, d)))
query("average_precision", AUC + " SELECT average_precision FROM m")(lambda s, d: multiple.average_precision(scored(s, d)))
query("brier", SCORED + " SELECT ROUND(AVG((score - label) * (score - label)), 6) AS brier FROM scored")(lambda s, d: metrics.brier(scored(s, d)))
query("detection_metrics", AUC + ", b AS (SELECT ROUND(AVG((score - label) * (score - label)), 6) AS brier, COUNT(*) AS n_cases, CAST(SUM(label) AS BIGINT) AS n_positive, COUNT(*) FILTER (score >= 0.5) AS n_detected FROM scored) SELECT auc, average_precision, brier, n_cases, n_positive, n_detected FROM m, b")(
    lambda s, d: multiple.roc_auc(scored(s, d)).join(F.broadcast(multiple.average_precision(scored(s, d)))).join(F.broadcast(metrics.brier(scored(s, d)))).join(F.broadcast(scored(s, d).agg(F.count(F.lit(1)).alias("n_cases"), F.sum("label").alias("n_positive"), F.count(F.when(F.col("score") >= 0.5, 1)).alias("n_detected")))))
DETECT = core.CALLS + f""", dc AS (SELECT c.*, n_variants / n_total AS score, CAST(a.af > 0.001 AS INT) AS label FROM calls c JOIN (SELECT sample_id, AVG(af_milli) / 1000 AS af FROM collapsed GROUP BY ALL) a USING (sample_id)),
 g AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM dc GROUP BY ALL), cu AS (SELECT *, SUM(neg) OVER (ORDER BY score) AS below, SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp FROM g),
 m AS (SELECT CASE WHEN SUM(pos) * SUM(neg) > 0 THEN SUM(pos * (below - neg / 2)) / (SUM(pos) * SUM(neg)) ELSE 0.5 END AS auc, SUM(pos * tp / (tp + fp)) / SUM(pos) AS ap FROM cu),
 cb AS (SELECT {{BIN}} AS bin, COUNT(*) AS n, AVG(label) AS er, AVG(score) AS cf FROM dc GROUP BY ALL)
 SELECT ROUND(ANY_VALUE(auc), 6) AS auc, ROUND(ANY_VALUE(ap), 6) AS average_precision, ROUND(AVG((score - label) * (score - label)), 6) AS brier, COUNT(*) FILTER (q <= 0.05 AND label = 1) AS detected_cases, COUNT(*) FILTER (label = 1) AS total_cases,
  (SELECT STRING_AGG(PRINTF('%d:%d:%.4f:%.4f', bin, n, ROUND(er, 4), ROUND(cf, 4)), ',' ORDER BY bin) FROM cb) AS calibration FROM dc, m"""


def _sample_calls(s, d):
    own = cut(core.collapsed(s, d))
    called = calling.call_samples(own, errors.fit_error_model(own.where("af_milli = 0")))
    return called.join(own.groupBy("sample_id").agg(F.avg("allele_fraction").alias("allele_fraction")), "sample_id")


TH = SCORED + ", th AS (SELECT CAST(i AS DOUBLE) / 19 AS t FROM GENERATE_SERIES(0, 19) g(i)), k AS (SELECT t, COUNT(*) FILTER (score >= t AND label = 1) AS tp, COUNT(*) FILTER (score >= t AND label = 0) AS fp, SUM(label) AS p, SUM(1 - label) AS n FROM scored, th GROUP BY ALL)"
query("roc_pr_curve", TH + " SELECT ROUND(t, 6) AS threshold, ROUND(tp / p, 6) AS tpr, ROUND(fp / n, 6) AS fpr, ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, ROUND(tp / p, 6) AS recall FROM k")(lambda s, d: multiple.roc_pr_curve(scored(s, d)))
query("threshold_sweep", SCORED + ", th AS (SELECT 0.01::DOUBLE + 0.02::DOUBLE * i AS t FROM GENERATE_SERIES(0, 49) g(i)), k AS (SELECT t, COUNT(*) FILTER (score > t AND label = 1) AS tp, COUNT(*) FILTER (score > t AND label = 0) AS fp, SUM(label) AS p FROM scored, th GROUP BY ALL), f AS (SELECT t, ROUND(CASE WHEN tp > 0 THEN 2.0 * tp / (tp + fp + p) ELSE 0 END, 12) AS v FROM k) SELECT ROUND(t, 6) AS threshold, ROUND(v, 6) AS value FROM f ORDER BY v DESC, t LIMIT 1")(lambda s, d: multiple.threshold_sweep(scored(s, d)))
query("threshold_unlabeled", SCORED + " SELECT ROUND(QUANTILE_CONT(score, 0.9), 6) AS threshold FROM scored")(lambda s, d: multiple.threshold_unlabelled(scored(s, d)))
query("credible_interval", SCORED + " SELECT label, ROUND(AVG(score), 6) AS mean, ROUND(MEDIAN(score), 6) AS median, ROUND(QUANTILE_CONT(score, 0.025), 6) AS lower, ROUND(QUANTILE_CONT(score, 0.975), 6) AS upper FROM scored GROUP BY ALL")(lambda s, d: multiple.credible_interval(scored(s, d), ["label"], "score"))
query("hpdi", SCORED + ", o AS (SELECT id % 50 AS grp, score, ROW_NUMBER() OVER (PARTITION BY id % 50 ORDER BY score) AS i, COUNT(*) OVER (PARTITION BY id % 50) AS n FROM scored), k AS (SELECT a.grp, a.score AS lo, b.score AS hi FROM o a JOIN o b ON a.grp = b.grp AND b.i = a.i + CAST(GREATEST(CEIL(ROUND(0.8 * a.n, 9)), 1) AS INT) - 1) SELECT grp, FIRST(lo ORDER BY hi - lo, lo) AS lower, FIRST(hi ORDER BY hi - lo, lo) AS upper FROM k GROUP BY ALL")(lambda s, d: multiple.hpdi(scored(s, d).withColumn("grp", F.col("id") % 50), ["grp"], "score", 0.8))
query("prediction_distribution", SCORED + " SELECT label, COUNT(score) AS n, ROUND(AVG(score), 6) AS mean, ROUND(MEDIAN(score), 6) AS median, ROUND(STDDEV_POP(score), 6) AS sd, MIN(score) AS least, MAX(score) AS most, ROUND(QUANTILE_CONT(score, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(score, 0.75), 6) AS q75 FROM scored GROUP BY ALL")(lambda s, d: qc.distribution(scored(s, d), "score", ["label"]))
BIN = "(" + " + ".join(f"CAST(score >= {e!r}::DOUBLE AS INT)" for e in [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]) + ")"
query("detection_metrics_calls", DETECT.replace("{BIN}", BIN))(lambda s, d: metrics.detection(_sample_calls(s, d)).withColumn("calibration", F.array_join(F.transform("calibration", lambda b: F.format_string("%d:%d:%.4f:%.4f", b["bin"], b["n"], F.round(b["event_rate"], 4), F.round(b["confidence"], 4))), ",")))
CAL = SCORED + f", cb AS (SELECT {BIN} AS bin, COUNT(*) AS n, AVG(label) AS er, AVG(score) AS cf FROM scored GROUP BY ALL)"
query("calibration_bins", CAL + " SELECT bin, n, ROUND(er, 6) AS event_rate, ROUND(cf, 6) AS confidence FROM cb")(lambda s, d: metrics.calibration_bins(scored(s, d)))
query("calibration_ece", CAL + " SELECT ROUND(SUM(ABS(er - cf) * n) / SUM(n), 6) AS ece, ROUND(MAX(ABS(er - cf)), 6) AS max_error, COUNT(*) AS n_bins, SUM(ABS(er - cf) * n) / SUM(n) < 0.05 AS well_calibrated FROM cb")(lambda s, d: metrics.calibration_error(scored(s, d)))
query("calibration_bins_by_stratum", SCORED + f", cb AS (SELECT id % 3 AS stratum, {BIN} AS bin, COUNT(*) AS n, AVG(label) AS er, AVG(score) AS cf FROM scored GROUP BY ALL) SELECT stratum, bin, n, ROUND(er, 6) AS event_rate, ROUND(cf, 6) AS confidence FROM cb")(lambda s, d: metrics.calibration_bins(scored(s, d).withColumn("stratum", F.col("id") % 3), by=["stratum"]))
STRATA = SCORED + f""", cb AS (SELECT id % 3 AS stratum, CASE WHEN score > 0 THEN {BIN.replace('>=', '>')} END AS bin, COUNT(*) AS n, AVG(label) AS er, AVG(score) AS cf FROM scored GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT id % 3 AS stratum FROM scored), GENERATE_SERIES(0, 9) gs(bin)),
 a AS (SELECT g.stratum, g.bin, COALESCE(n, 0) AS n, ROUND(COALESCE(er, 0), 4) AS er, ROUND(COALESCE(cf, 0), 4) AS cf FROM g LEFT JOIN cb ON cb.stratum = g.stratum AND cb.bin = g.bin), e AS (SELECT stratum, SUM(CASE WHEN bin IS NOT NULL THEN ABS(er - cf) * n END) / SUM(n) AS ece, MAX(CASE WHEN bin IS NOT NULL THEN ABS(er - cf) END) AS mx FROM cb GROUP BY ALL)"""
query("calibration_by_stratum", STRATA + " SELECT a.stratum, ROUND(ANY_VALUE(ece), 6) AS ece, ROUND(ANY_VALUE(mx), 6) AS max_error, STRING_AGG(PRINTF('%.4f', er), ',' ORDER BY bin) AS accuracies, STRING_AGG(PRINTF('%.4f', cf), ',' ORDER BY bin) AS confidences, STRING_AGG(n, ',' ORDER BY bin) AS counts FROM a JOIN e ON e.stratum = a.stratum GROUP BY a.stratum")(
    lambda s, d: metrics.calibration_strata(scored(s, d).withColumn("stratum", F.col("id") % 3), ["stratum"]).withColumns(
        {c: F.array_join(F.transform(c, lambda x: F.format_string("%.4f", F.round(x, 4))), ",") for c in ("accuracies", "confidences")} | {"counts": F.array_join(F.col("counts").cast("array<string>"), ",")}))
query("conformal_interval", SCORED + ", q AS (SELECT QUANTILE_CONT(ABS(label - score), 0.9) AS q FROM scored WHERE id % 2 = 0) SELECT id, ROUND(GREATEST(score - q, 0), 6) AS lower, ROUND(LEAST(score + q, 1), 6) AS upper FROM scored, q WHERE id % 2 = 1")(lambda s, d: metrics.conformal(scored(s, d).where("id % 2 = 0"), scored(s, d).where("id % 2 = 1")).select("id", "lower", "upper"))
query("bootstrap_metric_ci")(lambda s, d: metrics.interval(metrics.bootstrap_metric(scored(s, d)), "auc"))
query("bootstrap_basic_ci")(lambda s, d: metrics.interval(metrics.bootstrap_metric(scored(s, d)), "average_precision", multiple.average_precision(scored(s, d)).first()[0]))
query("bootstrap_robustness")(lambda s, d: metrics.robustness(metrics.bootstrap(cut(core.collapsed(s, d)), core.KEYS)))
query("bootstrap_scores")(lambda s, d: metrics.robustness(metrics.bootstrap(scored(s, d), ["id"], metrics.weighted_means(mean_score="score", positive_rate="label"))))
query("bootstrap_proportion_ci")(lambda s, d: metrics.proportion_interval(scored(s, d), F.col("score") > 0.8))
query("stratified_folds", SCORED + " SELECT CAST(CAST('0x' || SUBSTR(MD5(CONCAT_WS('|', id, label, '0')), 1, 8) AS BIGINT) % 5 AS INT) AS fold, label, COUNT(*) AS n FROM scored GROUP BY ALL")(lambda s, d: metrics.stratified_folds(scored(s, d), "id", "label").groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")))
FOLD = ", fs AS (SELECT CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model, CAST(FLOOR(id / 3) AS BIGINT) % 5 AS fold, AVG(score) AS score FROM scored GROUP BY ALL)"


def _fold_scores(s, d):
    model = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c")
    return scored(s, d).groupBy(model.alias("model"), (F.floor(F.col("id") / 3) % 5).alias("fold")).agg(F.avg("score").alias("score"))


query("model_compare", SCORED + FOLD + " SELECT x.model AS a, y.model AS b, ROUND(AVG(x.score - y.score), 6) AS mean_difference, ROUND(STDDEV_SAMP(x.score - y.score), 6) AS sd, COUNT(*) AS n, ROUND(AVG(x.score - y.score) / (STDDEV_SAMP(x.score - y.score) / SQRT(COUNT(*))), 4) AS t FROM fs x JOIN fs y ON x.fold = y.fold AND x.model < y.model GROUP BY ALL")(lambda s, d: metrics.compare_models(_fold_scores(s, d)).withColumn("t", F.round("t", 4)))
query("rank_models", SCORED + FOLD + ", mm AS (SELECT model, AVG(score) AS auc FROM fs GROUP BY ALL) SELECT model, ROUND(auc, 6) AS auc, CAST(RANK() OVER (ORDER BY ROUND(auc, 6) DESC) AS INT) AS place, RANK() OVER (ORDER BY ROUND(auc, 6) DESC) = 1 AS best FROM mm")(lambda s, d: qc.rank_models(_fold_scores(s, d).groupBy("model").agg(F.avg("score").alias("auc"))))

# jobs
query("job_success_stats", JOBS + " SELECT COUNT(*) AS n_jobs, COUNT(*) FILTER (status = 'completed') AS n_completed, COUNT(*) FILTER (status = 'failed') AS n_failed, ROUND(COUNT(*) FILTER (status = 'completed') / COUNT(*) FILTER (status IN ('completed', 'failed')), 6) AS success_rate, ROUND(AVG(duration_s) FILTER (status = 'completed'), 6) AS mean_duration FROM jobs")(lambda s, d: qc.job_success(jobs(s, d)))
query("recent_jobs", JOBS + " SELECT job_id, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 10")(lambda s, d: jobs(s, d).orderBy(F.desc("created_at"), "job_id").offset(10).limit(20).select("job_id", "status"))
query("hourly_status", JOBS + " SELECT DATE_TRUNC('hour', created_at) AS hour, status, COUNT(*) AS n FROM jobs GROUP BY ALL")(lambda s, d: qc.hourly_status(jobs(s, d)))
query("batch_metrics", JOBS + " SELECT job_id % 20 AS batch_id, COUNT(*) AS n, COUNT(*) FILTER (status = 'completed') AS n_ok, COUNT(*) FILTER (status = 'failed') AS n_failed, ROUND(AVG(CAST(status = 'completed' AS INT)), 6) AS success_rate, ROUND(AVG(duration_s), 6) AS mean_time FROM jobs GROUP BY ALL")(
    lambda s, d: jobs(s, d).groupBy((F.col("job_id") % 20).alias("batch_id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "completed", 1)).alias("n_ok"), F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"), qc.rate(F.col("status") == "completed").alias("success_rate"), F.avg("duration_s").alias("mean_time")))
query("kafka_result_lookup", JOBS + " SELECT job_id % 100 AS key, FIRST(status ORDER BY job_id DESC) AS status, MAX(job_id) AS job_id FROM jobs GROUP BY 1")(lambda s, d: joins.latest_by_key(jobs(s, d).withColumn("key", F.col("job_id") % 100), "key", "status", "job_id"))
