"""Queries over reads and families: scans, filters, joins, grouping, error models, calls and QC."""

from __future__ import annotations

from pyspark.sql import functions as F

from plasmaflow.functions import dna, tails
from plasmaflow.operators import calling, errors, filters, joins, multiple, qc, umi
from plasmaflow.operators.lineage import cut
from plasmaflow.plans.registry import query
from plasmaflow.sources import adapters, contracts

READS = f"WITH reads AS ({adapters.duck(adapters.READS)})"
FAMS = READS + """,
w AS (SELECT sample_id, chrom, pos, ref, umi, alt, SUM(CAST(POW(10, quality / 10.0) AS DECIMAL(20,6))) AS w, SUM(quality) AS q, COUNT(*) AS n
      FROM reads WHERE quality >= 20 GROUP BY ALL),
best AS (SELECT sample_id, chrom, pos, ref, umi, FIRST(alt ORDER BY w DESC, alt) AS best, CAST(MAX(w) AS DOUBLE) AS bw, CAST(SUM(w) AS DOUBLE) AS tw,
                FIRST(q / n ORDER BY w DESC, alt) AS bq FROM w GROUP BY ALL),
base AS (SELECT sample_id, af_milli, chrom, pos, ref, context, umi, COUNT(*) AS family_size, COUNT(*) FILTER (strand = '+') AS forward,
                COUNT(*) FILTER (strand = '-') AS backward, COUNT(*) FILTER (alt <> ref) AS alt_reads, COUNT(*) FILTER (alt = ref) AS ref_reads,
                AVG(quality) AS mean_quality FROM reads GROUP BY ALL),
fams AS (SELECT base.*, CASE WHEN bw / tw >= 0.6 THEN best END AS allele, CASE WHEN bw / tw >= 0.6 THEN bq END AS consensus_quality, bw / tw AS consensus_agreement
         FROM base LEFT JOIN best USING (sample_id, chrom, pos, ref, umi))"""
COLLAPSED = FAMS + """,
collapsed AS (SELECT *, af_milli / 1000.0 AS allele_fraction, COALESCE(mean_quality >= 20, FALSE) AS passes_quality, COALESCE(consensus_agreement >= 0.6, FALSE) AS passes_consensus,
              COALESCE(mean_quality >= 20 AND consensus_agreement >= 0.6 AND allele <> ref, FALSE) AS is_variant FROM fams WHERE family_size >= 3)"""
COUNTS = FAMS + """,
counts AS (SELECT sample_id, chrom, pos, ref, context, allele, COUNT(*) AS consensus_count FROM fams WHERE allele IS NOT NULL GROUP BY ALL)"""
NORMAL = """CASE WHEN SUBSTR(context, 2, 1) IN ('A', 'G') THEN REVERSE(TRANSLATE(context, 'ACGT', 'TGCA')) ELSE context END"""
NREF = "CASE WHEN SUBSTR(context, 2, 1) IN ('A', 'G') THEN TRANSLATE(ref, 'ACGT', 'TGCA') ELSE ref END"
NALLELE = "CASE WHEN SUBSTR(context, 2, 1) IN ('A', 'G') THEN TRANSLATE(allele, 'ACGT', 'TGCA') ELSE allele END"
RATES = COUNTS + f""",
norm AS (SELECT {NORMAL} AS context, {NREF} AS ref, {NALLELE} AS allele, consensus_count FROM counts),
rates AS (SELECT n.context, n.ref || '>' || n.allele AS mutation, SUM(n.consensus_count) / ANY_VALUE(t.total) AS rate
          FROM norm n JOIN (SELECT context, SUM(consensus_count) AS total FROM norm GROUP BY context) t ON t.context = n.context
          WHERE n.allele <> n.ref GROUP BY n.context, n.ref || '>' || n.allele)"""
CALLS = COLLAPSED + """,
rate AS (SELECT AVG(r) AS rate FROM (SELECT context, AVG(CAST(is_variant AS INT)) AS r FROM collapsed WHERE af_milli = 0 GROUP BY context)),
counted AS (SELECT sample_id, COUNT(*) FILTER (is_variant) AS n_variants, COUNT(*) AS n_total, AVG(mean_quality) AS mean_quality, AVG(consensus_agreement) AS mean_consensus FROM collapsed GROUP BY sample_id),
expect AS (SELECT *, n_total * rate AS lam FROM counted, rate),
tested AS (SELECT e.*, CASE WHEN lam <= 0 THEN 1.0 ELSE LEAST(1.0, 2 * LEAST(
    (SELECT SUM(EXP(-lam + i * LN(lam) - LGAMMA(i + 1))) FROM GENERATE_SERIES(0, n_variants) g(i)),
    1 - COALESCE((SELECT SUM(EXP(-lam + i * LN(lam) - LGAMMA(i + 1))) FROM GENERATE_SERIES(0, n_variants - 1) g(i)), 0))) END AS p FROM expect e),
ranked AS (SELECT *, COUNT(*) OVER () AS m, COUNT(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM tested),
calls AS (SELECT *, LEAST(1.0, MIN(p * m / rk) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM ranked)"""


def reads(s, d):
    return adapters.reads(s, d)


def fams(s, d):
    return umi.families(reads(s, d), parts=adapters.parts(s, d, "lineitem"))


def collapsed(s, d):
    return filters.collapsed_passes(umi.filter_family_size(fams(s, d))).withColumn("allele_fraction", F.col("af_milli") / 1000.0)


def counts(s, d):
    return umi.consensus_counts(fams(s, d), [*umi.SITE, "context"])


def rates(s, d):
    return errors.context_error_rates(counts(s, d))


def controls(s, d):
    return collapsed(s, d).where("af_milli = 0")


def calls(s, d):
    own = cut(collapsed(s, d))  # the reads are grouped once
    return calling.call_samples(own, errors.fit_error_model(own.where("af_milli = 0")))


def _perturbed(s, d):
    own = cut(collapsed(s, d))
    background = errors.fit_error_model(own.where("af_milli = 0")).select("context", F.col("error_rate").alias("background_rate"))
    return filters.perturb_grid(own.join(F.broadcast(background), "context", "left"))  # a row a context


# the normal quantile by its well-known rational approximation (relative error 1.2e-9) and the tail by its series, as SQL has neither
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(c, x: str) -> str:
    out = f"({c[0]!r}::DOUBLE)"
    for v in c[1:]:
        out = f"({out} * {x} + ({v!r}::DOUBLE))"
    return out


def _abs_isf(p: str) -> str:
    """Absolute upper normal quantile of p in (0, 0.5]."""
    t, q = f"SQRT(-2 * LN(GREATEST({p}, 1e-300)))", f"(0.5 - {p})"
    return f"ABS(CASE WHEN {p} < 0.02425 THEN {_horner(_C, t)} / {_horner(_D, t)} ELSE {_horner(_A, f'({q} * {q})')} * {q} / {_horner(_B, f'({q} * {q})')} END)"


def _sf(z: str) -> str:
    """Upper normal tail; 0 or 1 beyond six deviations."""
    return f"CASE WHEN {z} > 6 THEN 0 WHEN {z} < -6 THEN 1 ELSE 0.5 - SIGN({z}) * EXP(-{z} * {z} / 2) / SQRT(2 * PI()) * (SELECT SUM(EXP((2 * i + 1) * LN(GREATEST(ABS({z}), 1e-300)) - (i + 1) * LN(2) - LGAMMA(i + 1.5) + 0.5 * LN(PI()))) FROM GENERATE_SERIES(0, 150) gz(i)) END"


KEYS = ["sample_id", "chrom", "pos", "ref", "umi"]

query("call_mrd", CALLS + " SELECT sample_id, n_variants, n_total, ROUND(lam, 6) AS expected_variants, ROUND(p, 6) AS p_value, ROUND(q, 6) AS p_adjusted, q <= 0.05 AS significant FROM calls")(
    lambda s, d: calls(s, d).select("sample_id", "n_variants", "n_total", "expected_variants", "p_value", "p_adjusted", "significant"))
_TAIL = "(SELECT SUM(EXP(-lam + i * LN(lam) - LGAMMA(i + 1))) FROM GENERATE_SERIES({a}, {b}) gt(i))"  # sums from either end: tiny tails keep their digits
query("call_summary", CALLS + f""", exact AS (SELECT * REPLACE (CASE WHEN lam <= 0 THEN 1.0 ELSE LEAST(1.0, 2 * LEAST({_TAIL.format(a="0", b="n_variants")}, {_TAIL.format(a="n_variants", b="n_variants + 2000")})) END AS p) FROM calls), z AS (SELECT *, CASE WHEN n_variants >= lam THEN 1 ELSE -1 END * {_abs_isf("(p / 2)")} AS z FROM exact), t AS (SELECT COUNT(*) FILTER (q <= 0.05) AS n_positive, COUNT(*) AS n_total, MIN(p) AS min_p, SUM(SQRT(n_total) * z) / SQRT(SUM(n_total)) AS sz, -2 * SUM(LN(GREATEST(p, 1e-300))) AS fs, COUNT(*) AS half FROM z)
 SELECT n_positive, n_total, ROUND(min_p, 6) AS min_p, ROUND(sz, 4) AS stouffer_z, ROUND({_sf("sz")}, 4) AS stouffer_p, ROUND(fs, 4) AS fisher_stat,
  ROUND((SELECT SUM(EXP(-fs / 2 + i * LN(GREATEST(fs / 2, 1e-300)) - LGAMMA(i + 1))) FROM GENERATE_SERIES(0, half - 1) gf(i)), 4) AS fisher_p FROM t""")(  # an even number of degrees of freedom: a Poisson tail
    lambda s, d: calling.call_summary(calling.signed_z(calls(s, d))).withColumns({c: F.round(c, 4) for c in ("stouffer_z", "stouffer_p", "fisher_stat", "fisher_p")}))
query("umi_group_exact", READS + " SELECT sample_id, chrom, pos, ref, umi, COUNT(*) AS family_size FROM reads GROUP BY ALL")(lambda s, d: fams(s, d).select(*KEYS, "family_size"))
query("consensus_allele", FAMS + " SELECT sample_id, chrom, pos, ref, umi, allele, ROUND(consensus_quality, 6) AS consensus_quality FROM fams")(lambda s, d: fams(s, d).select(*KEYS, "allele", "consensus_quality"))
query("consensus_agreement", FAMS + " SELECT sample_id, chrom, pos, ref, umi, ROUND(consensus_agreement, 6) AS consensus_agreement FROM fams")(lambda s, d: fams(s, d).select(*KEYS, "consensus_agreement"))
query("strand_counts", FAMS + " SELECT sample_id, chrom, pos, ref, umi, forward, backward FROM fams")(lambda s, d: fams(s, d).select(*KEYS, "forward", "backward"))
query("allele_counts", READS + " SELECT sample_id, chrom, pos, ref, umi, alt, COUNT(*) AS n FROM reads GROUP BY ALL")(lambda s, d: reads(s, d).groupBy(*KEYS, "alt").agg(F.count(F.lit(1)).alias("n")))
query("alt_ref_reads", FAMS + " SELECT sample_id, chrom, pos, ref, umi, alt_reads, ref_reads FROM fams")(lambda s, d: fams(s, d).select(*KEYS, "alt_reads", "ref_reads"))
query("family_size_filter", FAMS + " SELECT sample_id, chrom, pos, ref, umi, family_size FROM fams WHERE family_size >= 3")(lambda s, d: umi.filter_family_size(fams(s, d)).select(*KEYS, "family_size"))
query("family_cap", READS + " SELECT sample_id, chrom, pos, ref, umi, LEAST(COUNT(*), 4) AS family_size FROM reads GROUP BY ALL")(
    lambda s, d: umi.cap_reads(reads(s, d), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 4).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("family_size")))
query("consensus_counts", COUNTS + " SELECT sample_id, chrom, pos, ref, allele, consensus_count FROM counts")(lambda s, d: umi.consensus_counts(fams(s, d)))
query("family_size_hist", FAMS + " SELECT family_size, COUNT(*) AS n_families FROM fams GROUP BY ALL")(lambda s, d: umi.family_size_histogram(fams(s, d)))
query("umi_efficiency", FAMS + """ SELECT COUNT(*) AS total_families, COUNT(allele) AS consensus_families, ROUND(COUNT(allele) / COUNT(*), 6) AS consensus_rate, CAST(SUM(family_size) AS BIGINT) AS total_reads,
  ROUND(AVG(family_size), 6) AS mean_family_size, COUNT(*) FILTER (family_size < 3) AS families_below_threshold, COUNT(*) FILTER (family_size > 1000) AS families_above_threshold,
  (SELECT ROUND(AVG(x), 6) FROM (SELECT DISTINCT family_size AS x FROM fams)) AS mean_distinct_family_size FROM fams""")(lambda s, d: umi.efficiency(fams(s, d)))
query("consensus_sequence_majority", READS + """, b AS (SELECT sample_id, chrom, pos, ref, i - 1 AS spot, SUBSTR(umi, CAST(i AS INT), 1) AS base, COUNT(*) AS n FROM reads, GENERATE_SERIES(1, 6) g(i) GROUP BY ALL),
 m AS (SELECT sample_id, chrom, pos, ref, spot, FIRST(base ORDER BY n DESC, base) AS base, SUM(n) AS n FROM b GROUP BY ALL)
 SELECT sample_id, chrom, pos, ref, STRING_AGG(base, '' ORDER BY spot) AS consensus, CAST(SUM(n) AS BIGINT) AS n_bases FROM m GROUP BY ALL""")(lambda s, d: umi.consensus_sequence(reads(s, d), umi.SITE, "umi"))
query("locus_summary", READS + """, f AS (SELECT sample_id, chrom, pos, umi, COUNT(*) AS n, COUNT(*) FILTER (alt <> ref) AS a FROM reads GROUP BY ALL HAVING COUNT(*) >= 2)
 SELECT sample_id, chrom, pos, CAST(SUM(a) AS BIGINT) AS alt_count, CAST(SUM(n) AS BIGINT) AS total_count, COUNT(*) AS family_count, ROUND(AVG(n), 6) AS mean_family_size, STRING_AGG(n, ',' ORDER BY n) AS family_sizes FROM f GROUP BY ALL""")(
    lambda s, d: umi.locus_summary(reads(s, d)).drop("max_family_size").join(
        umi.locus_sizes(reads(s, d)).withColumn("family_sizes", F.array_join(F.expr("flatten(transform(sizes, s -> array_repeat(cast(s.family_size as string), cast(s.n as int))))"), ",")).drop("sizes"), ["sample_id", "chrom", "pos"]))

UMIS = READS + ", u AS (SELECT sample_id, chrom, pos, ref, umi, COUNT(*) AS n FROM reads GROUP BY ALL), pairs AS (SELECT a.sample_id, a.chrom, a.pos, a.ref, a.umi, b.umi AS other FROM u a JOIN u b USING (sample_id, chrom, pos, ref) WHERE a.umi < b.umi AND LENGTH(a.umi) = LENGTH(b.umi) AND HAMMING(a.umi, b.umi) <= 1)"
query("umi_neighbor_join", UMIS + " SELECT * FROM pairs")(lambda s, d: umi.neighbours(umi.umi_counts(reads(s, d))))
CC = UMIS.replace("WITH reads", "WITH RECURSIVE reads") + """, e AS (SELECT * FROM pairs UNION ALL SELECT sample_id, chrom, pos, ref, other, umi FROM pairs),
 reach AS (SELECT sample_id, chrom, pos, ref, umi, umi AS other FROM u UNION SELECT r.sample_id, r.chrom, r.pos, r.ref, r.umi, e.other FROM reach r JOIN e ON (e.sample_id, e.chrom, e.pos, e.ref, e.umi) = (r.sample_id, r.chrom, r.pos, r.ref, r.other)),
 cc AS (SELECT sample_id, chrom, pos, ref, umi, MIN(other) AS cluster FROM reach GROUP BY ALL)"""


def _clusters(s, d):
    u = umi.umi_counts(reads(s, d))
    return umi.cluster_components(u, umi.neighbours(u))


def _greedy(s, d):
    u = umi.umi_counts(reads(s, d))
    return umi.cluster_greedy(u, umi.neighbours(u))


query("umi_cluster_cc", CC + " SELECT * FROM cc")(_clusters)
query("cluster_stats", CC + ", z AS (SELECT sample_id, chrom, pos, ref, cluster, COUNT(*) AS n FROM cc GROUP BY ALL) SELECT COUNT(*) AS n_clusters, CAST(SUM(n) AS BIGINT) AS n_umis, ROUND(AVG(n), 6) AS mean_cluster_size, MAX(n) AS max_cluster_size FROM z")(lambda s, d: umi.cluster_stats(_clusters(s, d)))
def _greedy_sql(keys: str, order: str, source: str) -> str:
    """Greedy clusters one by one: the first UMI left takes all within one mismatch, until none is left."""
    near = "len(x) = len(rest[1]) AND list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST(x[i] <> rest[1][i] AS INT))) <= 1"
    return f"""greedy AS (SELECT {keys}, LIST(umi ORDER BY {order}, umi) AS rest, NULL::VARCHAR AS seed, []::VARCHAR[] AS taken FROM {source} GROUP BY ALL
  UNION ALL SELECT {keys}, list_filter(rest, lambda x: NOT ({near})), rest[1], list_filter(rest, lambda x: {near}) FROM greedy WHERE len(rest) > 0),
 cl AS (SELECT {keys}, UNNEST(taken) AS umi, seed AS cluster FROM greedy WHERE seed IS NOT NULL)"""


RECURSIVE = READS.replace("WITH reads", "WITH RECURSIVE reads")
GREEDY = RECURSIVE + ", u AS (SELECT sample_id, chrom, pos, ref, umi, COUNT(*) AS n FROM reads GROUP BY ALL), " + _greedy_sql("sample_id, chrom, pos, ref", "n DESC", "u") + " SELECT * FROM cl"
query("umi_cluster_greedy", GREEDY)(_greedy)
query("umi_cluster_first_seen", GREEDY)(_greedy)  # with a set's order replaced by (count desc, umi) it is the same job
query("umi_cluster_repr", RECURSIVE + ", u AS (SELECT sample_id, chrom, pos, ref, strand, umi, MIN(l_orderkey) AS n FROM reads GROUP BY ALL), " + _greedy_sql("sample_id, chrom, pos, ref, strand", "n", "u") + " SELECT * FROM cl")(lambda s, d: (lambda u: umi.cluster_greedy(u, umi.neighbours(u, 1, [*umi.SITE, "strand"]), [*umi.SITE, "strand"]))(
    reads(s, d).groupBy(*umi.SITE, "strand", "umi").agg((-F.min(F.struct("l_orderkey", "l_linenumber")["l_orderkey"])).alias("n"))))
query("umi_cluster_fast", RECURSIVE + ", u AS (SELECT sample_id, chrom, pos, ref, CASE WHEN read_position % 7 = 0 THEN SUBSTR(umi, 1, 5) ELSE umi END AS umi, COUNT(*) AS n FROM reads GROUP BY ALL), " + _greedy_sql("sample_id, chrom, pos, ref", "n DESC", "u") + """,
 seeds AS (SELECT DISTINCT sample_id, chrom, pos, ref, cluster AS umi FROM cl), e AS (SELECT a.sample_id, a.chrom, a.pos, a.ref, a.umi, b.umi AS other FROM seeds a JOIN seeds b USING (sample_id, chrom, pos, ref) WHERE LENGTH(a.umi) <> LENGTH(b.umi) AND LEVENSHTEIN(a.umi, b.umi) <= 1),
 reach AS (SELECT *, umi AS other FROM seeds UNION SELECT r.sample_id, r.chrom, r.pos, r.ref, r.umi, e.other FROM reach r JOIN e ON (e.sample_id, e.chrom, e.pos, e.ref, e.umi) = (r.sample_id, r.chrom, r.pos, r.ref, r.other)),
 merged AS (SELECT sample_id, chrom, pos, ref, umi, MIN(other) AS cluster FROM reach GROUP BY ALL)
 SELECT cl.sample_id, cl.chrom, cl.pos, cl.ref, cl.umi, m.cluster FROM cl JOIN merged m ON (m.sample_id, m.chrom, m.pos, m.ref, m.umi) = (cl.sample_id, cl.chrom, cl.pos, cl.ref, cl.cluster)""")(
    lambda s, d: umi.cluster_fast(umi.umi_counts(reads(s, d).withColumn("umi", F.when(F.col("read_position") % 7 == 0, F.expr("substr(umi, 1, 5)")).otherwise(F.col("umi"))))))
query("umi_cross_length_join", READS + """, u AS (SELECT DISTINCT sample_id, chrom, pos, ref, CASE WHEN read_position % 7 = 0 THEN SUBSTR(umi, 1, 5) ELSE umi END AS umi FROM reads)
 SELECT a.sample_id, a.chrom, a.pos, a.ref, a.umi, b.umi AS other FROM u a JOIN u b USING (sample_id, chrom, pos, ref) WHERE LENGTH(a.umi) < LENGTH(b.umi) AND LEVENSHTEIN(a.umi, b.umi) <= 1""")(
    lambda s, d: umi.cross_length_pairs(reads(s, d).select(*umi.SITE, F.when(F.col("read_position") % 7 == 0, F.expr("substr(umi, 1, 5)")).otherwise(F.col("umi")).alias("umi")).distinct()))
query("umi_hamming", READS + ", u AS (SELECT DISTINCT sample_id, umi FROM reads) SELECT a.sample_id, a.umi, b.umi AS other, HAMMING(a.umi, b.umi) AS distance FROM u a JOIN u b USING (sample_id)")(
    lambda s, d: umi.distances(reads(s, d).select("sample_id", "umi").distinct(), ["sample_id"]))
query("umi_hamming_lenpen", READS + ", u AS (SELECT DISTINCT sample_id, umi, SUBSTR(umi, 1, 5) AS part FROM reads) SELECT sample_id, umi, part, CAST(HAMMING(SUBSTR(umi, 1, 5), part) + 1 AS INT) AS distance FROM u")(
    lambda s, d: reads(s, d).select("sample_id", "umi", F.expr("substr(umi, 1, 5)").alias("part")).distinct().withColumn("distance", dna.hamming_overlap("umi", "part")))
query("umi_levenshtein", READS + ", u AS (SELECT DISTINCT sample_id, umi, SUBSTR(umi, 2, 5) AS part FROM reads) SELECT sample_id, umi, part, CAST(LEVENSHTEIN(umi, part) AS INT) AS distance FROM u")(
    lambda s, d: reads(s, d).select("sample_id", "umi", F.expr("substr(umi, 2, 5)").alias("part")).distinct().withColumn("distance", dna.umi_distance("umi", "part")))

# filters and projections
query("site_keys", READS + " SELECT DISTINCT chrom || ':' || pos || ':' || ref AS site_key, chrom || ':' || pos || ':' || ref || '>' || alt AS variant_key FROM reads")(lambda s, d: reads(s, d).select(dna.site_key().alias("site_key"), dna.variant_key().alias("variant_key")).distinct())
query("read_quality_filter", READS + " SELECT sample_id, COUNT(*) FILTER (quality >= 20) AS n_good, COUNT(*) AS n FROM reads GROUP BY ALL")(lambda s, d: reads(s, d).groupBy("sample_id").agg(F.count(F.when(F.col("quality") >= 20, 1)).alias("n_good"), F.count(F.lit(1)).alias("n")))
VARIANTS = READS + """, variants AS (SELECT sample_id, chrom, pos, ref, ANY_VALUE(context) AS context, COALESCE(MAX(r.alt) FILTER (r.alt <> r.ref), r.ref) AS alt, COUNT(*) FILTER (r.alt <> r.ref) AS alt_count, COUNT(*) AS total_depth,
 COUNT(*) FILTER (r.alt <> r.ref AND strand = '+') AS alt_forward, COUNT(*) FILTER (r.alt <> r.ref AND strand = '-') AS alt_reverse, COUNT(*) FILTER (r.alt = r.ref AND strand = '+') AS ref_forward, COUNT(*) FILTER (r.alt = r.ref AND strand = '-') AS ref_reverse,
 AVG(quality) AS mq, COUNT(*) FILTER (r.alt <> r.ref AND (read_position <= 10 OR read_position >= 140)) AS near FROM reads r GROUP BY sample_id, chrom, pos, ref)"""


def variants(s, d):
    r, alt = reads(s, d), F.col("alt") != F.col("ref")
    n = lambda c: F.count(F.when(c, 1))
    plus = F.col("strand") == "+"
    near = (F.col("read_position") <= 10) | (F.col("read_position") >= 140)
    return r.groupBy(*umi.SITE, "context").agg(
        F.coalesce(F.max(F.when(alt, F.col("alt"))), F.first("ref")).alias("alt"), n(alt).alias("alt_count"), F.count(F.lit(1)).alias("total_depth"), n(alt & plus).alias("alt_forward"), n(alt & ~plus).alias("alt_reverse"),
        n(~alt & plus).alias("ref_forward"), n(~alt & ~plus).alias("ref_reverse"), F.count("quality").alias("n_qualities"), F.avg("quality").alias("site_quality"), F.count(F.when(alt, F.col("read_position"))).alias("n_positions"), n(alt & near).alias("near_ends"))


VKEYS = ["sample_id", "chrom", "pos", "ref"]
query("depth_filter", VARIANTS + """ SELECT sample_id, chrom, pos, ref, alt_count >= 2 AND total_depth >= 10 AS depth_filter, CASE WHEN alt_count < 2 THEN 'insufficient_alt_count' WHEN total_depth < 10 THEN 'insufficient_total_depth' END AS depth_filter_reason FROM variants""")(
    lambda s, d: filters.depth_filter(variants(s, d)).select(*VKEYS, "depth_filter", "depth_filter_reason"))
query("quality_filter", VARIANTS + " SELECT sample_id, chrom, pos, ref, mq >= 25 AS quality_filter, CASE WHEN mq < 25 THEN 'low_quality' END AS quality_filter_reason FROM variants")(lambda s, d: filters.quality_filter(variants(s, d), 25.0).select(*VKEYS, "quality_filter", "quality_filter_reason"))
FISHER = """LEAST(1.0, (SELECT SUM(EXP(l)) FROM (SELECT LGAMMA(r + 1) + LGAMMA(t - r + 1) + LGAMMA(c + 1) + LGAMMA(t - c + 1) - LGAMMA(t + 1) - LGAMMA(x + 1) - LGAMMA(r - x + 1) - LGAMMA(c - x + 1) - LGAMMA(t - r - c + x + 1) AS l
  FROM GENERATE_SERIES(GREATEST(0, r + c - t), LEAST(r, c)) g(x)) WHERE l <= LGAMMA(r + 1) + LGAMMA(t - r + 1) + LGAMMA(c + 1) + LGAMMA(t - c + 1) - LGAMMA(t + 1) - LGAMMA(a + 1) - LGAMMA(r - a + 1) - LGAMMA(c - a + 1) - LGAMMA(t - r - c + a + 1) + 1e-7))"""
FTEST = VARIANTS + f""", ft AS (SELECT *, {FISHER} AS p FROM (SELECT *, alt_forward AS a, alt_forward + alt_reverse AS r, alt_forward + ref_forward AS c, total_depth AS t FROM variants)),
 sb AS (SELECT *, CASE WHEN total_depth < 4 THEN 'insufficient_data_for_strand_test' WHEN p < 0.01 AND (alt_forward / NULLIF(alt_count, 0) > 0.95 OR alt_forward / NULLIF(alt_count, 0) < 0.05) THEN 'strand_bias' END AS why FROM ft)"""
ODDS = "CASE WHEN ref_forward + ref_reverse > 0 AND alt_forward + alt_reverse > 0 AND ref_forward + alt_forward > 0 AND ref_reverse + alt_reverse > 0 AND ref_reverse * alt_forward > 0 THEN ref_forward * alt_reverse / (ref_reverse * alt_forward) END"
query("fisher_2x2", FTEST + f" SELECT sample_id, chrom, pos, ref, ROUND(p, 6) AS p_value, ROUND({ODDS}, 6) AS odds_ratio FROM ft")(  # an infinite ratio is given as null
    lambda s, d: filters.strand_bias_filter(variants(s, d)).select(*VKEYS, F.col("strand_p").alias("p_value"), F.when(F.col("strand_odds") < float("inf"), F.col("strand_odds")).alias("odds_ratio")))
query("strand_bias_filter", FTEST + " SELECT sample_id, chrom, pos, ref, COALESCE(why <> 'strand_bias', TRUE) AS strand_bias_filter, why AS strand_bias_filter_reason FROM sb")(lambda s, d: filters.strand_bias_filter(variants(s, d)).select(*VKEYS, "strand_bias_filter", "strand_bias_filter_reason"))
BINOM = "(SELECT SUM(EXP(LGAMMA(n + 1) - LGAMMA(i + 1) - LGAMMA(n - i + 1) + i * LN(p0) + (n - i) * LN(1 - p0))) FROM GENERATE_SERIES({lo}, n) g(i))"
ENDS = VARIANTS + f""", er AS (SELECT *, CASE WHEN ref || '>' || alt IN ('G>T', 'C>A') AND alt_count > 0 THEN {BINOM.format(lo='near')} END AS pe FROM (SELECT *, alt_count AS n, 20.0 / 150 AS p0 FROM variants)),
 ef AS (SELECT *, COALESCE(pe < 0.05 AND near > 2 * p0 * n, FALSE) AS bad FROM er)"""
query("end_repair_filter", ENDS + " SELECT sample_id, chrom, pos, ref, NOT bad AS end_repair_filter, CASE WHEN bad THEN 'end_repair_artifact' END AS end_repair_filter_reason FROM ef")(lambda s, d: filters.end_repair_filter(variants(s, d)).select(*VKEYS, "end_repair_filter", "end_repair_filter_reason"))
ALLF = FTEST + ENDS[len(VARIANTS):] + """, af AS (SELECT sb.sample_id, sb.chrom, sb.pos, sb.ref, sb.alt_count >= 2 AND sb.total_depth >= 10 AS depth_filter, sb.mq >= 20 AS quality_filter, COALESCE(why <> 'strand_bias', TRUE) AS strand_bias_filter, NOT bad AS end_repair_filter,
 CASE WHEN sb.alt_count < 2 THEN 'insufficient_alt_count' WHEN sb.total_depth < 10 THEN 'insufficient_total_depth' END AS r1, CASE WHEN sb.mq < 20 THEN 'low_quality' END AS r2, why AS r3, CASE WHEN bad THEN 'end_repair_artifact' END AS r4
 FROM sb JOIN ef USING (sample_id, chrom, pos, ref))"""
query("variant_filter_all", ALLF + " SELECT sample_id, chrom, pos, ref, depth_filter, quality_filter, strand_bias_filter, end_repair_filter, depth_filter AND quality_filter AND strand_bias_filter AND end_repair_filter AS all_filters_passed FROM af")(
    lambda s, d: filters.all_filters(variants(s, d)).select(*VKEYS, *filters.FILTERS, "all_filters_passed"))
query("filter_summary_row", ALLF + " SELECT sample_id, chrom, pos, ref, 4 AS n_applied, CAST(depth_filter AS INT) + CAST(quality_filter AS INT) + CAST(strand_bias_filter AS INT) + CAST(end_repair_filter AS INT) AS n_passed, 4 - (CAST(depth_filter AS INT) + CAST(quality_filter AS INT) + CAST(strand_bias_filter AS INT) + CAST(end_repair_filter AS INT)) AS n_failed, CONCAT_WS(',', CASE WHEN NOT depth_filter THEN 'depth_filter' END, CASE WHEN NOT quality_filter THEN 'quality_filter' END, CASE WHEN NOT strand_bias_filter THEN 'strand_bias_filter' END, CASE WHEN NOT end_repair_filter THEN 'end_repair_filter' END) AS failed FROM af")(
    lambda s, d: (lambda v: v.select(*VKEYS, "n_applied", "n_passed", "n_failed", F.array_join(filters.failed_names(v), ",").alias("failed")))(filters.all_filters(variants(s, d))))
query("filter_report", ALLF + ", l AS (SELECT 'depth_filter' AS filter, CAST(depth_filter AS INT) AS p FROM af UNION ALL SELECT 'quality_filter', CAST(quality_filter AS INT) FROM af UNION ALL SELECT 'strand_bias_filter', CAST(strand_bias_filter AS INT) FROM af UNION ALL SELECT 'end_repair_filter', CAST(end_repair_filter AS INT) FROM af) SELECT filter, CAST(SUM(p) AS BIGINT) AS n_passed, CAST(SUM(1 - p) AS BIGINT) AS n_failed, ROUND(AVG(p), 6) AS pass_rate FROM l GROUP BY ALL")(
    lambda s, d: filters.filter_report(filters.all_filters(variants(s, d))))
query("filter_reasons", ALLF + ", l AS (SELECT r1 AS reason FROM af UNION ALL SELECT r2 FROM af UNION ALL SELECT r3 FROM af UNION ALL SELECT r4 FROM af) SELECT reason, COUNT(*) AS n FROM l WHERE reason IS NOT NULL GROUP BY ALL")(lambda s, d: filters.reason_histogram(filters.all_filters(variants(s, d))))
query("end_repair_flag", READS + " SELECT sample_id, COUNT(*) FILTER (ref || '>' || alt IN ('G>T', 'C>A') AND (read_position <= 10 OR read_position >= 140)) AS n_flagged FROM reads GROUP BY ALL")(lambda s, d: reads(s, d).groupBy("sample_id").agg(F.count(F.when(filters.end_repair_flag(), 1)).alias("n_flagged")))
query("collapsed_passes", COLLAPSED + " SELECT sample_id, chrom, pos, ref, umi, passes_quality, passes_consensus, is_variant FROM collapsed")(lambda s, d: collapsed(s, d).select(*KEYS, "passes_quality", "passes_consensus", "is_variant"))
query("negative_controls", COLLAPSED + " SELECT sample_id, chrom, pos, ref, umi FROM collapsed WHERE allele_fraction <= 1e-4")(lambda s, d: errors.negative_controls(collapsed(s, d)).select(*KEYS))
query("dynamic_thresholds", FAMS + " SELECT CAST(GREATEST(10, FLOOR(0.8 * AVG(mean_quality))) AS INT) AS min_quality, CAST(GREATEST(1, LEAST(3, FLOOR(QUANTILE_DISC(family_size ORDER BY family_size DESC, 0.5) / 2))) AS INT) AS min_family_size FROM fams".replace("QUANTILE_DISC(family_size ORDER BY family_size DESC, 0.5)", "-QUANTILE_DISC(-family_size, 0.5)"))(lambda s, d: filters.dynamic_thresholds(fams(s, d)))
query("perturb_grid", COLLAPSED + """, bg AS (SELECT context, AVG(CAST(is_variant AS INT)) AS background_rate FROM collapsed WHERE af_milli = 0 GROUP BY ALL), c AS (SELECT collapsed.*, background_rate FROM collapsed LEFT JOIN bg USING (context)),
 g AS (SELECT k AS kind, f AS factor FROM (VALUES ('family_size'), ('quality'), ('background_rate')) a(k), (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (1.1::DOUBLE), (1.2::DOUBLE)) b(f)),
 x AS (SELECT kind, factor, CASE WHEN kind = 'family_size' THEN LEAST(GREATEST(FLOOR(family_size * factor), 1), 1000) ELSE family_size END AS sz, CASE WHEN kind = 'quality' THEN LEAST(GREATEST(mean_quality * factor, 0), 40) ELSE mean_quality END AS q,
  CASE WHEN background_rate IS NULL THEN NULL WHEN kind = 'background_rate' THEN LEAST(GREATEST(background_rate * factor, 1e-6), 1e-2) ELSE background_rate END AS bg, is_variant FROM c, g)
 SELECT kind, ROUND(factor, 6) AS factor, COUNT(*) AS n_families, ROUND(AVG(sz), 6) AS mean_size, ROUND(AVG(q), 6) AS mean_quality, ROUND(AVG(bg), 6) AS mean_background, ROUND(AVG(CAST(q >= 20 AS INT)), 6) AS quality_rate, ROUND(AVG(CAST(is_variant AS INT)), 6) AS variant_rate FROM x GROUP BY ALL""")(_perturbed)
query("provenance_cols", CALLS + """ SELECT sample_id, 'poisson' AS test_type, CAST(0.05 AS DOUBLE) AS alpha, 'bh' AS fdr_method, SHA256('{"alpha": 0.05, "fdr_method": "bh", "test_type": "poisson"}') AS config_hash FROM calls""")(lambda s, d: calls(s, d).select("sample_id", "test_type", "alpha", "fdr_method", "config_hash"))
query("fastq_family_projection", FAMS + " SELECT sample_id, CAST(0 AS INT) AS family_id, family_size, FALSE AS is_variant, CAST(0 AS DOUBLE) AS allele_fraction FROM fams")(lambda s, d: fams(s, d).select("sample_id", F.lit(0).alias("family_id"), "family_size", F.lit(False).alias("is_variant"), F.lit(0.0).alias("allele_fraction")))

# error models
query("context_error_rates", RATES + " SELECT context, mutation, ROUND(rate, 6) AS rate FROM rates")(rates)
query("background_error_mean", COUNTS + f" SELECT {NORMAL} AS context, {NREF} || '>' || {NALLELE} AS mutation, ROUND(AVG(1.0 / consensus_count), 6) AS rate FROM counts WHERE consensus_count >= 2 AND allele <> ref GROUP BY 1, 2")(lambda s, d: errors.background_error_mean(counts(s, d), 2))
query("fit_error_model", COLLAPSED + " SELECT context, COUNT(*) AS n_observations, COUNT(*) FILTER (is_variant) AS k, ROUND(AVG(CAST(is_variant AS INT)), 6) AS error_rate FROM collapsed WHERE af_milli = 0 GROUP BY ALL")(lambda s, d: errors.fit_error_model(controls(s, d)).select("context", "n_observations", "k", "error_rate"))
query("fit_error_model_intervals")(lambda s, d: errors.fit_error_model(controls(s, d)))
query("bayes_error_model", COLLAPSED + ", c AS (SELECT context, COUNT(*) AS n, COUNT(*) FILTER (is_variant) AS k FROM collapsed WHERE af_milli = 0 GROUP BY ALL) SELECT context, n, k, ROUND((k + 1) / (n + 11.0), 6) AS mean, ROUND(SQRT((k + 1) * (n - k + 10.0) / ((n + 11.0) * (n + 11.0) * (n + 12.0))), 6) AS sd FROM c")(lambda s, d: errors.bayes_error_model(controls(s, d)).select("context", "n", "k", "mean", "sd"))
query("beta_interval", COLLAPSED + ", c AS (SELECT context, COUNT(*) AS n, COUNT(*) FILTER (is_variant) AS k FROM collapsed WHERE af_milli = 0 GROUP BY ALL) SELECT context, n, k, ROUND((k + 1) / (n + 11.0), 6) AS mean, ROUND(CASE WHEN n - k + 10 > 1 AND k + 1 > 1 THEN k / (n + 9.0) ELSE (k + 1) / (n + 11.0) END, 6) AS mode FROM c")(lambda s, d: errors.bayes_error_model(controls(s, d)).select("context", "n", "k", "mean", "mode"))
query("beta_interval_quantiles")(lambda s, d: errors.bayes_error_model(controls(s, d)).select("context", "ci_lower", "median", "ci_upper"))
WILSON = "ROUND(CASE WHEN n > 0 THEN GREATEST((k / n + z * z / (2 * n)) / (1 + z * z / n) - z * SQRT(k / n * (1 - k / n) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 0) ELSE 0 END, 6) AS ci_lower, ROUND(CASE WHEN n > 0 THEN LEAST((k / n + z * z / (2 * n)) / (1 + z * z / n) + z * SQRT(k / n * (1 - k / n) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 1) ELSE 1 END, 6) AS ci_upper"
query("wilson_ci", COLLAPSED + f", c AS (SELECT sample_id, COUNT(*) AS n, COUNT(*) FILTER (is_variant) AS k, 1.959963984540054 AS z FROM collapsed GROUP BY ALL) SELECT sample_id, n, k, {WILSON} FROM c")(
    lambda s, d: (lambda c: (lambda ci: c.withColumn("ci_lower", ci[0]).withColumn("ci_upper", ci[1]))(errors.wilson(F.col("k"), F.col("n"))))(collapsed(s, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_variant"), 1)).alias("k"))))
LOCI = READS + """, f AS (SELECT sample_id, chrom, pos, umi, COUNT(*) AS n, COUNT(*) FILTER (alt <> ref) AS a FROM reads GROUP BY ALL HAVING COUNT(*) >= 2),
 loci AS (SELECT sample_id, chrom, pos, CAST(SUM(a) AS BIGINT) AS alt_count, CAST(SUM(n) AS BIGINT) AS total_count, COUNT(*) AS family_count, AVG(n) AS mean_family_size, MAX(n) AS max_family_size FROM f GROUP BY ALL),
 mom AS (SELECT m, GREATEST(v, 1e-6) AS v FROM (SELECT AVG(alt_count / total_count) AS m, VAR_SAMP(alt_count / total_count) AS v FROM loci)),
 par AS (SELECT m * c AS alpha, (1 - m) * c AS beta FROM (SELECT m, CASE WHEN m * (1 - m) / v - 1 <= 0 THEN 1000 ELSE m * (1 - m) / v - 1 END AS c FROM mom))"""


def loci(s, d):
    return umi.locus_summary(reads(s, d))


def _moments(own):
    return errors.beta_binomial_moments(own, F.col("alt_count") / F.col("total_count"))


def _bb(s, d):
    own = cut(loci(s, d))
    return calling.call_beta_binomial(own, own.select("chrom", "pos").distinct().join(F.broadcast(_moments(own))))


BB = LOCI + """, t AS (SELECT l.*, alpha, beta, CASE WHEN alt_count = 0 THEN 1.0 ELSE GREATEST(0, 1 - (SELECT SUM(EXP(LGAMMA(total_count + 1) - LGAMMA(i + 1) - LGAMMA(total_count - i + 1) + LGAMMA(i + alpha) + LGAMMA(total_count - i + beta) - LGAMMA(total_count + alpha + beta) + LGAMMA(alpha + beta) - LGAMMA(alpha) - LGAMMA(beta)))
   FROM GENERATE_SERIES(0, alt_count - 1) g(i))) END AS p FROM loci l, par),
 rk AS (SELECT *, COUNT(*) OVER () AS m, COUNT(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM t),
 bb AS (SELECT *, LEAST(1.0, MIN(p * m / rk) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM rk)"""
query("beta_binom_mom", LOCI + " SELECT ROUND(alpha, 6) AS alpha, ROUND(beta, 6) AS beta FROM par")(lambda s, d: _moments(loci(s, d)))
query("distinct_loci", READS + " SELECT DISTINCT chrom, pos FROM reads")(lambda s, d: reads(s, d).select("chrom", "pos").dropDuplicates())
query("join_error_params", LOCI + " SELECT sample_id, chrom, pos, alt_count, total_count, ROUND(alpha, 6) AS alpha, ROUND(beta, 6) AS beta FROM loci, par")(lambda s, d: _bb(s, d).select("sample_id", "chrom", "pos", "alt_count", "total_count", "alpha", "beta"))
query("betabinom_sf", BB + " SELECT sample_id, chrom, pos, ROUND(p, 6) AS p_value FROM bb")(lambda s, d: _bb(s, d).select("sample_id", "chrom", "pos", "p_value"))
query("call_betabinom", BB + " SELECT sample_id, chrom, pos, ROUND(q, 6) AS p_adjusted, q <= 0.05 AS significant FROM bb")(lambda s, d: _bb(s, d).select("sample_id", "chrom", "pos", "p_adjusted", "significant"))
query("fisher_combine", BB + " SELECT sample_id, ROUND(-2 * SUM(LN(GREATEST(p, 1e-300))), 4) AS statistic, 2 * COUNT(*) AS df FROM bb GROUP BY ALL")(lambda s, d: calling.fisher_combine(_bb(s, d), ["sample_id"]).select("sample_id", F.round("statistic", 4).alias("statistic"), "df"))
query("fisher_combine_p")(lambda s, d: calling.fisher_combine(_bb(s, d), ["sample_id"]))
BZ = BB + f", zz AS (SELECT *, CASE WHEN alt_count / total_count >= alpha / (alpha + beta) THEN 1 ELSE -1 END * {_abs_isf('(p / 2)')} AS z FROM bb)"
query("stouffer", BZ + f", st AS (SELECT sample_id, SUM(SQRT(total_count) * z) / SQRT(SUM(total_count)) AS z FROM zz GROUP BY ALL) SELECT sample_id, ROUND(z, 4) AS z, ROUND({_sf('z')}, 4) AS p_value FROM st")(
    lambda s, d: calling.stouffer(_bb(s, d)).withColumn("z", F.round("z", 4)).withColumn("p_value", F.round("p_value", 4)))
query("norm_isf_z", BZ + " SELECT sample_id, chrom, pos, ROUND(z, 3) AS z FROM zz")(lambda s, d: _bb(s, d).select("sample_id", "chrom", "pos", F.round("z", 3).alias("z")))
query("mini_qc", LOCI + " SELECT ROUND(AVG(total_count), 6) AS coverage, ROUND(1 - AVG(mean_family_size) / MAX(max_family_size), 6) AS duplication, COUNT(*) AS n_loci, CAST(SUM(family_count) AS BIGINT) AS n_families FROM loci")(lambda s, d: qc.mini_qc(loci(s, d)))
query("error_profile", RATES + " SELECT context, ROUND(SUM(rate), 6) AS total_rate, ROUND(MAX(rate), 6) AS max_rate, COUNT(*) AS n_mutations, (SELECT ROUND(AVG(rate), 6) FROM rates) AS mean_rate, (SELECT ROUND(MEDIAN(rate), 6) FROM rates) AS median_rate, (SELECT ROUND(STDDEV_POP(rate), 6) FROM rates) AS sd_rate, (SELECT ROUND(MIN(rate), 6) FROM rates) AS least_rate, (SELECT ROUND(MAX(rate), 6) FROM rates) AS most_rate FROM rates GROUP BY context")(lambda s, d: errors.error_profile(rates(s, d)))
query("context_summary", RATES + ", k AS (SELECT *, REPLACE(mutation, '>', '') IN ('AG', 'GA', 'CT', 'TC') AS ti FROM rates), g AS (SELECT context, SUM(rate) AS t, COUNT(*) AS n, COALESCE(SUM(rate) FILTER (ti), 0) AS ts, COALESCE(SUM(rate) FILTER (NOT ti), 0) AS tv FROM k GROUP BY context) SELECT context, ROUND(t, 6) AS total_rate, n AS n_types, ROUND(ts, 6) AS transition_rate, ROUND(tv, 6) AS transversion_rate, ROUND(CASE WHEN tv > 0 THEN ts / tv END, 6) AS ti_tv FROM g")(lambda s, d: errors.context_summary(rates(s, d)))
query("context_enrichment", RATES + ", o AS (SELECT context, CAST(SUM(consensus_count) AS BIGINT) AS depth, CAST(SUM(CASE WHEN allele <> ref THEN consensus_count ELSE 0 END) AS BIGINT) AS observed FROM norm GROUP BY context), g AS (SELECT context, SUM(rate) AS rate FROM rates GROUP BY context) SELECT context, depth, observed, ROUND(rate, 6) AS rate, ROUND(COALESCE(rate, 1e-4) * depth, 6) AS expected, ROUND(observed / (COALESCE(rate, 1e-4) * depth), 6) AS enrichment FROM o LEFT JOIN g USING (context)")(lambda s, d: errors.context_enrichment(counts(s, d), rates(s, d)))
query("context_thresholds", RATES + ", g AS (SELECT context, SUM(rate) AS rate FROM rates GROUP BY context) SELECT context, ROUND(rate, 6) AS rate, ROUND(rate * 1000, 6) AS expected, ROUND(rate * 1000 + 3 * SQRT(rate * 1000), 6) AS threshold FROM g")(lambda s, d: errors.context_thresholds(rates(s, d), 1000.0))
CVAR = RATES + ", g AS (SELECT context, SUM(rate) AS rate FROM rates GROUP BY context), v AS (SELECT sample_id, chrom, pos, ref, context, COUNT(*) FILTER (allele <> ref) AS alt_count, COUNT(*) AS total_depth FROM fams WHERE allele IS NOT NULL GROUP BY ALL)"


def site_tests(own):
    """Per site and context the mutated and all called families, and the rate of each context, of one table of families."""
    sites = own.where("allele is not null").groupBy(*umi.SITE, "context").agg(F.count(F.when(F.col("allele") != F.col("ref"), 1)).alias("alt_count"), F.count(F.lit(1)).alias("total_depth"))
    each = errors.context_error_rates(umi.consensus_counts(own, [*umi.SITE, "context"]))
    return sites, each.groupBy("context").agg(F.sum("rate").alias("rate"))


query("join_context_rate", CVAR + " SELECT sample_id, chrom, pos, ref, ROUND(COALESCE(rate, 1e-4), 6) AS expected_rate FROM v LEFT JOIN g USING (context)")(lambda s, d: errors.join_context_rate(*site_tests(cut(fams(s, d)))).select(*VKEYS, "expected_rate"))
query("join_context_mutation_rate", RATES + f", v AS (SELECT DISTINCT context, ref, alt, {NORMAL} AS kc, {NREF} || '>' || {NALLELE.replace('allele', 'alt')} AS km FROM reads) SELECT v.context, v.ref, v.alt, ROUND(COALESCE(r.rate, CASE WHEN v.kc IN (SELECT context FROM rates) THEN 1e-6 ELSE 1e-4 END), 6) AS expected_rate FROM v LEFT JOIN rates r ON r.context = v.kc AND r.mutation = v.km")(lambda s, d: errors.join_context_mutation_rate(reads(s, d).select("context", "ref", "alt").distinct(), rates(s, d)).select("context", "ref", "alt", "expected_rate"))
PGREATER = "CASE WHEN alt_count = 0 THEN 1.0 ELSE GREATEST(0, 1 - (SELECT SUM(EXP(-lam + i * LN(lam) - LGAMMA(i + 1))) FROM GENERATE_SERIES(0, alt_count - 1) g2(i))) END"
TESTV = CVAR + f", x AS (SELECT *, COALESCE(rate, 1e-4) * total_depth AS lam FROM v LEFT JOIN g USING (context)), t AS (SELECT *, {PGREATER} AS p FROM x), rk AS (SELECT *, COUNT(*) OVER () AS m, COUNT(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM t), tv AS (SELECT *, LEAST(1.0, MIN(p * m / rk) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM rk)"
_tv = lambda s, d, **k: calling.test_variants(*site_tests(cut(fams(s, d))), **k)
query("test_variants", TESTV + " SELECT sample_id, chrom, pos, ref, ROUND(p, 6) AS p_value, ROUND(q, 6) AS p_adjusted, q <= 0.05 AS significant, p <= 0.05 AS significant_uncorrected FROM tv")(lambda s, d: _tv(s, d).select(*VKEYS, "p_value", "p_adjusted", "significant", "significant_uncorrected"))
query("poisson_tail", TESTV + " SELECT sample_id, chrom, pos, ref, ROUND(p, 6) AS p_value, ROUND(LN(alt_count + 1e-8) - LN(lam + 1e-8), 6) AS effect_size FROM tv")(lambda s, d: _tv(s, d).select(*VKEYS, "p_value", "effect_size"))
query("poisson_2s", CALLS + " SELECT sample_id, n_variants, ROUND(p, 6) AS p_value FROM calls")(lambda s, d: calls(s, d).select("sample_id", "n_variants", "p_value"))
BT = CVAR + ", x AS (SELECT v.*, total_depth AS n, COALESCE(rate, 1e-4) AS p0 FROM v LEFT JOIN g USING (context)), "
LOGIT = "CASE WHEN p0 > 1e-12 AND p0 < 1 - 1e-12 THEN LN(alt_count / n + 1e-12) - LN(1 - alt_count / n + 1e-12) - LN(p0 + 1e-12) + LN(1 - p0 + 1e-12) ELSE LEAST(GREATEST(alt_count / n / (p0 + 1e-12), 1e-12), 1e12) END"
# the lower bound is where the tail from alt_count on is 5 %: exact for one alt read, none or all; others are tested against the tail itself
query("binom_tail", BT + f"t AS (SELECT *, {BINOM.format(lo='alt_count')} AS p FROM x) SELECT sample_id, chrom, pos, ref, ROUND(p, 6) AS p_value, ROUND({LOGIT}, 6) AS effect_size, CASE WHEN alt_count = 0 THEN 0.0 WHEN alt_count = n THEN ROUND(POW(0.05, 1.0 / n), 6) WHEN alt_count = 1 THEN ROUND(1 - POW(0.95, 1.0 / n), 6) END AS ci_lower, CAST(1 AS DOUBLE) AS ci_upper FROM t")(
    lambda s, d: _tv(s, d, test="binomial").withColumn("ci_lower", F.when((F.col("alt_count") <= 1) | (F.col("alt_count") == F.col("total_depth")), F.col("ci_lower"))).select(*VKEYS, "p_value", "effect_size", "ci_lower", "ci_upper"))
LB = "LGAMMA(n + 1) - LGAMMA({i} + 1) - LGAMMA(n - {i} + 1) + {i} * LN(p0) + (n - {i}) * LN(1 - p0)"
query("binom_2s", BT + f"t AS (SELECT *, LEAST(1.0, (SELECT SUM(EXP({LB.format(i='i')})) FROM GENERATE_SERIES(0, n) g(i) WHERE {LB.format(i='i')} <= {LB.format(i='alt_count')} + 1e-7)) AS p FROM x) SELECT sample_id, chrom, pos, ref, ROUND(p, 6) AS p_value FROM t")(lambda s, d: _tv(s, d, test="binomial", alternative="two-sided").select(*VKEYS, "p_value"))
query("test_summary", TESTV + """, e AS (SELECT *, LN(alt_count + 1e-8) - LN(lam + 1e-8) AS effect FROM tv) SELECT COUNT(*) AS n_tests, COUNT(*) FILTER (q <= 0.05) AS n_significant, COUNT(*) FILTER (p <= 0.05) AS n_uncorrected, ROUND(MEDIAN(p), 6) AS median_p, ROUND(MIN(p), 6) AS min_p, ROUND(MAX(p), 6) AS max_p, ROUND(MEDIAN(q), 6) AS median_q,
 ROUND(MEDIAN(effect), 6) AS median_effect, ROUND(AVG(effect), 6) AS mean_effect, ROUND(MAX(effect), 6) AS max_effect, 'poisson' AS test_type, 'bh' AS fdr_method, CAST(0.05 AS DOUBLE) AS alpha FROM e""")(lambda s, d: calling.summarise_tests(_tv(s, d)))
POWER = """CASE WHEN lam > 5 THEN {normal} ELSE 1 - (SELECT SUM(EXP(-found + i * LN(found) - LGAMMA(i + 1))) FROM GENERATE_SERIES(0, (SELECT MIN(k) FROM GENERATE_SERIES(0, 63) gk(k)
  WHERE (SELECT SUM(EXP(-lam + j * LN(lam) - LGAMMA(j + 1))) FROM GENERATE_SERIES(0, k) gj(j)) >= 0.95)) gi(i)) END"""
query("detection_power_col", CALLS + ", wp AS (SELECT *, lam + 0.01 * n_total AS found FROM calls), wz AS (SELECT *, -(found - lam - 1.6448536269514722 * SQRT(lam)) / SQRT(found) AS y FROM wp) SELECT sample_id, n_total, ROUND(LEAST(GREATEST(" + POWER.format(normal=_sf("y")) + ", 0), 1), 6) AS power FROM wz")(lambda s, d: calling.detection_power(calls(s, d), effect=0.01).select("sample_id", "n_total", "power"))

# joins and sets
query("join_target_sites", COUNTS + """, sites AS (SELECT DISTINCT chrom, pos, ref, SUBSTR('ACGT', (INSTR('ACGT', ref) + CAST(pos / 1000 - 1 AS INT) % 3) % 4 + 1, 1) AS target FROM reads)
 SELECT s.chrom, s.pos, s.ref, s.target, CAST(COALESCE(SUM(CASE WHEN allele = target THEN consensus_count END), 0) AS BIGINT) AS alt_count, CAST(COALESCE(SUM(consensus_count), 0) AS BIGINT) AS total_depth FROM sites s LEFT JOIN counts c USING (chrom, pos, ref) GROUP BY ALL""")(
    lambda s, d: joins.target_summary(reads(s, d).select("chrom", "pos", "ref").distinct().withColumn("target", F.expr("substr('ACGT', (instr('ACGT', ref) + cast(pos / 1000 - 1 as int) % 3) % 4 + 1, 1)")), counts(s, d)))
SIG = FAMS + ", sig AS (SELECT DISTINCT sample_id, chrom || ':' || pos || ':' || ref || '>' || allele AS v FROM fams WHERE allele <> ref), rows AS (SELECT sample_id, COUNT(*) AS n FROM fams WHERE allele <> ref GROUP BY ALL)"


def signatures(s, d):
    return fams(s, d).where("allele <> ref").select("sample_id", F.concat(dna.site_key(), F.lit(">"), "allele").alias("v"))


query("contamination_overlap", SIG + " SELECT a.sample_id, COUNT(*) AS shared, ROUND(LEAST(COUNT(*) / ANY_VALUE(n), 0.1), 6) AS contamination FROM sig a JOIN sig b ON a.v = b.v AND a.sample_id <> b.sample_id JOIN rows r ON r.sample_id = a.sample_id GROUP BY a.sample_id")(lambda s, d: joins.contamination_overlap(signatures(s, d)))
query("signature_intersect", SIG + " SELECT v FROM sig WHERE sample_id = 1 INTERSECT SELECT v FROM sig WHERE sample_id = 6")(lambda s, d: signatures(s, d).where("sample_id = 1").select("v").intersect(signatures(s, d).where("sample_id = 6").select("v")))
query("site_scope_join", FAMS + " SELECT COALESCE(a.chrom, b.chrom) AS chrom, COALESCE(a.pos, b.pos) AS pos, n_families, depth FROM (SELECT chrom, pos, COUNT(*) AS n_families FROM fams GROUP BY ALL) a FULL JOIN (SELECT chrom, pos, COUNT(*) AS depth FROM fams WHERE allele IS NOT NULL GROUP BY ALL) b ON a.chrom = b.chrom AND a.pos = b.pos")(
    lambda s, d: fams(s, d).groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n_families")).join(umi.consensus_counts(fams(s, d)).groupBy("chrom", "pos").agg(F.sum("consensus_count").alias("depth")), ["chrom", "pos"], "full_outer"))
query("union_runs", READS + " SELECT 'real_' || sample_id AS sample, umi, COUNT(*) AS n FROM reads WHERE sample_id % 5 <> 0 GROUP BY ALL UNION ALL SELECT 'control_' || sample_id, umi, COUNT(*) FROM reads WHERE sample_id % 5 = 0 GROUP BY ALL")(
    lambda s, d: joins.union_prefixed({"real_": reads(s, d).where("sample_id % 5 <> 0"), "control_": reads(s, d).where("sample_id % 5 = 0")}, "sample_id", "sample").groupBy("sample", "umi").agg(F.count(F.lit(1)).alias("n")))
query("key_difference", SIG + " SELECT v FROM sig WHERE sample_id = 1 EXCEPT SELECT v FROM sig WHERE sample_id = 6")(lambda s, d: signatures(s, d).where("sample_id = 1").select("v").distinct().exceptAll(signatures(s, d).where("sample_id = 6").select("v").distinct()))
DIFF = READS + ", a AS (SELECT chrom || ':' || pos AS path, COUNT(*) AS h FROM reads WHERE sample_id < 25 GROUP BY ALL), b AS (SELECT chrom || ':' || pos AS path, COUNT(*) AS h FROM reads WHERE sample_id >= 20 AND pos > 3000 GROUP BY ALL)"


def _manifests(s, d):
    m = lambda c: reads(s, d).where(c).groupBy(F.concat_ws(":", "chrom", "pos").alias("path")).agg(F.count(F.lit(1)).alias("h"))
    return m("sample_id < 25"), m("sample_id >= 20 and pos > 3000")


query("manifest_diff", DIFF + " SELECT COALESCE(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h")(lambda s, d: joins.manifest_diff(*_manifests(s, d), "path", "h"))
query("table_diff", DIFF + " SELECT 'left' AS side, path, h FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', path, h FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")(lambda s, d: joins.table_diff(*_manifests(s, d)))

# quality control
query("family_size_stats", FAMS + " SELECT COUNT(*) AS n_families, ROUND(AVG(family_size), 6) AS mean, ROUND(MEDIAN(family_size), 6) AS median, ROUND(STDDEV_POP(family_size), 6) AS sd, MIN(family_size) AS least, MAX(family_size) AS most, ROUND(QUANTILE_CONT(family_size, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(family_size, 0.75), 6) AS q75 FROM fams")(lambda s, d: qc.family_size_stats(fams(s, d)).drop("skew", "kurtosis"))
query("family_size_shape", FAMS + ", z AS (SELECT AVG(family_size) AS m, STDDEV_POP(family_size) AS s FROM fams) SELECT ROUND(AVG(POW((family_size - m) / s, 3)), 6) AS skew, ROUND(AVG(POW((family_size - m) / s, 4)) - 3, 6) AS kurtosis FROM fams, z")(lambda s, d: qc.family_size_stats(fams(s, d)).select("skew", "kurtosis"))
query("depth_metrics", COUNTS + ", dp AS (SELECT chrom, pos, ref, SUM(consensus_count) AS d FROM counts GROUP BY ALL), m AS (SELECT MEDIAN(d) AS m FROM dp) SELECT COUNT(*) AS n_sites, CAST(SUM(d) AS BIGINT) AS total_depth, ROUND(AVG(d), 6) AS mean_depth, ROUND(MAX(m), 6) AS median_depth, CAST(MIN(d) AS BIGINT) AS min_depth, CAST(MAX(d) AS BIGINT) AS max_depth, ROUND(STDDEV_SAMP(d), 6) AS sd_depth, COUNT(*) FILTER (d < 100) AS low_sites, ROUND(STDDEV_SAMP(d) / AVG(d), 6) AS cv, ROUND(AVG(CAST(d >= m / 2 AND d <= m * 2 AS INT)), 6) AS uniformity FROM dp, m")(lambda s, d: qc.depth_metrics(counts(s, d)))
query("consensus_efficiency", FAMS + " SELECT COUNT(*) AS n_families, COUNT(*) FILTER (family_size < 3) AS n_below, COUNT(*) FILTER (family_size > 1000) AS n_above, ROUND(AVG(CAST(family_size < 3 AS INT)), 6) AS share_below, ROUND(AVG(CAST(family_size > 1000 AS INT)), 6) AS share_above, COUNT(*) FILTER (family_size BETWEEN 3 AND 1000) AS n_effective, ROUND(AVG(CAST(family_size BETWEEN 3 AND 1000 AS INT)), 6) AS share_effective FROM fams")(lambda s, d: qc.consensus_efficiency(fams(s, d)))
query("site_qc", FAMS + """, a AS (SELECT chrom, pos, ref, COUNT(*) AS n_families, AVG(CAST(allele IS NOT NULL AS INT)) AS cr, AVG(family_size) AS ms, COUNT(allele) AS depth FROM fams GROUP BY ALL), b AS (SELECT chrom, pos, ref, COUNT(*) AS n_alleles, MAX(n) AS max_allele_depth FROM (SELECT chrom, pos, ref, allele, COUNT(*) AS n FROM fams WHERE allele IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 c AS (SELECT *, CONCAT_WS(',', CASE WHEN n_families < 10 THEN 'families' END, CASE WHEN cr < 0.8 THEN 'consensus' END, CASE WHEN depth < 100 THEN 'depth' END) AS failed FROM a LEFT JOIN b USING (chrom, pos, ref))
 SELECT chrom, pos, ref, n_families, ROUND(cr, 6) AS consensus_rate, ROUND(ms, 6) AS mean_size, depth, COALESCE(n_alleles, 0) AS n_alleles, COALESCE(max_allele_depth, 0) AS max_allele_depth, failed, failed = '' AS passed FROM c""")(lambda s, d: qc.site_qc(fams(s, d)))
query("top_sites", FAMS + " SELECT chrom, pos, ref, COUNT(*) AS n_families FROM fams GROUP BY ALL ORDER BY chrom, pos, ref LIMIT 10")(lambda s, d: fams(s, d).groupBy("chrom", "pos", "ref").agg(F.count(F.lit(1)).alias("n_families")).orderBy("chrom", "pos", "ref").limit(10))
CONT = COUNTS + ", cv AS (SELECT *, consensus_count / SUM(consensus_count) OVER (PARTITION BY sample_id, chrom, pos, ref) AS vaf FROM counts), ce AS (SELECT sample_id, COUNT(*) FILTER (allele <> ref AND vaf BETWEEN 0.001 AND 0.05) AS n_low, COUNT(*) AS n_rows FROM cv GROUP BY ALL)"
query("contamination_estimate", CONT + " SELECT sample_id, n_low, n_rows, ROUND(LEAST(n_low / n_rows, 0.1), 6) AS contamination FROM ce")(lambda s, d: errors.contamination_estimate(counts(s, d), umi.SITE))
_guard = lambda s, d: qc.sample_guardrails(fams(s, d), errors.contamination_estimate(counts(s, d), umi.SITE))
GUARD = CONT + """, st AS (SELECT sample_id, chrom, pos, ref, COUNT(allele) AS depth, COUNT(*) AS families FROM fams GROUP BY ALL), sm AS (SELECT sample_id, CAST(SUM(families) AS BIGINT) AS n_families, SUM(depth) / SUM(families) AS cr, AVG(depth) AS md FROM st GROUP BY ALL),
 gd AS (SELECT sm.*, COALESCE(LEAST(n_low / n_rows, 0.1), 0) AS ct FROM sm LEFT JOIN ce USING (sample_id)), gr AS (SELECT *, CONCAT_WS(',', CASE WHEN n_families < 1000 THEN 'families' END, CASE WHEN ct > 0.05 THEN 'contamination' END, CASE WHEN cr < 0.8 THEN 'consensus' END, CASE WHEN md < 100 THEN 'depth' END) AS failed FROM gd)"""
WARN = """[x FOR x IN [CASE WHEN n_families < 1000 THEN PRINTF('insufficient_total_families: %d < 1000', n_families) END, CASE WHEN ct > 0.05 THEN PRINTF('high_contamination: %.4f > 0.05', ROUND(ct, 4)) END] IF x IS NOT NULL] AS failed_criteria,
 [x FOR x IN [CASE WHEN cr < 0.8 THEN PRINTF('low_consensus_rate: %.4f < 0.8', ROUND(cr, 4)) END, CASE WHEN md < 100 THEN PRINTF('low_mean_depth: %.1f < 100', ROUND(md, 1)) END] IF x IS NOT NULL] AS warnings"""
query("clinical_guardrails", GUARD + f", gw AS (SELECT *, {WARN} FROM gr) SELECT sample_id, n_families, ROUND(cr, 6) AS consensus_rate, ROUND(md, 6) AS mean_depth, ROUND(ct, 6) AS contamination, failed, ARRAY_TO_STRING(failed_criteria, '; ') AS failed_criteria, ARRAY_TO_STRING(warnings, '; ') AS warnings, LEN(failed_criteria) = 0 AS sample_valid FROM gw")(
    lambda s, d: _guard(s, d).drop("quality_score").withColumns({c: F.array_join(c, "; ") for c in ("failed_criteria", "warnings")}))
query("quality_score", GUARD + " SELECT sample_id, ROUND(1 - (CAST(n_families < 1000 AS INT) + CAST(ct > 0.05 AS INT) + CAST(cr < 0.8 AS INT) + CAST(md < 100 AS INT)) / 4.0, 6) AS quality_score FROM gr")(lambda s, d: _guard(s, d).select("sample_id", "quality_score"))
query("qc_report", GUARD + ", sq AS (SELECT sample_id, AVG(CAST(depth >= 5 AS INT)) AS site_pass_rate FROM st GROUP BY ALL) SELECT sample_id, n_families, failed, ROUND(site_pass_rate, 6) AS site_pass_rate FROM gr JOIN sq USING (sample_id)")(
    lambda s, d: _guard(s, d).select("sample_id", "n_families", "failed").join(fams(s, d).groupBy(*umi.SITE).agg(F.count("allele").alias("depth")).groupBy("sample_id").agg(qc.rate(F.col("depth") >= 5).alias("site_pass_rate")), "sample_id"))
query("umi_vs_read_af", FAMS + ", r AS (SELECT sample_id, AVG(CAST(alt <> ref AS INT)) AS read_af FROM reads GROUP BY ALL), f AS (SELECT sample_id, AVG(CAST(allele <> ref AS INT)) AS umi_af FROM fams WHERE allele IS NOT NULL GROUP BY ALL) SELECT sample_id, ROUND(read_af, 6) AS read_af, ROUND(umi_af, 6) AS umi_af, umi_af < 0.5 * read_af AS suspicious FROM r JOIN f USING (sample_id)")(lambda s, d: qc.umi_vs_read_af(reads(s, d), fams(s, d)))
query("lod_grid", FAMS + " SELECT af_milli, chrom, pos, ROUND(AVG(CAST(alt_reads > 0 AS INT)), 6) AS detection_rate, ROUND(AVG(alt_reads), 6) AS mean_alt FROM fams GROUP BY ALL")(lambda s, d: qc.lod_grid(fams(s, d), ["af_milli", "chrom", "pos"]))
query("sort_lod_grid", FAMS + " SELECT af_milli, ROUND(AVG(CAST(alt_reads > 0 AS INT)), 6) AS detection_rate, ROUND(AVG(alt_reads), 6) AS mean_alt FROM fams GROUP BY ALL ORDER BY 1")(lambda s, d: qc.lod_grid(fams(s, d), ["af_milli"]).orderBy("af_milli"))

# contracts
RULES = [("family_size", "family_size between 1 and 10000"), ("umi_present", "umi is not null and umi <> ''"), ("allele", "allele is null or allele in ('A', 'C', 'G', 'T', 'N')"), ("quality", "consensus_quality is null or consensus_quality between 0 and 100"), ("reads_add_up", "alt_reads + ref_reads = family_size"), ("large_family", "family_size >= 3")]
query("schema_contract", FAMS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, COUNT(*) FILTER (NOT COALESCE({c}, FALSE)) AS n_bad FROM fams" for n, c in RULES) + ") ORDER BY 1")(lambda s, d: contracts.violations(fams(s, d), RULES))
query("umi_output_rules", FAMS + " SELECT sample_id, chrom, pos, ref, umi FROM fams WHERE NOT (family_size >= 3 AND allele IS NOT NULL)")(lambda s, d: contracts.quarantine(fams(s, d), [("size", "family_size >= 3"), ("called", "allele is not null")])[1].select(*KEYS))
query("variant_input_checks", VARIANTS + " SELECT sample_id, chrom, pos, ref FROM variants WHERE alt_count >= 0 AND total_depth > 0 AND alt_count <= total_depth")(lambda s, d: contracts.quarantine(variants(s, d), [("alt", "alt_count >= 0"), ("depth", "total_depth > 0"), ("share", "alt_count <= total_depth")])[0].select(*VKEYS))
query("collapsed_invariants", FAMS + " SELECT sample_id, umi, COUNT(*) AS n FROM fams GROUP BY ALL HAVING COUNT(*) > 1")(lambda s, d: contracts.duplicates(fams(s, d), ["sample_id", "umi"]))
query("coverage_rules", FAMS + " SELECT 'context' AS kind, context AS item, COUNT(*) AS n, COUNT(*) >= 10 AS passed FROM fams GROUP BY ALL UNION ALL SELECT 'family_size', CASE WHEN family_size >= 3 THEN 'enough' ELSE 'too_small' END, COUNT(*), BOOL_AND(family_size >= 3) FROM fams GROUP BY 2")(lambda s, d: contracts.coverage(fams(s, d)))
query("table_fingerprint")(lambda s, d: contracts.fingerprint(fams(s, d)))
