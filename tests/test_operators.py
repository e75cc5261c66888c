"""Hand-worked goldens, ties, nulls and empty input of the operators."""

import pytest
from pyspark.sql import functions as F

from plasmaflow.functions import dna
from plasmaflow.operators import calling, errors, filters, limits, multiple, umi

READ = "sample_id int, chrom string, pos int, ref string, umi string, alt string, quality int, strand string"


def family(spark, reads, **k):
    rows = [(1, "chr1", 1, "A", "AAAA", alt, q, "+") for alt, q in reads]
    return umi.families(spark.createDataFrame(rows, READ), **k)


@pytest.mark.parametrize(
    ("reads", "share", "allele", "quality"),
    [
        ([("T", 30), ("T", 28), ("A", 32)], 0.6, None, None),
        ([("T", 30), ("T", 28), ("A", 32)], 0.5, "T", 29.0),
        ([("T", 15), ("T", 10), ("A", 32)], 0.6, "A", 32.0),
        ([("T", 30), ("C", 28), ("G", 32)], 0.6, None, None),
        ([("T", 30), ("C", 30)], 0.5, "C", 30.0),
        ([(None, 30)], 0.6, None, None),
    ],
)
def test_consensus(spark, reads, share, allele, quality):
    row = family(spark, reads, share=share).first()
    assert (row["allele"], row["consensus_quality"], row["family_size"]) == (allele, quality, len(reads))


def test_empty_input_keeps_the_schema(spark):
    empty = family(spark, [])
    assert empty.count() == 0
    assert umi.consensus_counts(empty).count() == 0
    assert multiple.adjust(spark.createDataFrame([], "p_value double")).columns == ["p_value", "p_adjusted", "significant"]


def test_strings(spark):
    row = spark.range(1).select(
        dna.hamming(F.lit("AAGGCCTT"), F.lit("AAGGCCTA")).alias("a"), dna.hamming(F.lit("AAGGCCTT"), F.lit("AAGGCC")).alias("b"), dna.hamming_overlap(F.lit("ACG"), F.lit("ACGT")).alias("c"),
        dna.normal_context(F.lit("AGT")).alias("d"), dna.normal_base(F.lit("AGT"), F.lit("G")).alias("e"), dna.normal_context(F.lit("ACG")).alias("f"),
        dna.umi_from_header(F.lit("READ_001 UMI:AAAAAAAC")).alias("g"), dna.phred_decode(F.lit("IH")).alias("h"), dna.normal_context(F.lit("AC")).alias("i"),
    ).first()
    assert tuple(row) == (1, 8, 1, "ACT", "C", "ACG", "AAAAAAAC", [40, 39], None)


def p_values(spark, ps, **k):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p_value double")
    return [r["p_adjusted"] for r in multiple.adjust(df, **k).orderBy("i").collect()]


def test_multiple_testing(spark):
    assert p_values(spark, [0.001, 0.005, 0.01, 0.03, 0.05, 0.1]) == pytest.approx([0.006, 0.015, 0.02, 0.045, 0.06, 0.1])
    assert p_values(spark, [0.01, 0.02, 0.03], method="holm") == pytest.approx([0.03, 0.04, 0.04])
    assert p_values(spark, [0.01, 0.5], method="bonferroni") == pytest.approx([0.02, 1])
    assert p_values(spark, [0.02, 0.02, None]) == [pytest.approx(0.02), pytest.approx(0.02), None]


def test_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1)], "label int, score double")
    assert multiple.roc_auc(df).first()[0] == pytest.approx(0.75)
    assert multiple.average_precision(df).first()[0] == pytest.approx(0.75)
    assert multiple.roc_auc(df.where("label = 1")).first()[0] == 0.5


def test_hpdi(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (0, 1, 2, 3, 10)], "g int, x double")
    assert tuple(multiple.hpdi(df, ["g"], "x", 0.8).first()) == (1, 0.0, 3.0)


def curve(spark, afs, rates):
    return spark.createDataFrame([(1000, a, r, r, r) for a, r in zip(afs, rates, strict=True)], "umi_depth int, allele_fraction double, rate double, ci_lower double, ci_upper double")


def test_limit_of_detection(spark):
    reached = limits.lod_interpolated(curve(spark, [0.0001, 0.0005, 0.001, 0.005, 0.01], [0.1, 0.5, 0.9, 0.98, 0.99])).first()
    assert reached["lod"] == pytest.approx(0.0035)
    never = limits.lod_interpolated(curve(spark, [0.001, 0.005, 0.01], [0.3, 0.6, 0.8])).first()
    assert (never["lod"], never["ci_lower"], never["ci_upper"], never["reached"]) == (0.02, 0.01, None, False)


def test_wilson_and_moments(spark):
    low, high = errors.wilson(F.lit(5), F.lit(100))
    assert tuple(spark.range(1).select(low, high).first()) == pytest.approx((0.021544, 0.111750), abs=1e-6)
    row = errors.beta_binomial_moments(spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.1, 0.2)], "v double"), F.col("v")).first()
    assert tuple(row) == pytest.approx((0.870625, 9.079375), abs=1e-4)


def test_fisher_combine(spark):
    row = calling.fisher_combine(spark.createDataFrame([("a", p) for p in (0.01, 0.04, 0.5)], "s string, p_value double"), ["s"]).first()
    assert (row["statistic"], row["combined_p"]) == (pytest.approx(17.034386, abs=1e-5), pytest.approx(0.009158, abs=1e-5))


def sequential_greedy(counts, close):
    order, taken = sorted(counts, key=lambda u: (-counts[u], u)), {}
    for seed in order:
        if seed not in taken:
            for u in order:
                if u not in taken and (u == seed or close(seed, u)):
                    taken[u] = seed
    return taken


def test_clusters(spark):
    counts = {"AAAA": 5, "AAAT": 3, "AATT": 2, "CCCC": 4, "CCCG": 4, "CCGG": 4, "GGGG": 1}
    df = spark.createDataFrame([(1, "c", 1, "A", u, n) for u, n in counts.items()], "sample_id int, chrom string, pos int, ref string, umi string, n int")
    pairs = umi.neighbours(df)
    close = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    assert {r["umi"]: r["cluster"] for r in umi.cluster_greedy(df, pairs).collect()} == sequential_greedy(counts, close)
    components = {r["umi"]: r["cluster"] for r in umi.cluster_components(df, pairs).collect()}
    assert components["AATT"] == "AAAA" and components["CCGG"] == "CCCC" and components["GGGG"] == "GGGG"
    assert {(r["umi"], r["other"]) for r in umi.neighbours(df, 2).collect()} >= {("AAAA", "AATT"), ("CCGG", "GGGG")}


def test_filters_pass_without_inputs(spark):
    df = spark.createDataFrame([("G", "T", 5, 50, None, None, None, None, None, None)], "ref string, alt string, alt_count int, total_depth int, quality_scores array<int>, alt_forward int, alt_reverse int, ref_forward int, ref_reverse int, read_positions array<int>")
    assert filters.all_filters(df).first()["all_filters_passed"]


def test_results_do_not_depend_on_partitions(spark, sf):
    from plasmaflow.plans import core
    from plasmaflow.sources import contracts

    prints = {tuple(contracts.fingerprint(umi.families(core.reads(spark, sf).repartition(n)).drop("mean_quality")).first()) for n in (1, 4, 17)}
    assert len(prints) == 1


def test_fastq_records_of_a_split_file(spark, tmp_path):
    from plasmaflow.sources import fastq

    with open(tmp_path / "lane.fastq", "w") as f:
        f.writelines(f"@r{i} UMI:ACGTAC\n{'ACGT' * (1 + i % 7)}\n+\n{'I' * (4 + 4 * (i % 7))}\n" for i in range(3000))
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        records = fastq.read_fastq(spark, str(tmp_path / "lane.fastq"))
        assert spark.read.text(str(tmp_path / "lane.fastq")).rdd.getNumPartitions() > 5
        rows = {r["record_idx"]: (r["read_id"], r["sequence_length"]) for r in records.collect()}
        limited = fastq.read_fastq(spark, str(tmp_path / "lane.fastq"), max_reads=100).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    assert rows == {i: (f"r{i} UMI:ACGTAC", 4 + 4 * (i % 7)) for i in range(3000)}
    assert limited == 100


def test_a_large_sample_is_several_messages_with_the_same_calls(spark, sf, tmp_path):
    from plasmaflow.plans import core
    from plasmaflow.streaming import calls

    reads = core.reads(spark, sf)
    messages = calls.to_messages(reads, most=20)
    assert messages.select("key").distinct().count() == 50
    assert messages.select(F.size(F.from_json("value", calls.MESSAGE)["sample_data"]["reads"]).alias("n")).agg(F.max("n")).first()[0] < reads.groupBy("sample_id").count().agg(F.max("count")).first()[0]
    messages.repartition(6).write.json(f"{tmp_path}/in")
    calls.run(calls.file_source(spark, f"{tmp_path}/in", files_per_trigger=2), 0.002, f"{tmp_path}/out", f"{tmp_path}/errors", f"{tmp_path}/state").awaitTermination()
    fields = ["sample_id", "n_reads", "n_variants", "n_total", "p_value", "significant"]
    parts = spark.read.parquet(f"{tmp_path}/out")
    want = calls.batch_calls(calls.parse(calls.to_messages(reads, most=10**9))[0], 0.002).select(fields)
    assert parts.count() > want.count()
    plain = lambda df: sorted((*r[:4], round(r[4], 9), r[5]) for r in df.select(fields).collect())
    assert plain(calls.totals(parts, 0.002)) == plain(want)
