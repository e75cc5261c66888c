"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plasmaflow.llm import dropout, forest, langid, line_dedup, maxscore, minhash, mixing, oracles, phrases, quality, runs, token_counts, url_filter, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(_table(spark, sf_dir, "embeddings"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropout.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(runs.with_periodic_tails(_table(spark, sf_dir, "documents"))))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_templates": op2_url_templates,
    "op3_prefix_forest": op3_prefix_forest,
    "op4_token_counts": op4_token_counts,
    "op5_maxscore": op5_maxscore,
    "op6_merge_dropout": op6_merge_dropout,
    "op7_flow_mixing": op7_flow_mixing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_wavelet_shards": op9_wavelet_shards,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_quality_discriminant": op13_quality_discriminant,
}

#: The others cannot be expressed in SQL; tests/llm holds them against brute force, the tokenizer libraries or held-out labels.
ORACLES = {
    "op5_maxscore": oracles.MAXSCORE,
    "op8_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op10_line_dedup": oracles.LINES,
    "op12_phrase_collocations": oracles.COLLOCATIONS,
}
