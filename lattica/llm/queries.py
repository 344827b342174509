"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import ball_kmeans, chosen_path, embedding_dedup, external_shuffle, fingerprint, hidden_markov, mixing, packing, secret_scan, spelling, token_files, toxicity, winnowing
from lattica.llm.common import Scratch, read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_texts(read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "op3").path("tokens")
    manifest = token_files.write(read(spark, sf_dir, "documents"), root, tokenizer_path())
    return token_files.documents(spark, root, manifest)


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(read(spark, sf_dir, "documents"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "op8").path("shards")
    return external_shuffle.digest(*external_shuffle.shuffle_into(read(spark, sf_dir, "documents"), root))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(read(spark, sf_dir, "documents")))


def op10_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_wavelet_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_token_files": op3_token_files,
    "op4_merkle_fingerprint": op4_merkle_fingerprint,
    "op5_length_buckets": op5_length_buckets,
    "op6_pareto_mixing": op6_pareto_mixing,
    "op7_chosen_path": op7_chosen_path,
    "op8_external_shuffle": op8_external_shuffle,
    "op9_secret_scan": op9_secret_scan,
    "op10_sorted_projections": op10_sorted_projections,
    "op11_winnowing": op11_winnowing,
    "op12_wavelet_spelling": op12_wavelet_spelling,
    "op13_ball_kmeans": op13_ball_kmeans,
}

#: DuckDB SQL by query; the others are held against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op4_merkle_fingerprint": fingerprint.ORACLE,
    "op6_pareto_mixing": mixing.ORACLE,
    "op7_chosen_path": chosen_path.ORACLE,
    "op10_sorted_projections": embedding_dedup.ORACLE,
    "op11_winnowing": winnowing.ORACLE,
    "op13_ball_kmeans": ball_kmeans.ORACLE,
}
