"""The registered queries of this folder: thin callers of its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import bpe, exact, hmm, licenses, merkle, mixing, pii, quality, sharding, simhash, spelling, topk, wavelet
from voxelweave.llm.sql import ORACLES


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repository_path() -> F.Column:
    """The tables name no files; a path is derived from source, language and id. Every twentieth is a licence file."""
    n = F.col("doc_id")
    name = F.when(n % 20 == 0, "LICENSE.txt").otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    return F.concat_ws("/", "source", "lang", F.floor(n / 400).cast("string"), name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", repository_path().alias("path"), "text")
    return licenses.scan(docs)


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "topic", "tokens", F.round("multiplier", 6).alias("multiplier"),
                      F.round("probability", 6).alias("probability"), "sampled")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.write_shards(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", *bpe_digests())


def bpe_digests() -> list[F.Column]:
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


def op5_uniform_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, shards=16, keys=("doc_id",))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(_read(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.KINDS],
        F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.as_text(every).alias("spans"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(_read(spark, sf_dir, "documents"), words_each=3, radius=3)
    return classes.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.tampered_manifest(_read(spark, sf_dir, "documents"))
    text = {c: F.lower(F.hex(b)).alias(c) for c, b in (
        ("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof_sha256", "proof"), ("folded_root", "folded"))}
    return out.select(F.col("id").alias("doc_id"), *text.values(), "verified")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_mixture, op3_token_shards, op4_byte_bpe, op5_uniform_shuffle, op6_quality, op7_private_data,
    op8_exact_dedup, op9_simhash, op10_top_k,
    op11_merkle_manifest, op12_spelling_groups, op13_hmm_scores, pipeline,
)}


def load_all():
    return QUERIES, ORACLES
