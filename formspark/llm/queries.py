"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, chat, manifest, media, mixing, near, pii, quality, sharding, suffixes, toxicity, word_bpe
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.drop("place")


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat.digest_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join_similar(table(spark, sf_dir, "documents"))


def op10_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.through_avi(table(spark, sf_dir, "documents")).withColumn("feature", media.feature()).drop("clips")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_words(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, _ = align.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered, changed = manifest.letters_lowered()
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered=tampered, changed=changed)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_shard_documents, op3_suffix_dedup, op4_toxicity, op5_private_data, op6_quality_rules, op7_byte_bpe, op8_chat_format, op9_ngram_join, op10_media_clips, op11_word_bpe, op12_align_tokenizers, op13_merkle_manifest)}
ORACLE = {"op8_chat_format": chat.DIGEST_SQL, "op13_merkle_manifest": manifest.SQL}
