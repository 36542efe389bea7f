"""A corpus from raw documents: toxic texts and near duplicates go, personal data is masked, sources are mixed, and the
rest becomes tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from formspark.llm import bpe, mixing, near, pii, toxicity
from formspark.llm.common import stored, table
from formspark.ship import ship

#: No SQL: learning, MinHash and tokens are beyond it. tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below 0.7. Null and empty texts score as texts without words; without toxic labels all stay."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the least id; rows without doc_id stay."""
    return near.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows, each span of personal data replaced by its kind; null texts stay null."""
    return pii.mask_private(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources has them, once at least; null sources are one source."""
    return mixing.mix_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids as little-endian 32-bit integers; no tokens for null and
    empty texts."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, remembered=100_000, piece=1 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other, each result cut from its lineage.

    Null and empty texts are kept as they are and have no tokens; rows that share a doc_id, or have none, are rows of their
    own in every stage but that one_of_each and the mix take equal texts and ids alike; other columns of documents, whatever
    their names, stay until the last stage. An empty table gives no rows.
    """
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
