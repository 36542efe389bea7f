"""Every operator and stage on nulls in all columns, repeated rows, extra columns of clashing names, and no rows at all."""

import random
import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formspark.llm import bpe, chat, media, mixing, near, pii, quality, sharding, suffixes, toxicity

from .edge import documents, edge_texts, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "mix": lambda d, l: mixing.mix(d)[0],
    "shard": lambda d, l: sharding.shard_documents(d),
    "repeats": lambda d, l: suffixes.remove_repeats(d),
    "toxicity": lambda d, l: toxicity.rate_documents(d, l),
    "without_toxic": lambda d, l: toxicity.without_toxic(d, toxicity.learn(d, l)),
    "private": lambda d, l: pii.find_private(d),
    "mask": lambda d, l: pii.mask_private(d),
    "quality": lambda d, l: quality.judge(d, l),
    "bpe": lambda d, l: bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN),
    "near": lambda d, l: near.join_similar(d),
    "one_of_each": lambda d, l: near.one_of_each(d),
    "mix_rows": lambda d, l: mixing.mix_rows(d),
    "media": lambda d, l: media.through_avi(d),
}
OWN = {"doc_id", "text", "lang", "source", "n_chars"}
#: Every short name that occurs in the operators' code.
NAMES = sorted({n.lower() for p in (Path(near.__file__).parent).glob("*.py") for n in re.findall(r'"([A-Za-z_][A-Za-z0-9_]{0,20})"', p.read_text())} - OWN)


@pytest.fixture(scope="module")
def tables(spark):
    docs = documents(spark, [*edge_texts(), None, "twice the same words in a row here", "twice the same words in a row here"], ids=[*range(len(edge_texts())), None, None, None], source=lambda i: None if i % 4 == 0 else f"s{i % 2}", lang=lambda i: None if i % 3 == 0 else "en")
    docs = docs.unionByName(docs.filter("doc_id in (0, 6, 13)"))
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (None, None, None), (6, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    return docs.coalesce(2).cache(), labels


def rows(df, names):
    return sorted(map(str, df.select(*[f"`{n}`" for n in names]).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(tables, name):
    docs, labels = tables
    plain = OPERATORS[name](docs, labels)
    wide = docs.select("*", *[F.lit("own").alias(n) for n in NAMES])
    assert rows(OPERATORS[name](wide, labels.withColumns({n: F.lit("own") for n in ("text", "lang", "source", "score")})), plain.columns) == rows(plain, plain.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(tables, name):
    docs, labels = tables
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_every_row_has_its_result(tables):
    docs, labels = tables
    n = docs.count()
    for name in ("shard", "repeats", "toxicity", "private", "mask", "quality", "bpe", "near", "media"):
        assert OPERATORS[name](docs, labels).count() == n, name


def test_chat_ignores_extra_columns(spark):
    own = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    plain = chat.digest_conversations(own)
    wide = own.select("*", *[F.lit("own").alias(n) for n in NAMES if n not in own.columns])
    assert rows(chat.digest_conversations(wide), plain.columns) == rows(plain, plain.columns)


def test_pipeline_without_rows(spark, tables, tmp_path):
    docs, labels = tables
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_add_no_links(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = documents(spark, [base, base + " end", "other words of no such kind at all"])
    rows = near.join_similar(docs.unionByName(docs)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in rows) == [(0, 0, 1, 2)] * 2 + [(1, 0, 1, 2)] * 2 + [(2, 2, 0, 2)] * 2


def test_classes_with_null_and_shared_ids(spark):
    rng = random.Random(12)
    bases = [prose(rng, 60) for _ in range(6)]
    texts = [b + tail for b in bases for tail in ("", " one", " two")]
    own = [(rng.choice([None, None, 3, 3, *range(40)]), rng.choice(texts)) for _ in range(90)]
    own += [(None, t) for t in (texts[0], texts[0], texts[1])] + [(50, "alone one"), (50, "alone two"), (None, "alone two"), (None, "no id at all")]
    kind = lambda t: bases.index(t.rsplit(" ", 1)[0] if t.endswith((" one", " two")) else t) if t in texts else t
    least = {k: min((i for i, t in own if i is not None and kind(t) == k), default=None) for k in {kind(t) for _, t in own}}
    links = {k: len({t for _, t in own if kind(t) == k}) - 1 for k in least}
    want = [(i, least[kind(t)], links[kind(t)], sum(u == t for _, u in own)) for i, t in own]
    docs = documents(spark, [t for _, t in own], ids=[i for i, _ in own])
    assert sorted(map(str, map(tuple, near.join_similar(docs).collect()))) == sorted(map(str, want))
    left = [(i, t) for i, t in own if i is None or i == least[kind(t)]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in near.one_of_each(docs).collect()))) == sorted(map(str, left))
    assert {kind(t) for _, t in left} == set(least)
