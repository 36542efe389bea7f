import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from formspark.llm import bpe, media, quality

from .edge import documents, edge_texts


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics(spark):
    texts = edge_texts()
    labels = spark.createDataFrame([(6, 1), (7, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.judge(documents(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        r, b = rows[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, i
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and (not r.kept or not r.base_failed)


def test_cutoffs_hold_the_limit(spark):
    good = ["a b c d e f g h i j k l m n o p q r s t u v w x y z %d" % i for i in range(2000)]
    bad = ["a| b# c| d| e| f| g| h| i| j| k| l| m| n| o| p| q| r| s| t| %d" % i for i in range(200)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 2000)) for i in range(2200)], "doc_id long, quality int")
    rows = quality.judge(docs, labels).collect()
    assert sum(not r.kept for r in rows if r.doc_id < 2000) <= 100
    assert not any(r.kept for r in rows if r.doc_id >= 2000)
    few = quality.judge(docs, labels.filter("doc_id < 10")).collect()
    assert all(r.kept for r in few)  # ten labels prove nothing
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_few_labels_prove_the_union(spark):
    good = ["a b c d e f g h i j k l m n o p q r s t u v w x y z %d" % i for i in range(130)]
    docs = documents(spark, good + ["a| b# c| d| e| f| g| h| i| j| k| l| m| n| o| p| q| r| s| t| 9"])
    labels = spark.createDataFrame([(i, 1) for i in range(130)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.judge(docs, labels).collect() if not r.kept] == [130]


def test_cutoffs_equal_a_plain_search(spark):
    rng = random.Random(13)
    rows = [(i, rng.choice(["de", "en", None]), rng.randint(20, 200), 0, 0, rng.randint(1, 20), 0, 0, 0) for i in range(900)]
    rows = [(i, s, n, rng.randint(3 * n, 7 * n if rng.random() < 0.98 else 30 * n), rng.choice([0] * 60 + [n]), ln, rng.choice([0] * 90 + [ln]), rng.choice([0] * 90 + [n // 4]), rng.randint(n // 3, n)) for i, s, n, _, _, ln, *_ in rows]
    good = spark.createDataFrame(rows, quality.METRICS)
    got = {(r.stratum, r.rule): r.cutoff for r in quality.cutoffs(good).collect()}
    value = {"symbols": lambda r: r[4] / max(r[3], 1), "dup_lines": lambda r: r[6] / max(r[5], 1), "repeat_words": lambda r: r[7] / max(r[2], 1), "few_distinct": lambda r: 1 - r[8] / max(r[2], 1), "long_words": lambda r: r[3] / max(r[2], 1)}
    want = {}
    for s in ("de", "en", None):
        own, limits = [r for r in rows if r[1] == s], {}
        for rule, cutoff in quality.moves():
            tried = {**limits, rule: cutoff}
            k, n = sum(any(value[x](r) > c for x, c in tried.items()) for r in own), len(own)
            if sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) > 0.05 / 3:
                break
            limits = tried
        want |= {(s, rule): c for rule, c in limits.items()}
    assert got == want and 3 < len(want)


def test_proofs_hold_their_error():
    """Of many samples, few prove a setting that rejects more of the good texts than is allowed."""
    rng, first_bad = np.random.default_rng(5), 4
    shares = np.array([0.0, 0.01, 0.01, 0.02, 0.02, 0.1])  # of the texts that each move rejects first: 0.06 after the fifth
    wrong = 0
    for _ in range(2000):
        n = int(rng.integers(60, 1500))
        counts = rng.multinomial(n, [*shares, 1 - shares.sum()])[:-1]
        wrong += quality.proven(counts.tolist(), n, 0.05, 0.05) > first_bad
    assert 0 < wrong <= 0.05 * 2000 + 3 * (2000 * 0.05 * 0.95) ** 0.5
    assert quality.proven([0] * 6, 10, 0.05, 0.05) == 0 and quality.proven([0] * 6, 59, 0.05, 0.05) == 6
    names = [r for r, _ in quality.moves()]
    assert set(names) == set(quality.GRID) and len(names) == sum(len(x) for _, x in quality.GRID.values())


def test_binomial_tail():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 50, 0.2), (10, 10, 0.5)):
        assert abs(quality.binomial_tail(k, n, p) - min(1, sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))) < 1e-12


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, own):
    rng = random.Random(7)
    texts = [*edge_texts(), *("".join(rng.choice(["ab", "aab", "é", "🙂a", " th"]) for _ in range(rng.randint(1, 60))) for _ in range(300)), "x" * 5000, "<|endoftext|> it's  we'll\n\n  \tend  ", "ab" * 3000 + "🙂" * 50, "aaaa" * 999 + "!" * 777]
    rows = {r.doc_id: r for r in bpe.encode_documents(documents(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_media_reads_back(spark):
    texts = [*edge_texts(), "\xff" * 9000, "a" * 64, "a" * 65]
    rows = {r.doc_id: r for r in media.through_avi(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.store([payload])[0]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert (rows[6].media_sha256, rows[6].clips) == (rows[7].media_sha256, rows[7].clips)


def test_clip_rows(spark):
    texts = ["a" * 4096 * 3 + "\x7f" * 4096 * 4, None, "a" * 4096 * 3 + "\x7f" * 4096 * 4]
    rows = media.clip_rows(media.through_avi(documents(spark, texts, ids=[4, None, 4]))).collect()
    own = sorted((r.clip, r.start_s, r.end_s, r.frames, r.mean) for r in rows if r.doc_id == 4)
    assert own == sorted([(0, 0.0, 3 / 25, 3, 97.0), (1, 3 / 25, 7 / 25, 4, 127.0)] * 2)
    assert [(r.clip, r.frames, r.mean) for r in rows if r.doc_id is None] == [(0, 1, 0.0)]
    assert media.clip_rows(media.through_avi(documents(spark, ["a"]).limit(0))).count() == 0


def test_media_random_samples_and_files_without_index():
    rng = np.random.default_rng(0)
    for n in (64, 4096, 4160, 40960):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        stored = media.store([payload])[0]
        fps, frames = media.parse(stored)
        assert fps == media.FPS and b"".join(f.tobytes() for f in media.decode(frames)) == payload
        cut = stored[: stored.rindex(b"idx1")]
        assert media.parse(cut)[1] == frames


def test_shots_split_where_the_histogram_moves():
    rng = np.random.default_rng(1)
    dark, light = [rng.integers(0, 60, (64, 64)).astype(np.uint8) for _ in range(6)], [rng.integers(180, 250, (64, 64)).astype(np.uint8) for _ in range(5)]
    assert media.shots(dark + light) == [(0, 6), (6, 11)]
    assert media.shots(dark[:1]) == [(0, 1)]


def test_a_tile_of_long_texts_is_cut_into_grams_piece_by_piece(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from formspark.llm import near
    from formspark.llm import text_arrays as ta

    monkeypatch.setattr(ta, "_factors", {k: np.ones(1, np.uint32) for k in ta._factors})
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 9000)) for _ in range(40)]
    texts += [texts[0] + " more", "two words", "", None]
    column, zero = pa.array(texts, pa.string()), [0] * len(texts)
    tile = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), *[pa.array(zero, pa.int64())] * 4, column], ["node", "cluster", "chunk", "lo", "hi", "text"])
    tracemalloc.start()
    rows = pa.Table.from_batches(list(near._cluster_links(5, 0.8)(iter([tile])))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows["links"] == [1] + [0] * 39 + [1, 0, 0, 0] and rows["root"][40] == 0
    assert peak < 60 << 20
    # what a worker keeps grows with a piece, not with a tile
    assert max(map(len, ta._factors.values())) <= 4 * near.PIECE
    whole = near.shingles(column, 5)
    assert all((a == b).all() for a, b in zip(whole, near.shingles_by_piece(pa.table({"text": column}), 5)))


def test_common_grams_of_a_few_texts_need_a_small_table():
    import tracemalloc

    from formspark.llm import near

    sets = [{1, 2, 3, 9}, {2, 3, 4}, {3, 7}]
    g, d = (np.array(x) for x in zip(*((y, i) for i, own in enumerate(sets) for y in sorted(own))))
    tracemalloc.start()
    both = near.overlaps(g.astype(np.uint64), d, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [both[0, 1], both[0, 2], both[1, 2]] == [2, 1, 1] and (both == both.T).all()
    assert peak < 1 << 20
