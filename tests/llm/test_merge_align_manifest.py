"""Word BPE and alignment against the libraries, the manifest against a plain tree."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from formspark.llm import align, manifest, word_bpe

from .edge import SCHEMA, documents, edge_texts

WORDS = public_tokenizers.path("word_bpe_49k.json")
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def raw(path):
    with open(path, "rb") as f:
        return f.read()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def clashing(docs):
    """Columns whose names the operators use themselves."""
    return docs.selectExpr("*", "1 AS n", "2 AS g", "3 AS d", "4 AS i", "'x' AS pair", "'y' AS block", "5 AS leaf", "6 AS n_tokens", "7 AS o", "8 AS t")


# --- words


@pytest.fixture(scope="module")
def words():
    return word_bpe.Codec(raw(WORDS), 1000), Tokenizer.from_file(WORDS)


def by_library(t, text):
    ids = t.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)


def test_words_as_the_library(words):
    own, lib = words
    rng = random.Random(1)
    some = "abcdeéÉß'lvs 1²٣ \t\n\x1c\x00ć漢🙂ΣσÅ <|>_-ֈǅﬁ"
    cases = ["Hello <|endoftext|> World's don't  12345 <|EndOfText|>", "a<|startoftext|>b", "<|endoftext|><|endoftext|>", "e<|endoftext|>́", "'ll've're 'S", "a\x1cb \x1d", "ΑΣ ΟΔΟΣ İ", "\x00", " \x00 a\x00b ", "x" * 3000, "ab" * 700]
    cases += ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    cases += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x20000)])) for _ in range(20)).encode("utf-8", "ignore").decode() for _ in range(3000)]
    for lo in range(0, len(cases), 1000):  # so that what is remembered is forgotten on the way
        part = cases[lo : lo + 1000]
        assert list(zip(*own.encode(part))) == [by_library(lib, x) for x in part]


def test_trees_of_all_widths_merge_alike(words):
    m, rng = words[0].merges, random.Random(2)
    pieces = ["".join(rng.choice("etaoinshr") for _ in range(n)).encode() for n in [*range(1, word_bpe.LONG + 1)] * 3]
    ids, n = word_bpe.merge_all(pieces, m)
    stop = np.cumsum(n)
    assert [ids[hi - k : hi].tolist() for hi, k in zip(stop, n)] == [word_bpe.merge(p, m) for p in pieces]
    assert [len(x) for x in word_bpe.merge_all([], m)] == [0, 0]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="lower-case words"):
        word_bpe.Codec(raw(A_FILE), 10)


def test_word_documents_at_the_edges(spark, words):
    texts = edge_texts()
    docs = documents(spark, texts, ids=[None, *range(1, len(texts) - 1), 1])
    got = word_bpe.encode_words(clashing(docs), WORDS, keep=True).collect()
    ids = [None, *range(1, len(texts) - 1), 1]
    want = []
    for d, t in zip(ids, texts):
        n, i, tokens = by_library(words[1], t or "")
        want.append((d, n, sha(i), sha(tokens), [int(x) for x in i.split()], tokens))
    assert sorted(map(tuple, got), key=lambda r: key(r[:4])) == sorted(want, key=lambda r: key(r[:4]))
    assert word_bpe.encode_words(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


# --- alignment


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE), align.Aligner(raw(A_FILE), raw(B_FILE), 10)


def test_gallop_equals_intersection():
    rng = random.Random(3)
    for _ in range(400):
        a, b = (sorted(rng.sample(range(1, 200), rng.randint(0, n))) for n in (20, 150))
        i, j = align.gallop(a, b)
        assert [a[x] for x in i] == [b[x] for x in j] == sorted({*a} & {*b})
        if a and b:
            a, b = sorted({*a, 200}), sorted({*b, 200})
            lo, hi = align.overlaps(a, b)
            start = [0, *a[:-1]], [0, *b[:-1]]
            assert [set(range(x, y)) for x, y in zip(lo, hi)] == [{k for k in range(len(b)) if start[1][k] < e and b[k] > s} for s, e in zip(start[0], a)]


def aligned(docs, a, b, own):
    """All of it, a document at a time."""
    out, count = [], collections.Counter()
    for d, text in docs:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not b"".join(own.a_bytes[i] for i in x) == (" " + (text or "")).encode() == b"".join(own.b_bytes[i] for i in y):
            x = y = []
        ends = []
        for ids, size in ((x, own.a_bytes), (y, own.b_bytes)):
            at, e = 0, {}
            for k, i in enumerate(ids):
                at += len(size[i])
                e[at] = k
            ends.append(e)
        groups, links, i, j = [], [], 0, 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        count.update(links)
        start = [dict(zip(sorted(e), [0, *sorted(e)[:-1]])) for e in ends]
        over = sum(start[1][f] < e and f > start[0][e] for e in ends[0] for f in ends[1]) if len(x) < 300 else len(x) + len(y) - len(groups)
        out.append((d, len(x), len(y), groups, links, over))
    most = collections.Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    rows = [(d, nx, ny, len(g), len(e), sum(count[p] == most[p[1]] for p in e), sum(count[p] for p in e), sha(";".join(g)) if nx else "", over) for d, nx, ny, g, e, over in out]
    return rows, {(x, y, n, n == most[y]) for (x, y), n in count.items()}


def test_alignment_as_plainly_done(spark, tokenizers):
    rng = random.Random(4)
    some = "abcdeé'ls 1² \t\n▁漢🙂<|> .,-_ \xa0\x1c"
    texts = [*edge_texts(), "a  b", " a", "a ", "foo\n \nbar", "foo \n bar", "x\n\n y", "<|endoftext|> <s> </s>", "<0x0A>", "▁x"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [" ".join("".join(rng.choice("etaoin.,\n") for _ in range(rng.randint(1, 12))) for _ in range(20)) for _ in range(100)]
    ids = [None, *range(1, len(texts) - 1), 1]
    docs = clashing(documents(spark, texts, ids=ids)).repartition(3)
    got, pairs = align.align_documents(docs, A_FILE, B_FILE, remembered=200, block=20_000)
    want, totals = aligned(zip(ids, texts), *tokenizers)
    same(got.collect(), want)
    assert {tuple(r) for r in pairs.collect()} == totals
    empty, none = align.align_documents(spark.createDataFrame([], SCHEMA), A_FILE, B_FILE)
    assert empty.count() == none.count() == 0


def test_equal_rows_align_alike(spark, tokenizers):
    rows = [(5, "the same text, again")] * 300 + [(6, "another one")]
    got, _ = align.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), A_FILE, B_FILE, keep=True)
    same([tuple(r)[:9] for r in got.collect()], aligned(rows, *tokenizers)[0])
    assert {r["groups"].count("|") for r in got.collect()} == {r["n_groups"] for r in got.collect()}


# --- manifest


def plain_manifest(rows):
    def digest(*x):
        return sha("".join(x))

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return digest(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(t, i):
        for level in t[:-1]:
            k = i % 8
            run = level[i - k : i - k + 8]
            yield k, run[:k] + run[k + 1 :]
            i //= 8

    by = collections.defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {x: tree([leaf(r, r["text"]) for r in by[x]]) for x in langs}
    over = tree([trees[x][-1][0] for x in langs])
    for q, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            up, text = [*path(trees[x], i), *path(over, q)], r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            d = leaf(r, text)
            for k, others in up:
                d = digest(*others[:k], d, *others[k:])
            yield r["doc_id"], trees[x][0][i], trees[x][-1][0], over[-1][0], digest(*(y for _, others in up for y in others)), d, d == over[-1][0]


def made(docs, **options):
    tampered, changed = manifest.letters_lowered()
    return manifest.manifest(docs, tampered=tampered, changed=changed, **options)


def check_manifest(docs, **options):
    got = made(clashing(docs), **options).collect()
    same(got, list(plain_manifest([r.asDict() for r in docs.collect()])))
    return got


def test_manifest_at_the_edges(spark):
    texts = [t and t.title() for t in edge_texts()]
    got = check_manifest(documents(spark, texts, ids=[None, *range(1, len(texts) - 1), 1], lang=lambda i: [None, "", "de", "É", "z"][i % 5]))
    assert {r["verified"] for r in got} == {True, False}
    assert made(spark.createDataFrame([], SCHEMA)).count() == 0
    check_manifest(documents(spark, ["Only"]))
    check_manifest(documents(spark, ["A"] * 9, lang=lambda i: None))
    check_manifest(documents(spark, [f"T {i}" for i in range(70)], lang=lambda i: f"l{i}"))


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_over_many_stages(spark, height):
    """Blocks of 8 or 64 leaves, so that small tables have several stages; equal rows are a third."""
    check_manifest(documents(spark, [f"Text {i if i % 3 else 0}" for i in range(700)], ids=[i if i % 3 else 0 for i in range(700)], lang=lambda i: None if i % 3 == 0 else "en" if i % 2 else f"x{i % 9}"), height=height)


def test_a_version_copies_the_ancestors_only(spark):
    docs = documents(spark, [f"Text {i}" for i in range(200)])
    rows = made(docs, keep=True).collect()
    base = {r["leaf"] for r in rows}
    for r in rows:
        d, up = r["leaf"], r["siblings"]
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        assert len(r["copied"]) == (len(up) if tampered else 0)
        assert set(up[0]) < base and d not in up[0]
        assert not tampered or (r["copied"][-1] == r["folded_root"] and not set(r["copied"]) & {x for level in up for x in level})
