"""BPE over whole words with a mark at their end, merged by segment trees over the ranks of adjacent pairs.

A leaf of a tree is a place of the word; its key is the rank of the pair that begins there and the place itself, so that
the root is the leftmost pair of the lowest rank. A merge changes three leaves and the nodes above them. All new short words
of a batch are merged in step, a tree each; a long word has a tree of its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from . import text_arrays as ta

#: Stretches between white space that a worker remembers (some 250 bytes each); when full, it starts anew.
REMEMBERED = 800_000
#: Words of more bytes have a tree of their own.
LONG = 64
#: No pair: more than any key, and an id that no pair has.
NONE, NO_ID = np.int64(1) << 40, 1 << 30
#: White space for str.split but not for the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Merges:
    """The pairs of ids that merge, their ranks and what they become."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"])))
        keys, self.made = left << 32 | right, made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        # A byte's character: its own where that is printable, or else the next one from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        chars = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
        self.inner, self.last = (np.array([vocab[c + end] for c in chars], np.int64) for end in ("", suffix))
        self.text = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.text[i] = token

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Their ranks, NONE for pairs that don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge(word: bytes, m: Merges) -> list[int]:
    """Ids of one word, by one tree: the root's pair merges until there is none."""
    n = len(word)
    ids = [*m.inner[np.frombuffer(word, np.uint8)].tolist()[:-1], int(m.last[word[-1]])]
    if n == 1:
        return ids
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    width = 1 << (n - 2).bit_length()
    none, rank_of, made = int(NONE) * n, m.rank_of.get, m.made.tolist()

    def key(i: int) -> int:
        j = after[i]
        r = rank_of(ids[i] << 32 | ids[j]) if j < n else None
        return none if r is None else r * n + i

    tree = [none] * (2 * width)
    tree[width : width + n - 1] = map(key, range(n - 1))
    for x in range(width - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])

    def put(i: int, k: int) -> None:
        x = width + i
        tree[x] = k
        while x > 1:
            k = min(tree[x], tree[x ^ 1])
            x >>= 1
            if tree[x] == k:
                break
            tree[x] = k

    while (top := tree[1]) < none:
        r, i = divmod(top, n)
        j = after[i]
        ids[i], after[i] = made[r], (k := after[j])
        if k < n:
            before[k] = i
        if j < n - 1:
            put(j, none)
        put(i, key(i))
        if (h := before[i]) >= 0:
            put(h, key(h))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def _in_step(words: list[bytes], width: int, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of at most width + 1 bytes, one after the other, and how many each has."""
    n, places = len(words), width + 1
    size = np.array([len(w) for w in words])
    at = np.arange(places)
    inside = at < size[:, None]
    ids = np.full((n, places + 1), NO_ID, np.int64)  # the last place stands for none
    data = np.frombuffer(b"".join(words), np.uint8)
    ids[:, :places][inside] = m.inner[data]
    ids[np.arange(n), size - 1] = m.last[data[np.cumsum(size) - 1]]
    after = np.where(at + 1 < size[:, None], at + 1, places)
    after = np.concatenate((after, np.full((n, 1), places)), axis=1)
    before = np.tile(np.concatenate(([places], at)), (n, 1))
    tree = np.full((n, 2 * width), NONE, np.int64)
    rank = m.rank(ids[:, :width].ravel(), ids[:, 1:places].ravel()).reshape(n, width)
    tree[:, width:] = np.where(rank < NONE, rank * width + at[:width], NONE)
    x = width
    while x > 1:
        tree[:, x // 2 : x] = np.minimum(tree[:, x : 2 * x : 2], tree[:, x + 1 : 2 * x : 2])
        x //= 2
    flat, row = tree.ravel(), np.arange(n)
    row = row[tree[:, 1] < NONE]
    while len(row):
        r, i = np.divmod(tree[row, 1], width)
        j = after[row, i]
        k, h = after[row, j], before[row, i]
        ids[row, i], after[row, i], before[row, k] = m.made[r], k, i
        inside[row, j] = False
        new = m.rank(np.concatenate((ids[row, i], ids[row, h])), np.concatenate((ids[row, k], ids[row, i])))
        leaf, rows = np.concatenate((i, h, j)), np.tile(row, 3)
        keys = np.concatenate((new, np.full(len(row), NONE)))
        keys = np.where(keys < NONE, keys * width + leaf, NONE)
        real = leaf < width  # the last place begins no pair
        start, x = rows[real] * (2 * width), leaf[real] + width
        flat[start + x] = keys[real]
        for _ in range(width.bit_length() - 1):
            flat[start + (x >> 1)] = np.minimum(flat[start + x], flat[start + (x ^ 1)])
            x = x >> 1
        row = row[tree[row, 1] < NONE]
    return ids[:, :places][inside], inside.sum(axis=1)


def merge_all(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """merge of each word: all ids one after the other, and how many each word has. Short words take their merges in step."""
    sizes = np.array([len(w) for w in words], np.int64)
    widths = np.where(sizes > LONG, 0, 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64))
    flat, counts, order = [], [], []
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        own = [words[i] for i in which.tolist()]
        if width:
            ids, n = _in_step(own, width, m)
        else:
            each = [merge(w, m) for w in own]
            ids, n = np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
        flat.append(ids)
        counts.append(n)
        order.append(which)
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, n, order = np.concatenate(flat), np.concatenate(counts), np.argsort(np.concatenate(order))
    start, n = (np.cumsum(n) - n)[order], n[order]
    stop = np.cumsum(n)
    return ids[np.repeat(start - (stop - n), n) + np.arange(len(ids))], n


def joined(strings: pa.Array, n: np.ndarray) -> pa.Array:
    """The first n[0] strings joined by spaces, the next n[1], and so on."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int64()), strings), pa.scalar(" ", pa.large_string()))


def distinct(strings: list[str]) -> tuple[list[str], np.ndarray]:
    """The different strings, and the place of each string among them."""
    d = pa.array(strings, pa.large_string()).dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy()


class Codec:
    """Texts to ids. What stands between white space is remembered as its ids and its tokens, both as text.

    Normal forms never reach over white space, so each stretch is normalized by itself: ASCII here, others by the
    library's normalizer and splitter, whose Unicode version so holds.
    """

    def __init__(self, spec: bytes, remembered: int):
        parts = json.loads(spec)
        kinds = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        split, model = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0], parts["model"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not (split["invert"] and split["behavior"] == "Removed") or parts["decoder"] or not model["end_of_word_suffix"] or model["unk_token"]:
            raise ValueError("not a byte-level BPE of lower-case words with a mark at their end")
        self.merges = Merges(model)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split = Tokenizer.from_str(spec.decode()).pre_tokenizer[0]
        self.ascii = re.compile(split["pattern"]["Regex"].replace(r"[\p{L}]", "[a-z]").replace(r"\p{L}", "a-z").replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "0-9"), re.ASCII)
        self.special = {x["content"]: x["id"] for x in parts["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.remembered = remembered
        self.id_text, self.token_text = (pa.array(x, pa.large_string()) for x in ([str(i) for i in range(len(self.merges.text))], self.merges.text))
        self.forget()

    def forget(self) -> None:
        """Nothing but the special tokens is known."""
        self.place = {s: k for k, s in enumerate(self.special)}  # of a stretch in what follows
        self.ids, self.tokens = (pa.array(map(str, x), pa.large_string()) for x in (self.special.values(), self.special))
        self.n = np.ones(len(self.special), np.int64)

    def stretches(self, text: str) -> list[str]:
        """The text cut at white space; special tokens stand alone."""
        if any(s in text for s in self.special):
            return [x for k, part in enumerate(self.specials.split(text)) for x in ([part] if k % 2 else self.between(part))]
        return self.between(text)

    @staticmethod
    def between(text: str) -> list[str]:
        if ODD_SPACE.search(text):  # no space to the tokenizer
            return [x for x in re.split("[^\\S\x1c-\x1f]+", text) if x]
        return text.split()

    def by_library(self, text: str) -> list[str]:
        return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]

    def words(self, stretches: list[str]) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
        """The stretches of a kind, all their words, and how many each has. Many are cut at once, NUL between them; what
        holds one itself is cut alone."""
        alone = [s for s in stretches if "\0" in s]
        if alone:
            each = [self.by_library(s) for s in alone]
            yield alone, [w for ws in each for w in ws], np.array([len(ws) for ws in each])
        kinds: tuple[list[str], list[str]] = [], []
        for s in stretches if not alone else set(stretches).difference(alone):
            kinds[not s.isascii() or ODD_SPACE.search(s) is not None].append(s)
        for own, cut in zip(kinds, (lambda x: self.ascii.findall(x.lower()), self.by_library)):
            if own:
                flat = cut(" \0 ".join(own))
                ends = np.concatenate(([-1], np.flatnonzero(np.array([w == "\0" for w in flat])), [len(flat)]))
                yield own, [w for w in flat if w != "\0"], np.diff(ends) - 1

    def learn(self, stretches: list[str]) -> None:
        for own, words, n in self.words(stretches):
            different, at = distinct(words)
            ids, m = merge_all([w.encode() for w in different], self.merges)
            for name, texts in (("ids", self.id_text), ("tokens", self.token_text)):
                new = joined(joined(texts.take(ids), m).take(at), n)
                setattr(self, name, pa.concat_arrays([getattr(self, name), new]))
            self.place |= zip(own, range(len(self.n), len(self.n) + len(own)))
            self.n = np.concatenate((self.n, np.add.reduceat(m[at], np.cumsum(n) - n)))

    def encode(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each text the number of tokens, the ids, and the tokens, both joined by spaces."""
        if len(self.place) > self.remembered:
            self.forget()
        found = [self.stretches(t) for t in texts]
        size = np.array([len(own) for own in found], np.int64)
        stretches, at = distinct([s for own in found for s in own])
        self.learn([s for s in stretches if s not in self.place])
        at = np.array([self.place[s] for s in stretches], np.int64)[at]
        before = np.concatenate(([0], np.cumsum(self.n[at])))
        stop = np.cumsum(size)
        return (before[stop] - before[stop - size]).tolist(), joined(self.ids.take(at), size).to_pylist(), joined(self.tokens.take(at), size).to_pylist()


@functools.lru_cache(maxsize=1)
def codec(spec: bytes, remembered: int = REMEMBERED) -> Codec:
    return Codec(spec, remembered)


def encode_words(docs: DataFrame, path: str, keep: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text; keep adds ids (array) and decoded (the tokens' text).

    path: the JSON file of a byte-level BPE of lower-case words with a mark at their end, read by the driver and broadcast
    (a few MB). Special tokens inside a text are tokens, as the library takes them; without a decoder the tokens are joined
    by spaces. Null, empty and blank texts have no tokens. Repeated rows are rows of the result each; equal texts of a batch
    are encoded once. Columns other than doc_id and text are left out; no rows give no rows.
    """
    with open(path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value, remembered)
        for batch in ta.chunks(batches, limit=4 << 20):
            texts = [x.as_py() or "" for x in batch.column(1)]
            done = dict.fromkeys(texts)
            for text, n, ids, tokens in zip(done, *c.encode(list(done))):
                done[text] = n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest(), *([[int(i) for i in ids.split()], tokens] if keep else [])
            n, ids_sha, text_sha, *whole = zip(*(done[t] for t in texts))
            cols, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols, names = [*cols, pa.array(whole[0], pa.list_(pa.int32())), pa.array(whole[1], pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)
