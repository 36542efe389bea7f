"""Byte-level BPE with a rank queue: a hierarchical bitmap of merge ranks over buckets of linked-list positions.

All new short pre-tokens of a batch share one queue, whose buckets are arrays: the next rank merges in all of them at once,
the leftmost place of each. A long pre-token has a queue of its own, which merges place by place.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import text_arrays as ta

#: Pre-tokens whose ids a worker remembers (some 250 bytes each); when full, it starts anew.
REMEMBERED = 800_000
#: Pre-tokens of more bytes have a queue of their own and aren't remembered.
LONG = 48


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked pair merges first, the leftmost of equals.

    The queue of pairs has a bucket of positions for each merge rank, and a bitmap of two levels over the ranks: a bit
    of top for each word of low that isn't zero, a bit of low for each rank that has positions. The lowest set bits lead
    to the next rank. Entries are never taken out early; one whose pair has changed since is skipped.
    """
    rank_of = ranks.get
    if (known := rank_of(piece)) is not None:
        return [known]
    n = len(piece)
    end = list(range(1, n + 2))  # of the part that begins here
    before = list(range(-1, n))
    pair = [-1] * (n + 1)  # the rank of the pair that begins here
    top, low, buckets = 0, {}, {}
    again = range(n - 1)
    while True:
        for i in again:
            j = end[i]
            if i < 0 or j >= n:
                continue
            r = rank_of(piece[i : end[j]])
            if r is None:
                pair[i] = -1
                continue
            pair[i] = r
            if (bucket := buckets.get(r)) is None:
                buckets[r] = [i]
                a = r >> 6
                low[a] = low.get(a, 0) | 1 << (r & 63)
                top |= 1 << a
            else:
                heappush(bucket, i)
        while top:
            a = (top & -top).bit_length() - 1
            x = low[a]
            r = a << 6 | (x & -x).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                low[a] = x = x & x - 1
                if not x:
                    top &= top - 1
            if pair[i] == r:
                break
        else:
            break
        j = end[i]
        end[i] = k = end[j]
        pair[i] = pair[j] = -1
        before[k] = i
        again = (i, before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """The rank of each pair of ids that merges; an open hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(splits, np.int64).reshape(-1, 3).T
        key, bits = left << 32 | right, (len(splits) * 4).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys, self.ranks = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int64)
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            if at.max() + 2 > len(self.keys):
                self.keys, self.ranks = (np.append(x, np.full(64, -1)) for x in (self.keys, self.ranks))
            new = todo[self.keys[at[todo]] < 0]
            self.keys[at[new]] = key[new]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] += 1
        self.ranks[at] = rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Their ranks; -1 for pairs that don't merge."""
        key = left << 32 | right
        at = self._slot(key)
        found = self.keys[at]
        while len(on := np.flatnonzero((found != key) & (found >= 0))):
            at[on] += 1
            found[on] = self.keys[at[on]]
        return np.where(found == key, self.ranks[at], -1)


def merge_together(pieces: list[bytes], pairs: Pairs, of_byte: np.ndarray) -> list[bytes]:
    """merge of each of many pieces, as little-endian 32-bit integers, by one queue: the positions of a rank merge together,
    the leftmost of each piece; the others of a piece wait in the bucket, since a lower rank may come up before them."""
    size = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n, stop = len(data), np.cumsum(size)
    piece = np.repeat(np.arange(len(pieces)), size)
    ids = np.append(of_byte[data], 0)
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    after[stop - 1], before[stop - size] = n, -1
    alive, pair = np.ones(n, bool), np.full(n + 1, -1, np.int64)
    buckets: dict[int, list[np.ndarray]] = {}
    top, low = 0, {}

    def put(at: np.ndarray, ranks: np.ndarray) -> None:
        nonlocal top
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(ranks), 1), bool), ranks[1:] != ranks[:-1])))
        for r, lo, hi in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            if r in buckets:
                buckets[r].append(at[lo:hi])
            else:
                buckets[r] = [at[lo:hi]]
                low[r >> 6] = low.get(r >> 6, 0) | 1 << (r & 63)
                top |= 1 << (r >> 6)

    inner = np.flatnonzero(after < n)
    pair[inner] = pairs.of(ids[inner], ids[inner + 1])
    put(inner, pair[inner])
    while top:
        a = (top & -top).bit_length() - 1
        x = low[a]
        r = a << 6 | (x & -x).bit_length() - 1
        low[a] = x = x & x - 1
        if not x:
            top &= top - 1
        own = buckets.pop(r)
        i = own[0] if len(own) == 1 else np.sort(np.concatenate(own))
        i = i[pair[i] == r]  # the others have changed since
        if not len(i):
            continue
        leftmost = np.concatenate(([True], piece[i[1:]] != piece[i[:-1]]))
        if not leftmost.all():
            put(i[~leftmost], np.full(len(i) - int(leftmost.sum()), r))
            i = i[leftmost]
        j = after[i]
        k = after[j]
        ids[i], after[i], before[k] = r, k, i
        alive[j], pair[j] = False, -1
        h = before[i]
        h, to = h[h >= 0], i[h >= 0]
        at = np.concatenate((i, h))
        pair[at] = pairs.of(ids[at], np.concatenate((ids[k], ids[to])))
        pair[i[k == n]] = -1
        put(at, pair[at])
    end = np.cumsum(alive)[stop - 1] * 4
    whole = ids[:n][alive].astype("<u4").tobytes()
    return [whole[lo:hi] for lo, hi in zip([0, *end.tolist()], end.tolist())]


class Codec(dict):
    """Pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, rank_file: bytes, pattern: str, remembered: int):
        super().__init__()
        self.remembered = remembered
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs = Pairs(self.ranks)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        if len(self) > self.remembered:
            self.clear()
        long, short, coded = {}, [], []
        for piece in {p for own in found for p in own if p not in self}:
            raw = piece.encode()
            if (known := self.ranks.get(raw)) is not None:
                self[piece] = known.to_bytes(4, "little")
            elif len(raw) > LONG:
                long[piece] = np.array(merge(raw, self.ranks), "<u4").tobytes()
            else:
                short.append(piece)
                coded.append(raw)
        if short:
            self.update(zip(short, merge_together(coded, self.pairs, self.of_byte)))
        of = self.__getitem__ if not long else lambda p: long.get(p) or self[p]
        return [b"".join(map(of, own)) for own in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=1)
def codec(rank_file: bytes, pattern: str, remembered: int = REMEMBERED) -> Codec:
    return Codec(rank_file, pattern, remembered)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = False, remembered: int = REMEMBERED, piece: int = 4 << 20) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text, with the ids themselves on request.

    rank_path: a rank file of a few MB at most, read by the driver and broadcast. piece: texts of about so many bytes are
    encoded at once. Null and empty texts have no tokens.
    Repeated rows are rows of the result each; equal texts of a batch are encoded once. All other columns of docs than
    doc_id and text are left out; no rows give no rows.
    """
    with open(rank_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value, pattern, remembered)
        for batch in ta.chunks(batches, limit=piece):
            texts = [x.as_py() or "" for x in batch.column(1)]
            done = dict.fromkeys(texts)  # of the equal texts of a batch, one is encoded
            for text, ids in zip(done, c.encode(list(done))):
                done[text] = ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()
            coded, ids_sha, text_sha = zip(*(done[t] for t in texts))
            n = [len(ids) // 4 for ids in coded]
            cols, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(coded, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return docs.select("doc_id", "text").mapInArrow(ta.frees(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
