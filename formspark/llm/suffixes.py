"""Removal of long repeated strings, and search for repeated passages, with a distributed, sparse suffix array.

A suffix matters here by its first `length` tokens only (bytes, or words), and equal strings of that length must fall
together. Every string of that length has an anchor: its position with the least hash of a short gram, so equal strings
have their anchors at equal offsets. Suffixes that share an anchor and nearly its offset form a block, and are sorted
twice:

1. Blocks, by the leading tokens of what all suffixes of the block share, then by the fingerprint of all they share, then
   by that of all tokens of the block. Blocks without equal shared tokens hold no equal suffixes; two that agree in both
   fingerprints hold the same.
2. Blocks that agree in what they share only, in parts of up to 32 suffixes that carry the few bytes around what they
   share, so that the bucket that sorts them compares their suffixes one by one (words: suffix by suffix).

Each sort range-partitions by sampled splitters over these keys (ties are split by position, so a very frequent string
spreads over many buckets), sorts each bucket by multikey quicksort, and compares neighbours, also across boundaries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import partitions, stored

_U = np.uint64
_POS_BITS = _U(28)
PART = 32
#: lead: the leading tokens; k0, k1: which row it is; pos: the first suffix.
ROW = "lead long, tok0 long, tok1 long, k0 long, k1 long, pos int, span int"
NAMES = ["lead", "tok0", "tok1", "k0", "k1", "pos", "span"]
BY = NAMES[:6]
#: span: successive suffixes from pos, plus so many times the distance from pos to their anchor.
SPAN = 1024
SETTLED, OPEN, EDGE = 0, 1, 2
#: Splitters are weighted quantiles of rows of so large a part of the texts, of about this many a bucket, this many in all.
SAMPLED, SPLIT_ROWS, MAX_SPLIT_ROWS = 1 / 16, 200, 1_000_000


@dataclass(frozen=True)
class Unit:
    """What suffixes are made of: the tokens of an anchor's gram, and the suffixes of a block at most."""

    words: bool
    gram: int
    block: int


BYTES, WORDS = Unit(False, 16, 128), Unit(True, 4, 32)


def multikey_quicksort(keys: list[np.ndarray], small: int = 1 << 13) -> np.ndarray:
    """The order of rows by keys[0], then keys[1], ...: three-way partitions by one key at a time; rows equal to the
    pivot go on with the next key. Ranges below `small` are sorted at once."""
    order = np.arange(len(keys[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == len(keys):
            continue
        own = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = own[np.lexsort([k[own] for k in reversed(keys[depth:])])]
            continue
        k = keys[depth][own]
        pivot = np.partition(k[:: max(1, len(k) // 31)], 15)[15]
        less, more = k < pivot, k > pivot
        equal = ~(less | more)
        order[lo:hi] = np.concatenate((own[less], own[equal], own[more]))
        a, b = lo + int(less.sum()), hi - int(more.sum())
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def tokens(column: pa.Array, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, or the prints of their words, and where each text begins and ends."""
    data, offs = ta.as_bytes(column)
    if not unit.words:
        return data, offs
    start, end, doc = ta.words(data, offs)
    return ta.Prints(data).of(start, end), np.searchsorted(doc, np.arange(len(column) + 1))


def gram_hashes(data: np.ndarray, unit: Unit) -> np.ndarray:
    if unit.words:
        return ta.grams(data, np.zeros(len(data), np.int8), unit.gram)[0]
    e = ta.eights(data)
    h = e[:-8] * _U(0x9E3779B97F4A7C15) + e[8:] * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(32))) * _U(0xBF58476D1CE4E5B9)


def leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes, or the word, at each place, as a number in their order."""
    if data.dtype == np.uint8:
        return data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.int64)
    return data[at].view(np.int64)


def anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each string of w grams: the place of the least (texts don't matter yet)."""
    grams = len(hashes)
    key = (hashes >> _POS_BITS << _POS_BITS) | np.arange(grams).astype(_U)
    whole = -(-grams // w) * w
    key = np.concatenate((key, np.full(whole - grams, ~_U(0)))).reshape(-1, w)
    head = np.minimum.accumulate(key, axis=1).ravel()
    tail = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    m = grams - w + 1
    return (np.minimum(tail[:m], head[w - 1 : w - 1 + m]) & ((_U(1) << _POS_BITS) - _U(1))).astype(np.int64)


def blocks_of(data: np.ndarray, p: np.ndarray, a: np.ndarray, doc: np.ndarray, length: int, size: int) -> tuple[np.ndarray, ...]:
    """Suffixes p of texts doc with anchors a, in order -> blocks: text, first and last suffix, anchor, start of the
    shared tokens, and the three keys. size: the suffixes of a block at most, a power of two."""
    j = (a - p) >> (size.bit_length() - 1)
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (j[1:] != j[:-1]) | (doc[1:] != doc[:-1]) | (p[1:] != p[:-1] + 1))))
    a, j, doc, first, final = a[new], j[new], doc[new], p[new], p[np.concatenate((new[1:], [len(p)])) - 1]
    core = a - size * j
    prints = ta.Prints(data)
    tok0 = prints.of(core, core + length - size + 1) + j.astype(_U)
    tok1 = prints.of(first, final + length) + ta.mix64((a - first).astype(_U))
    return doc, first, final, a, core, leads(data, core), tok0.view(np.int64), tok1.view(np.int64)


def all_suffixes(data: np.ndarray, offs: np.ndarray, length: int, unit: Unit) -> tuple[np.ndarray, ...]:
    """Every suffix of at least `length` tokens: place, anchor, text."""
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, z
    anchor = anchors(gram_hashes(data, unit), length - unit.gram + 1)
    n = np.maximum(np.diff(offs) - length + 1, 0)
    p = np.repeat(offs[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return p, anchor[p], np.repeat(np.arange(len(n)), n)


def _batches(cols: list[np.ndarray], names: list[str], types: list, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(cols[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + size], t) for c, t in zip(cols, types)], names)


_TYPES = [*[pa.int64()] * 5, pa.int32(), pa.int32()]


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)


def _once(doc: np.ndarray, tok0: np.ndarray, tok1: np.ndarray) -> np.ndarray:
    """The first of the rows of a text that agree in both fingerprints."""
    order = np.lexsort((tok1, tok0, doc))
    d, x, y = doc[order], tok0[order], tok1[order]
    return np.sort(order[np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))])


def _block_rows(length: int, unit: Unit) -> Callable:
    """k0, k1, text -> the blocks of each text; of words, each block once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.chunks(batches, limit=1 << 17):
            k0, k1 = _keys(batch)
            data, offs = tokens(batch.column(2), unit)
            p, a, doc = all_suffixes(data, offs, length, unit)
            if len(p):
                doc, first, final, a, _, *toks = blocks_of(data, p, a, doc, length, unit.block)
                cols = [*toks, k0[doc], k1[doc], first - offs[doc], (a - first) * SPAN + final - first + 1]
                if unit.words:
                    at = _once(doc, *toks[1:])
                    cols = [c[at] for c in cols]
                yield from _batches(cols, NAMES, _TYPES)

    return run


def _opened(batch: pa.RecordBatch, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of the open blocks of a batch (fourth column: pos and span), in order: place, anchor, text."""
    spans = batch.column(3)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(spans.offsets)))
    flat = spans.flatten()
    pos, span = np.asarray(flat.field(0), np.int64) + offs[doc], np.asarray(flat.field(1), np.int64)
    order = np.argsort(pos, kind="stable")
    pos, span, doc = pos[order], span[order], doc[order]
    n = span % SPAN
    p = np.repeat(pos - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return p, np.repeat(pos + span // SPAN, n), np.repeat(doc, n)


def _suffix_rows(length: int, unit: Unit) -> Callable:
    """k0, k1, text and open blocks -> the suffixes of these blocks, each different one once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.chunks(batches):
            k0, k1 = _keys(batch)
            data, offs = tokens(batch.column(2), unit)
            p, _, doc = _opened(batch, offs)
            if len(p):
                tok0 = ta.Prints(data).of(p, p + length)
                tok1 = ta.Prints(ta.mix64(data + _U(1))).of(p, p + length)
                at = _once(doc, tok0, tok1)
                p, doc = p[at], doc[at]
                yield from _batches([leads(data, p), tok0[at].view(np.int64), tok1[at].view(np.int64), k0[doc], k1[doc], p - offs[doc], np.ones(len(p), np.int32)], NAMES, _TYPES)

    return run


PARTS = ROW + ", left binary, right binary"


def _part_rows(length: int) -> Callable:
    """k0, k1, text and open blocks of bytes -> the parts of these blocks, with the bytes on either side of what the
    suffixes of a part share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.chunks(batches, limit=1 << 20):
            k0, k1 = _keys(batch)
            data, offs = tokens(batch.column(2), BYTES)
            p, a, doc = _opened(batch, offs)
            if not len(p):
                continue
            doc, first, final, a, core, *toks = blocks_of(data, p, a, doc, length, PART)
            end = core + length - PART + 1
            raw = data.tobytes()
            left = [raw[x:y] for x, y in zip(first.tolist(), core.tolist())]
            right = [raw[x:y] for x, y in zip(end.tolist(), (final + length).tolist())]
            cols = [*toks, k0[doc], k1[doc], first - offs[doc], (a - first) * SPAN + final - first + 1]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, _TYPES)), pa.array(left, pa.binary()), pa.array(right, pa.binary())], [*NAMES, "left", "right"])

    return run


def _part_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a bucket of parts and compares, within each run of equal shared bytes, suffix by suffix: SETTLED spans.
    The suffixes of the first and the last run are told one by one (EDGE), since their runs may go on elsewhere."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    del parts
    order = multikey_quicksort([np.asarray(t.column(k)) for k in range(3)])
    t = t.take(pa.array(order)).combine_chunks()
    lead, tok0, _, k0, k1, pos, span = (np.asarray(t.column(k)) for k in range(7))
    run = np.cumsum(np.concatenate(([False], (tok0[1:] != tok0[:-1]) | (lead[1:] != lead[:-1]))))
    alone = np.bincount(run)[run] == 1
    edge = (run == 0) | (run == run[-1])
    keep = np.flatnonzero(~alone | edge)
    left, right = (t.column(k).take(pa.array(keep)).combine_chunks() for k in (7, 8))
    data, offs = ta.as_bytes(pa.chunked_array([left, right]).combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    prints, m, n = ta.Prints(data), len(keep), span[keep] % SPAN
    row = np.repeat(np.arange(m), n)
    k = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    x = (span[keep] // SPAN)[row] % PART - k  # bytes of the suffix before the shared ones
    own = prints.of(offs[1:][row] - x, offs[1:][row])
    far = offs[m:][row]
    tok1 = ta.mix64(own * _U(3) + prints.of(far, far + PART - 1 - x) + x.astype(_U))
    twice, _ = ta.repeats(ta.mix64(tok1 ^ ta.mix64(run[keep][row].astype(_U))))
    begin = np.flatnonzero(twice & ~(np.concatenate(([False], twice[:-1])) & (k > 0)))
    stop = np.flatnonzero(twice & ~(np.concatenate((twice[1:], [False])) & (np.concatenate((k[1:], [0])) > 0))) if len(k) else begin
    at = keep[row[begin]]
    names, types = ["kind", *NAMES], [pa.int32(), *_TYPES]
    z = np.zeros(len(at), np.int64)
    yield from _batches([np.full(len(at), SETTLED, np.int32), z, z, z, k0[at], k1[at], pos[at] + k[begin], stop - begin + 1], names, types)
    out = np.flatnonzero(edge[keep][row])
    at = keep[row[out]]
    yield from _batches([np.full(len(at), EDGE, np.int32), lead[at], tok0[at], tok1[out].view(np.int64), k0[at], k1[at], pos[at] + k[out], np.ones(len(at), np.int32)], names, types)


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a bucket and tells for its rows what their neighbours tell: SETTLED rows agree with another in all keys,
    OPEN rows stand for those that agree with others in what they share only, EDGE rows are the first and the last."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    cols = [np.concatenate([np.asarray(b.column(k)) for b in parts]) for k in range(7)]
    del parts
    order = multikey_quicksort(cols[:3])
    cols = [c[order] for c in cols]
    same0 = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
    same1 = same0 & (cols[2][1:] == cols[2][:-1])
    no = np.zeros(1, bool)
    before0 = np.concatenate((no, same0))
    before1, after1 = np.concatenate((no, same1)), np.concatenate((same1, no))
    # a run of equal shared tokens is mixed if its blocks differ
    run = np.cumsum(~before0) - 1
    mixed = np.bincount(run, before0 & ~before1, minlength=run[-1] + 1)[run] > 0
    for kind, keep in ((SETTLED, before1 | after1), (OPEN, mixed & ~before1)):
        at = np.flatnonzero(keep)
        yield from _batches([np.full(len(at), kind, np.int32), *(c[at] for c in cols)], ["kind", *NAMES], [pa.int32(), *_TYPES])
    at = np.array([0, len(run) - 1])[: min(2, len(run))]
    yield from _batches([np.full(len(at), EDGE, np.int32), *(c[at] for c in cols)], ["kind", *NAMES], [pa.int32(), *_TYPES])


def bucket_of(cols: list[np.ndarray], split: list[np.ndarray]) -> np.ndarray:
    """The number of splitters that aren't above each row, by binary search in all columns."""
    lo, hi = np.zeros(len(cols[0]), np.int32), np.full(len(cols[0]), len(split[0]), np.int32)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, len(split[0]) - 1)
        below, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for s, c in zip(split, cols):
            below |= same & (s[at] < c)
            same &= s[at] == c
        up = below | same
        lo, hi = np.where(open_ & up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


def _sampler(rows: Callable, most: int) -> Callable:
    """At most so many of the rows of a task, by a hash, and how many each of them stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = 0, np.zeros((len(BY), 0), np.int64)
        for b in rows(batches):
            seen += b.num_rows
            held = np.concatenate((held, [np.asarray(b.column(k), np.int64) for k in range(len(BY))]), axis=1)
            if held.shape[1] > most:
                own = held.astype(_U)
                h = ta.mix64(own[2] ^ ta.mix64(own[4] ^ ta.mix64(own[5])))
                held = held[:, np.argpartition(h, most)[:most]]
        if seen:
            yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array(np.full(held.shape[1], seen / held.shape[1]))], [*BY, "weight"])

    return run


def splitters(sample: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The n - 1 rows (columns of sample) that cut the sorted sample into n parts of equal weight."""
    order = np.lexsort(sample[::-1])
    upto = np.cumsum(weight[order])
    return sample[:, order[np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)]] if len(order) else sample


def in_ranges(docs: DataFrame, texts: Callable[[DataFrame], DataFrame], rows: Callable, schema: str, sort: Callable) -> DataFrame:
    """The rows that `rows` makes of texts(docs), dealt into ranges of BY by sampled splitters, each range through sort."""
    n, spark = partitions(docs), docs.sparkSession
    each = max(1, math.ceil(3 * min(SPLIT_ROWS * n, MAX_SPLIT_ROWS) / max(n, docs.rdd.getNumPartitions())))
    *sample, weight = texts(docs.sample(SAMPLED, seed=7)).mapInArrow(_sampler(rows, each), ", ".join(f"{c} long" for c in BY) + ", weight double").toArrow().columns
    split = spark.sparkContext.broadcast(splitters(np.array([np.asarray(c, np.int64) for c in sample]), np.asarray(weight), n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            at = bucket_of([np.asarray(b.column(k), np.int64) for k in range(len(BY))], list(split.value))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "bucket"])

    return texts(docs).mapInArrow(deal, f"{schema}, bucket int").repartitionById(n, "bucket").drop("bucket").mapInArrow(sort, "kind int, " + ROW)


def neighbours(sorted_: DataFrame) -> DataFrame:
    """kind (SETTLED or OPEN), k0, k1, pos, span of the rows that agree with others, from sorted buckets. A row may be
    told twice."""
    sorted_ = stored(sorted_)
    # across boundaries: two rows of each bucket
    edges = sorted_.filter(F.col("kind") == EDGE).distinct()
    own = ["k0", "k1", "pos", "span"]
    held = edges.groupBy("lead", "tok0", "tok1").agg(F.count("*").alias("c1"), F.collect_list(F.struct(*own)).alias("rows"))
    met = held.groupBy("lead", "tok0").agg(F.sum("c1").alias("c0"), F.collect_list(F.struct("c1", "rows")).alias("held")).filter("c0 > 1")
    met = met.select(F.explode("held").alias("x")).select("x.c1", F.explode("x.rows").alias("r")).select("c1", "r.*")
    across = met.select(F.explode(F.when(F.col("c1") > 1, F.array(F.lit(SETTLED), F.lit(OPEN))).otherwise(F.array(F.lit(OPEN)))).alias("kind"), *own)
    return sorted_.filter(F.col("kind") != EDGE).select("kind", *own).unionByName(across)


def keyed(docs: DataFrame) -> DataFrame:
    """k0, k1 and text of each row of docs: 128 bits that tell rows apart by text and doc_id. Equal rows share them, and
    then share all results."""
    own = F.coalesce("text", F.lit(""))
    return docs.withColumns({"k0": F.xxhash64(own), "k1": F.xxhash64(F.lit(1), own, F.col("doc_id"))})


def _with_open(docs: DataFrame, found: DataFrame) -> DataFrame:
    """k0, k1, text, open: the texts that have open blocks, equal rows as often as docs has them."""
    opened = found.filter(F.col("kind") == OPEN).groupBy("k0", "k1").agg(F.collect_set(F.struct("pos", "span")).alias("open"))
    return docs.join(opened, ["k0", "k1"]).select("k0", "k1", "text", "open")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """k0, k1, pos, n: the starts (n successive ones from pos) of strings of `length` bytes that start elsewhere, too.

    docs: k0, k1, text.
    """
    if length <= BYTES.block + BYTES.gram:
        raise ValueError(f"strings of more than {BYTES.block + BYTES.gram} bytes only")
    found = neighbours(in_ranges(docs, lambda d: d, _block_rows(length, BYTES), ROW, _bucket))
    parts = stored(in_ranges(docs, lambda d: _with_open(d, found), _part_rows(length), PARTS, _part_bucket))
    settled = F.col("kind") == SETTLED
    edges = parts.filter(F.col("kind") == EDGE).drop("kind")
    across = neighbours(edges.repartitionByRange(partitions(docs), *BY).mapInArrow(_bucket, "kind int, " + ROW))
    spans = found.filter(settled).select("k0", "k1", "pos", (F.col("span") % SPAN).alias("n"))
    for more in (parts, across):
        spans = spans.unionByName(more.filter(settled).select("k0", "k1", "pos", F.col("span").alias("n")))
    return spans


def shared_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """k0, k1 of the texts of which some `words` successive words stand in another row of docs (k0, k1, text), too. A key
    may be told more than once; passages that only repeat within a text don't count."""
    if words <= WORDS.block + WORDS.gram:
        raise ValueError(f"passages of more than {WORDS.block + WORDS.gram} words only")
    found = neighbours(in_ranges(docs, lambda d: d, _block_rows(words, WORDS), ROW, _bucket))
    single = neighbours(in_ranges(docs, lambda d: _with_open(d, found), _suffix_rows(words, WORDS), ROW, _bucket))
    return found.unionByName(single).filter(F.col("kind") == SETTLED).select("k0", "k1")


def _cut_out(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(4)]
            for x, spans in zip(batch.column(1), batch.column(2)):
                raw = (x.as_py() or "").encode()
                kept, removed, n = _without(raw, spans, length)
                for o, v in zip(out, (len(raw), removed, n, hashlib.sha256(kept).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string()), batch.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"])

    return run


def _without(raw: bytes, spans: pa.Scalar, length: int) -> tuple[bytes, int, int]:
    """The bytes that no span covers, the number of those it removes, and of the maximal runs they form."""
    if not spans.is_valid or not len(spans.values):
        return raw, 0, 0
    pos, n = np.asarray(spans.values.field(0), np.int64), np.asarray(spans.values.field(1), np.int64)
    depth = np.bincount(pos, minlength=len(raw) + 1)[: len(raw) + 1] - np.bincount(np.minimum(pos + n - 1 + length, len(raw)), minlength=len(raw) + 1)
    gone = np.cumsum(depth)[: len(raw)] > 0
    runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(docs: DataFrame, length: int = 400, words: int = 50) -> DataFrame:
    """Sizes, removed bytes and the digest of what is left of each text of docs (doc_id, text), and shares_passage: 1 if
    some `words` successive words of it stand in another row, too (they may be shorter than `length` bytes), or else 0.

    A null text is empty; texts of fewer than `length` bytes lose nothing. Repeated rows are documents of their own, so
    that all of them lose what they share. Rows that share a doc_id, or have none, are told apart by their text.
    """
    own = keyed(docs.select("doc_id", "text"))
    bare = own.select("k0", "k1", "text")
    spans = repeated_spans(bare, length).select("k0", "k1", F.struct("pos", "n").alias("span"), F.lit(0).alias("shared"))
    told = shared_passages(bare, words).distinct().select("k0", "k1", F.lit(None).cast(spans.schema["span"].dataType).alias("span"), F.lit(1).alias("shared"))
    one = spans.unionByName(told).groupBy("k0", "k1").agg(F.collect_list("span").alias("spans"), F.max("shared").alias("shared"))
    met = own.join(one, ["k0", "k1"], "left").select("doc_id", "text", "spans", F.coalesce("shared", F.lit(0)).alias("shares_passage"))
    return met.mapInArrow(_cut_out(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage int")
