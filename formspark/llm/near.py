"""Similarity join on word n-grams: MinHash banding for candidates, full n-gram sets for proof.

Equal texts are taken together first. Bands bring texts with a similar share of n-grams into buckets; inside a bucket
short sketches tell which of them may be linked, by a search that stops comparing once everything is connected, so that
a bucket of near copies yields as many rows as members. Texts that hang together this way form a cluster, and within a
cluster every pair is compared on its whole n-gram sets. Large buckets and clusters are cut into tiles, so that no task
holds a group of unlimited size; only counts of links and a spanning tree leave a tile, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import cut, free, partitions
from .graph import components, join_groups

_U = np.uint64
#: MinHash values whose low byte goes into the sketch.
SKETCH = 128
BUCKET_TILE, CLUSTER_TILE = 2048, 512
#: Texts are cut into n-grams in pieces of about so many bytes; pairs are counted in tables of about so many cells.
PIECE, CELLS = 1 << 18, 1 << 20


def banding(similarity: float, recall: float, most: int = 400) -> tuple[int, int]:
    """Bands and rows for the target recall at the similarity: as many rows as most hash values allow, since more rows
    mean fewer false candidates."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, 30):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def text_print(text: str) -> tuple[Column, Column]:
    """A 128-bit print of a text; null is the empty text."""
    own = F.coalesce(text, F.lit(""))
    return F.xxhash64(own), F.xxhash64(F.lit(1), own)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, with the text's index. A text of fewer than n words, but one at least, has
    one gram of all its words."""
    data, offs = ta.as_bytes(column)
    prints = ta.Prints(data)
    start, end, doc = ta.words(data, offs)
    w = prints.of(start, end)
    g, first = ta.grams(w, doc, n)
    g, d = g, doc[first]
    count = np.bincount(doc, minlength=len(column))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        for k in range(1, n):
            at = short[count[short] == k]
            if len(at):
                lo = np.searchsorted(doc, at)
                h = np.zeros(len(at), _U)
                for i in range(k):
                    h = ta.mix64(h + w[lo + i] + _U(i + 1))
                g, d = np.concatenate((g, h)), np.concatenate((d, at))
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]))) if len(g) else np.zeros(0, bool)
    return g[keep], d[keep]


def shingles_by_piece(rows: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles of the column text, worked out piece by piece; at least one row."""
    found, before = [], 0
    for piece in ta.chunks(rows.select(["text"]).to_batches(), limit=PIECE):
        g, d = shingles(piece.column(0), n)
        found.append((g, d + before))
        before += piece.num_rows
    return tuple(np.concatenate(x) for x in zip(*found))


def _sketches(n: int, bands: int, rows: int) -> Callable:
    factor = np.random.default_rng(7).integers(1, 2**63, max(bands * rows, SKETCH), dtype=np.int64).astype(_U) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.chunks(batches, limit=PIECE):
            g, d = shingles(batch.column(3), n)
            with_any, at = np.unique(d, return_index=True)
            least = np.empty((len(factor), len(with_any)), _U)
            if len(at):
                for k, f in enumerate(factor):
                    least[k] = np.minimum.reduceat(g * f, at)
            band = np.zeros((bands, len(with_any)), _U)
            for k in range(bands):
                h = np.full(len(with_any), k + 1, _U)
                for r in range(rows):
                    h = ta.mix64(h * _U(31) + least[k * rows + r])
                band[k] = h
            sketch = ta.mix64(least[:SKETCH]).astype(np.uint8)
            size = np.zeros(batch.num_rows, np.int64)
            size[with_any] = bands
            offsets = np.concatenate(([0], np.cumsum(size)))
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band.T.ravel().view(np.int64)))
            whole = [b""] * batch.num_rows
            for i, row in zip(with_any.tolist(), np.ascontiguousarray(sketch.T)):
                whole[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], keys, pa.array(whole, pa.binary())], ["doc_id", "t0", "t1", "bands", "sketch"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each text and id in a batch, so that repeated rows of one text don't meet in one task."""
    for batch in batches:
        first: dict[tuple, int] = {}
        for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
            first.setdefault(key, i)
        yield batch if len(first) == batch.num_rows else batch.take(pa.array(first.values(), pa.int64()))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(k[:, lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def spread(linked: Callable[[int, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The least member of each member's component. linked(i, others) tells which of the others i is linked to; members
    that are connected already are not compared again."""
    root, free = np.arange(n), np.arange(n)
    while len(free):
        first, free = free[0], free[1:]
        todo = [first]
        while todo and len(free):
            hit = linked(todo.pop(), free)
            new = free[hit]
            root[new] = first
            todo += new.tolist()
            free = free[~hit]
    return root


def _bucket_edges(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[], []]
        for t in groups(batches, ["band", "lo", "hi"]):
            node, at = np.unique(np.asarray(t.column("node")), return_index=True)
            if len(node) < 2:
                continue
            sketch = np.frombuffer(b"".join(t.column("sketch").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(node), SKETCH)
            root = spread(lambda i, others: (sketch[others] == sketch[i]).sum(axis=1) >= least * SKETCH, len(node))
            far = root != np.arange(len(node))
            out[0].append(node[far])
            out[1].append(node[root[far]])
            if len(out[0]) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])
                out = [[], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])

    return run


def overlaps(g: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Common grams of each pair of n texts."""
    _, ids, count = np.unique(g, return_inverse=True, return_counts=True)
    shared = count > 1
    ids, d = (np.cumsum(shared) - 1)[ids[shared[ids]]], d[shared[ids]]
    total = np.zeros((n, n), np.float32)
    width = min(max(64, CELLS // max(n, 1)), max(int(shared.sum()), 1))
    order = np.argsort(ids, kind="stable")
    ids, d = ids[order], d[order]
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(ids, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[d[a:b], ids[a:b] - lo] = 1
        total += m @ m.T
    return np.rint(total).astype(np.int64)


def _cluster_links(n: int, similarity: float) -> Callable:
    num, den = round(similarity * 1000), 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for t in groups(batches, ["cluster", "lo", "hi"]):
            node, at = np.unique(np.asarray(t.column("node")), return_index=True)
            rows = t.take(pa.array(at)).combine_chunks()
            g, d = shingles_by_piece(rows, n)
            size = np.bincount(d, minlength=len(node))
            both = overlaps(g, d, len(node))
            # both / (a + b - both) >= similarity, in whole numbers
            link = both * (den + num) >= num * (size[:, None] + size[None, :])
            link &= (both > 0) & ~np.eye(len(node), dtype=bool)
            chunk = np.asarray(rows.column("chunk"))
            if rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py():
                link &= chunk[:, None] != chunk[None, :]
            root = spread(lambda i, others: link[i, others], len(node))
            for o, v in zip(out, (node, node[root], link.sum(axis=1))):
                o.append(v)
            if len(out[0]) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["node", "root", "links"])
                out = [[], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["node", "root", "links"])

    return run


def tiles(rows: DataFrame, count: str, tile: int) -> DataFrame:
    """Adds chunk and one row for each tile (lo, hi) that the row is part of: pairs of chunks of about `tile` rows."""
    c = F.ceil(F.col(count) / tile).cast("int")
    rows = rows.withColumn("_c", c).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("_c")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return rows.withColumn("lo", F.least("chunk", "_other")).withColumn("hi", F.greatest("chunk", "_other")).drop("_c", "_other")


def _classes(docs: DataFrame, n: int, similarity: float, recall: float) -> DataFrame:
    """join_similar's columns and the print of the text (t0, t1). Nodes are texts, whatever ids their rows have; only at
    the end are classes named by an id."""
    bands, rows = banding(similarity, recall)
    n_out = partitions(docs)
    t0, t1 = text_print("text")
    own = docs.select("doc_id", t0.alias("t0"), t1.alias("t1"), "text")
    marked = cut(own.mapInArrow(ta.frees(_sketches(n, bands, rows)), "doc_id long, t0 long, t1 long, bands array<long>, sketch binary"))
    texts = marked.groupBy("t0", "t1").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()))
    keyed = texts.select("node", F.explode("bands").alias("band"))
    full = keyed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = tiles(join_groups(keyed, full, "band", "size", bands * texts.count()), "size", BUCKET_TILE).select("node", "band", "lo", "hi")
    sketched = members.join(texts.select("node", "sketch"), "node")
    slack = 5 * math.sqrt(similarity * (1 - similarity) / SKETCH)
    edges = sketched.repartition(n_out, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(ta.frees(_bucket_edges(similarity - slack)), "a long, b long")
    near = cut(components(edges))
    sizes = near.groupBy("root").agg(F.count("*").alias("size"))
    clusters = tiles(join_groups(near, sizes, "root", "size", near.count()).select("node", F.col("root").alias("cluster"), "size"), "size", CLUSTER_TILE).select("node", "cluster", "size", "chunk", "lo", "hi")
    # a text is read from a row with its least id
    of = ["t0", "t1", "id"]
    clusters = cut(clusters.join(texts.select("node", "t0", "t1", F.coalesce("least", F.lit(0)).alias("id")), "node"))
    read = own.select("t0", "t1", F.coalesce("doc_id", F.lit(0)).alias("id"), "text").mapInArrow(ta.frees(_once), "t0 long, t1 long, id long, text string")
    read = read.join(clusters.select(of).distinct(), of, "left_semi").dropDuplicates(of)
    tiled = read.join(clusters, of).select("node", "cluster", "chunk", "lo", "hi", "text").repartition(n_out, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    linked = cut(tiled.mapInArrow(ta.frees(_cluster_links(n, similarity)), "node long, root long, links long"))
    links = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = cut(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(texts.select("node", "least"), "node"))
    names = roots.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("size"))
    named = join_groups(roots.select("node", "root"), names, "root", "size", roots.count()).select("node", "class_id")
    known = texts.select("t0", "t1", "node", "least", "n_copies").join(links, "node", "left").join(named, "node", "left")
    known = cut(known.select("t0", "t1", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "least").alias("class_id")))
    rows = known.agg(F.sum("n_copies")).first()[0] or 0
    return join_groups(marked.select("doc_id", "t0", "t1"), known, ["t0", "t1"], "n_copies", rows)


def join_similar(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row of docs (doc_id, text).

    class_id: the least doc_id of those that links connect to it; n_links: the other texts whose n-gram sets have at
    least that Jaccard similarity with its own; n_copies: the rows with the very same text, itself included. A null text
    is an empty one. Texts without words are linked to nothing but their copies. A row gets the class of its text, so
    that rows that share a doc_id, or have none, may be of different classes; class_id is null only if all texts of the
    class lack a doc_id.
    """
    return _classes(docs, n, similarity, recall).select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows whose class has a lesser doc_id. Rows without doc_id stay; rows that share one and the text
    stay or go together. All columns of docs stay as they are."""
    other, a, b = free(docs, "_id", "_t0", "_t1")
    gone = _classes(docs, 5, 0.8, 0.999).filter("doc_id <> class_id").select(F.col("doc_id").alias(other), F.col("t0").alias(a), F.col("t1").alias(b)).distinct()
    t0, t1 = text_print("text")
    return docs.join(gone, (F.col("doc_id") == F.col(other)) & (t0 == F.col(a)) & (t1 == F.col(b)), "left_anti")
