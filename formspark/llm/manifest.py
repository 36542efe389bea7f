"""A Merkle manifest of a table: a tree of digests a group, and one over the groups' roots.

Leaves are numbered within their group by a distributed sort. Aligned blocks of 8^4 leaves make the lowest four levels of a
group, a task each; the roots of blocks are the leaves of the next stage, until one is left. What lies above a block, its
path to the root, is the same for all its leaves and comes back down to it once. A tampered leaf begins a version of the
tree that shares every node but the leaf's ancestors: those in its block are copied there, those above are continued from the
block's path in the same task, so that no upper node ever meets all versions.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Children of a node, and levels of a block, which so has up to 8^4 leaves.
FANOUT, HEIGHT = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """Its UTF-8 byte count, a colon and the value; - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def H(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels(n: int, height: int) -> int:
    """Levels that a block of a group of n nodes has above its own."""
    k = 0
    while k < height and n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


class Tree:
    """The levels of a block, from its leaves up."""

    def __init__(self, leaves: list[str], height: int):
        self.levels = [leaves]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([H(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> list[tuple[int, list[str]]]:
        """For each level the place among the run's nodes, and the others of the run."""
        out = []
        for level in self.levels[:-1]:
            k = i % FANOUT
            run = level[i - k : i - k + FANOUT]
            out.append((k, run[:k] + run[k + 1 :]))
            i //= FANOUT
        return out


def copies(digest: str, path: list[tuple[int, list[str]]]) -> list[str]:
    """The ancestors of a leaf whose digest is another now: all that a version copies; the last is its root."""
    out = []
    for k, others in path:
        digest = H([*others[:k], digest, *others[k:]])
        out.append(digest)
    return out


def packed(path: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes((k, len(others))) + bytes.fromhex("".join(others)) for k, others in path)


def unpacked(path: bytes) -> list[tuple[int, list[str]]]:
    out, i = [], 0
    while i < len(path):
        k, n = path[i], path[i + 1]
        others = path[i + 2 : i + 2 + 32 * n].hex()
        out.append((k, [others[j : j + 64] for j in range(0, len(others), 64)]))
        i += 2 + 32 * n
    return out


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with i, the place of a row within its group by order, from 0 on, and n, the group's size.

    Ranges are sorted where they lie, and written, since a second sort might cut them elsewhere. A group has as many rows in
    the sums as it has ranges. Equal rows may come in any order.
    """
    keys = [*group, *order]
    ranged = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    dealt = ranged.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sums = dealt.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    part = ", ".join(group) or "0"
    sums = sums.select(*group, "_range", F.expr(f"sum(_n) OVER (PARTITION BY {part} ORDER BY _range) - _n - _first").alias("_shift"), F.expr(f"sum(_n) OVER (PARTITION BY {part})").alias("n"))
    return dealt.join(sums, [*group, "_range"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def blocks(nodes: DataFrame, height: int, *kept: str) -> DataFrame:
    """nodes (g, i, n, d, and what is kept of each) by aligned blocks, one row each: g, b, n and an array of nodes."""
    return nodes.groupBy("g", F.shiftright("i", 3 * height).alias("b")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "d", *kept))).alias("nodes"))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One block at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def parents(own: DataFrame, height: int) -> DataFrame:
    """The blocks' roots as nodes (g, i, n, d) of the next stage."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for r in _rows(part):
                k = levels(r["n"], height)
                out.append((r["g"], r["b"], -(-r["n"] // FANOUT**k), bytes.fromhex(Tree([x["d"].hex() for x in r["nodes"]], k).root)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["g", "i", "n", "d"])

    return stored(own.mapInArrow(run, "g string, i long, n long, d binary"))


def paths(own: DataFrame, height: int) -> DataFrame:
    """Of each node (g, i) of a block b its path to the block's root."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in _rows(part):
                t = Tree([x["d"].hex() for x in r["nodes"]], levels(r["n"], height))
                k = len(r["nodes"])
                cols = [[r["g"]] * k, [x["i"] for x in r["nodes"]], [r["b"]] * k, [packed(t.path(j)) for j in range(k)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["g", "i", "b", "path"])

    return own.mapInArrow(run, "g string, i long, b long, path binary")


def climb(nodes: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """The root (g, d) of each group of nodes (g, i, n, d), and each node's path to it (g, i, path)."""
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.select("g", "d"), nodes.select("g", "i", F.lit(b"").alias("path"))
    own = stored(blocks(nodes, height))
    roots, above = climb(parents(own, height), height)
    up = above.select("g", F.col("i").alias("b"), F.col("path").alias("rest"))
    return roots, paths(own, height).join(up, ["g", "b"]).select("g", "i", F.concat("path", "rest").alias("path"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", tampered: Column | None = None, changed: dict[str, Column] | None = None, keep: bool = False, height: int = HEIGHT) -> DataFrame:
    """Of each row: order's column, leaf, subroot (of its group), root (of all), proof_sha256 (of all siblings up to root),
    folded_root (recomputed from the leaf, or of a tampered row from that of its changed columns) and verified.

    tampered: which rows are; changed: what their columns hold then. keep adds siblings (array of arrays, a level each) and
    copied (the ancestors that the row's version copies; empty where it isn't tampered). Rows of one order and group go by
    their leaves. height: levels of a block. Null columns are a hyphen in the leaf, a null order comes first, null groups are one group and come first.
    Repeated rows are leaves each. Other columns of docs are left out. No rows give no rows.
    """
    tampered = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # never null, in the order of the groups
    own = docs.select(F.col(order).alias("o"), g.alias("g"), leaf_digest([F.col(c) for c in columns]).alias("d"), F.when(tampered, leaf_digest(other)).alias("t"))
    leaves = stored(own.withColumn("_row", F.monotonically_increasing_id()))  # tells equal rows apart, so that ranges can cut them
    whole = stored(blocks(numbered(leaves, ["g"], ["o", "d", "_row"]).drop("_row"), height, "o", "t"))
    subroots, up = climb(parents(whole, height), height)
    subroots = stored(subroots)
    seq = stored(numbered(subroots.withColumn("all", F.lit("")), ["all"], ["g"]))
    top, over = climb(seq.select(F.col("all").alias("g"), "i", "n", "d"), height)
    over = seq.select("g", "i").join(over.select("i", F.col("path").alias("rest")), "i").drop("i")
    top = top.select(F.col("d").alias("root"))
    ends = subroots.join(over, "g").crossJoin(F.broadcast(top)).select("g", F.col("d").alias("sub"), "rest", "root")
    last = up.join(ends, "g").select("g", F.col("i").alias("b"), F.col("path").alias("up"), "rest", "sub", "root")
    key = docs.schema[order].dataType
    out = f"{order} {key.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<array<string>>, copied array<string>" * keep

    def prove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                block = part.slice(k, 1)
                r = block.to_pylist()[0]
                tree = Tree([x["d"].hex() for x in r["nodes"]], levels(r["n"], height))
                rest, sub, root = unpacked(r["up"]) + unpacked(r["rest"]), r["sub"].hex(), r["root"].hex()
                rest_text = "".join(x for _, others in rest for x in others)
                cols: list[list] = [[] for _ in range(6)]
                for j, x in enumerate(r["nodes"]):
                    inner, leaf, is_t = tree.path(j), x["d"].hex(), x["t"] is not None
                    inside = copies(x["t"].hex() if is_t else leaf, inner)
                    start = inside[-1] if inside else (x["t"].hex() if is_t else leaf)
                    above = copies(start, rest)
                    folded = above[-1] if above else start
                    proof = hashlib.sha256(("".join([y for _, others in inner for y in others]) + rest_text).encode()).hexdigest()
                    for c, v in zip(cols, (leaf, proof, folded, folded == root, [others for _, others in inner + rest] if keep else None, inside + above if is_t else [])):
                        c.append(v)
                n = len(r["nodes"])
                o = block.column("nodes").flatten().field("o")
                arrays = [o, pa.array(cols[0]), pa.array([sub] * n), pa.array([root] * n), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3])]
                names = [order, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if keep:
                    arrays, names = [*arrays, pa.array(cols[4], pa.list_(pa.list_(pa.string()))), pa.array(cols[5], pa.list_(pa.string()))], [*names, "siblings", "copied"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return whole.join(last, ["g", "b"]).select("n", "nodes", "up", "rest", "sub", "root").mapInArrow(prove, out)


def letters_lowered(order: str = "doc_id") -> tuple[Column, dict[str, Column]]:
    """A tampering for tests of a manifest: rows whose id has a CRC-32 that 3 divides get lower-case letters a to z."""
    return F.crc32(F.col(order).cast("string").cast("binary")) % 3 == 0, {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}


def _sql(levels_of_group: int = 7, levels_of_all: int = 4) -> str:
    """op13's query for DuckDB, for groups of up to 8^7 rows and up to 8^4 groups."""

    def text(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def step(tree: str, k: int, g: str, i: str) -> list[str]:
        """The next level of a tree, its runs, and the walk of every row over it."""
        p = f"(({i} >> {3 * k}) & 7)"
        return [
            f"r_{tree}{k} AS (SELECT g, i >> 3 AS i, list(d ORDER BY i) AS ds, max(n) AS n FROM {tree}{k} GROUP BY ALL)",
            f"{tree}{k + 1} AS (SELECT g, i, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, count(*) OVER (PARTITION BY g) AS n FROM r_{tree}{k})",
            f"w_{tree}{k} AS (SELECT w.* REPLACE (w.proof || CASE WHEN r.n = 1 THEN '' ELSE array_to_string(r.ds[1:{p}], '') || array_to_string(r.ds[{p} + 2:], '') END AS proof, "
            f"CASE WHEN r.n = 1 THEN w.f ELSE sha256(array_to_string(r.ds[1:{p}], '') || w.f || array_to_string(r.ds[{p} + 2:], '')) END AS f) FROM w JOIN r_{tree}{k} r ON r.g = {g} AND r.i = {i} >> {3 * k + 3})",
        ]

    other = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    head, lower = " || ".join(text(c) for c in COLUMNS[:-1]), text(other)
    ctes = [
        f"t AS (SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({head} || {text('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256({head} || {lower}) END AS t FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM t)",
        "a0 AS (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM p)",
        "w0 AS (SELECT *, coalesce(t, leaf) AS f, '' AS proof FROM p)",
    ]
    last = "w0"
    for k in range(levels_of_group):
        ctes += [x.replace(" FROM w JOIN", f" FROM {last} w JOIN") for x in step("a", k, "w.g", "w.i")]
        last = f"w_a{k}"
    ctes += [
        f"s AS (SELECT g, d AS sub, row_number() OVER (ORDER BY g) - 1 AS q FROM a{levels_of_group})",
        "b0 AS (SELECT 0 AS g, q AS i, sub AS d, count(*) OVER () AS n FROM s)",
        f"v AS (SELECT w.*, s.sub, s.q FROM {last} w JOIN s ON w.g = s.g)",
    ]
    last = "v"
    for k in range(levels_of_all):
        ctes += [x.replace(" FROM w JOIN", f" FROM {last} w JOIN") for x in step("b", k, "0", "w.q")]
        last = f"w_b{k}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, sub AS subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM {last} CROSS JOIN (SELECT d FROM b{levels_of_all}) top"


SQL = _sql()
