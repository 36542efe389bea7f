"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. A key hashes to a cell; the cell belongs to the shard of the next
virtual node clockwise. Only the count of keys per cell decides how full each shard gets, so the walk of the
overflow around the ring works on at most RING_CELLS counts, whatever the size of the table. Each row then finds
its shard from its cell and its rank inside the cell.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Cells of the ring: bounds what reaches the driver and what is broadcast.
RING_CELLS = 1 << 14
#: A cell of more than 1 / HOT of all rows, and of more than LARGE, is ranked in HOT parts.
HOT, LARGE = 256, 10_000


def ring_nodes(n_shards: int, vnodes: int = 128, cells: int = RING_CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order. The nodes of a shard don't depend on the other shards."""
    taken: dict[int, tuple[str, int]] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            h = hashlib.md5(f"node:{shard}:{v}".encode()).hexdigest()
            cell = int(h[:8], 16) % cells
            taken[cell] = min(taken.get(cell, (h, shard)), (h, shard))
    return sorted((cell, shard) for cell, (_, shard) in taken.items())


def place(counts: dict[int, int], n_shards: int, vnodes: int = 128, cells: int = RING_CELLS, slack: float = 0.0) -> list[tuple[int, int, int, int, int, int]]:
    """Walk the ring once for the keys that stay at home and once for those that overflow.

    Returns (cell, home, lo, hi, shard, slot): the keys of rank lo < rank <= hi in the cell go to the shard, the first
    of them to that slot. A shard holds at most (1 + slack) times its share; without slack the loads differ by one at most.
    """
    nodes = ring_nodes(n_shards, vnodes, cells)
    at = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [int((total // n_shards + (s < total % n_shards)) * (1 + slack)) for s in range(n_shards)]
    filled, out, over = [0] * n_shards, [], []

    def take(cell: int, home: int, lo: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - filled[shard])
        if n > 0:
            out.append((cell, home, lo, lo + n, shard, filled[shard]))
            filled[shard] += n
        return max(n, 0)

    for cell in sorted(counts):
        k = bisect_left(at, cell) % len(nodes)
        home = nodes[k][1]
        got = take(cell, home, 0, counts[cell], home)
        if got < counts[cell]:
            over.append((cell, home, k, got))
    for cell, home, k, got in over:
        for step in range(1, len(nodes)):
            if got == counts[cell]:
                break
            got += take(cell, home, got, counts[cell] - got, nodes[(k + step) % len(nodes)][1])
        for shard in range(n_shards):  # a shard whose nodes all lost their cell
            got += take(cell, home, got, counts[cell] - got, shard)
    return out


def shard_rows(df: DataFrame, key: Column, n_shards: int, tie: list[Column] = (), vnodes: int = 128, slack: float = 0.0) -> DataFrame:
    """Adds home_shard, shard and slot (gapless from 0 in each shard) to the rows of df.

    Nulls share one key. Rows that agree in key and tie share a cell and are told apart by their rank alone, so equal
    rows are interchangeable. A key of very many rows is ranked in parts by its ties, and very many rows equal in both in
    parts by their places (df is written then). An empty table gives an empty table. The added columns replace columns of the same name.
    """
    spark = df.sparkSession
    h = F.xxhash64(F.lit("ring"), key.cast("string"))
    df = df.withColumns({"_ring_hash": h, "_ring_cell": F.pmod(h, F.lit(RING_CELLS)).cast("int")})
    counts = {r[0]: r[1] for r in df.groupBy("_ring_cell").count().collect()}  # RING_CELLS rows at most
    most = max(sum(counts.values()) // HOT, LARGE)
    hot = [c for c, n in counts.items() if n > most]  # fewer than HOT
    part = F.lit(0)
    if hot:
        tied = F.xxhash64(F.lit("part"), key.cast("string"), *tie)
        part = F.when(F.col("_ring_cell").isin(hot), F.pmod(tied, F.lit(HOT)).cast("int")).otherwise(0)
        same = sorted(r[0] for r in df.filter(F.col("_ring_cell").isin(hot)).groupBy(tied.alias("_tied")).count().filter(F.col("count") > most).collect())  # fewer than HOT
        if same:  # equal rows: any of them may come first, so that each is dealt by its place, which must stay as it is
            df = cut(df.withColumn("_ring_part", F.pmod(F.monotonically_increasing_id(), F.lit(HOT)).cast("int")))
            own = F.array_position(F.array(*map(F.lit, same)), tied).cast("int")
            part = F.when(F.col("_ring_cell").isin(hot) & (own > 0), own * HOT + F.col("_ring_part")).otherwise(part)
    df = df.withColumn("_ring_part", part)
    finer: dict[int, list[tuple[int, int, int]]] = {}  # part, rows before it, its rows; fewer than 2 * HOT * HOT in all
    for cell, p, n in sorted(df.filter(F.col("_ring_cell").isin(hot)).groupBy("_ring_cell", "_ring_part").count().collect()) if hot else []:
        own = finer.setdefault(cell, [])
        own.append((p, sum(own[-1][1:]) if own else 0, n))
    rows = []
    for cell, home, lo, hi, shard, slot in place(counts, n_shards, vnodes, slack=slack):
        for p, before, n in finer.get(cell, [(0, 0, counts[cell])]):
            a, b = max(lo, before), min(hi, before + n)
            if a < b:
                rows.append((cell, p, home, a - before, b - before, shard, slot + a - lo))
    parts = spark.createDataFrame(rows, "_cell int, _part int, home_shard int, _lo long, _hi long, shard int, _slot long")
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("_ring_cell", "_ring_part").orderBy("_ring_hash", key, *tie)))
    met = ranked.drop("home_shard", "shard", "slot").join(F.broadcast(parts), (F.col("_ring_cell") == F.col("_cell")) & (F.col("_ring_part") == F.col("_part")) & (F.col("_rank") > F.col("_lo")) & (F.col("_rank") <= F.col("_hi")))
    return met.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_lo") - 1).drop("_ring_hash", "_ring_cell", "_ring_part", "_rank", "_cell", "_part", "_lo", "_hi", "_slot")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Documents onto shards by row count: the counts of any two shards differ by one at most.

    A null text has size 1 and the crc32 of the empty string; rows with equal doc_id are ordered by crc and size.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(rows, F.col("doc_id"), n_shards, [F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
