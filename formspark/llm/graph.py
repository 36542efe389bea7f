"""Connected components of very large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Groups that are broadcast at most, whatever the size of the table.
HUBS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """rows joined to groups on key (a column or several); no task gets all rows of a large group.

    groups: one row a key; its column size: at least the rows of the key in rows; total: at least the sum of size.
    Groups of more than total / HUBS rows, which can't be more than HUBS, are broadcast; the rest are joined by key.
    """
    large = F.col(size) > total // HUBS
    hubs = groups.filter(large)
    met = rows.join(F.broadcast(hubs), key)
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(groups.filter(~large), key)
    return met.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge (a, b: long); root is the least node of its component.

    Alternates large and small stars: each node hands its larger neighbours to the least one it knows, then its smaller
    ones. The edges never grow in number, and the rounds grow with the logarithm of the size of a component. Loops and
    repeated edges don't matter. The edges of a node of very many are not brought together.
    """
    own = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while True:
        now = tuple(own.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == was:
            break
        was = now
        both = own.union(own.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = join_groups(both.filter("b > a"), least, "a", "n", 2 * now[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_groups(large, least, "a", "n", now[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        own = cut(small)
    return own.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(own.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
