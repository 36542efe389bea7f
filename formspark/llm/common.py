"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import cut, shared_dir, stored

__all__ = ["cut", "free", "partitions", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no columns of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"{n}_"
        taken.add(n.lower())
        out.append(n)
    return out
