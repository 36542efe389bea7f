"""Pages by number, however deep: a table kept in its order, with counts of its ranges."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

RANGE, PLACE = "_range", "_place"
#: Places share a block in all but these low bits; a page skips rows inside one block only.
BLOCK = 12


def write_ranked(df: DataFrame, path: str, by: str = "upload_date", facets: tuple[str, ...] = ("status",), rows: int = 1_000_000) -> str:
    """Writes df newest first by a column, then by id, in ranges of some `rows` rows, and returns the path.

    path/rows has a folder for each range, split at sampled keys, and path/counts the rows of each range by the facets, so
    that page_at finds any page without counting again. path/about comes last: a folder without it isn't read. Rows without
    the key come last, as in page_of; rows of one key and id stay together. It is a copy as of now: changes need a new folder.
    """
    if {RANGE, PLACE} & {c.lower() for c in df.columns} or "n" in facets:
        raise ValueError(f"{RANGE}, {PLACE} and a facet n are names of its own")
    spark, order = df.sparkSession, [F.desc(by), F.desc("id")]
    ranges = df.repartitionByRange(max(1, math.ceil(df.count() / rows)), *order).withColumn(RANGE, F.spark_partition_id())
    # the sort begins with the range, which is one value in a task, so that the writer doesn't sort again
    placed = ranges.sortWithinPartitions(RANGE, *order).withColumn(PLACE, F.monotonically_increasing_id())
    placed.write.partitionBy(RANGE).parquet(f"{path}/rows")
    about = (by, json.dumps(list(facets)), df.schema.json())
    counted(_read(spark, path, df.schema), RANGE, *facets).write.parquet(f"{path}/counts")
    spark.createDataFrame([about], "by string, facets string, schema string").coalesce(1).write.parquet(f"{path}/about")
    return path


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def _read(spark: SparkSession, path: str, schema: StructType, ranges: list[int] | None = None) -> DataFrame:
    """All ranges, with their number, or the folders of a few; only these are listed then."""
    own = StructType([*schema.fields, StructField(PLACE, LongType())])
    if ranges is None:
        return spark.read.schema(StructType([*own.fields, StructField(RANGE, IntegerType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if not ranges:
        return spark.createDataFrame([], own)
    return spark.read.schema(own).parquet(*[f"{path}/rows/{RANGE}={r}" for r in ranges])


def _overlap(counts: DataFrame, slot: str, skip: int, limit: int) -> tuple[list[int], int]:
    """The slots that hold rows skip to skip + limit, and how many of the rows skipped lie in the first; a slot has a row at
    least, so that no more than `limit` of them are brought to the driver."""
    until = F.sum("n").over(Window.orderBy(slot).rowsBetween(Window.unboundedPreceding, 0))
    hits = counts.select(slot, (until - F.col("n")).alias("before"), until.alias("until")).filter((F.col("before") < skip + limit) & (F.col("until") > skip)).collect()
    hits.sort(key=lambda r: r[slot])
    return [r[slot] for r in hits], skip - hits[0].before if hits else 0


def page_at(spark: SparkSession, path: str, skip: int = 0, limit: int = 100, where: Column | None = None, most: int = 1000, **facets: object) -> DataFrame:
    """Rows skip to skip + limit of a table that write_ranked wrote, as page_of gives them, with all of its columns.

    facets: wanted values of the facets (None: NULL), whose counts are kept. where: any other condition; the rows that meet
    it are counted first, by range, without a sort. Then the ranges of the page are read, mostly one, and of these the blocks
    that the page lies in.
    """
    about = spark.read.parquet(f"{path}/about").first()
    known, schema = json.loads(about.facets), StructType.fromJson(json.loads(about.schema))
    if set(facets) - set(known):
        raise ValueError(f"no counts by {sorted(set(facets) - set(known))}")
    limit = max(0, min(limit, most))
    meets = F.lit(True) if where is None else where
    for name, value in facets.items():
        meets = meets & F.col(name).eqNullSafe(F.lit(value))
    if where is None:
        kept = spark.read.parquet(f"{path}/counts")
        counts = kept.filter(meets).groupBy(RANGE).agg(F.sum("n").alias("n"))
    else:
        counts = counted(_read(spark, path, schema).filter(meets), RANGE)
    ranges, skip = _overlap(counts, RANGE, skip, limit)
    rows = _read(spark, path, schema, ranges).filter(meets)
    blocks, skip = _overlap(counted(rows.select(F.shiftright(PLACE, BLOCK).alias("block")), "block"), "block", skip, limit)
    if blocks:
        rows = rows.filter(F.col(PLACE).between(blocks[0] << BLOCK, (blocks[-1] + 1 << BLOCK) - 1))
    return rows.orderBy(PLACE).offset(skip).limit(limit).drop(PLACE)
