"""A snapshot of forms that takes changes without being rewritten.

path/base/version=<n>: the forms as of the last folding, with the time of each patched field. path/changes/version=<n>:
what each batch since then holds, folded, a folder a batch. path/versions: a row for each base that is complete; readers take
the last, so that no half-written file is ever read. Folds may come twice and in any order (changes.merge_folds): a batch
that is applied again gives the same forms, and a change that is older than what a later one left loses, however late it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import FOLDED, apply_fold, fold_patches, merge_folds

TRACKED = ("patched_at", "named_at")


def _tracked(forms: DataFrame) -> DataFrame:
    return forms.withColumns({"patched_at": F.lit(None).cast("map<string,timestamp>"), "named_at": F.lit(None).cast("timestamp")})


def _publish(forms: DataFrame, path: str, version: int) -> None:
    """A base, an empty folder of changes, and last the row that makes both known."""
    spark = forms.sparkSession
    forms.write.mode("overwrite").parquet(f"{path}/base/version={version}")
    spark.createDataFrame([], FOLDED).write.mode("append").parquet(f"{path}/changes/version={version}/batch=none")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def write_snapshot(forms: DataFrame, path: str) -> None:
    """A new snapshot. forms have id, status, verified_date and any of the fields."""
    _publish(_tracked(forms), path, 0)


def version_of(spark: SparkSession, path: str) -> int:
    return spark.read.schema("version long").parquet(f"{path}/versions").agg(F.max("version")).first()[0]


def _whole(spark: SparkSession, path: str, version: int) -> DataFrame:
    base = spark.read.parquet(f"{path}/base/version={version}")
    folds = spark.read.schema(FOLDED).parquet(f"{path}/changes/version={version}")
    return apply_fold(base, merge_folds(folds.select("form_id", "field", "at", "value", "named_at")), insert=True)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The forms with all changes so far."""
    return _whole(spark, path, version_of(spark, path)).drop(*TRACKED)


def fold_snapshot(spark: SparkSession, path: str) -> int:
    """Brings the changes into a new base, whose version it gives. For the one writer of a snapshot: readers may go on, the
    old base and its changes stay until nobody reads them."""
    version = version_of(spark, path)
    _publish(_whole(spark, path, version), path, version + 1)
    return version + 1


def stream_upsert(changes: DataFrame, path: str, checkpoint: str, fold_every: int = 0) -> StreamingQuery:
    """Each micro-batch of patches (form_id, submitted_at, fields) adds one small folder of changes and rewrites no base;
    forms that aren't in the snapshot come in with the first patch. fold_every: after so many batches the changes are folded
    into a new base; 0 leaves that to fold_snapshot."""
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # another query's batches have other names

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fold_patches(batch).write.mode("overwrite").parquet(f"{path}/changes/version={version_of(spark, path)}/batch={own}-{n}")
        if fold_every and (n + 1) % fold_every == 0:
            fold_snapshot(spark, path)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
