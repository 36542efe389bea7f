"""Readers, intake validation and the small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

ALLOWED = ("jpg", "jpeg", "png", "pdf", "tiff", "bmp")
MAX_BYTES = 10 * 1024 * 1024

# Canonical provider, display label, confidence where none is reported, price of a page in dollars.
PROVIDERS = (
    ("tesseract", "Tesseract (Local)", None, 0.0),
    ("google-vision", "Google Vision", 95.0, 0.0015),
    ("google-documentai", "Google Document AI", 92.0, 0.01),
    ("azure-vision", "Azure Vision", 90.0, 0.0015),
    ("azure-form-recognizer", "Azure Form Recognizer", 90.0, 0.01),
    ("aws-textract", "AWS Textract", 85.0, 0.0015),
    ("abbyy", "ABBYY FineReader", 90.0, 0.01),
)
ALIASES = {"google": "google-vision", "azure": "azure-vision"}
BEST = ("best", "multi")
ZERO_IF_EMPTY = ("google-vision", "google-documentai", "azure-vision")  # their confidence in an empty text


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.FORMS)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.PROFILES)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.DOCUMENTS)


def read_attempts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.ATTEMPTS, fmt)


def file_ext(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")


def validate_intake(files: DataFrame) -> DataFrame:
    """Adds accepted and reason to a manifest (filename, size)."""
    ok = F.col("filename").contains(".") & file_ext(F.col("filename")).isin(*ALLOWED)
    reason = F.when(~F.coalesce(ok, F.lit(False)), "extension").when(F.col("size") > MAX_BYTES, "size")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def provider_dim(spark: SparkSession, enabled: list[str] | None = None) -> DataFrame:
    """name (canonical, alias or best-of), canonical, label, default_confidence, price, zero_if_empty. Best-of needs two providers."""
    own = [p for p in PROVIDERS if enabled is None or p[0] in enabled]
    own = [(*p, p[0] in ZERO_IF_EMPTY) for p in own]
    rows = [(p[0], *p) for p in own] + [(a, *p) for a, c in ALIASES.items() for p in own if p[0] == c]
    if len(own) >= 2:
        rows += [(b, "best", "Automatic (Best)", None, None, False) for b in BEST]
    return spark.createDataFrame(rows, "name string, canonical string, label string, default_confidence double, price double, zero_if_empty boolean")


def category_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in schemas.CATEGORIES], "document_category string")


def missing_providers(requested: DataFrame, dim: DataFrame) -> DataFrame:
    return requested.join(F.broadcast(dim), requested.provider == dim.name, "left_anti")


def discover_samples(labels: DataFrame, files: DataFrame, only_ids: list[str] | None = None, limit: int | None = None, missing: str = "null") -> DataFrame:
    """Labels (label, file, filename, ...) with the path of their raw file: by name if one is given, else by stem. Of
    several files of one name the least path is taken.

    missing: "null" gives a label without a file path NULL, "error" fails the query that reads it.
    """
    own = labels.withColumn("sample_id", file_stem(F.col("label"))).withColumn("_named", F.coalesce(F.nullif("file", F.lit("")), F.nullif("filename", F.lit(""))))
    if only_ids:
        own = own.filter(F.lower("sample_id").isin(*[i.lower() for i in only_ids]))
    by_name = files.groupBy(F.col("filename").alias("_f")).agg(F.min("path").alias("_p1"))
    by_stem = files.groupBy(file_stem(F.col("filename")).alias("_s")).agg(F.min("path").alias("_p2"))
    met = own.join(by_name, F.col("_named") == F.col("_f"), "left").join(by_stem, F.col("_named").isNull() & (F.col("sample_id") == F.col("_s")), "left")
    found = F.coalesce("_p1", "_p2")
    if missing == "error":
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no raw file for sample "), "sample_id")).cast("string"))
    met = met.withColumn("path", found).drop("_named", "_f", "_s", "_p1", "_p2").orderBy("label")
    return met.limit(limit) if limit is not None else met
