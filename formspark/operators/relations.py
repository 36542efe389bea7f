"""Joins of forms, documents and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas


def _newest(docs: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """One row a key, with its rows newest first as an array."""
    row = F.struct(F.col("upload_date"), F.col("id"), *[F.col(n) for n in names if n not in ("upload_date", "id")])
    return docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(row), asc=False).alias("_rows"))


def with_documents(forms: DataFrame, docs: DataFrame, names: tuple[str, ...] = ("filename", "document_category", "file_size")) -> DataFrame:
    """forms with their documents, newest first, as an array. The documents of one form are one row: they must fit into a
    task (form_documents reads those of a form of any number)."""
    nested = _newest(docs, "form_id", names)
    out = forms.join(nested, F.col("id") == F.col("_key"), "left")
    return out.withColumn("documents", F.coalesce("_rows", F.array().cast(nested.schema["_rows"].dataType))).drop("_key", "_rows")


def form_detail(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """All parts of a form, in one order: its summary, what was extracted, every field, and its documents. Columns that
    forms lacks are NULL."""
    out, own = with_documents(forms, docs, schemas.DOCUMENT_VIEW), StructType.fromDDL(schemas.FORMS)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast(own[c].dataType).alias(c) for c in schemas.DETAIL])


def profile_counts(profiles: DataFrame, forms: DataFrame, docs: DataFrame) -> DataFrame:
    out = profiles
    for name, child in (("form_count", forms), ("document_count", docs)):
        n = child.groupBy(F.col("student_profile_id").alias("_k")).agg(F.count("*").alias(name))
        out = out.join(n, F.col("id") == F.col("_k"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("_k")
    return out


def profile_detail(profiles: DataFrame, forms: DataFrame, docs: DataFrame) -> DataFrame:
    out = profiles
    for name, child, names in (("forms", forms, ("filename", "status")), ("documents", docs, ("filename", "document_category"))):
        nested = _newest(child, "student_profile_id", names)
        out = out.join(nested, F.col("id") == F.col("_key"), "left").withColumn(name, F.coalesce("_rows", F.array().cast(nested.schema["_rows"].dataType))).drop("_key", "_rows")
    return out.withColumns({"form_count": F.size("forms"), "document_count": F.size("documents")})


def profile_forms(forms: DataFrame, profile_id: int) -> DataFrame:
    return forms.filter(F.col("student_profile_id") == profile_id).orderBy(F.desc("upload_date"), F.desc("id"))


def form_documents(docs: DataFrame, form_id: int) -> DataFrame:
    return docs.filter(F.col("form_id") == form_id).orderBy(F.desc("upload_date"), F.desc("id"))


def profile_documents(docs: DataFrame, profile_id: int) -> DataFrame:
    return docs.filter(F.col("student_profile_id") == profile_id).orderBy(F.desc("upload_date"), F.desc("id"))


def orphan_documents(docs: DataFrame, forms: DataFrame, profiles: DataFrame) -> DataFrame:
    """Documents that name a form or a profile that doesn't exist."""
    no_form = docs.filter(F.col("form_id").isNotNull()).join(forms.select(F.col("id").alias("_f")), F.col("form_id") == F.col("_f"), "left_anti").select("id", F.lit("form").alias("missing"))
    no_profile = docs.filter(F.col("student_profile_id").isNotNull()).join(profiles.select(F.col("id").alias("_p")), F.col("student_profile_id") == F.col("_p"), "left_anti").select("id", F.lit("profile").alias("missing"))
    return no_form.unionByName(no_profile)


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("_aadhar", F.nullif("aadhar_number", F.lit("")))


def existing_profiles(new: DataFrame, profiles: DataFrame) -> DataFrame:
    own = _key(profiles).select(F.col("student_name").alias("_n"), F.col("_aadhar").alias("_a"))
    return _key(new).join(own, (F.col("student_name") == F.col("_n")) & F.col("_aadhar").eqNullSafe(F.col("_a")), "left_semi").drop("_aadhar")


def link_profiles(forms: DataFrame, profiles: DataFrame) -> DataFrame:
    """forms with student_profile_id of the profile of the same name and aadhar (empty and NULL are the same)."""
    own = _key(profiles).groupBy(F.col("student_name").alias("_n"), F.col("_aadhar").alias("_a")).agg(F.min("id").alias("_p"))
    met = _key(forms).join(own, (F.col("student_name") == F.col("_n")) & F.col("_aadhar").eqNullSafe(F.col("_a")), "left")
    old = F.col("student_profile_id") if "student_profile_id" in forms.columns else F.lit(None).cast("long")
    return met.withColumn("student_profile_id", F.coalesce("_p", old)).drop("_n", "_a", "_p", "_aadhar")
