"""Exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso
from ..operators.search import export_view


def _flat(forms: DataFrame) -> DataFrame:
    out = forms
    for c in ("upload_date", "verified_date"):
        if c in forms.columns:
            out = out.withColumn(c, iso(F.col(c)))
    return out


def csv_view(forms: DataFrame) -> DataFrame:
    out = _flat(forms)
    if "additional_info" in forms.columns:
        out = out.withColumn("additional_info", F.to_json("additional_info"))
    return export_view(out)


def export_csv(forms: DataFrame, path: str) -> None:
    csv_view(forms).write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", mode="overwrite")


def json_view(forms: DataFrame) -> DataFrame:
    out = _flat(forms)
    if "additional_info" in forms.columns:
        out = out.withColumn("additional_info", F.coalesce("additional_info", F.create_map().cast("map<string,string>")))
    return export_view(out)


def export_json(forms: DataFrame, filters: dict[str, str], path: str) -> None:
    """The forms under path/forms, one row about the export under path/manifest: generated_at, count and the filters as
    an object."""
    json_view(forms).write.json(f"{path}/forms", ignoreNullFields=False, mode="overwrite")
    own = F.create_map(*[F.lit(x) for k, v in filters.items() if v not in (None, "") for x in (k, str(v))]).cast("map<string,string>")
    about = forms.agg(F.count("*").alias("count")).select(iso(F.current_timestamp()).alias("generated_at"), "count", own.alias("filters"))
    about.write.json(f"{path}/manifest", mode="overwrite")


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    summary.write.json(f"{path}/summary", mode="overwrite")
    details.write.partitionBy("provider").parquet(f"{path}/details", mode="overwrite")
