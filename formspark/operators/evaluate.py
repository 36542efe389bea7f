"""Extraction quality against labels, and operational metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import SPECS, FieldSpec, extract_fields
from ..functions.scalars import edit_similarity, field_similarity, norm_text, normalize_confidence, round_at


def evaluate_fields(labels: DataFrame, parsed: DataFrame, raw: DataFrame | None = None, similarity: str = "blocks") -> DataFrame:
    """labels (sample_id, field, expected) with parsed (sample_id, field, actual) and raw (sample_id, raw_text).

    Fields whose expected text is empty don't count. A field without an actual text scores 0, or 0.8 where the expected
    text occurs in the raw one. ratio is the similarity before it is rounded. similarity: "blocks" (matching blocks) or "edits" (edit distance, native).
    """
    own = labels.withColumn("_e", norm_text(F.col("expected"))).filter("_e <> ''")
    met = own.join(parsed.select("sample_id", "field", "actual"), ["sample_id", "field"], "left").withColumn("_a", norm_text(F.col("actual")))
    met = met.join(raw.select("sample_id", F.lower("raw_text").alias("_raw")), "sample_id", "left") if raw is not None else met.withColumn("_raw", F.lit(""))
    ratio = field_similarity(F.col("_e"), F.col("_a")) if similarity == "blocks" else edit_similarity(F.col("_e"), F.col("_a"))
    met = met.withColumn("_r", ratio).withColumn("found_in_raw", F.coalesce(F.col("_raw").contains(F.col("_e")), F.lit(False)))
    met = met.withColumn("_r", F.when((F.col("_a") == "") & F.col("found_in_raw"), F.greatest("_r", F.lit(0.8))).otherwise(F.col("_r")))
    return met.select("sample_id", "field", "expected", "actual", round_at(F.col("_r"), 3).alias("similarity"), (F.col("_r") >= 0.999).alias("exact_match"), "found_in_raw", F.col("_r").alias("ratio"))


def structured_or_parsed(extractions: DataFrame, specs: tuple[FieldSpec, ...] = SPECS) -> DataFrame:
    """sample_id, field, actual from extractions (sample_id, raw_text, structured_data, form_type): the structured data
    where there are any, or else what the raw text of a sample of known form type gives."""
    has = F.coalesce(F.size("structured_data") > 0, F.lit(False))
    given = extractions.filter(has).select("sample_id", F.explode("structured_data").alias("field", "actual"))
    names = [s.name for s in specs]
    parsed = extract_fields(extractions.filter(~has & (F.nullif("form_type", F.lit("")).isNotNull())).select("sample_id", "raw_text"), specs=specs)
    return given.unionByName(parsed.unpivot(["sample_id"], names, "field", "actual").filter("actual IS NOT NULL"))


def union_reports(reports: list[DataFrame]) -> DataFrame:
    """The reports of several providers one after the other; columns that one lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def score_samples(scores: DataFrame, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Means over the fields of a sample, of the ratios before they are rounded."""
    return scores.groupBy(*by).agg(F.avg("ratio").alias("similarity"), F.avg(F.col("exact_match").cast("double")).alias("exact_rate"), F.count("*").alias("n_fields"))


def provider_summary(samples: DataFrame) -> DataFrame:
    """samples: provider, confidence, similarity, exact_rate, time_ms, error. Failed samples count, but give no score."""
    ok = lambda c: F.avg(F.when(F.col("error").isNull(), F.col(c)))
    return samples.groupBy("provider").agg(F.count("*").alias("samples"), round_at(ok("confidence"), 2).alias("avg_confidence"), round_at(ok("similarity"), 3).alias("avg_similarity"), round_at(ok("exact_rate"), 3).alias("avg_exact_rate"), round_at(ok("time_ms"), 2).alias("avg_time_ms"), F.count_if(F.col("error").isNotNull()).alias("failures"))


def throughput(events: DataFrame, every: str = "1 hour", target: int = 60) -> DataFrame:
    """events: ts, provider. Works on streams with a watermark, too."""
    out = events.groupBy(F.window("ts", every).alias("w"), "provider").agg(F.count("*").alias("forms"))
    return out.select(F.col("w.start").alias("hour"), "provider", "forms", (F.col("forms") >= target).alias("on_target"))


def sla_breaches(forms: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return forms.filter((F.col("status") == "extracted") & (F.col("upload_date") < as_of - F.make_dt_interval(hours=F.lit(hours))))


def needs_review(forms: DataFrame, least: float = 80.0) -> DataFrame:
    return forms.filter(normalize_confidence(F.col("confidence")) < least)


def expired_uploads(forms: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return forms.filter(F.col("upload_date") < as_of - F.make_dt_interval(days=F.lit(days)))


def qc_sample(forms: DataFrame, percent: int) -> DataFrame:
    """A fixed share of the verified forms, by a hash of the id."""
    return forms.filter((F.col("status") == "verified") & (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 6), 16, 10).cast("long") % 100 < percent))


def cost_report(pages: DataFrame, prices: DataFrame) -> DataFrame:
    own = prices.select(F.col("name").alias("provider"), "canonical", "price")
    return pages.join(F.broadcast(own), "provider").groupBy("canonical").agg(F.count("*").alias("pages"), round_at(F.sum("price"), 4).alias("estimated_cost"))


def impute_confidence(attempts: DataFrame, dim: DataFrame) -> DataFrame:
    """Providers that report no confidence get their default; of an empty text, those that give it 0 by the dimension get 0."""
    own = dim.select(F.col("name").alias("_p"), F.col("default_confidence").alias("_d"), F.col("zero_if_empty").alias("_z"))
    met = attempts.join(F.broadcast(own), F.col("provider") == F.col("_p"), "left")
    empty = F.trim(F.coalesce("raw_text", F.lit(""))) == ""
    return met.withColumn("confidence", F.coalesce("confidence", F.when(empty & F.col("_z"), 0.0).otherwise(F.col("_d")))).drop("_p", "_d", "_z")
