"""Confidence, labels, sizes, dates, maps and similarity as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import schemas
from ..sources.tables import ALIASES, BEST, PROVIDERS
from .matching import ratios

_LABELS = {p[0]: p[1] for p in PROVIDERS}
PROVIDER_LABELS = _LABELS | {a: _LABELS[c] for a, c in ALIASES.items()} | {b: "Automatic (Best)" for b in BEST}
# Status labels.
STATUS_LABELS = {"uploaded": "Uploaded", "extracting": "Extracting", "extracted": "Pending Verification", "verified": "Verified", "error": "Error"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def round_at(c: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value, the same in every engine."""
    return F.round(c.cast("decimal(20,10)"), digits).cast("double")


def normalize_confidence(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), None).when(c <= 1, c * 100).otherwise(c)


def confidence_band(c: Column) -> Column:
    n = normalize_confidence(c)
    return F.when(n.isNull(), "neutral").when(n >= 90, "high").when(n >= 75, "medium").otherwise("low")


def format_confidence(c: Column) -> Column:
    n = normalize_confidence(c)
    return F.when(n.isNull(), "n/a").otherwise(F.concat(F.round(n.cast("decimal(20,10)"), 1).cast("decimal(18,1)").cast("string"), F.lit("%")))


def attempt_score(confidence: Column, text: Column) -> Column:
    return confidence * (1 + F.char_length(F.trim(F.coalesce(text, F.lit("")))) / 1000.0)


def mode_score(confidence: Column, words: Column) -> Column:
    return confidence * (1 + words / 100.0)


def provider_label(c: Column) -> Column:
    """Known labels, or the name with spaces for - and _ and the first letter of each word raised."""
    words = F.split(F.regexp_replace(c, "[-_]", " "), r"\b(?=[A-Za-z0-9])")
    free = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
    return F.when(F.coalesce(c, F.lit("")) == "", "Not specified").otherwise(F.coalesce(_lookup(PROVIDER_LABELS, F.lower(c)), free))


def status_label(c: Column) -> Column:
    return F.coalesce(_lookup(STATUS_LABELS, F.coalesce(c, F.lit(""))), c)


def format_size(c: Column) -> Column:
    def of(x: Column, unit: str) -> Column:
        return F.concat(F.round(x.cast("decimal(30,10)"), 2).cast("decimal(28,2)").cast("string"), F.lit(unit))

    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, of(c / 1024, " KB")).otherwise(of(c / (1024 * 1024), " MB"))


def iso(c: Column) -> Column:
    """ISO text, with microseconds where there are any."""
    micros = F.date_format(c, ".SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != ".000000", micros).otherwise(""))


def format_date(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd"), c))


def norm_text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def error_category(c: Column) -> Column:
    m = F.lower(c)
    return F.when(m.contains("tesseract") & m.contains("not found"), "tool_missing").when(m.contains("broken data stream") | (m.contains("invalid") & m.contains("image")), "corrupt_image").when(m.isNotNull(), "other")


def resolve_provider(requested: Column, own: Column, default: str) -> Column:
    name = F.lower(F.coalesce(F.nullif(requested, F.lit("")), F.nullif(own, F.lit("")), F.lit(default)))
    return F.when(name == "multi", "best").otherwise(name)


def is_known_template(filename: Column) -> Column:
    low = F.lower(filename)
    return low.contains("srcc") | low.contains("data form")


def active_filters(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def merge_info(a: Column, b: Column) -> Column:
    """Right side wins on equal keys."""
    a, b = F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def parse_extraction(c: Column) -> Column:
    """The JSON of an extraction as a struct; parts it lacks, and texts that aren't JSON, are NULL."""
    return F.from_json(c, schemas.EXTRACTED)


@F.pandas_udf(DoubleType())
def field_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts; 0 where the second is empty."""
    a, b = a.fillna(""), b.fillna("")
    return pd.Series(ratios(a.tolist(), b.tolist())).where((b != "").to_numpy(), 0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 where the second is empty."""
    return F.when(b == "", 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)))
