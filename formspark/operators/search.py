"""Filters, projections, ordering and paging of forms, documents and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

TEXT_FILTERS = ("student_name", "phone_number", "email", "enrollment_number", "application_number", "course_applied")


def contains(c: Column, needle: str, literal: bool = False) -> Column:
    """Case-insensitive substring; % and _ are wildcards unless literal."""
    return F.lower(c).contains(needle.lower()) if literal else c.ilike(f"%{needle}%")


def search_forms(forms: DataFrame, status: str | None = None, date_from: str | None = None, date_to: str | None = None, literal: bool = False, **needles: str | None) -> DataFrame:
    """Conjunction of any of the filters; absent ones do nothing. Both dates are whole days."""
    for name, needle in needles.items():
        if name not in TEXT_FILTERS:
            raise ValueError(f"no filter on {name}")
        if needle:
            forms = forms.filter(contains(F.col(name), needle.strip(), literal))
    if status:
        forms = forms.filter(F.col("status") == status)
    if date_from:
        forms = forms.filter(F.col("upload_date") >= F.to_date(F.lit(date_from)))
    if date_to:
        forms = forms.filter(F.col("upload_date") < F.date_add(F.to_date(F.lit(date_to)), 1))
    return forms


def export_forms(forms: DataFrame, status: str | None = None, **filters: str | None) -> DataFrame:
    """Search result for an export, newest first; verified forms unless a status is given."""
    return search_forms(forms, status=status or "verified", **filters).orderBy(F.desc("upload_date"), F.desc("id"))


def search_documents(docs: DataFrame, profiles: DataFrame | None = None, student_name: str | None = None, category: str | None = None, form_id: int | None = None, profile_id: int | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """An unknown category and dates that can't be read do nothing. A name drops documents without a profile."""
    if category in schemas.CATEGORIES:
        docs = docs.filter(F.col("document_category") == category)
    if form_id is not None:
        docs = docs.filter(F.col("form_id") == form_id)
    if profile_id is not None:
        docs = docs.filter(F.col("student_profile_id") == profile_id)
    for value, keep in ((date_from, lambda c, d: c >= d), (date_to, lambda c, d: c <= d)):
        if value:
            at = F.try_to_timestamp(F.lit(value)).cast("timestamp_ntz")
            docs = docs.filter(at.isNull() | keep(F.col("upload_date").cast("timestamp_ntz"), at))
    if student_name:
        own = profiles.filter(contains(F.col("student_name"), student_name)).select(F.col("id").alias("_pid"))
        docs = docs.join(own, docs.student_profile_id == F.col("_pid")).drop("_pid")
    return docs


def search_profiles(profiles: DataFrame, name: str | None = None, aadhar: str | None = None) -> DataFrame:
    for c, needle in (("student_name", name), ("aadhar_number", aadhar)):
        if needle:
            profiles = profiles.filter(contains(F.col(c), needle))
    return profiles


def get_form(forms: DataFrame, form_id: int) -> DataFrame:
    return forms.filter(F.col("id") == form_id)


def page_of(df: DataFrame, by: str, skip: int = 0, limit: int = 100, most: int = 1000) -> DataFrame:
    """Newest first by a column, then by id."""
    return df.orderBy(F.desc(by), F.desc("id")).offset(skip).limit(min(limit, most))


def list_forms(forms: DataFrame, skip: int = 0, limit: int = 100, status: str | None = None, sort_by: str = "upload_date") -> DataFrame:
    if sort_by not in ("upload_date", "verified_date", "student_name"):
        raise ValueError(f"no order by {sort_by}")
    return page_of(search_forms(forms, status=status), sort_by, skip, limit)


def after(df: DataFrame, by: str, last: object, last_id: int, limit: int) -> DataFrame:
    """The page after a row, found by its key rather than by counting rows."""
    key = F.col(by)
    return df.filter((key < F.lit(last)) | ((key == F.lit(last)) & (F.col("id") < last_id))).orderBy(F.desc(by), F.desc("id")).limit(limit)


def form_summary(forms: DataFrame) -> DataFrame:
    return forms.select(*schemas.SUMMARY)


def document_view(docs: DataFrame) -> DataFrame:
    return docs.select(*schemas.DOCUMENT_VIEW)


def export_view(forms: DataFrame) -> DataFrame:
    """The 51 export columns under their display labels; columns that forms lacks are NULL."""
    have = set(forms.columns)
    return forms.select(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(schemas.export_label(c)) for c in schemas.EXPORT])


def fields_long(forms: DataFrame, ids: tuple[str, ...] = ("id",), fields: tuple[str, ...] = schemas.FIELDS) -> DataFrame:
    own = [f for f in fields if f in forms.columns]
    return forms.unpivot([F.col(i) for i in ids], own, "field", "value")
