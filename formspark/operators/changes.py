"""Snapshots and change tables: each function gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from .lineage import stored
from .relations import _key, existing_profiles, link_profiles


def latest(changes: DataFrame, key: str = "form_id", at: str = "submitted_at") -> DataFrame:
    """The last change of each key; of changes at the same time, the one whose text as JSON is the greatest."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(F.to_json(F.struct("*"))))
    return changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _fields(df: DataFrame) -> list[str]:
    return [c for c in (*schemas.FIELDS, "additional_info") if c in df.columns]


def apply_verifications(forms: DataFrame, changes: DataFrame, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The forms with all fields overwritten by the last verification of each (fields it lacks become NULL), the rejects
    (blank names), and the next profiles, where profiles are given: a verified form is linked to the profile of its name
    and Aadhar number, which is created if there is none. Other forms pass through and keep their links; only verified ones
    are written and linked."""
    last = latest(changes)
    blank = F.trim(F.coalesce("student_name", F.lit(""))) == ""
    own = _fields(forms)
    new = last.filter(~blank).select(F.col("form_id").alias("_id"), F.col("submitted_at").alias("_at"), *[F.col(c).alias(f"_{c}") for c in own if c in changes.columns])
    given = {c: F.col(f"_{c}") if c in changes.columns else F.lit(None).cast(forms.schema[c].dataType) for c in own}
    done = forms.join(new, F.col("id") == F.col("_id")).withColumns(given | {"status": F.lit("verified"), "verified_date": F.col("_at")}).select(*forms.columns)
    rest = forms.join(new.select("_id"), F.col("id") == F.col("_id"), "left_anti")
    if profiles is None:
        return done.unionByName(rest), last.filter(blank), None
    done = stored(done)
    keyed = done if "aadhar_number" in done.columns else done.withColumn("aadhar_number", F.lit(None).cast("string"))
    known = stored(upsert_profiles(profiles, keyed.select("student_name", "aadhar_number", F.col("verified_date").alias("at"))))
    return link_profiles(keyed, known).select(*forms.columns).unionByName(rest), last.filter(blank), known


FOLDED = "form_id long, field string, at timestamp, value string, named_at timestamp"


def fold_patches(patches: DataFrame) -> DataFrame:
    """Patches (form_id, submitted_at and fields) as one row for each form and field: its last value that isn't NULL and the
    time of it; of the name the first time that one was given, too. Of values at the same time the greatest wins."""
    values = [(F.to_json(c) if c == "additional_info" else F.col(c).cast("string")).alias(c) for c in _fields(patches)]
    if not values:
        return patches.sparkSession.createDataFrame([], FOLDED)
    at = F.col("submitted_at").cast("timestamp").alias("at")
    long = patches.select("form_id", at, *values).unpivot(["form_id", "at"], _fields(patches), "field", "value").filter("value IS NOT NULL")
    return merge_folds(long.withColumn("named_at", F.when((F.col("field") == "student_name") & (F.col("value") != ""), F.col("at"))))


def merge_folds(folds: DataFrame) -> DataFrame:
    """Folds brought together. The order, and how often one comes, don't matter, so that batches may be cut anyhow."""
    out = folds.groupBy("form_id", "field").agg(F.max(F.struct("at", "value")).alias("_v"), F.min("named_at").alias("named_at"))
    return out.select("form_id", "field", "_v.at", "_v.value", "named_at")


def apply_fold(forms: DataFrame, folds: DataFrame, insert: bool = False) -> DataFrame:
    """The forms with the changes of folds. Where forms have patched_at (field to time) and named_at, a field keeps its value
    if that is newer, and both are brought up to date. insert: forms that aren't there come in, as uploaded."""
    own = _fields(forms)
    tracked = "patched_at" in forms.columns
    entries = F.map_from_entries(F.collect_list(F.struct("field", F.struct("at", "value"))))  # as many as there are fields
    change = folds.groupBy(F.col("form_id").alias("_id")).agg(entries.alias("_new"), F.min("named_at").alias("_named"))
    met = forms.join(change, F.col("id") == F.col("_id"), "full" if insert else "left")
    new, cols = lambda f: F.try_element_at("_new", F.lit(f)), {}
    for f in own:
        value, kind = new(f)["value"], forms.schema[f].dataType
        value = F.from_json(value, kind) if f == "additional_info" else value.cast(kind)
        text = F.to_json(f) if f == "additional_info" else F.col(f).cast("string")
        newer = new(f)["at"].isNotNull() | new(f)["value"].isNotNull()
        if tracked:
            known = F.try_element_at("patched_at", F.lit(f))
            newer &= known.isNull() | (F.struct(new(f)["at"].alias("a"), new(f)["value"].alias("v")) > F.struct(known.alias("a"), text.alias("v")))
        cols[f] = F.when(newer, value).otherwise(F.col(f))
    named, was = F.col("_named"), F.col("verified_date")
    if tracked:
        named = F.least("_named", "named_at")
        times = F.transform_values("_new", lambda _, v: v["at"])
        cols["patched_at"] = F.when(F.col("_id").isNull(), F.col("patched_at")).otherwise(F.map_zip_with(F.coalesce("patched_at", F.create_map().cast("map<string,timestamp>")), times, lambda _, a, b: F.greatest(a, b)))
        cols["named_at"] = named
        was = F.when(F.col("named_at").isNull(), was)  # a date that a patch gave may become an earlier one
    date = forms.schema["verified_date"].dataType
    cols |= {"verified_date": F.coalesce(was, named.cast(date), F.col("verified_date")), "status": F.when(F.col("_named").isNotNull(), "verified").otherwise(F.coalesce("status", F.when(F.col("id").isNull(), "uploaded"))), "id": F.coalesce("id", F.col("_id").cast(forms.schema["id"].dataType))}
    return met.withColumns(cols).select(*forms.columns)


def apply_patches(forms: DataFrame, patches: DataFrame, insert: bool = False) -> DataFrame:
    """Only what the patches of a form hold changes, each field by the last that has it; a name that isn't empty verifies the
    form, and the first gives the date where there is none. Patches of unknown forms are left out, or come in with insert."""
    return apply_fold(forms, fold_patches(patches), insert)


def merged(base: Column, update: Column, overwrite: bool) -> Column:
    """Empty updates never count."""
    b, u = F.nullif(base, F.lit("")), F.nullif(update, F.lit(""))
    return F.coalesce(u, b) if overwrite else F.coalesce(b, u)


def autofill(forms: DataFrame, parsed: DataFrame, fields: tuple[str, ...] = schemas.FIELDS, overwrite: bool = True) -> DataFrame:
    """Fills columns from a parse (id and fields); of several parses of a form the greatest, by its fields in turn."""
    own = [f for f in fields if f in parsed.columns and f in forms.columns]
    if not own:
        return forms
    new = parsed.groupBy(F.col("id").alias("_id")).agg(F.max(F.struct(*own)).alias("_p")).select("_id", *[F.col(f"_p.{f}").alias(f"_{f}") for f in own])
    return forms.join(new, F.col("id") == F.col("_id"), "left").withColumns({f: merged(F.col(f), F.col(f"_{f}"), overwrite) for f in own}).select(*forms.columns)


def prefill(forms: DataFrame, structured: DataFrame, lite: DataFrame) -> DataFrame:
    """Forms that aren't verified get structured data, else (fill only) the lite parse; `address` goes to permanent_address."""
    lite = lite.withColumnRenamed("address", "permanent_address") if "address" in lite.columns else lite
    open_ = forms.filter(F.coalesce(F.col("status") != "verified", F.lit(True)))
    has = structured.select("id").distinct()
    first = autofill(open_.join(has, "id", "left_semi"), structured)
    rest = autofill(open_.join(has, "id", "left_anti"), lite, overwrite=False)
    return forms.filter("status = 'verified'").unionByName(first).unionByName(rest)


def upsert_profiles(profiles: DataFrame, keys: DataFrame) -> DataFrame:
    """Profiles with keys (student_name, aadhar_number, at): known ones are touched, new ones get the next ids by name.

    The new keys are written once in order: their numbers hang on where the ranges end, which a second run may shift.
    """
    new = _key(keys).groupBy("student_name", "_aadhar").agg(F.max("at").alias("at"))
    k = new.select(F.col("student_name").alias("_n"), F.col("_aadhar").alias("_a"), "at")
    same = (F.col("student_name") == F.col("_n")) & F.col("_aadhar").eqNullSafe(F.col("_a"))
    touched = _key(profiles).join(k, same, "left").withColumn("updated_date", F.coalesce("at", "updated_date")).select(*profiles.columns)
    known = _key(profiles).select(F.col("student_name").alias("_n"), F.col("_aadhar").alias("_a"))
    fresh = new.join(known, same, "left_anti")
    ranged = stored(fresh.repartitionByRange("student_name", "_aadhar").sortWithinPartitions("student_name", "_aadhar").withColumn("_m", F.monotonically_increasing_id()))
    dealt = ranged.withColumn("_b", F.shiftright("_m", 33))
    sizes = dealt.groupBy("_b").count()
    starts = sizes.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_start"))
    top = profiles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    added = dealt.join(F.broadcast(starts), "_b").crossJoin(F.broadcast(top))
    added = added.select((F.col("_top") + F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).alias("id"), "student_name", F.col("_aadhar").alias("aadhar_number"), F.col("at").alias("updated_date"), F.col("at").alias("created_date"))
    return touched.unionByName(added.select(*[c for c in profiles.columns]))


def create_profiles(profiles: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted new profiles and the rejected ones with a reason."""
    blank = F.trim(F.coalesce("student_name", F.lit(""))) == ""
    dup = existing_profiles(new.filter(~blank), profiles)
    keys = dup.select(F.col("student_name").alias("_n"), F.nullif("aadhar_number", F.lit("")).alias("_a"))
    ok = _key(new.filter(~blank)).join(keys, (F.col("student_name") == F.col("_n")) & F.col("_aadhar").eqNullSafe(F.col("_a")), "left_anti").drop("_aadhar")
    return ok, new.filter(blank).withColumn("reason", F.lit("no name")).unionByName(dup.withColumn("reason", F.lit("exists")))


def attach_documents(new: DataFrame, forms: DataFrame, profiles: DataFrame) -> DataFrame:
    """New documents with the reason of their rejection, NULL where they are accepted."""
    f, p = forms.select(F.col("id").alias("_f")).distinct(), profiles.select(F.col("id").alias("_p")).distinct()
    met = new.join(f, F.col("form_id") == F.col("_f"), "left").join(p, F.col("student_profile_id") == F.col("_p"), "left")
    reason = (
        F.when(~F.coalesce(F.col("document_category").isin(*schemas.CATEGORIES), F.lit(False)), "category")
        .when(F.col("form_id").isNull() & F.col("student_profile_id").isNull(), "no parent")
        .when(F.col("form_id").isNotNull() & F.col("_f").isNull(), "unknown form")
        .when(F.col("student_profile_id").isNotNull() & F.col("_p").isNull(), "unknown profile")
    )
    return met.withColumn("reason", reason).drop("_f", "_p")


def delete_forms(forms: DataFrame, docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forms without the deleted ones; their documents stay, with form_id NULL. ids: id."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("form_id") == F.col("_gone"), "left").withColumn("form_id", F.when(F.col("_gone").isNull(), F.col("form_id"))).drop("_gone")
    return forms.join(gone, F.col("id") == F.col("_gone"), "left_anti"), left


def delete_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")


def apply_reextraction(forms: DataFrame, assembled: DataFrame, parsed: DataFrame) -> DataFrame:
    """Forms with a new extraction (form_id, provider; provider NULL: it failed) get its fields, provider and status, and
    extracted_data, where forms have it, of those of its parts that assembled holds. A failed one changes the status only. Of several of a form, the one whose text as JSON is the
    greatest counts."""
    whole = F.struct(*assembled.columns)
    new = assembled.groupBy(F.col("form_id").alias("_id")).agg(F.max_by(whole, F.to_json(whole)).alias("_new"))
    out = autofill(forms, parsed).join(new, F.col("id") == F.col("_id"), "left")
    hit, done = F.col("_id").isNotNull(), F.col("_new.provider").isNotNull()
    got = {"status": F.when(hit & ~done, "error").when(hit, "extracted").otherwise(F.col("status")), "ocr_provider": F.coalesce("_new.provider", "ocr_provider")}
    if "extracted_data" in forms.columns:
        parts = forms.schema["extracted_data"].dataType
        whole = F.struct(*[(F.col(f"_new.{p.name}") if p.name in assembled.columns else F.lit(None)).cast(p.dataType).alias(p.name) for p in parts.fields])
        got["extracted_data"] = F.when(done, whole).otherwise(F.col("extracted_data"))
    return out.withColumns(got).select(*forms.columns)
