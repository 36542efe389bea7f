"""The registered queries over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import elements, fields, scalars
from ..operators import attempts, changes, evaluate, layout, lineage, ranked, relations, search
from ..sources import sinks, tables
from .fixtures import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, *views: str):
    """Registers a function of the named views (and the session first, if it asks for none)."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, d: f(*[view(spark, d, v) for v in views])
        if sql:
            ORACLE[name] = duck(sql)
        return f

    return put


def rounded(x: str, n: int) -> str:
    return f"cast(round(cast({x} AS decimal(20,10)), {n}) AS double)"


# Search, order and paging
for _c, _n in (("student_name", "customer#00000001"), ("phone_number", "9123"), ("email", "7@MAIL"), ("enrollment_number", "enr12"), ("application_number", "app-12"), ("course_applied", "build")):
    query(f"flt_{_c}", f"SELECT id, {_c} FROM forms WHERE {_c} ILIKE '%{_n}%'", "forms")(lambda f, c=_c, n=_n: search.search_forms(f, **{c: f" {n} "}).select("id", c))
query("flt_status", "SELECT id, status FROM forms WHERE status = 'extracted'", "forms")(lambda f: search.search_forms(f, status="extracted").select("id", "status"))
query("flt_dates", "SELECT id FROM forms WHERE upload_date >= timestamp '1996-03-01 00:00:00' AND upload_date < timestamp '1996-06-16 00:00:00'", "forms")(lambda f: search.search_forms(f, date_from="1996-03-01", date_to="1996-06-15").select("id"))
query("flt_conjunction", "SELECT id FROM forms WHERE status = 'verified' AND course_applied ILIKE '%auto%' AND upload_date >= timestamp '1995-01-01 00:00:00'", "forms")(lambda f: search.search_forms(f, status="verified", course_applied="auto", date_from="1995-01-01", email="").select("id"))
query("flt_documents", "SELECT id FROM docs WHERE document_category = 'ID Proof' AND upload_date >= timestamp '1996-01-01 00:00:00' AND upload_date <= timestamp '1997-01-01 00:00:00'", "docs")(lambda d: search.search_documents(d, category="ID Proof", date_from="1996-01-01T00:00:00Z", date_to="1997-01-01").select("id"))
query("join_document_name", "SELECT d.id, student_name FROM docs d JOIN (SELECT id AS pid, student_name FROM profiles WHERE student_name ILIKE '%00001%') p ON student_profile_id = pid", "docs", "profiles")(lambda d, p: search.search_documents(d, p, student_name="00001").join(p.select(F.col("id").alias("pid"), "student_name"), F.col("student_profile_id") == F.col("pid")).select("id", "student_name"))
query("flt_profiles", "SELECT id FROM profiles WHERE student_name ILIKE '%1%' AND aadhar_number ILIKE '%00001%'", "profiles")(lambda p: search.search_profiles(p, "1", "00001").select("id"))
query("get_form", "SELECT id, filename FROM forms WHERE id = 7", "forms")(lambda f: search.get_form(f, 7).select("id", "filename"))
query("known_template", "SELECT id, (lower(filename) LIKE '%srcc%' OR lower(filename) LIKE '%data form%') AS known FROM forms", "forms")(lambda f: f.select("id", scalars.is_known_template(F.col("filename")).alias("known")))
query("form_summary", "SELECT id, filename, upload_date, status, ocr_provider, student_profile_id FROM forms", "forms")(search.form_summary)
query("document_view", "SELECT id, filename, document_category, description, upload_date, file_size, form_id, student_profile_id, file_path FROM docs", "docs")(search.document_view)
query("fields_long", " UNION ALL ".join(f"SELECT id, '{c}' AS field, {c} AS value FROM forms" for c in ("student_name", "aadhar_number", "phone_number", "email", "course_applied", "application_number", "enrollment_number")), "forms")(search.fields_long)
query("list_forms", "SELECT id, upload_date FROM forms ORDER BY upload_date DESC, id DESC LIMIT 50 OFFSET 100", "forms")(lambda f: search.list_forms(f, 100, 50).select("id", "upload_date"))
query("search_page", "SELECT id FROM forms WHERE status = 'verified' ORDER BY upload_date DESC, id DESC LIMIT 20 OFFSET 40", "forms")(lambda f: search.page_of(search.search_forms(f, status="verified"), "upload_date", 40, 20).select("id"))
query("next_page", "SELECT id FROM forms WHERE upload_date < timestamp '1996-01-01 00:00:00' ORDER BY upload_date DESC, id DESC LIMIT 20", "forms")(lambda f: search.after(f, "upload_date", __import__("datetime").datetime(1996, 1, 1), 0, 20).select("id"))
_ranked = lambda f: ranked.write_ranked(f, f"{lineage.shared_dir(f.sparkSession)}/{uuid.uuid4()}", rows=4096)
query("page_by_number", "SELECT id, upload_date, student_name FROM forms WHERE status = 'extracted' ORDER BY upload_date DESC, id DESC LIMIT 100 OFFSET 2500", "forms")(lambda f: ranked.page_at(f.sparkSession, _ranked(f), 2500, 100, status="extracted").select("id", "upload_date", "student_name"))
query("found_page_by_number", "SELECT id, upload_date FROM forms WHERE course_applied ILIKE '%house%' ORDER BY upload_date DESC, id DESC LIMIT 50 OFFSET 1200", "forms")(lambda f: ranked.page_at(f.sparkSession, _ranked(f), 1200, 50, search.contains(F.col("course_applied"), "house")).select("id", "upload_date"))
query("list_profiles", "SELECT id, updated_date FROM profiles ORDER BY updated_date DESC NULLS LAST, id DESC LIMIT 30", "profiles")(lambda p: search.page_of(p, "updated_date", 0, 30).select("id", "updated_date"))
query("list_documents", "SELECT id, upload_date FROM docs ORDER BY upload_date DESC, id DESC LIMIT 30", "docs")(lambda d: search.page_of(d, "upload_date", 0, 30).select("id", "upload_date"))
query("recent_forms", "SELECT id FROM forms ORDER BY upload_date DESC, id DESC LIMIT 10", "forms")(lambda f: search.list_forms(f, 0, 10).select("id"))
query("sort_by_name", "SELECT id, student_name FROM forms ORDER BY student_name DESC, id DESC LIMIT 25", "forms")(lambda f: search.list_forms(f, 0, 25, sort_by="student_name").select("id", "student_name"))
query("count_results", "SELECT count(*) AS n FROM forms WHERE course_applied ILIKE '%house%'", "forms")(lambda f: search.search_forms(f, course_applied="house").agg(F.count("*").alias("n")))
_iso = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', {c}) % 1000000 <> 0 THEN strftime({c}, '.%f') ELSE '' END"
_have = ("id", "filename", "status", "ocr_provider", "student_profile_id", "student_name", "aadhar_number", "phone_number", "email", "course_applied", "application_number", "enrollment_number")
_EXPORT_SQL = "SELECT " + ", ".join((f"{c}" if c in _have else f"{_iso(c)}" if c in ("upload_date", "verified_date") else "NULL::VARCHAR") + f' AS "{schemas.export_label(c)}"' for c in schemas.EXPORT) + " FROM (SELECT * REPLACE (upload_date + to_microseconds(id % 3 * 125000) AS upload_date) FROM forms ) f WHERE status = 'verified'"
_timed = lambda f: f.withColumn("upload_date", F.col("upload_date") + F.expr("make_dt_interval(0, 0, 0, cast(id % 3 * 0.125 AS decimal(18,6)))"))
query("export_csv_view", _EXPORT_SQL, "forms")(lambda f: sinks.csv_view(search.export_forms(_timed(f))))
query("export_json_view", _EXPORT_SQL, "forms")(lambda f: sinks.json_view(search.export_forms(_timed(f))))

# Intake and dimensions
query("validate_intake", "SELECT id, CASE WHEN filename ILIKE '%.exe' THEN 'extension' WHEN size > 10485760 THEN 'size' END AS reason, NOT filename ILIKE '%.exe' AND size <= 10485760 AS accepted FROM (SELECT id, filename, cast(o_totalprice * 50 AS bigint) AS size FROM forms) x", "forms")(lambda f: tables.validate_intake(f.select("id", "filename", (F.col("o_totalprice") * 50).cast("decimal(20,0)").cast("long").alias("size"))).select("id", "reason", "accepted"))
query("file_names", "SELECT id, lower(regexp_extract(filename, '[.]([^.]*)$', 1)) AS ext, regexp_replace(filename, '[.][^.]*$', '') AS stem FROM forms", "forms")(lambda f: f.select("id", tables.file_ext(F.col("filename")).alias("ext"), tables.file_stem(F.col("filename")).alias("stem")))
query("missing_providers", "SELECT DISTINCT ocr_provider AS provider FROM forms WHERE ocr_provider NOT IN ('tesseract', 'google', 'google-vision', 'google-documentai', 'azure', 'azure-vision', 'azure-form-recognizer', 'aws-textract', 'abbyy', 'best', 'multi')", "forms")(lambda f: tables.missing_providers(f.select(F.col("ocr_provider").alias("provider")).distinct(), tables.provider_dim(f.sparkSession)))

# Joins
_docs_sql = "coalesce((SELECT list(d.id ORDER BY d.upload_date DESC, d.id DESC) FROM docs d WHERE d.{} = {}.id), [])"
query("with_documents", "SELECT f.id, coalesce(ids, []) AS ids FROM forms f LEFT JOIN (SELECT form_id, list(id ORDER BY upload_date DESC, id DESC) AS ids FROM docs GROUP BY form_id) d ON form_id = f.id", "forms", "docs")(lambda f, d: relations.with_documents(f, d).select("id", F.col("documents.id").alias("ids")))
query("profile_counts", "SELECT p.id, coalesce(a.n, 0) AS form_count, coalesce(b.n, 0) AS document_count FROM profiles p LEFT JOIN (SELECT student_profile_id AS k, count(*) AS n FROM forms GROUP BY 1) a ON a.k = p.id LEFT JOIN (SELECT student_profile_id AS k, count(*) AS n FROM docs GROUP BY 1) b ON b.k = p.id", "profiles", "forms", "docs")(lambda p, f, d: relations.profile_counts(p, f, d).select("id", "form_count", "document_count"))
query("profile_detail", "SELECT p.id, coalesce(a.ids, []) AS forms_, coalesce(b.ids, []) AS docs_, len(coalesce(a.ids, [])) AS n FROM profiles p LEFT JOIN (SELECT student_profile_id AS k, list(id ORDER BY upload_date DESC, id DESC) AS ids FROM forms GROUP BY 1) a ON a.k = p.id LEFT JOIN (SELECT student_profile_id AS k, list(id ORDER BY upload_date DESC, id DESC) AS ids FROM docs GROUP BY 1) b ON b.k = p.id", "profiles", "forms", "docs")(lambda p, f, d: relations.profile_detail(p, f, d).select("id", F.col("forms.id").alias("forms_"), F.col("documents.id").alias("docs_"), F.col("form_count").alias("n")))
query("profile_forms", "SELECT id FROM forms WHERE student_profile_id = 10", "forms")(lambda f: relations.profile_forms(f, 10).select("id"))
query("form_documents", "SELECT id FROM docs WHERE form_id = 3", "docs")(lambda d: relations.form_documents(d, 3).select("id"))
query("profile_documents", "SELECT id FROM docs WHERE student_profile_id = 4", "docs")(lambda d: relations.profile_documents(d, 4).select("id"))
query("orphan_documents", "SELECT id, 'form' AS missing FROM docs WHERE form_id IS NOT NULL AND form_id NOT IN (SELECT id FROM forms) UNION ALL SELECT id, 'profile' FROM docs WHERE student_profile_id IS NOT NULL AND student_profile_id NOT IN (SELECT id FROM profiles)", "docs", "forms", "profiles")(relations.orphan_documents)
query("existing_profiles", "SELECT f.id FROM forms f WHERE EXISTS (SELECT 1 FROM profiles p WHERE p.student_name = f.student_name AND p.aadhar_number IS NOT DISTINCT FROM f.aadhar_number)", "forms", "profiles")(lambda f, p: relations.existing_profiles(f, p).select("id"))
query("link_profiles", "SELECT f.id, p.id AS student_profile_id FROM forms f LEFT JOIN profiles p ON p.student_name = f.student_name AND p.aadhar_number IS NOT DISTINCT FROM f.aadhar_number", "forms", "profiles")(lambda f, p: relations.link_profiles(f.drop("student_profile_id"), p).select("id", "student_profile_id"))
query("dashboard", "SELECT count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'extracted') AS pending, (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM profiles) AS profiles FROM forms", "forms", "docs", "profiles")(attempts.dashboard)

# Attempts and pages
_BEST = "(SELECT *, row_number() OVER (PARTITION BY form_id, page ORDER BY confidence * (1 + length(trim(raw_text)) / 1000.0::double) DESC NULLS LAST, attempt_ord, provider) AS rn FROM attempts WHERE error IS NULL)"
query("best_attempt", f"SELECT form_id, page, attempt_ord, provider FROM {_BEST} WHERE rn = 1", "attempts")(lambda a: attempts.best_attempt(a).select("form_id", "page", "attempt_ord", "provider"))
query("best_or_error", f"SELECT form_id, page, provider, NULL AS error FROM {_BEST} WHERE rn = 1 UNION ALL SELECT form_id, page, arg_min(provider, (attempt_ord, provider)), min(error) FROM attempts GROUP BY form_id, page HAVING count(*) FILTER (error IS NULL) = 0", "attempts")(lambda a: attempts.best_attempt(a, "error").select("form_id", "page", "provider", "error"))
query("best_mode", "SELECT form_id, page, attempt_ord FROM (SELECT *, row_number() OVER (PARTITION BY form_id, page ORDER BY confidence * (1 + word_count / 100.0::double) DESC NULLS LAST, attempt_ord, provider) AS rn FROM (SELECT *, length(raw_text) % 17 AS word_count FROM attempts WHERE error IS NULL)) WHERE rn = 1", "attempts")(lambda a: attempts.best_mode(a.withColumn("word_count", F.char_length("raw_text") % 17)).select("form_id", "page", "attempt_ord"))
query("attempt_list", "SELECT form_id, page, list(attempt_ord ORDER BY attempt_ord) AS ords, list(length(raw_text) ORDER BY attempt_ord, provider, confidence NULLS FIRST, length(raw_text)) AS lengths FROM attempts WHERE error IS NULL GROUP BY form_id, page", "attempts")(lambda a: attempts.attempt_list(a).select("form_id", "page", F.col("attempts.attempt_ord").alias("ords"), F.col("attempts.text_length").alias("lengths")))
query("all_attempts", f"SELECT a.form_id, a.page, n AS n_providers, b.provider AS best_provider FROM (SELECT form_id, page, count(DISTINCT provider) AS n FROM attempts WHERE error IS NULL GROUP BY form_id, page) a JOIN {_BEST} b ON a.form_id = b.form_id AND a.page = b.page AND rn = 1", "attempts")(lambda a: attempts.all_attempts(a).select("form_id", "page", F.size("results").alias("n_providers"), "best_provider"))
_PAGES = "string_agg(chr(10) || '--- Page ' || page || ' ---' || chr(10) || raw_text, chr(10) ORDER BY page) FILTER (trim(raw_text) <> '')"
for _m, _conf, _cnt in (("upload", "avg(confidence) FILTER (trim(raw_text) <> '' AND confidence <> 0)", "count(*)"), ("eval", "avg(confidence)", "count(*)")):
    query(f"assemble_{_m}", f"SELECT form_id, coalesce({_PAGES}, '') AS raw_text, {rounded(f'coalesce({_conf}, 0)', 2)} AS confidence, {_cnt} AS pages_processed, arg_min(provider, page) AS provider, list(page ORDER BY page) AS pages FROM form_pages GROUP BY form_id", "form_pages")(lambda p, m=_m: attempts.assemble_pages(p, m).select("form_id", "raw_text", "confidence", "pages_processed", "provider", F.col("page_results.page").alias("pages")))
query("split_pages", "SELECT form_id, page, raw_text FROM form_pages WHERE trim(raw_text) <> ''", "form_pages")(lambda p: attempts.split_pages(attempts.assemble_pages(p)))
query("number_pages", "SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY (page + 1) % 2, page) AS page FROM form_pages", "form_pages")(lambda p: attempts.number_pages(p.withColumns({"file_ord": (F.col("page") + 1) % 2, "page_in_file": F.col("page")})).select("form_id", "page"))
query("form_status", "SELECT form_id, CASE WHEN count(*) FILTER (error IS NULL) > 0 THEN 'extracted' ELSE 'error' END AS status FROM attempts GROUP BY form_id", "attempts")(attempts.form_status)

# Layout
query("page_confidence", "SELECT form_id AS page_id, coalesce(avg(confidence) FILTER (confidence > 0), 0) AS confidence, count(*) FILTER (trim(raw_text) <> '') AS word_count FROM attempts GROUP BY form_id", "attempts")(lambda a: layout.page_confidence(a.select(F.col("form_id").alias("page_id"), F.col("raw_text").alias("text"), "confidence")))
query("assemble_lines", "SELECT form_id AS page_id, trim(string_agg(raw_text, chr(10) ORDER BY attempt_ord)) AS raw_text FROM attempts GROUP BY form_id", "attempts")(lambda a: layout.assemble_lines(a.select(F.col("form_id").alias("page_id"), F.col("attempt_ord").alias("line_no"), F.col("raw_text").alias("text"))))
query("kv_map", "SELECT form_id AS page_id, provider AS key, arg_max(raw_text, attempt_ord) AS value FROM attempts GROUP BY form_id, provider", "attempts")(lambda a: layout.kv_map(a.select(F.col("form_id").alias("page_id"), F.col("provider").alias("key"), F.col("raw_text").alias("value"), F.col("attempt_ord").alias("ord"))).select("page_id", F.explode("structured_data")))
query("tables_from_cells", "SELECT form_id AS page_id, max(page) + 1 AS row_count, max(attempt_ord) + 1 AS column_count, string_agg(raw_text, '|' ORDER BY page, attempt_ord) AS cells FROM attempts GROUP BY form_id", "attempts")(lambda a: layout.tables_from_cells(a.select(F.col("form_id").alias("page_id"), F.lit(0).alias("table_no"), F.col("page").alias("row_index"), F.col("attempt_ord").alias("column_index"), F.col("raw_text").alias("content"))).select("page_id", "row_count", "column_count", F.array_join(F.flatten("rows"), "|").alias("cells")))
query("selection_counts", "SELECT form_id AS page_id, count(*) FILTER (page = 1) AS n_selected, count(*) AS n_marks FROM attempts WHERE attempt_ord % 3 <> 0 GROUP BY form_id", "attempts")(lambda a: layout.selection_counts(layout.selection_marks(a.select(F.col("form_id").alias("page_id"), F.col("attempt_ord").cast("string").alias("block_id"), F.when(F.col("attempt_ord") % 3 != 0, "SELECTION_ELEMENT").otherwise("WORD").alias("block_type"), F.when(F.col("page") == 1, "SELECTED").otherwise("NOT_SELECTED").alias("selection_status"), "confidence"))))


def _blocks(a: DataFrame) -> DataFrame:
    """Key-value blocks from attempts: each attempt is a key (its provider) with a value (its text)."""
    i, page = F.col("attempt_ord").cast("string"), F.col("form_id").alias("page_id")
    rel = lambda *pairs: F.array(*[F.struct(F.lit(t).alias("type"), F.array(*x).alias("ids")) for t, x in pairs])
    none = F.lit(None).cast("array<struct<type:string,ids:array<string>>>")
    block = lambda p, kind, ents, text, r: a.select(page, F.concat(F.lit(p), i).alias("block_id"), F.lit(kind).alias("block_type"), F.array(*[F.lit(e) for e in ents]).cast("array<string>").alias("entity_types"), text.alias("text"), r.alias("relationships"))
    no = F.lit(None).cast("string")
    return block("k", "KEY_VALUE_SET", ["KEY"], no, rel(("VALUE", [F.concat(F.lit("v"), i)]), ("CHILD", [F.concat(F.lit("x"), i), F.concat(F.lit("y"), i)]))).unionByName(block("v", "KEY_VALUE_SET", ["VALUE"], no, rel(("CHILD", [F.concat(F.lit("w"), i)])))).unionByName(block("w", "WORD", [], F.col("raw_text"), none)).unionByName(block("x", "WORD", [], F.col("provider"), none)).unionByName(block("y", "WORD", [], F.concat(F.lit("#"), i), none))


query("assemble_key_values", "SELECT form_id AS page_id, provider || ' #' || attempt_ord AS key, raw_text AS value FROM attempts", "attempts")(lambda a: layout.assemble_key_values(_blocks(a)))

# Extraction


def _sql_clean(v: str, how: str) -> str:
    v = f"trim(regexp_replace(regexp_replace({v}, '[^\\p{{L}}\\p{{N}}_\\s@.,\\-+()/]', '', 'g'), '\\s+', ' ', 'g'))"
    words = f"array_to_string(list_transform(string_split({v}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    keep = lambda c: f"regexp_replace({v}, '[^{c}]', '', 'g')"
    return {"base": v, "name": words, "lower": f"lower({v})", "phone": keep("\\d+"), "date": keep("\\d/\\-."), "address": f"trim(trim({v}, ','))", "id": keep("\\d\\-"), "number": keep("\\d."), "upper": f"upper({v})"}[how]


def _sql_valid(v: str, check: str) -> str:
    digits = f"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    own = {"any": "true", "name": f"length({v}) BETWEEN 2 AND 50 AND regexp_matches({v}, '[a-zA-Z]')", "email": f"length({v}) >= 5 AND coalesce(contains(split_part({v}, '@', 2), '.'), false)", "phone": f"{digits} BETWEEN 10 AND 15", "date": f"length({v}) BETWEEN 8 AND 12", "address": f"length({v}) >= 10", "digits12": f"{digits} = 12", "digits6": f"{digits} = 6", "short": f"length({v}) BETWEEN 3 AND 100", "percent": f"coalesce(try_cast({v} AS double) BETWEEN 0 AND 100, false)"}
    return f"length({v}) >= 2 AND {own[check]}"


def extraction_sql(source: str, specs: tuple[fields.FieldSpec, ...]) -> str:
    raw = ", ".join(_sql_clean("regexp_extract(t, '(?im)" + p.replace("'", "''") + "', 1)", s.clean) + f" AS {s.name}_{k}" for s in specs for k, p in enumerate(s.patterns))
    out = ", ".join("coalesce(" + ", ".join(f"CASE WHEN {_sql_valid(f'{s.name}_{k}', s.check)} THEN {s.name}_{k} END" for k in range(len(s.patterns))) + f") AS {s.name}" for s in specs)
    return f"SELECT id, {out} FROM (SELECT id, {raw} FROM (SELECT id, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS t FROM {source} ) a) b"


for _group, _names in schemas.GROUPS.items():
    _specs = tuple(s for s in fields.SPECS if s.name in _names)
    query(f"extract_{_group}", extraction_sql("rendered", _specs), "rendered")(lambda r, s=_specs: fields.extract_fields(r, specs=s).select("id", *[x.name for x in s]))
_bare = tuple(s for s in fields.SPECS if s.name in ("email", "pincode", "date_of_birth"))
query("extract_free_text", extraction_sql("(SELECT doc_id AS id, text AS raw_text FROM documents)", _bare), "documents")(lambda d: fields.extract_fields(d.select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text")), specs=_bare).select("id", *[s.name for s in _bare]))
_pick = lambda *names: tuple(s for s in fields.SPECS if s.name in names)
_PROFILES = {
    "admission": _pick("student_name", "course_applied", "enrollment_number"),
    "contact": (*_pick("phone_number", "email"), fields.FieldSpec("student_name", "upper", "name", (r"(?:student\s+name)[:\s]+([a-z]+)",))),
}
_TYPED = ("student_name", "course_applied", "enrollment_number", "phone_number", "email")
_TYPED_SQL = " UNION ALL ".join("SELECT id, " + ", ".join(n if n in {s.name for s in specs} else f"NULL::varchar AS {n}" for n in _TYPED) + f" FROM ({extraction_sql(f'(SELECT * FROM rendered WHERE id % 3 = {k})', specs) if specs else 'SELECT id FROM rendered WHERE id % 3 = 2'}) t{k}" for k, specs in enumerate((*_PROFILES.values(), ())))
query("extract_by_form_type", _TYPED_SQL, "rendered")(lambda r: fields.extract_by_type(r.withColumn("form_type", F.element_at(F.array(*map(F.lit, (*_PROFILES, "other"))), (F.col("id") % 3 + 1).cast("int"))), "form_type", _PROFILES).select("id", *_TYPED))
query("validation_report", "SELECT id, 'aadhar_number' AS field, substr(aadhar_number, 1, 11) AS value FROM forms WHERE aadhar_number IS NOT NULL AND id % 2 = 0", "forms")(lambda f: fields.validation_report(f.withColumn("aadhar_number", F.when(F.col("id") % 2 == 0, F.substring("aadhar_number", 1, 11)).otherwise(F.col("aadhar_number")))))
_ALL_SQL = "SELECT id, e.field AS field, e.value AS value FROM (SELECT id, unnest([" + ", ".join(f"{{'field': '{n}', 'value': {n}}}" for n in schemas.FIELDS) + f"]) AS e FROM ({extraction_sql('rendered', fields.SPECS)}) x) y WHERE e.value IS NOT NULL"
query("extract_all_map", _ALL_SQL, "rendered")(lambda r: fields.extract_fields(r).select("id", F.explode(fields.to_structured(list(schemas.FIELDS))).alias("field", "value")))


def _lite_sql(source: str) -> str:
    get = lambda name, k=0, group=1: "trim(regexp_extract(t, '" + fields.LITE[name][k].replace("'", "''") + f"', {group}))"
    digits = lambda v: f"regexp_replace({v}, '[^\\d+]', '', 'g')"
    tidy = lambda v: f"array_to_string(list_transform(string_split(regexp_replace({v}, '\\s+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    between = lambda v, lo, hi: f"CASE WHEN length({v}) > {lo} AND length({v}) < {hi} THEN {v} END"
    check = fields.LITE["name_check"][0].replace("'", "''")
    names = ", ".join(f"CASE WHEN regexp_matches(n{k}, '{check}') AND length(n{k}) > 2 AND length(n{k}) < 50 THEN {tidy(f'n{k}')} END" for k in range(2))
    address = "array_to_string(list_filter(list_transform(string_split(ad, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ', ')"
    return f"""SELECT id, coalesce({names}) AS student_name, nullif(lower(em), '') AS email, coalesce({", ".join(between(f"p{k}", 9, 16) for k in range(3))}) AS phone_number, coalesce({", ".join(between(f"d{k}", 7, 13) for k in range(2))}) AS date_of_birth,
  CASE WHEN length({address}) > 10 THEN {address} END AS address, CASE WHEN length(gn) > 2 AND length(gn) < 50 THEN {tidy("gn")} END AS guardian_name, CASE WHEN length(gp) >= 10 THEN gp END AS guardian_phone, {between("co", 3, 100)} AS course_applied, {between("qu", 3, 100)} AS previous_qualification
FROM (SELECT id, {get("student_name")} AS n0, {get("student_name", 1)} AS n1, {get("email")} AS em, {digits(get("phone_number"))} AS p0, {digits(f"coalesce(nullif({get('phone_number', 1)}, ''), {get('phone_number', 1, 0)})")} AS p1, {get("phone_number", 2, 0)} AS p2,
  {get("date_of_birth")} AS d0, {get("date_of_birth", 1)} AS d1, {get("address")} AS ad, {get("guardian_name")} AS gn, {digits(get("guardian_phone"))} AS gp, {get("course_applied")} AS co, {get("previous_qualification")} AS qu FROM (SELECT id, raw_text AS t FROM {source} ) a) b"""


query("extract_lite", _lite_sql("rendered"), "rendered")(lambda r: fields.extract_fields_lite(r).drop("raw_text"))

# Elements
_marks = lambda c: c.select(F.col("conv_id").alias("doc_id"), F.concat(F.when(F.col("turn") % 2 == 0, "[x] yes\n( ) no\n☐\n\nlater\n● on\nGender: Male\nGrade - A\n").otherwise("[ ] off ☑ on\n"), "text").alias("text"))
_MARKS_SQL = "SELECT conv_id AS doc_id, string_split(CASE WHEN turn % 2 = 0 THEN '[x] yes\n( ) no\n☐\n\nlater\n● on\nGender: Male\nGrade - A\n' ELSE '[ ] off ☑ on\n' END || text, chr(10)) AS l FROM conversations"


def _marks_sql(patterns: tuple[str, ...]) -> str:
    """Marks on a line, less the one at its end if it and the next two lines say nothing more."""
    silent = " AND ".join(f"regexp_matches(coalesce(l[i + {k}], ''), '^\\s*$')" for k in (1, 2))
    return " + ".join(f"len(regexp_extract_all(l[i], '{p}')) - CASE WHEN regexp_matches(l[i], '{p}\\s*$') AND {silent} THEN 1 ELSE 0 END" for p in patterns)


_DROP_SQL = " + ".join(f"len(list_filter(regexp_extract_all(l[i], '{p}', 1), lambda x: regexp_matches(lower(x), '{'|'.join(elements.KEYWORDS)}')))" for p in elements.DROPDOWN)
_COUNTS_SQL = f"""SELECT doc_id, sum(cb)::bigint AS checkbox_count, sum(ra)::bigint AS radio_count, sum(dd)::bigint AS dropdown_count, sum(cb + ra + dd)::bigint AS total_elements
FROM (SELECT doc_id, {_marks_sql(elements.CHECKBOXES)} AS cb, {_marks_sql(elements.RADIOS)} AS ra, {_DROP_SQL} AS dd FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ({_MARKS_SQL}) a) b) c GROUP BY doc_id HAVING sum(cb + ra + dd) > 0"""
query("element_counts", _COUNTS_SQL, "conversations")(lambda c: elements.element_counts(elements.detect_elements(_marks(c))))
_TRIMMED = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_DROPDOWNS_SQL = " UNION ALL ".join(f"SELECT doc_id, i AS line, unnest(list_zip(regexp_extract_all(l[i], '{p}', 1), regexp_extract_all(l[i], '{p}', 2))) AS m FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ({_MARKS_SQL}) a) b{k}" for k, p in enumerate(elements.DROPDOWN))
query("dropdowns", f"SELECT doc_id, {_TRIMMED('m[1]')} AS label, {_TRIMMED('m[2]')} AS value, line::int AS line FROM ({_DROPDOWNS_SQL}) c WHERE regexp_matches(lower(m[1]), '{'|'.join(elements.KEYWORDS)}')", "conversations")(lambda c: elements.detect_dropdowns(_marks(c)).select("doc_id", "label", "value", "line"))


def _elements_sql() -> str:
    """Every element with its line and place: a match begins after the gaps and matches before it."""
    parts = []
    for kind, patterns, on in (("checkbox", elements.CHECKBOXES, elements.CHECKED), ("radio", elements.RADIOS, elements.SELECTED), ("dropdown", elements.DROPDOWN, ())):
        for p in patterns:
            below = f"coalesce(nullif({_TRIMMED('l[i + 1]')}, ''), nullif({_TRIMMED('l[i + 2]')}, ''))"
            text = f"nullif({_TRIMMED('l[i][place + length(m[k]) + 1:]')}, '')"
            label, value, checked = (_TRIMMED("a[k]"), _TRIMMED("b[k]"), "NULL::boolean") if kind == "dropdown" else (f"coalesce({text}, {below})", "NULL::varchar", "lower(a[k]) IN (" + ", ".join(f"'{c}'" for c in sorted(on)) + ")")
            second = f"regexp_extract_all(l[i], '{p}', {2 if kind == 'dropdown' else 0})"
            found = f"SELECT doc_id, l, i, regexp_extract_all(l[i], '{p}', 0) AS m, regexp_extract_all(l[i], '{p}', 1) AS a, {second} AS b, string_split_regex(l[i], '{p}') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ({_MARKS_SQL}) x) y"
            placed = f"SELECT *, (length(array_to_string(g[1:k], '')) + length(array_to_string(m[1:k - 1], '')))::int AS place FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM ({found}) z) w"
            parts.append(f"SELECT doc_id, '{kind}' AS type, {checked} AS checked, {label} AS label, {value} AS value, i::int AS line, place AS position FROM ({placed}) v")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) e WHERE CASE WHEN type = 'dropdown' THEN regexp_matches(lower(label), '{'|'.join(elements.KEYWORDS)}') ELSE label IS NOT NULL END"


query("element_rows", _elements_sql(), "conversations")(lambda c: elements.detect_elements(_marks(c)))

# Scalars
query("confidence", f"SELECT form_id, attempt_ord, CASE WHEN c <= 1 THEN c * 100 ELSE c END AS normal, CASE WHEN c IS NULL THEN 'neutral' WHEN CASE WHEN c <= 1 THEN c * 100 ELSE c END >= 90 THEN 'high' WHEN CASE WHEN c <= 1 THEN c * 100 ELSE c END >= 75 THEN 'medium' ELSE 'low' END AS band, CASE WHEN c IS NULL THEN 'n/a' ELSE cast(cast(round(cast(CASE WHEN c <= 1 THEN c * 100 ELSE c END AS decimal(20,10)), 1) AS decimal(18,1)) AS string) || '%' END AS text FROM (SELECT *, CASE WHEN attempt_ord % 2 = 0 THEN confidence / 100 ELSE confidence END AS c FROM attempts)", "attempts")(lambda a: a.withColumn("c", F.when(F.col("attempt_ord") % 2 == 0, F.col("confidence") / 100).otherwise(F.col("confidence"))).select("form_id", "attempt_ord", scalars.normalize_confidence(F.col("c")).alias("normal"), scalars.confidence_band(F.col("c")).alias("band"), scalars.format_confidence(F.col("c")).alias("text")))
query("labels", "SELECT id, CASE ocr_provider WHEN 'tesseract' THEN 'Tesseract (Local)' WHEN 'google' THEN 'Google Vision' WHEN 'azure-vision' THEN 'Azure Vision' ELSE 'MyOCR Own Ocr' END AS provider, CASE status WHEN 'verified' THEN 'Verified' WHEN 'extracted' THEN 'Pending Verification' ELSE 'Uploaded' END AS status FROM forms", "forms")(lambda f: f.select("id", scalars.provider_label(F.col("ocr_provider")).alias("provider"), scalars.status_label(F.col("status")).alias("status")))
query("file_sizes", "SELECT id, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN cast(cast(round(cast(file_size / 1024 AS decimal(30,10)), 2) AS decimal(28,2)) AS string) || ' KB' ELSE cast(cast(round(cast(file_size / 1048576 AS decimal(30,10)), 2) AS decimal(28,2)) AS string) || ' MB' END AS size FROM docs", "docs")(lambda d: d.select("id", scalars.format_size(F.col("file_size")).alias("size")))
query("resolve_provider", "SELECT id, CASE WHEN id % 2 = 0 THEN 'best' ELSE lower(ocr_provider) END AS provider FROM forms", "forms")(lambda f: f.select("id", scalars.resolve_provider(F.when(F.col("id") % 2 == 0, "MULTI").otherwise(""), F.col("ocr_provider"), "tesseract").alias("provider")))
query("error_category", "SELECT form_id, attempt_ord, CASE WHEN attempt_ord % 4 = 1 THEN 'tool_missing' WHEN attempt_ord % 4 = 2 THEN 'other' WHEN attempt_ord % 4 = 3 OR error IS NOT NULL THEN 'corrupt_image' END AS category FROM attempts", "attempts")(lambda a: a.withColumn("error", F.when(F.col("attempt_ord") % 4 == 1, "Tesseract is NOT FOUND here").when(F.col("attempt_ord") % 4 == 2, "out of memory").when(F.col("attempt_ord") % 4 == 3, "broken data stream when reading").otherwise(F.col("error"))).select("form_id", "attempt_ord", scalars.error_category(F.col("error")).alias("category")))
query("similarity", "SELECT id, CASE WHEN b = '' THEN 0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) END AS edits FROM (SELECT id, lower(student_name) AS a, email AS b FROM forms)", "forms")(lambda f: f.select("id", scalars.edit_similarity(scalars.norm_text(F.col("student_name")), F.col("email")).alias("edits")))
query("block_similarity", None, "forms")(lambda f: f.select("id", scalars.field_similarity(scalars.norm_text(F.col("student_name")), F.col("email")).alias("blocks")))
query("active_filters", "SELECT id, CASE WHEN aadhar_number IS NULL THEN 'status=' || status ELSE 'aadhar=' || aadhar_number || ',status=' || status END AS active FROM forms", "forms")(lambda f: f.select("id", F.array_join(F.transform(F.array_sort(F.map_entries(scalars.active_filters(F.create_map(F.lit("status"), "status", F.lit("email"), F.lit(""), F.lit("aadhar"), "aadhar_number")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("active")))
query("merge_info", "SELECT id, CASE WHEN id % 5 <> 0 THEN status END AS a, CASE id % 3 WHEN 0 THEN CASE WHEN id % 5 <> 0 THEN 'old' END ELSE 'new' END AS b, (CASE WHEN id % 5 <> 0 THEN 2 ELSE 0 END + CASE WHEN id % 5 = 0 AND id % 3 <> 0 THEN 1 ELSE 0 END)::int AS n FROM forms", "forms")(lambda f: f.withColumn("m", scalars.merge_info(F.when(F.col("id") % 5 != 0, F.create_map(F.lit("a"), "status", F.lit("b"), F.lit("old"))), F.when(F.col("id") % 3 != 0, F.create_map(F.lit("b"), F.lit("new"))))).select("id", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"), F.size("m").alias("n")))
query("format_date", "SELECT id, CASE id % 3 WHEN 0 THEN '-' WHEN 1 THEN strftime(upload_date, '%Y-%m-%d') ELSE 'on ' || id END AS shown FROM forms", "forms")(lambda f: f.select("id", scalars.format_date(F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, scalars.iso(F.col("upload_date"))).otherwise(F.concat(F.lit("on "), F.col("id").cast("string")))).alias("shown")))
query("parse_extraction", f"SELECT form_id, pages_processed, page, raw_text, confidence, provider FROM (SELECT *, count(*) OVER (PARTITION BY form_id) AS pages_processed FROM form_pages)", "form_pages")(lambda p: attempts.assemble_pages(p).select("form_id", scalars.parse_extraction(F.to_json(F.struct("raw_text", "confidence", "provider", "pages_processed", "page_results"))).alias("e")).select("form_id", F.col("e.pages_processed").cast("long").alias("pages_processed"), F.inline("e.page_results")))

# Changes
_patch = lambda f: f.filter("id % 3 = 0").select(F.col("id").alias("form_id"), F.when(F.col("id") % 2 == 0, " ").otherwise(F.concat(F.lit("New "), "student_name")).alias("student_name"), F.lit(None).cast("string").alias("email"), F.col("upload_date").alias("submitted_at"))
_VERIFIED_SQL = """SELECT f.id, CASE WHEN hit THEN 'New ' || student_name ELSE student_name END AS student_name, CASE WHEN NOT hit THEN email END AS email, CASE WHEN NOT hit THEN phone_number END AS phone_number, CASE WHEN NOT hit THEN course_applied END AS course_applied,
  CASE WHEN hit THEN 'verified' ELSE status END AS status, CASE WHEN hit THEN top + nth END AS student_profile_id
FROM (SELECT *, id % 3 = 0 AND id % 2 = 1 AS hit FROM forms ) f LEFT JOIN (SELECT student_name AS n, row_number() OVER (ORDER BY student_name) AS nth FROM (SELECT DISTINCT student_name FROM forms WHERE id % 3 = 0 AND id % 2 = 1) y) z ON f.student_name = n, (SELECT max(id) AS top FROM profiles ) t"""
query("apply_verifications", _VERIFIED_SQL, "forms", "profiles")(lambda f, p: changes.apply_verifications(f.withColumn("student_profile_id", F.lit(None).cast("long")), _patch(f), p)[0].select("id", "student_name", "email", "phone_number", "course_applied", "status", "student_profile_id"))
query("verified_profiles", "SELECT id, student_name, aadhar_number FROM profiles UNION ALL SELECT (SELECT max(id) FROM profiles ) + row_number() OVER (ORDER BY n), n, NULL FROM (SELECT DISTINCT 'New ' || student_name AS n FROM forms WHERE id % 3 = 0 AND id % 2 = 1) x", "forms", "profiles")(lambda f, p: changes.apply_verifications(f, _patch(f), p.withColumn("created_date", F.col("updated_date")))[2].select("id", "student_name", "aadhar_number"))
query("verification_rejects", "SELECT id AS form_id FROM forms WHERE id % 6 = 0", "forms")(lambda f: changes.apply_verifications(f, _patch(f))[1].select("form_id"))
query("apply_patches", "SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN ' ' ELSE 'New ' || student_name END ELSE student_name END AS student_name, email, CASE WHEN id % 3 = 0 THEN 'verified' ELSE status END AS status, coalesce(verified_date, CASE WHEN id % 3 = 0 THEN upload_date END) AS verified_date FROM forms", "forms")(lambda f: changes.apply_patches(f, _patch(f)).select("id", "student_name", "email", "status", "verified_date"))
_MANY_PATCHES = "(SELECT form_id, upload_date AS t, CASE id % 3 WHEN 0 THEN description || id WHEN 1 THEN '' END AS name, CASE WHEN id % 2 = 0 THEN file_path END AS mail FROM docs ) p"
_last = lambda c: f"(SELECT form_id, {c} FROM {_MANY_PATCHES} WHERE {c} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY form_id ORDER BY t DESC, {c} DESC) = 1) {c}_"
_MANY_SQL = f"""SELECT id, coalesce(name, student_name) AS student_name, coalesce(mail, email) AS email, CASE WHEN first IS NULL THEN status ELSE 'verified' END AS status, coalesce(verified_date, first) AS verified_date
FROM forms LEFT JOIN {_last('name')} ON name_.form_id = id LEFT JOIN {_last('mail')} ON mail_.form_id = id LEFT JOIN (SELECT form_id, min(t) AS first FROM {_MANY_PATCHES} WHERE name <> '' GROUP BY form_id) f ON f.form_id = id"""
_many = lambda d: d.select("form_id", F.col("upload_date").alias("submitted_at"), F.when(F.col("id") % 3 == 0, F.concat("description", F.col("id").cast("string"))).when(F.col("id") % 3 == 1, "").alias("student_name"), F.when(F.col("id") % 2 == 0, F.col("file_path")).alias("email"))
query("apply_many_patches", _MANY_SQL, "forms", "docs")(lambda f, d: changes.apply_patches(f, _many(d)).select("id", "student_name", "email", "status", "verified_date"))
query("autofill", "SELECT id, CASE WHEN id % 2 = 0 THEN 'x' ELSE student_name END AS student_name, coalesce(aadhar_number, CASE WHEN id % 2 = 0 THEN '1' END) AS aadhar_number FROM forms", "forms")(lambda f: changes.autofill(changes.autofill(f, f.filter("id % 2 = 0").select("id", F.lit("x").alias("student_name"), F.lit("").alias("email"))), f.filter("id % 2 = 0").select("id", F.lit("1").alias("aadhar_number")), overwrite=False).select("id", "student_name", "aadhar_number"))
query("upsert_profiles", "SELECT id, student_name, aadhar_number, coalesce(CASE WHEN id % 4 = 0 THEN timestamp '2024-01-01 00:00:00' END, updated_date) AS updated_date FROM profiles UNION ALL SELECT max(id) + 1, 'Zed', NULL, timestamp '2024-01-01 00:00:00' FROM profiles", "profiles")(lambda p: changes.upsert_profiles(p, p.filter("id % 4 = 0").select("student_name", F.coalesce("aadhar_number", F.lit("")).alias("aadhar_number"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("at")).union(p.sparkSession.sql("SELECT 'Zed', '', timestamp_ntz'2024-01-01 00:00:00'"))))
query("create_profiles", "SELECT id FROM profiles WHERE id % 5 = 1", "profiles")(lambda p: changes.create_profiles(p, p.withColumn("student_name", F.when(F.col("id") % 5 == 1, F.concat(F.lit("New "), "student_name")).otherwise(F.col("student_name"))))[0].select("id"))
query("attach_documents", "SELECT id, CASE WHEN form_id NOT IN (SELECT id FROM forms) THEN 'unknown form' WHEN student_profile_id NOT IN (SELECT id FROM profiles) THEN 'unknown profile' END AS reason FROM docs", "docs", "forms", "profiles")(lambda d, f, p: changes.attach_documents(d, f, p).select("id", "reason"))
query("delete_forms", "SELECT id, CASE WHEN form_id % 2 = 0 THEN NULL ELSE form_id END AS form_id FROM docs", "forms", "docs")(lambda f, d: changes.delete_forms(f, d, d.select(F.col("form_id").alias("id")).filter("id % 2 = 0"))[1].select("id", "form_id"))
query("forms_left", "SELECT id FROM forms WHERE id % 2 = 1", "forms", "docs")(lambda f, d: changes.delete_forms(f, d, f.select("id").filter("id % 2 = 0"))[0].select("id"))
query("delete_documents", "SELECT id FROM docs WHERE document_category <> 'Other'", "docs")(lambda d: changes.delete_documents(d, d.filter("document_category = 'Other'").select("id")).select("id"))
query("reextract", "SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'error' ELSE 'extracted' END ELSE status END AS status, CASE WHEN id % 6 = 3 THEN 'abbyy' ELSE ocr_provider END AS ocr_provider, CASE WHEN id % 6 = 3 THEN 'a@b.c' ELSE email END AS email FROM forms", "forms")(lambda f: changes.apply_reextraction(f, f.filter("id % 3 = 0").select(F.col("id").alias("form_id"), F.when(F.col("id") % 2 == 1, "abbyy").alias("provider")), f.filter("id % 6 = 3").select("id", F.lit("a@b.c").alias("email"))).select("id", "status", "ocr_provider", "email"))
query("prefill", "SELECT id, CASE WHEN status = 'verified' THEN email WHEN id % 2 = 0 THEN 's@t.u' ELSE email END AS email FROM forms", "forms")(lambda f: changes.prefill(f, f.filter("id % 2 = 0").select("id", F.lit("s@t.u").alias("email")), f.select("id", F.lit("l@m.n").alias("email"), F.lit("somewhere").alias("address"))).select("id", "email"))


# Evaluation
def _eval(r: DataFrame, how: str) -> DataFrame:
    parsed = fields.extract_fields(r, specs=tuple(s for s in fields.SPECS if s.name in ("email", "aadhar_number", "city")))
    long = parsed.unpivot(["id"], ["email", "aadhar_number", "city"], "field", "actual").withColumnRenamed("id", "sample_id")
    labels = long.select("sample_id", "field", F.when(F.col("sample_id") % 4 == 0, F.translate("actual", "1a", "7o")).otherwise(F.col("actual")).alias("expected"))
    return evaluate.evaluate_fields(labels, long, r.select(F.col("id").alias("sample_id"), "raw_text"), how)


_STRUCTURED_SQL = "SELECT sample_id, field, actual FROM (SELECT id AS sample_id, 'email' AS field, CASE WHEN id % 3 = 0 THEN 's@t.u' WHEN id % 3 = 1 THEN email END AS actual FROM ({}) x UNION ALL SELECT id, 'city', CASE WHEN id % 3 = 1 THEN city END FROM ({}) y) z WHERE actual IS NOT NULL"
_PARSED = tuple(s for s in fields.SPECS if s.name in ("email", "city"))
query("structured_or_parsed", _STRUCTURED_SQL.format(*[extraction_sql("rendered", _PARSED)] * 2), "rendered")(lambda r: evaluate.structured_or_parsed(r.select(F.col("id").alias("sample_id"), "raw_text", F.when(F.col("id") % 3 == 0, F.create_map(F.lit("email"), F.lit("s@t.u"))).alias("structured_data"), F.when(F.col("id") % 3 != 2, "srcc").alias("form_type")), _PARSED))
query("evaluate_blocks", None, "rendered")(lambda r: _eval(r, "blocks"))
_EVAL = tuple(s for s in fields.SPECS if s.name in ("email", "aadhar_number", "city"))
_LABELED_SQL = " UNION ALL ".join(f"SELECT id, lower(trim({s.name})) AS a, lower(trim(CASE WHEN id % 4 = 0 THEN translate({s.name}, '1a', '7o') ELSE {s.name} END)) AS e FROM ({extraction_sql('rendered', _EVAL)}) x_{s.name}" for s in _EVAL)
_SCORES_SQL = f"""SELECT id AS sample_id, {rounded("avg(r)", 6)} AS similarity, {rounded("avg(CASE WHEN r >= 0.999 THEN 1.0::double ELSE 0.0 END)", 6)} AS exact_rate, count(*) AS n_fields
FROM (SELECT id, 1 - levenshtein(e, a) / greatest(length(e), length(a), 1) AS r FROM ({_LABELED_SQL}) y WHERE coalesce(e, '') <> '') z GROUP BY id"""
query("score_samples", _SCORES_SQL, "rendered")(lambda r: evaluate.score_samples(_eval(r, "edits")).withColumns({c: scalars.round_at(F.col(c), 6) for c in ("similarity", "exact_rate")}))
query("provider_summary", f"SELECT provider, count(*) AS samples, {rounded('avg(confidence) FILTER (error IS NULL)', 2)} AS avg_confidence, {rounded('avg(confidence / 100) FILTER (error IS NULL)', 3)} AS avg_similarity, {rounded('avg(page) FILTER (error IS NULL)', 3)} AS avg_exact_rate, {rounded('avg(attempt_ord) FILTER (error IS NULL)', 2)} AS avg_time_ms, count(error) AS failures FROM attempts GROUP BY provider", "attempts")(lambda a: evaluate.provider_summary(a.select("provider", "confidence", (F.col("confidence") / 100).alias("similarity"), F.col("page").alias("exact_rate"), F.col("attempt_ord").alias("time_ms"), "error")))
query("throughput", "SELECT date_trunc('hour', ts) AS hour, event_type AS provider, count(*) AS forms, count(*) >= 60 AS on_target FROM events GROUP BY 1, 2", "events")(lambda e: evaluate.throughput(e.select("ts", F.col("event_type").alias("provider"))))
query("sla_breaches", "SELECT id FROM forms WHERE status = 'extracted' AND upload_date < timestamp '1997-01-01 00:00:00'", "forms")(lambda f: evaluate.sla_breaches(f, F.expr("timestamp_ntz'1997-01-02 00:00:00'")).select("id"))
query("expired_uploads", "SELECT id FROM forms WHERE upload_date < timestamp '1996-12-02 00:00:00'", "forms")(lambda f: evaluate.expired_uploads(f, F.expr("timestamp_ntz'1997-01-01 00:00:00'")).select("id"))
query("needs_review", "SELECT form_id, page FROM form_pages WHERE CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END < 80", "form_pages")(lambda p: evaluate.needs_review(p).select("form_id", "page"))
query("qc_sample", "SELECT id FROM forms WHERE status = 'verified' AND ('0x' || substr(md5(cast(id AS string)), 1, 6))::bigint % 100 < 7", "forms")(lambda f: evaluate.qc_sample(f, 7).select("id"))
query("cost_report", "SELECT canonical, count(*) AS pages, cast(round(cast(sum(price) AS decimal(20,10)), 4) AS double) AS estimated_cost FROM (SELECT CASE provider WHEN 'google' THEN 'google-vision' ELSE provider END AS canonical, cast(CASE provider WHEN 'google' THEN 0.0015 WHEN 'aws-textract' THEN 0.0015 WHEN 'abbyy' THEN 0.01 ELSE 0 END AS double) AS price FROM attempts) x GROUP BY canonical", "attempts")(lambda a: evaluate.cost_report(a, tables.provider_dim(a.sparkSession)))
query("impute_confidence", "SELECT form_id, attempt_ord, coalesce(confidence, CASE provider WHEN 'google' THEN CASE WHEN form_id % 4 < 2 THEN 0.0 ELSE 95.0 END WHEN 'aws-textract' THEN 85.0 WHEN 'abbyy' THEN 90.0 END)::double AS confidence FROM attempts", "attempts")(lambda a: evaluate.impute_confidence(a.withColumn("raw_text", F.when(F.col("form_id") % 4 == 0, " ").when(F.col("form_id") % 4 != 1, F.col("raw_text"))), tables.provider_dim(a.sparkSession)).select("form_id", "attempt_ord", "confidence"))
query("union_reports", "SELECT id, 'a' AS report, NULL AS status FROM forms WHERE status = 'verified' UNION ALL SELECT id, 'b', status FROM forms WHERE status <> 'verified'", "forms")(lambda f: evaluate.union_reports([f.filter("status = 'verified'").select("id", F.lit("a").alias("report")), f.filter("status <> 'verified'").select("id", F.lit("b").alias("report"), "status")]))
query("union_pages", "SELECT form_id, provider, row_number() OVER (PARTITION BY form_id ORDER BY provider <> 'user', page) AS page FROM form_pages", "form_pages")(lambda p: attempts.union_pages([p.filter("provider = 'user'"), p.filter("provider <> 'user'")]).select("form_id", "provider", "page"))
query("shown_pages", "SELECT form_id, CASE WHEN form_id % 3 = 0 THEN 1 ELSE count(*) END AS pages FROM form_pages GROUP BY form_id", "form_pages")(lambda p: attempts.assemble_pages(p).withColumns({"pages_processed": F.when(F.col("form_id") % 3 == 1, F.col("pages_processed")), "page_results": F.when(F.col("form_id") % 3 != 0, F.col("page_results"))}).select("form_id", attempts.shown_pages().cast("long").alias("pages")))
query("form_detail", "SELECT f.id, filename, f.status, student_name, email, NULL AS pincode, coalesce(ids, []) AS document_ids FROM forms f LEFT JOIN (SELECT form_id, list(id ORDER BY upload_date DESC, id DESC) AS ids FROM docs GROUP BY form_id) d ON form_id = f.id", "forms", "docs")(lambda f, d: relations.form_detail(f, d).select("id", "filename", "status", "student_name", "email", "pincode", F.col("documents.id").alias("document_ids")))

_FLAG = tuple(s for s in fields.SPECS if s.name in ("email", "phone_number"))
_FLAG_TEXT = f"(SELECT form_id AS id, coalesce({_PAGES}, '') AS raw_text FROM form_pages GROUP BY form_id)"
_FLAG_SQL = f"""SELECT form_id, confidence, pages_processed, email, phone_number, CASE WHEN c >= 90 THEN 'high' WHEN c >= 75 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT *, CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END AS c FROM (SELECT form_id, count(*) AS pages_processed, {rounded("coalesce(avg(confidence) FILTER (trim(raw_text) <> '' AND confidence <> 0), 0)", 2)} AS confidence FROM form_pages GROUP BY form_id) f) g
JOIN ({extraction_sql(_FLAG_TEXT, _FLAG)}) x ON x.id = g.form_id ORDER BY confidence DESC, form_id DESC LIMIT 20"""
query("flagship", _FLAG_SQL, "form_pages")(lambda p: fields.extract_fields(attempts.assemble_pages(p), specs=_FLAG).select("form_id", "confidence", "pages_processed", "email", "phone_number", scalars.confidence_band(F.col("confidence")).alias("band")).orderBy(F.desc("confidence"), F.desc("form_id")).limit(20))
