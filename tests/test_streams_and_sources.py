import datetime as dt

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from formspark import schemas
from formspark.functions import elements, fields
from formspark.operators import changes, evaluate, layout, relations
from formspark.sources import sinks, tables
from formspark.streaming import jobs, snapshots

PAGE = "form_id long, page int, raw_text string, confidence double, provider string, ts timestamp, n_pages int"


def at(minute):
    return dt.datetime(2025, 1, 1, 0, minute) if minute < 60 else dt.datetime(2025, 1, 1, minute // 60, minute % 60)


def test_new_pages_are_extracted_once(spark, tmp_path):
    where, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n, mail in enumerate(("a@b.co", "c@d.org")):
        spark.createDataFrame([(n, 1, f"Email: {mail}", 90.0, "x", at(n), 1)], PAGE).write.mode("append").parquet(where)
        jobs.stream_extract(spark, where, out, mark).awaitTermination()
    assert sorted((r.form_id, r.email) for r in spark.read.parquet(out).collect()) == [(0, "a@b.co"), (1, "c@d.org")]


@pytest.fixture
def assembled(spark, tmp_path):
    """Gives all forms told after a batch of pages (form, page, text, minute, number of pages)."""
    where, out = str(tmp_path / "in"), str(tmp_path / "out")

    def batch(*rows, mark="mark"):
        if rows:
            spark.createDataFrame([(f, p, t, 9.0, f"x{p}", at(m), n) for f, p, t, m, n in rows], PAGE).coalesce(1).write.mode("append").parquet(where)
        told = jobs.stream_assemble(jobs.read_pages(spark, where))
        told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / mark)).trigger(availableNow=True).start(out + mark).awaitTermination()
        return {r.form_id: r for r in spark.read.parquet(out + mark).collect()}

    return batch


def test_pages_over_the_hour_are_one_form(assembled):
    assert assembled((1, 2, "b", 61, 2)) == {}
    got = assembled((1, 1, "a", 59, 2))
    assert [p.page for p in got[1].page_results] == [1, 2] and got[1].is_complete and got[1].closed_at == at(59)
    assert (got[1].raw_text, got[1].confidence, got[1].pages_processed, got[1].provider) == ("\n--- Page 1 ---\na\n\n--- Page 2 ---\nb", 9.0, 2, "x1")


def test_forms_that_lack_pages_are_told_when_their_time_ends(assembled):
    first = assembled((1, 1, "a", 5, 3), (2, 1, "c", 6, None), (3, 1, " ", 7, 1), (1, 1, "again", 8, 3), (1, 2, "b", 9, 3))
    assert {k: r.is_complete for k, r in first.items()} == {3: True}  # a missing tail is no complete form
    assembled((9, 1, "z", 130, 2))
    later = assembled((1, 3, "late", 20, 3), (3, 1, "once more", 131, 1))
    assert {k: (r.is_complete, [p.raw_text for p in r.page_results]) for k, r in later.items() if k < 3} == {1: (False, ["a", "b"]), 2: (None, ["c"])}
    assert later[1].closed_at == at(65) and later[3].raw_text in ("", "\n--- Page 1 ---\nonce more")
    once = assembled(mark="anew")  # all pages at once, from an empty checkpoint
    assert once[3].is_complete and (1 not in once or not once[1].is_complete or len(once[1].page_results) == 3)


CHANGE = "form_id long, student_name string, email string, submitted_at timestamp"


def forms_of(spark, n=40):
    cols = "student_name string, email string, additional_info map<string,string>, status string, verified_date timestamp"
    return spark.createDataFrame([(i, "ABC"[i % 3], "a@b.co" if i == 1 else None, {"k": "v"} if i == 2 else None, "extracted", None) for i in range(n)], f"id long, {cols}")


def test_patches_of_one_table_are_those_in_turn(spark):
    forms = forms_of(spark, 4)
    rows = [(1, "Anna", "new@x.y", at(1)), (1, None, "last@x.y", at(2)), (2, "", None, at(1)), (3, "Bob", None, at(3)), (3, "Bo", "b@o", at(1)), (9, "Zoe", None, at(1)), (None, "Q", None, at(1))]
    patches = spark.createDataFrame(rows, CHANGE)
    in_turn = forms
    for r in sorted(rows, key=lambda r: r[3]):
        in_turn = changes.apply_patches(in_turn, spark.createDataFrame([r], CHANGE))
    got = changes.apply_patches(forms, patches).collect()
    assert sorted(got) == sorted(in_turn.collect())
    assert {r.id: (r.student_name, r.email, r.status, r.verified_date) for r in got if r.id} == {1: ("Anna", "last@x.y", "verified", at(1)), 2: ("", None, "extracted", None), 3: ("Bob", "b@o", "verified", at(1))}
    info = spark.createDataFrame([(2, {"a": "b"}, at(1)), (3, None, at(1))], "form_id long, additional_info map<string,string>, submitted_at timestamp")
    assert {r.id: r.additional_info for r in changes.apply_patches(forms, info).collect()} == {0: None, 1: None, 2: {"a": "b"}, 3: None}
    assert sorted(changes.apply_patches(forms, patches.select("form_id", "submitted_at")).collect()) == sorted(forms.collect())


def test_a_parse_given_twice_fills_a_form_once(spark):
    forms = forms_of(spark, 3)
    parsed = spark.createDataFrame([(1, "x@y.z"), (1, "a@y.z"), (1, "x@y.z")], "id long, email string")
    assert [r.email for r in changes.autofill(forms, parsed).orderBy("id").collect()] == [None, "x@y.z", None]


def test_verifications_write_only_what_they_change(spark):
    forms = forms_of(spark).withColumn("student_profile_id", F.lit(None).cast("long"))
    profiles = spark.createDataFrame([(7, "Ann", None, None)], "id long, student_name string, aadhar_number string, updated_date timestamp")
    out, rejects, known = changes.apply_verifications(forms, spark.createDataFrame([(1, "Ann", None, at(1)), (2, " ", None, at(1)), (3, "Bo", "b@o", at(2)), (99, "Q", None, at(1))], CHANGE), profiles)
    got = {r.id: (r.student_name, r.email, r.status, r.student_profile_id) for r in out.collect()}
    assert len(got) == 40 and got[1] == ("Ann", None, "verified", 7) and got[3] == ("Bo", "b@o", "verified", 8) and got[2] == ("C", None, "extracted", None)
    assert [r.form_id for r in rejects.collect()] == [2] and known.count() == 2


def test_a_stream_of_changes_rewrites_no_base(spark, tmp_path):
    snap, where, mark = (str(tmp_path / x) for x in ("snap", "in", "mark"))
    jobs.write_snapshot(forms_of(spark), snap)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "snap/base").rglob("*.parquet")}
    before = files()
    batches = [(1, "Ann", None, at(5)), (1, "An", "old@x.y", at(2))], [(2, None, "b@c.co", at(2)), (1, "A", "older@x.y", at(1))], [(77, "New", None, at(3)), (78, None, "n@n", at(3))]
    for rows in batches:
        spark.createDataFrame(rows, CHANGE).write.mode("append").parquet(where)
        jobs.stream_upsert(spark.readStream.schema(CHANGE).parquet(where), snap, mark).awaitTermination()
    assert files() == before
    want = {i: ("ABC"[i % 3], None, "extracted", None) for i in range(40)} | {1: ("Ann", "old@x.y", "verified", at(1)), 2: ("C", "b@c.co", "extracted", None), 77: ("New", None, "verified", at(3)), 78: (None, "n@n", "uploaded", None)}
    state = lambda: {r.id: (r.student_name, r.email, r.status, r.verified_date) for r in jobs.read_snapshot(spark, snap).collect()}
    assert state() == want
    at_once = changes.apply_patches(forms_of(spark), spark.createDataFrame([r for b in batches for r in b], CHANGE), insert=True)
    assert sorted(jobs.read_snapshot(spark, snap).collect(), key=lambda r: r.id) == sorted(at_once.collect(), key=lambda r: r.id)
    assert snapshots.fold_snapshot(spark, snap) == 1 and state() == want
    spark.createDataFrame([(1, "Late", None, at(0)), (2, "B", None, at(9))], CHANGE).write.mode("append").parquet(where)  # older than what was folded
    jobs.stream_upsert(spark.readStream.schema(CHANGE).parquet(where), snap, mark, fold_every=1).awaitTermination()
    assert state() == want | {1: ("Ann", "old@x.y", "verified", at(0)), 2: ("B", "b@c.co", "verified", at(9))} and snapshots.version_of(spark, snap) == 2


def test_a_batch_that_dies_leaves_a_snapshot(spark, tmp_path, monkeypatch):
    snap, where, mark = (str(tmp_path / x) for x in ("snap", "in", "mark"))
    jobs.write_snapshot(forms_of(spark, 3), snap)
    spark.createDataFrame([(1, "Ann", None, at(5))], CHANGE).write.parquet(where)
    run = lambda: jobs.stream_upsert(spark.readStream.schema(CHANGE).parquet(where), snap, mark, fold_every=1).awaitTermination()
    names = lambda: sorted(r.student_name for r in jobs.read_snapshot(spark, snap).collect())
    publish = snapshots._publish

    def dies(forms, path, version):
        forms.write.parquet(f"{path}/base/version={version}")
        raise OSError("gone")

    monkeypatch.setattr(snapshots, "_publish", dies)
    with pytest.raises(Exception, match="gone"):
        run()
    assert names() == ["A", "Ann", "C"] and snapshots.version_of(spark, snap) == 0  # the new base isn't known
    monkeypatch.setattr(snapshots, "_publish", publish)
    run()
    assert names() == ["A", "Ann", "C"] and snapshots.version_of(spark, snap) == 1


def test_forms_not_verified_in_time_are_told_once(spark, tmp_path):
    e, v, out, mark = (str(tmp_path / x) for x in ("e", "v", "out", "mark"))
    es, vs = "form_id long, extracted_at timestamp", "form_id long, verified_at timestamp"

    def batch(extracted, verified):
        spark.createDataFrame([(f, dt.datetime(2025, 1, d) + dt.timedelta(hours=h)) for f, d, h in extracted], es).coalesce(1).write.mode("append").parquet(e)
        spark.createDataFrame([(f, dt.datetime(2025, 1, d) + dt.timedelta(hours=h)) for f, d, h in verified], vs).coalesce(1).write.mode("append").parquet(v)
        told = jobs.stream_sla(spark.readStream.schema(es).parquet(e), spark.readStream.schema(vs).parquet(v))
        told.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.form_id for r in spark.read.parquet(out).collect())

    assert batch([(1, 1, 8), (2, 1, 10), (3, 1, 11), (4, 1, 12)], [(1, 1, 20)]) == []
    assert batch([(5, 2, 10)], [(8, 2, 10)]) == []
    assert batch([], [(2, 2, 9.5), (3, 2, 12)]) == []  # 2 comes late, but within the watermark's hour; 3 is an hour too late
    batch([(6, 4, 0)], [(9, 4, 0)])
    assert batch([], []) == [3, 4, 5]
    batch([(7, 6, 0)], [(9, 6, 0)])
    assert batch([], []) == [3, 4, 5, 6]


def test_pages_are_split_once_a_batch(spark, tmp_path):
    where, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = [(1, 1, "a", 9.0, "x", at(1), 1), (None, 1, "a", 9.0, "x", at(1), 1), (2, 0, "a", 9.0, "x", at(1), 1), (3, 1, None, None, "x", at(1), 1), (4, 1, "a", 900.0, "x", at(1), 1), (5, 1, "", None, "x", at(1), 1)]
    spark.createDataFrame(rows, PAGE).write.parquet(where)
    for again in range(2):
        jobs.stream_pages(jobs.read_pages(spark, where), out, f"{mark}{again}").awaitTermination()  # the second applies batch 0 again
        assert sorted(r.form_id for r in spark.read.parquet(f"{out}/accepted").collect()) == [1, 5]
        assert {(r.form_id, r.reason) for r in spark.read.parquet(f"{out}/rejected").collect()} == {(None, "no form"), (2, "page number"), (3, "nothing recognized"), (4, "confidence")}


def test_manifests_are_split(spark, tmp_path):
    where, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    own = "filename string, size long"
    for rows in ([("a.pdf", 5), ("b.exe", 5)], [("c.png", 11 << 20)]):
        spark.createDataFrame(rows, own).write.mode("append").parquet(where)
        jobs.stream_intake(spark.readStream.schema(own).parquet(where), out, mark).awaitTermination()
    assert sorted((r.filename, r.accepted, r.reason) for r in spark.read.parquet(out).collect()) == [("a.pdf", "true", None), ("b.exe", "false", "extension"), ("c.png", "false", "size")]


def test_a_row_that_fails_spoils_no_other(spark):
    calls = spark.sparkContext.accumulator(0)

    def extract(rows: pd.DataFrame) -> pd.DataFrame:
        calls.add(1)
        if (rows["raw_text"] == "bad").any():
            raise ValueError("no text")
        rows = rows[rows["raw_text"] != "lost"]
        return pd.DataFrame({"id": rows["id"], "raw_text": rows["raw_text"].str.upper(), "confidence": 50.0, "structured": [{"k": "v"}] * len(rows), "provider": "own"})

    texts = {i: "bad" if i in (7, 300) else "lost" if i == 9 else f"t{i}" for i in range(512)}
    df = spark.createDataFrame(list(texts.items()), "id long, raw_text string").coalesce(1)
    got = {r.id: (r.raw_text, r.provider, r.error) for r in jobs.with_extractor(df, extract).collect()}
    assert got == {i: (None, None, "ValueError: no text") if t == "bad" else (None, None, "no result") if t == "lost" else (t.upper(), "own", None) for i, t in texts.items()}
    assert calls.value <= 2 * 2 * 10  # not one call a row


def test_samples_meet_their_files(spark):
    labels = spark.createDataFrame([("b.json", None, None), ("a.json", "x.png", None), ("c.json", None, "")], "label string, file string, filename string")
    files = spark.createDataFrame([("in/x.png", "x.png"), ("in/b.pdf", "b.pdf")], "path string, filename string")
    assert [(r.sample_id, r.path) for r in tables.discover_samples(labels, files).collect()] == [("a", "in/x.png"), ("b", "in/b.pdf"), ("c", None)]
    assert [r.sample_id for r in tables.discover_samples(labels, files, only_ids=["B", "A"], limit=1).collect()] == ["a"]
    twice = files.union(spark.createDataFrame([("in2/x.png", "x.png"), ("in2/b.tif", "b.tif")], files.schema))
    assert [(r.sample_id, r.path) for r in tables.discover_samples(labels, twice, missing="error").filter("sample_id <> 'c'").collect()] == [("a", "in/x.png"), ("b", "in/b.pdf")]
    with pytest.raises(PySparkException, match="no raw file for sample c"):
        tables.discover_samples(labels, files, missing="error").collect()


def test_readers_keep_their_schemas(spark, tmp_path):
    for read, schema in ((tables.read_forms, schemas.FORMS), (tables.read_profiles, schemas.PROFILES), (tables.read_documents, schemas.DOCUMENTS), (tables.read_attempts, schemas.ATTEMPTS)):
        path = str(tmp_path / read.__name__)
        empty = spark.createDataFrame([], schema)
        empty.write.parquet(path)
        assert read(spark, path).columns == empty.columns and read(spark, path).count() == 0


def test_best_needs_two_providers(spark):
    names = lambda enabled: {r.name for r in tables.provider_dim(spark, enabled).collect()}
    assert names(["tesseract"]) == {"tesseract"} and {"best", "multi", "google"} <= names(["tesseract", "google-vision"])
    assert tables.category_dim(spark).count() == 7


def test_reports_are_written(spark, tmp_path):
    samples = spark.createDataFrame([("a", 90.0, 1.0, 1.0, 5.0, None), ("a", None, None, None, None, "boom"), ("b", None, None, None, None, "boom")], "provider string, confidence double, similarity double, exact_rate double, time_ms double, error string")
    summary = evaluate.provider_summary(samples)
    assert {r.provider: (r.samples, r.avg_confidence, r.failures) for r in summary.collect()} == {"a": (2, 90.0, 1), "b": (1, None, 1)}
    sinks.write_report(summary, samples, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary")).count() == 2 and spark.read.parquet(str(tmp_path / "r/details")).count() == 3


def test_the_miner_is_a_table_function(spark):
    spark.udtf.register("form_elements", elements.FormElements)
    rows = spark.sql("SELECT t.id, e.* FROM VALUES (1, '[x] yes\\n☐\\nlater'), (2, '( ) no'), (3, NULL), (4, 'My Gender: Male') AS t(id, text), LATERAL form_elements(t.text) e").collect()
    assert {(r.type, r.label, r.value, r.line, r.position) for r in rows if r.id == 4} == {("dropdown", "My Gender", "Male", 1, 0)} and {r.position for r in rows} == {0}
    rows = [r for r in rows if r.id < 4]
    assert {(r.id, r.type, r.checked, r.label, r.line) for r in rows} == {(1, "checkbox", True, "yes", 1), (1, "checkbox", False, "later", 2), (2, "checkbox", False, "no", 1), (2, "radio", False, "no", 1)}


def test_own_specs_and_form_types(spark):
    own = (fields.FieldSpec("room", "upper", "any", (r"(?:room)[:\s]+([a-z]\d+)",)),)
    df = spark.createDataFrame([(1, "Room: b12", True), (2, "Room: c3", False)], "id long, raw_text string, known boolean")
    assert {r.id: r.room for r in fields.extract_fields(df, specs=own, form_type=F.col("known")).collect()} == {1: "B12", 2: None}


def test_checks_of_filled_fields(spark):
    df = spark.createDataFrame([(1, "a@b", "500001"), (2, "a@b.co", "12"), (3, None, " ")], "id long, email string, pincode string")
    assert sorted((r.id, r.field) for r in fields.validation_report(df).collect()) == [(1, "email"), (2, "pincode")]


def test_links_take_empty_and_null_numbers_as_the_same(spark):
    forms = spark.createDataFrame([(1, "A", None, 7), (2, "A", "", None), (3, "B", "1", None), (4, "C", None, None)], "id long, student_name string, aadhar_number string, student_profile_id long")
    profiles = spark.createDataFrame([(10, "A", ""), (11, "B", "1"), (12, "B", None)], "id long, student_name string, aadhar_number string")
    assert {r.id: r.student_profile_id for r in relations.link_profiles(forms, profiles).collect()} == {1: 10, 2: 10, 3: 11, 4: None}


def test_equal_times_give_one_change(spark):
    rows = [(1, "A", at(1)), (1, "B", at(1)), (2, None, at(1))]
    own = "form_id long, student_name string, submitted_at timestamp"
    got = [{r.form_id: r.student_name for r in changes.latest(spark.createDataFrame(x, own)).collect()} for x in (rows, rows[::-1])]
    assert got[0] == got[1] == {1: "B", 2: None}


def test_confidence_of_words_blocks_and_pages(spark):
    words = spark.createDataFrame([(1, "a", 80.0), (1, " ", 0.0), (2, None, -1.0)], "page_id long, text string, confidence double")
    got = lambda mode: {r.page_id: (r.confidence, r.word_count) for r in layout.page_confidence(words, mode).collect()}
    assert got("word") == {1: (80.0, 1), 2: (0.0, 0)} and got("block")[2][0] == -1.0 and got("page")[1][0] == 4000.0
    with pytest.raises((KeyError, PySparkException)):
        layout.page_confidence(words, "no such mode")
