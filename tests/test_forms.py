import datetime as dt

import pytest
from pyspark.sql import functions as F

from formspark import schemas, ship
from formspark.functions import elements, fields, scalars
from formspark.operators import attempts, changes, lineage, relations, search
from formspark.sources import sinks, tables


@pytest.fixture(scope="module")
def forms(spark):
    rows = [
        (1, "sample.pdf", dt.datetime(2025, 4, 10, 9, 30), "verified", "Alice Johnson", "B.Com"),
        (2, "b.exe", dt.datetime(2025, 5, 5, 14), "extracted", "Bob Smith", "BBA"),
        (3, "SRCC c.PNG", dt.datetime(2025, 4, 30, 23, 59, 59, 999999), "verified", "", "BSC"),
        (4, "d.jpg", dt.datetime(2025, 5, 1), None, None, None),
    ]
    return spark.createDataFrame(rows, "id long, filename string, upload_date timestamp, status string, student_name string, course_applied string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(forms):
    assert ids(search.search_forms(forms, student_name=" alice ")) == [1]
    assert ids(search.search_forms(forms, date_from="2025-04-01", date_to="2025-04-30")) == [1, 3]
    assert ids(search.search_forms(forms, status="extracted", course_applied="bb")) == [2]
    assert ids(search.search_forms(forms, student_name="", status=None)) == [1, 2, 3, 4]
    assert ids(search.search_forms(forms, student_name="%")) == [1, 2, 3] and ids(search.search_forms(forms, student_name="%", literal=True)) == []
    assert ids(search.export_forms(forms)) == [1, 3]
    assert [r.id for r in search.list_forms(forms, 1, 2).collect()] == [4, 3]


def test_exports(spark, forms, tmp_path):
    full = forms.withColumn("additional_info", F.create_map(F.lit("remarks"), F.lit('a "b", é\n')))
    assert len(search.export_view(full).columns) == 51 and search.export_view(full).columns[0] == "Form ID"
    sinks.export_csv(full, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True)
    assert len(back.columns) == 51 and back.filter("`Form ID` = 1").first()["Upload Date"] == "2025-04-10T09:30:00"
    sinks.export_json(full.drop("additional_info").withColumn("additional_info", F.lit(None).cast("map<string,string>")), {"status": "verified", "email": ""}, str(tmp_path / "json"))
    about = spark.read.json(str(tmp_path / "json/manifest")).first()
    assert about["count"] == 4 and about.filters.asDict() == {"status": "verified"} and len(about.generated_at) in (19, 26)
    assert back.filter("`Form ID` = 3").first()["Upload Date"] == "2025-04-30T23:59:59.999999"


def test_parser_text(spark):
    text = "  Name: John Doe\n  Date of Birth: 01/01/2000\n  Phone: 1234567890\n  Email: john@example.com\n  Enrollment Number: ENR2024001"
    row = fields.extract_fields(spark.createDataFrame([(1, text), (2, None)], "id long, raw_text string")).collect()
    assert (row[0].date_of_birth, row[0].phone_number, row[0].email, row[0].enrollment_number) == ("01/01/2000", "1234567890", "john@example.com", "ENR2024001")
    assert all(row[1][f] is None for f in schemas.FIELDS)


def test_best_attempt_ties_and_failures(spark):
    rows = [(1, 1, 1, "a", "t", 50.0, None), (1, 1, 2, "b", "u", 50.0, None), (1, 2, 1, "a", None, None, "boom")]
    df = spark.createDataFrame(rows, "form_id long, page int, attempt_ord int, provider string, raw_text string, confidence double, error string")
    assert [(r.page, r.provider) for r in attempts.best_attempt(df).collect()] == [(1, "a")]
    assert sorted((r.page, r.error) for r in attempts.best_attempt(df, "error").collect()) == [(1, None), (2, "boom")]


def test_intake_elements_and_scalars(spark, forms):
    got = {r.id: r.reason for r in tables.validate_intake(forms.withColumn("size", F.when(F.col("id") == 4, 11 << 20).otherwise(5))).collect()}
    assert got == {1: None, 2: "extension", 3: None, 4: "size"}
    text = "[x] one ( ) two\n☐\n\nlater\n● on\nGender: Male"
    rows = elements.detect_elements(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert ("checkbox", False, "later", 2) in {(r.type, r.checked, r.label, r.line) for r in rows} or ("checkbox", False, "later", 2, 0) in {(r.type, r.checked, r.label, r.line, r.position) for r in rows}
    assert ("radio", True, "on") in {(r.type, r.checked, r.label) for r in rows} and ("dropdown", "Gender", "Male") in {(r.type, r.label, r.value) for r in rows}
    one = spark.range(1).select(scalars.field_similarity(F.lit("abcd"), F.lit("bcde")).alias("s"), scalars.confidence_band(F.lit(0.95)).alias("b")).first()
    assert (one.s, one.b) == (0.75, "high")


def test_upserted_profiles_get_new_ids(spark):
    p = spark.createDataFrame([(5, "A", None, None), (9, "B", "1", None)], "id long, student_name string, aadhar_number string, updated_date timestamp")
    keys = spark.createDataFrame([("A", "", dt.datetime(2025, 1, 1)), ("C", None, dt.datetime(2025, 1, 2)), ("D", "2", dt.datetime(2025, 1, 2))], "student_name string, aadhar_number string, at timestamp")
    rows = changes.upsert_profiles(p, keys).collect()
    assert sorted((r.id, r.student_name) for r in rows) == [(5, "A"), (9, "B"), (10, "C"), (11, "D")]


def test_a_new_extraction_replaces_the_old(spark):
    forms = spark.createDataFrame([], schemas.FORMS).select("id", "status", "ocr_provider", "email", "extracted_data")
    old = ("old", 1.0, None, "a", 1, None, 1, [])
    forms = spark.createDataFrame([(i, "uploaded", "a", None, old) for i in (1, 2, 3)], forms.schema)
    new = spark.createDataFrame([(1, "new", 80.0, "b", 2), (2, None, None, None, None)], "form_id long, raw_text string, confidence double, provider string, pages_processed int")
    got = {r.id: r for r in changes.apply_reextraction(forms, new, spark.createDataFrame([(1, "x@y.z")], "id long, email string")).collect()}
    assert {i: (r.status, r.ocr_provider, r.email, r.extracted_data.raw_text, r.extracted_data.pages_processed, r.extracted_data.word_count) for i, r in got.items()} == {1: ("extracted", "b", "x@y.z", "new", 2, None), 2: ("error", "a", None, "old", 1, 1), 3: ("uploaded", "a", None, "old", 1, 1)}


def test_extractions_from_json(spark):
    text = '{"raw_text": "t", "confidence": 9.5, "structured_data": {"a": "b"}, "page_results": [{"page": 1, "raw_text": "t"}], "other": 1}'
    rows = spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "id long, x string").select("id", scalars.parse_extraction(F.col("x")).alias("e")).orderBy("id").collect()
    assert (rows[0].e.raw_text, rows[0].e.confidence, rows[0].e.structured_data, rows[0].e.page_results[0].page, rows[0].e.provider) == ("t", 9.5, {"a": "b"}, 1, None)
    assert rows[1].e is None or rows[1].e.raw_text is None
    assert rows[2].e is None


def test_forms_of_unknown_profiles_stay_without_one(spark, forms):
    profiles = spark.createDataFrame([(7, "Alice Johnson", None)], "id long, student_name string, aadhar_number string")
    got = {r.id: r.student_profile_id for r in relations.link_profiles(forms.withColumn("aadhar_number", F.lit("")), profiles).collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None}
    assert ids(relations.existing_profiles(forms.withColumn("aadhar_number", F.lit(None).cast("string")), profiles)) == [1]


def test_labels_raise_first_letters_only(spark):
    rows = spark.createDataFrame([("myOCR-x_two",), ("google",), ("",), (None,), ("GOOGLE-VISION",)], "p string").select(scalars.provider_label(F.col("p")).alias("l")).collect()
    assert [r.l for r in rows] == ["MyOCR X Two", "Google Vision", "Not specified", "Not specified", "Google Vision"]


def test_detail_has_every_part(spark, forms):
    docs = spark.createDataFrame([], schemas.DOCUMENTS)
    out = relations.form_detail(forms.withColumn("file_path", F.lit("x")), docs)
    assert out.columns == list(schemas.DETAIL) and out.count() == 4 and out.first().documents == []


def test_folders_are_refused_where_tasks_run_elsewhere():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session())


def test_the_package_is_sent_to_other_machines(tmp_path):
    import zipfile

    class Context:
        master, environment, listFiles = "local-cluster[1,1,512]", {}, []

        def addPyFile(self, path):
            self.listFiles = [*self.listFiles, path]

    session = type("Session", (), {"sparkContext": Context()})()
    ship.ship(session)
    ship.ship(session)
    assert len(session.sparkContext.listFiles) == 1
    assert "formspark/operators/attempts.py" in zipfile.ZipFile(session.sparkContext.listFiles[0]).namelist()


def test_gates_begin_every_match():
    assert fields.gate(r"(?:e?mail|post)[:\s]+(x)") == () and fields.gate(r"(?:Room|hall)[:\s]+(x)") == () and fields.gate(r"(?:rooms?|hall\s+no)[:\s]+(x)") == ("hall", "room")
    assert fields.gate(r"(x@y)") == ("@",) and fields.gate(r"(\d{6})") == ()
    assert all(fields.gate(p) or not p.startswith("(?:") for s in fields.SPECS for p in s.patterns)


def test_labels_after_letters_that_lower_to_two(spark):
    df = spark.createDataFrame([(1, "İİİİİİ Email: a@b.co Religion: None at all"), (2, "religious EMAIL Email: c@d.co")], "id long, raw_text string")
    assert {r.id: (r.email, r.religion) for r in fields.extract_fields(df).collect()} == {1: ("a@b.co", "None At All"), 2: ("c@d.co", None)}


def test_matching_blocks_equal_the_librarys():
    import difflib
    import random

    from formspark.functions.matching import ratios

    rng = random.Random(5)
    text = lambda n, some: "".join(rng.choice(some) for _ in range(n))
    pairs = [("", ""), ("a", ""), ("", "b"), ("é🙂", "🙂é")]
    for some in ("ab", "abcdef ", "abcdefghijklmnopqrstuvwxyz éü🙂"):
        pairs += [(text(rng.randint(0, 40), some), text(rng.randint(0, 40), some)) for _ in range(300)]
    for some in ("abc", "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(300, 500)))):  # with and without frequent characters
        for _ in range(25):
            x, y, k = text(rng.randint(0, 500), some), text(rng.randint(150, 500), some), rng.randrange(150)
            pairs += [(x, y), (y[:k] + "##" + y[k + 3 :] + x[:20], y)]
    assert ratios(*map(list, zip(*pairs))).tolist() == [difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert ratios([], []).tolist() == []
