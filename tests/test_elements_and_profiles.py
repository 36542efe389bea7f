import random

import pytest
from pyspark.sql import functions as F

from formspark.functions import elements, fields

KINDS = ("checkbox", "radio", "dropdown")


def test_native_elements_equal_the_python_form(spark):
    rng = random.Random(1)
    bits = ["[x]", "( )", "[X]", "(x)", "☐", "☑", "✓", "□", "■", "○", "●", "(•)", "[•]", "\n", "\n\n", " ", "\t", " ", " ", "\x1c", "Gender: Male", "Grade - A", "class – b", "yes", "İx", "😀", "a:b", ": ", "Status: on - off"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", "x\n" * 5000 + "[x] end", "[x] same", "[x] same", "( ) " * 300]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, line string")
    for kinds, context in ((KINDS, 2), (KINDS, 0), (("radio",), 1), (("dropdown",), 3)):
        want = sorted(((i, *e) for i, t in enumerate(texts) for e in elements.elements_of(t, kinds, context)), key=repr)
        assert sorted(map(tuple, elements.marked(df, kinds, context).collect()), key=repr) == want
    assert elements.detect_elements(df.limit(0)).collect() == []
    assert "Python" not in elements.detect_elements(df)._jdf.queryExecution().toString()


def test_a_form_type_chooses_the_profile(spark):
    text = "Student Name: Ann Lee DOB: 01/02/2003 Email: a@b.org City: Pune"
    email, city = (next(s for s in fields.SPECS if s.name == n) for n in ("email", "city"))
    other = fields.FieldSpec("email", "lower", "any", (r"(?:email)[:\s]+([a-z]{2,})@",))
    rows = [(1, "x", text), (2, "y", text), (3, "z", text), (4, None, text), (5, "x", None)]
    df = spark.createDataFrame(rows, "id long, kind string, raw_text string")
    profiles = {"x": (email, city), "y": (other,), "w": ()}
    got = {r.id: (r.email, r.city) for r in fields.extract_by_type(df, "kind", profiles).collect()}
    assert got == {1: ("a@b.org", "Pune"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    got = {r.id: r.email for r in fields.extract_by_type(df, "kind", {"x": (email,), "y": (fields.FieldSpec("email", "upper", "any", email.patterns),)}, default="y").collect()}
    assert got == {1: "a@b.org", 2: "A@B.ORG", 3: "A@B.ORG", 4: "A@B.ORG", 5: None}
    with pytest.raises(ValueError):
        fields.extract_by_type(df, "kind", profiles, default="v")


def test_rendered_texts_are_dealt_over_tasks(spark):
    from formspark.plans.fixtures import view

    counts = [n for (n,) in view(spark, "/root/testdata/sf0.001", "rendered").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(counts) >= 16 and sum(counts) == 150 and max(counts) <= 20


def test_gated_patterns_equal_plain_ones(spark):
    rng = random.Random(3)
    labels = [a.replace(r"\s+", " ").replace("?", "") for s in fields.SPECS for p in s.patterns if p.startswith("(?:") for a in p[3 : p.index(")")].split("|")]
    bits = ["Ann Lee", "male", "F", "01/02/2003", "9-1-99", "1234 5678 9012", "560001", "+91 98765 43210", "a.b@c.org", "12,000.50", "98.5", "120", "2016", "R/12-3", "O+", "is 4 Main Road", "é", "İ", "😀", "K", "name", "dob", "&", "'", "_"]
    seps = [": ", " ", "\n", "\t", ":", "  ", " ", " ", "\r\n", ", "]
    texts = ["".join(rng.choice([rng.choice(labels), rng.choice(labels).title(), rng.choice(bits)]) + rng.choice(seps) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", " ", "name", "Name:", "NAME: ann lee DOB"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string")
    names = [s.name for s in fields.SPECS]
    for mode in ("collapsed", "lines"):
        whole = fields.collapse(F.col("raw_text")) if mode == "collapsed" else F.coalesce("raw_text", F.lit(""))
        plain = df.withColumn("t", whole).withColumns({f"{s.name}_{k}": fields.clean(F.regexp_extract("t", "(?im)" + p, 1), s.clean) for s in fields.SPECS for k, p in enumerate(s.patterns)})
        plain = plain.select("id", *[F.coalesce(*[F.when(fields.is_valid(F.col(f"{s.name}_{k}"), s.check), F.col(f"{s.name}_{k}")) for k in range(len(s.patterns))]).alias(s.name) for s in fields.SPECS])
        want, got = (sorted(map(tuple, x.select("id", *names).collect()), key=str) for x in (plain, fields.extract_fields(df, mode=mode)))
        assert got == want and sum(v is not None for row in want for v in row) > 1000


def test_labels_of_several_words():
    p = r"(?:phone|phone\s+no|student\s+phone|father'?s\s+tel|10th\s+%)[:\s]+(x)"
    assert fields.gate(p) == ("10th", "father", "phone", "student") and fields.gate(p, True) == ("10th %", "father", "phone", "student phone")
    assert fields.gate(r"(?:rooms?|hall\s+no)[:\s]+(x)", True) == ("hall no", "room") and fields.gate(r"(?:e?mail|post)[:\s]+(x)", True) == ()
    assert fields.led("(?:sex|gender)(x)", ("gender", "sex")) == "(?=[gs][e][nx])(?:sex|gender)(x)"
