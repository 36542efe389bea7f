import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from formspark.operators import ranked, search

START = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def forms(spark):
    """20,000 forms, a third of them at one time, some without a time or a status."""
    rng = random.Random(2)
    time = lambda i: START if i % 3 == 0 else None if i % 50 == 1 else START + dt.timedelta(minutes=rng.randrange(5000))
    rows = [(i, time(i), rng.choice(["verified", "extracted", "rare" if i % 500 == 0 else "verified", None]), f"name {i % 7}", i) for i in range(20000)]
    return spark.createDataFrame(rows, "id long, upload_date timestamp, status string, student_name string, n int").repartition(5)


@pytest.fixture(scope="module")
def kept(forms, tmp_path_factory):
    return ranked.write_ranked(forms, f"{tmp_path_factory.mktemp('ranked')}/forms", rows=1500)


def both(spark, forms, kept, skip, limit, where=None, **facets):
    found = forms if where is None else forms.filter(where)
    for name, value in facets.items():
        found = found.filter(F.col(name).eqNullSafe(F.lit(value)))
    return ranked.page_at(spark, kept, skip, limit, where, **facets).collect(), search.page_of(found, "upload_date", skip, limit).collect()


@pytest.mark.parametrize("skip, limit", [(0, 10), (9000, 100), (4090, 20), (19990, 100), (20000, 5), (0, 5000), (7, 0)])
def test_a_page_is_that_of_the_offset_form(spark, forms, kept, skip, limit):
    got, want = both(spark, forms, kept, skip, limit)
    assert got == want and len(want) == max(0, min(limit, 1000, 20000 - skip))


def test_pages_of_facets_and_conditions(spark, forms, kept):
    name = search.contains(F.col("student_name"), "NAME 3")
    for args in ((6000, 50, None, {"status": "verified"}), (5, 30, None, {"status": "rare"}), (4000, 40, None, {"status": None}), (2000, 60, name, {}), (700, 25, name, {"status": "extracted"}), (0, 5, None, {"status": "none such"})):
        got, want = both(spark, forms, kept, *args[:3], **args[3])
        assert got == want
    with pytest.raises(ValueError):
        ranked.page_at(spark, kept, student_name="name 3")


def test_a_deep_page_reads_one_range(spark, kept):
    page = ranked.page_at(spark, kept, 15000, 20)
    assert len({f.split("/")[-2] for f in page.inputFiles()}) == 1
    plan = page._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_place), GreaterThanOrEqual(_place" in plan


def test_empty_tables_and_own_names(spark, forms, tmp_path):
    path = ranked.write_ranked(forms.limit(0), f"{tmp_path}/none")
    page = ranked.page_at(spark, path, 3, 10)
    assert page.collect() == [] and page.columns == forms.columns
    with pytest.raises(ValueError):
        ranked.write_ranked(forms.withColumn("_place", F.lit(1)), f"{tmp_path}/clash")
    twice = forms.limit(300).unionByName(forms.limit(300))
    path = ranked.write_ranked(twice, f"{tmp_path}/twice", facets=(), rows=100)
    assert ranked.page_at(spark, path, 100, 200).collect() == search.page_of(twice, "upload_date", 100, 200).collect()
