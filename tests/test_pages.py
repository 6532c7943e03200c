from __future__ import annotations

import duckdb
import pytest

from fathomline.plans import catalog

PAGES = [
    "<html><title>one token = &quot</title><body><h1>one token = &quot</h1><p>a &amp b &ampc &quot;d&quot; &copy 1 &copy; 2 &middot x &quo",
    "<title>A &amp; B &am</title><h1>&quotX; &copyright;</h1><a href='/x?a=1&copy=2&amp;b=3'>next &middot</a><p>&amp;quot; &amp;quot",
    "<title>plain</title><h1>plain</h1><script>a&&b&copy</script>text",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    rows = [(i, "http://a.test/p", page) for i, page in enumerate(PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def test_cut_entities_in_texts_stay_as_in_the_sql(spark, folder):
    assert_equal(spark, folder, "html_text")


@pytest.mark.parametrize("name", ["page_titles", "page_links"])
def test_cut_entities_in_elements_stay_as_in_the_sql(spark, folder, name):
    assert_equal(spark, folder, name)


def assert_equal(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
