"""Pages that the small tables don't have: queries over them against their SQL."""

import duckdb
import pytest

from corpusloom import oracles
from corpusloom import queries as engine


def against_sql(spark, folder, name, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    found = con.execute(oracles.ORACLES[name])
    names = [x[0] for x in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert want and sorted((tuple(r[c] for c in names) for r in engine.queries()[name](spark, str(folder)).collect()), key=repr) == want


def test_crawl_of_pages_with_equal_urls(spark, tmp_path):
    """Of pages 3 and 4 with one URL, the one with the least id leads on."""
    against_sql(spark, tmp_path, "crawl_visits", [(i, f"https://a.se/en/{3 if i == 4 else i}", "") for i in range(15)])


@pytest.mark.parametrize("name", ["page_main_text", "page_record", "page_sections", "page_title_parsed", "run_pages", "run_pages_json", "sites_saved"])
def test_titles_cut_within_a_reference(spark, tmp_path, name):
    """What is left of a reference without its semicolon is text."""
    page = '<html lang="en"><head><title>{0}</title></head><body><article><h1>{0}</h1><p>' + "A long sentence. " * 9 + "</p></article></body></html>"
    ends = ["&amp;", "&amp", "&am", "&", "&quot", "&lt", "&#39", "&ampx;"]
    against_sql(spark, tmp_path, name, [(i, f"https://a.se/en/{i}", page.format(f"Title&amp;{x}")) for i, x in enumerate(ends)])
