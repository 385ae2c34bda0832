"""Main texts of pages that mark their article: differencing decides first, the markup is checked after it."""

from __future__ import annotations

from loomrec.llm import pages


def test_marked_pages_are_differenced_and_checked(spark):
    def page(i):
        return f"<p>Welcome to the site</p><p>teaser {i} of the day</p><article><h1>Title {i}</h1><p>a passage of all</p><p>story number {i} at some length</p></article>"

    rows = [(i, f"http://h/a/{i}", page(i)) for i in range(6)] + [(9, "http://alone/1", page(9)), (10, "http://h/a/7", None)]
    got = {r["page_id"]: r for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i]["text"] == f"Title {i} a passage of all story number {i} at some length"
        assert (got[i]["n_template"], got[i]["n_restored"], got[i]["n_dropped"]) == (2, 1, 1)
    assert (got[9]["text"], got[9]["n_template"], got[9]["n_dropped"]) == ("Title 9 a passage of all story number 9 at some length", 0, 2)
    assert got[10]["text"] == "" and got[10]["n_template"] == 0
