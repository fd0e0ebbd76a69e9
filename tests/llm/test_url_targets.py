"""Operator 5 judges the targets of links that are no pages of their own."""

from stratagraph.llm import url_filter

ROWS = [
    (1, "http://foo.org/a", "<link rel=canonical href=http://bad.net/x>"),
    (2, "http://foo.org/b", '<meta http-equiv="refresh" content="0; URL=http://bad.net/y">'),
    # An explicitly allowed target protects its component, page or not.
    (3, "http://foo.org/c", "<link rel=canonical href=http://bad.net/z><meta http-equiv=refresh content='0; url=http://free.org/fr/'>"),
    (4, "http://foo.org/d", None),
    (5, "http://foo.org/e", None),
    (6, "http://foo.org/f", "<link rel=canonical href=http://good.org/>"),
]


def test_targets_that_are_no_rows(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://foo.org/d", "http://hop.org/1"), ("http://hop.org/1", "https://BAD.net/q?1#x")], "src string, dst string")
    got = sorted((r["page_id"], r["verdict"], r["via"]) for r in url_filter.judge(pages, url_filter.RULES, redirects).collect())
    assert got == [(1, "block", "alias"), (2, "block", "alias"), (3, "allow", "none"), (4, "block", "alias"), (5, "allow", "none"), (6, "allow", "none")]
