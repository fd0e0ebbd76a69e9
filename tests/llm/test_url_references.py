"""Links of pages are taken by the rules of URLs."""

from urllib.parse import urljoin

from stratagraph.llm import url_filter


def test_references_like_the_standard_library(spark):
    pages = ["http://a.com/x/y", "https://A.com/p?x=1", "http://a.com", "http://a.com/d/e/f/"]
    links = ["../z", "./z2", "?x=2", "z3", "/r/./s/../t", "//B.org/u/../v", "https://c.net/w/..", "../../../../q", ".", "..", "g;x=1/../y", "a/./b/", "/x?p=../q", "k#frag"]
    rows = [(p, f"<link rel=canonical href='{link}'>") for p in pages for link in links]
    got = {(r["src"], r["dst"]) for r in url_filter.page_links(spark.createDataFrame(rows, "url string, html string")).collect()}

    def node(url):
        rest = url.split("://", 1)[1].split("#")[0]
        cut = min([k for k in (rest.find("/"), rest.find("?")) if k >= 0], default=len(rest))
        return rest[:cut].lower() + (rest[cut:] or "/")

    # The library leaves the dots of links that bring a host; the rules of URLs do not.
    given = {"//B.org/u/../v": "http://b.org/v", "https://c.net/w/..": "https://c.net/"}
    assert got == {(node(p), node(given.get(link) or urljoin(p, link))) for p in pages for link in links}


def test_entities_fragments_and_other_schemes(spark):
    html = {1: "/a?x=1&amp;y=2", 2: "&#47;b&#x2F;c", 3: "#top", 4: "mailto:me@b.net", 5: "javascript:void(0)", 6: "&#x2e;./d", 7: "", 8: "/e&#8364;f"}
    rows = [(f"http://h.com/s/{k}", f'<link rel="canonical" href="{link}">') for k, link in html.items()]
    got = {r["src"]: r["dst"] for r in url_filter.page_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"h.com/s/1": "h.com/a?x=1&y=2", "h.com/s/2": "h.com/b/c", "h.com/s/6": "h.com/d", "h.com/s/8": "h.com/e&"}


def test_a_relative_link_carries_a_block(spark):
    pages = [(1, "http://a.com/x/y", "<link rel=canonical href='../z'>"), (2, "http://a.com/z", "<meta http-equiv=refresh content='0;url=http://bad.net/'>"), (3, "http://a.com/p?x=1", "<link rel=canonical href='?x=2'>"), (4, "http://a.com/p?x=2", "<link rel=canonical href='http://bad.net/'>")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), url_filter.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block"}
