from urllib.parse import parse_qsl, urljoin, urlsplit

from pyspark.sql import functions as F

from corpusloom.functions import urls as U

NORMAL = {
    "HTTP://WWW.Site.SE/": "http://www.site.se/",
    "https://a.se": "https://a.se/",
    "https://a.se/x/index.html": "https://a.se/x",
    "https://a.se/INDEX.PHP": "https://a.se/",
    "https://a.se/x//": "https://a.se/x",
    "  https://a.se/x#top ": "https://a.se/x",
    "https://a.se/x;v=1?b=2&a=1&utm_source=q&REF=z": "https://a.se/x?a=1&b=2",
    "https://a.se/?b=&a": "https://a.se/?a=&b=",
    "https://a.se/?a=2&a=1": "https://a.se/?a=1&a=2",
    "https://a.se/?q=%C3%A5+b%2Fc~*": "https://a.se/?q=%C3%A5+b%2Fc~%2A",
    "https://a.se/?q=100%": "https://a.se/?q=100%25",
    "https://a.se/?a=b=c": "https://a.se/?a=b%3Dc",
    "a.se/x": "http://a.se/x",
    "https://a.se:443/x": "https://a.se:443/x",
    "https://[::1/x": "https://[::1/x",
    "https://a.se/%7Ex": "https://a.se/%7Ex",
}


def column(spark, values, make, *names):
    rows = spark.createDataFrame(
        [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)],
        "id long, " + ", ".join(f"{n} string" for n in names)
    )
    return [r["out"] for r in rows.select("id", make(*(F.col(n) for n in names)).alias("out")).orderBy("id").collect()]


def test_normal_forms(spark):
    assert dict(zip(NORMAL, column(spark, list(NORMAL), U.normalize_url, "u"), strict=True)) == NORMAL


def test_normal_form_is_stable(spark):
    once = column(spark, list(NORMAL), U.normalize_url, "u")
    assert column(spark, once, U.normalize_url, "u") == once


def test_normal_query_keeps_the_other_parameters(spark):
    urls = [
        "https://a.se/?" + q for q in (
            "x=1&y=%20&x=0", "a=%E2%82%AC&fbclid=1&b=c%26d", "k=a+b&k=&k=%2B", "å=ö&%C3%A5=%C3%B6", "&&a=1&", "a=1;b=2"
        )
    ]
    for url, got in zip(urls, column(spark, urls, U.normalize_url, "u"), strict=True):
        want = sorted(p for p in parse_qsl(urlsplit(url).query, keep_blank_values=True) if p[0].lower() not in U.TRACKING)
        assert sorted(parse_qsl(urlsplit(got).query, keep_blank_values=True)) == want


def test_parts_agree_with_the_standard_library(spark):
    urls = [
        "https://u:p@A.se:8/x/y;p?q#f", "//a.se/x", "mailto:a@b.se", "/x?y", "x/y", "http:", "1http://x", "ht tp://x",
        "https://a.se?x#y", ""
    ]
    for name in ("scheme", "authority", "query"):
        got = column(spark, urls, lambda u, name=name: U.parts(u)[name], "u")
        assert got == [getattr(urlsplit(u), {"authority": "netloc"}.get(name, name)) for u in urls]


def test_resolve_agrees_with_the_standard_library(spark):
    bases = ["https://a.se/d/e/f?x=1#y", "http://a.se", "https://a.se/d/", "https://a.se/d;p/e"]
    bases += ["https://a.se/a//b/", "https://a.se//x/y", "https://a.se/d;p", "https://a.se/d/e?q"]
    hrefs = [
        "HTTPS://O.se/./x?#", "https:g/../h", "https:", "HTTP://b.se", "../c", "a//b", "/a//../b", "/..//x", "x//",
        "//O.se/a/../b?", "ftp://x/./y", "?", "#", ";p", "g;x=1/./y"
    ]
    hrefs += [
        "g", "./g", "../g", "../../../g", "/g/../h", "?y=2", "#s", "", "//b.se/x", "https://c.se/", "g/", "..", ".",
        "/.", "g?y/../x", "a/./b/../c", "mailto:x@y", "g#s/../x", "/å ä"
    ]
    pairs = [(b, h) for b in bases for h in hrefs]
    got = column(spark, pairs, U.resolve, "b", "h")
    assert {p: (g, urljoin(*p)) for p, g in zip(pairs, got, strict=True) if g != urljoin(*p)} == {}


def test_what_a_crawl_may_take(spark):
    cases = {
        "https://www.a.se/x": True, "http://a.se/x.pdf": True, "https://b.a.se/": False, "ftp://a.se/": False, "https://a.se/x.JPG": False, "https://a.se/.css": True,
        "https://a.se/images/x.png/view": False, "https://a.se/images/x": True, "https://a.se/" + "x" * 2000: False, "https://a.se:80/": False, "/x": False, None: False,
    }
    got = column(spark, list(cases), lambda u: U.is_valid_url(u, F.lit("www.a.se")), "u")
    assert dict(zip(cases, got, strict=True)) == cases


def test_keywords(spark):
    words = lambda *w: F.array(*(F.lit(x) for x in w)).cast("array<string>")
    urls = ["https://a.se/Spam", "https://a.se/en", "https://a.se/"]
    assert column(spark, urls, lambda u: U.keywords_pass(u, words("spam", ""), words("en", "sp")), "u") == [False, True, False]
    assert column(spark, urls, lambda u: U.keywords_pass(u, words(), words()), "u") == [True, True, True]


def test_scores(spark):
    urls = ["https://a.se/om-oss/policy", "https://a.se/nyheter/2024", "https://a.se/blogg/kontakt", "https://a.se/x"]
    assert column(spark, urls, lambda u: U.frontier_score(u, U.LINK, 2), "u") == [14, 22, 19, 17]


def test_names(spark):
    assert column(spark, ["/Å b/c-_-d!", "é", "", "--x--"], U.slugify, "u") == ["a-bc-_-d", "é", "", "x"]
    h = F.lit("abcdef0123")
    assert column(
        spark, ["https://a.se/", "https://a.se/" + "y" * 60], lambda u: U.page_file_name(u, h, ".md"), "u"
    ) == ["_abcdef.md", "y" * 50 + "_abcdef.md"]
    cases = [
        ("https://a.se/f/Rapport%20tv%C3%A5.PDF", None), ("https://a.se/x", 'attachment; filename="B.v2.docx"'),
        ("https://a.se/", ""), ("https://a.se/a+b", None)
    ]
    got = column(spark, cases, U.document_file_name, "u", "d")
    assert [(g.split("_")[0], g[g.rindex("."):]) for g in got] == [
        ("rapport-tva", ".pdf"), ("b", ".docx"), ("dokument", ".pdf"), ("ab", ".pdf")
    ]


def test_followed(spark):
    assert column(spark, ["#a", "javascript:x", "mailto:a", "/x", "JAVASCRIPT:x"], U.is_followed, "u") == [False, False, False, True, True]
