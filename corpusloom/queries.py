"""The engine's registered queries over the driver's tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import urls as U
from .functions.dates import page_dates
from .operators import extract, frontier, incremental, maintext, route, schedule, stats
from .operators.settle import placed, settled
from .plans.runs import run_site, run_sites
from .sources import config, report, responses, robots, sinks, sitemap

#: When pages count as fetched.
FETCHED = "2026-01-01T00:00:00"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _long(c):
    return c.cast("long")


# --- URLs ---


def url_normalize(spark, d):
    return _pages(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("norm_url"))


def url_distinct(spark, d):
    return _pages(spark, d).agg(F.countDistinct(U.normalize_url(F.col("url"))).alias("n_urls"))


def url_valid(spark, d):
    url = F.col("url")
    host = F.lower(U.parts(url)["authority"])
    return _pages(spark, d).select(
        "page_id", U.is_valid_url(url).alias("valid"),
        U.is_valid_url(url, F.lit("www.ththen.example.com")).alias("valid_strict"),
        U.is_valid_url(url, host).alias("valid_own")
    )


def url_keywords(spark, d):
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    return _pages(spark, d).where(
        U.is_valid_url(F.col("url"), None, words("spam", "pills", ""), words("/en/", "/de/", "1"))
    ).select("page_id", "url")


def frontier_score(spark, d):
    norm = U.normalize_url(F.col("url"))
    return _pages(spark, d).select(
        "page_id", U.frontier_score(norm).alias("score"), U.frontier_score(norm, U.SITEMAP, 2).alias("sitemap_score")
    )


def _entries(spark, d):
    return frontier.candidates(_pages(spark, d).select("url", F.col("page_id").alias("seq")))


def frontier_topk(spark, d):
    return frontier.top(_entries(spark, d), 20).select(F.col("rank").cast("long").alias("rank"), "url", "score", "seq")


def frontier_dedup(spark, d):
    return _entries(spark, d).select("url", "seq", "score")


# --- links ---


def _quick(spark, d):
    each = _pages(spark, d).select("page_id", "url", F.posexplode(extract.quick_links(F.col("html"))).alias("position", "href"))
    return each.where(U.is_followed(F.col("href")))


def _targets(spark, d):
    return extract.with_targets(_quick(spark, d))


def links_extracted(spark, d):
    return _quick(spark, d).select("page_id", _long(F.col("position")).alias("position"), "href")


def links_resolved(spark, d):
    return _targets(spark, d).select("page_id", _long(F.col("position")).alias("position"), "target")


def links_parsed(spark, d):
    """The same links, by the HTML parser."""
    found = extract.page_links(extract.parse_pages(_pages(spark, d), "page_id"), "page_id").where(U.is_followed(F.col("href")))
    return found.select("page_id", _long(F.col("position")).alias("position"), "href", "target")


def _known(spark, d):
    return frontier.normalized(_pages(spark, d).select("url"))


def links_new(spark, d):
    found = frontier.normalized(_targets(spark, d).select(F.col("target").alias("url"))).distinct()
    return frontier.unseen(found, _known(spark, d))


def _graph(spark, d):
    """Links between all pages: page k leads to pages 2k + 1 and 2k + 2, by the URLs as they are, and to an anchor."""
    pages = _pages(spark, d).select("page_id", "url")
    child = pages.select(F.col("page_id").alias("child"), F.col("url").alias("target"))
    each = pages.select(
        "page_id", "url", F.explode(F.array(*(F.col("page_id") * 2 + k for k in (1, 2)))).alias("child")
    ).join(child, "child")
    made = each.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("child"), F.col("target")))).alias("found"))  # two at most
    links = F.transform("found", lambda x: F.struct(x["target"].alias("href"), x["target"].alias("target")))
    anchor = F.array(F.struct(F.lit("#top").alias("href"), F.concat("url", F.lit("#top")).alias("target")))
    return pages.join(made, "page_id", "left").select(
        "page_id", "url",
        F.concat(anchor, F.coalesce(links, F.expr("cast(array() as array<struct<href:string,target:string>>)"))).alias("links")
    )


def crawl_visits(spark, d):
    """A crawl of all pages from the first one on, of any domain but without some words and under a robots.txt, round by round."""
    graph = _graph(spark, d)
    start = graph.where("page_id = 0").select("url").first()["url"]
    seen = frontier.crawl(
        spark, graph.select("url", "links", F.col("page_id").alias("seq")), [start], strict_domain=False, exclude=["/de/1", "spam"],
        robots_txt="User-agent: *\nDisallow: /es/2\n"
    )
    return seen.select("url", "depth", "score", "round")


def expand_gate(spark, d):
    """Links of pages at depths of 0 to 2, where 2 is the limit."""
    links = _targets(spark, d).select(
        (F.col("page_id") % 3).cast("int").alias("depth"), (F.col("page_id") * 100000 + F.col("position")).alias("seq"),
        "href", "target"
    )
    return frontier.expand(links, 2).select("url", "depth", "score")


def frontier_expand(spark, d):
    """Seeds at depth 0 and what they link to at depth 1, each URL once."""
    seeds = _entries(spark, d).select("url", "depth")
    links = _targets(spark, d).select(
        F.lit(0).alias("depth"), (F.col("page_id") * 100000 + F.col("position")).alias("seq"), "href", "target"
    )
    found = frontier.expand(links).select("url", "depth")
    return seeds.unionByName(found).groupBy("url").agg(F.min("depth").alias("depth"))


# --- pages ---


def page_title(spark, d):
    return _pages(spark, d).select("page_id", extract.quick_title(F.col("html")).alias("title"))


def page_lang(spark, d):
    return _pages(spark, d).select("page_id", extract.quick_language(F.col("html")).alias("language"))


def page_title_parsed(spark, d):
    return extract.page_records(extract.parse_pages(_pages(spark, d), "page_id"), F.lit(FETCHED), []).select("page_id", "title", "language")


def page_sections(spark, d):
    records = extract.page_records(extract.parse_pages(_pages(spark, d), "page_id"), F.lit(FETCHED))
    return records.select("page_id", F.posexplode("sections").alias("position", "s")).select(
        "page_id", _long(F.col("position")).alias("position"), "s.heading", "s.text"
    )


def page_record(spark, d):
    records = extract.page_records(extract.parse_pages(_pages(spark, d), "page_id"), F.lit(FETCHED))
    n = {"n_keywords": F.size("keywords"), "n_chunks": F.size("chunks"), "n_chars": F.length("plain_text")}
    return records.select(
        "page_id", "title", "url", "author", "published_date", "modified_date", "language", "og_type", "description", *(
            _long(c).alias(k) for k, c in n.items()
        ), F.sha2("plain_text", 256).alias("text_sha256")
    )


def page_main_text(spark, d):
    """Pages whose text is what the main-content extractor finds."""
    records = extract.page_records(extract.parse_pages(_pages(spark, d), "page_id", extractor=maintext.main_text), F.lit(FETCHED))
    return records.select("page_id", "plain_text", _long(F.size("sections")).alias("n_sections"))


NO_CACHE = "url string, content_hash string, title string, crawled_at string, content_length long"


def run_pages(spark, d):
    """A whole run over the pages with an empty cache: what would be saved."""
    return run_site(_pages(spark, d), spark.createDataFrame([], NO_CACHE), F.lit(FETCHED)).saved


def run_pages_json(spark, d):
    """The same as JSON files, with all fields."""
    return run_site(_pages(spark, d), spark.createDataFrame([], NO_CACHE), F.lit(FETCHED), ".json").saved


#: name, start_url, strict_domain, exclude_keywords, respect_robots, save_format
SITES = [
    ("mobil", "https://m.site.example/", False, ["/de/"], False, ".txt"),
    ("fr", "https://fr.example/", False, None, True, "Ingen text"),
    ("rest", "https://rest.example/", False, None, True, ".md"),
    ("ingen", "https://x.example/", True, None, True, ".md")
]


def _run_sites(spark, d):
    """Pages dealt to sites of different settings: mobile hosts, French ones, and the rest, each twice over: also to a strict site that none belongs to."""
    given = spark.createDataFrame(
        SITES,
        "name string, start_url string, strict_domain boolean, exclude_keywords array<string>, respect_robots boolean, save_format string"
    )
    types = dict(x.strip().split(" ") for x in config.SCHEMA.split(", "))
    given = given.withColumns({k: F.lit(True) for k in T.PII})
    sites = config.with_defaults(given.select("*", *(F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in given.columns)))
    site = F.when(F.col("url").rlike("://m\\."), "mobil").when(F.contains("url", F.lit("/fr/")), "fr").otherwise("rest")
    pages = _pages(spark, d).select("url", "html", F.explode(F.array(site, F.lit("ingen"))).alias("site"))
    rules = spark.createDataFrame(
        [("rest", "User-agent: *\nDisallow: /en/1\n"), ("mobil", "User-agent: *\nDisallow: /\n")],
        "site string, robots_txt string"
    )
    return run_sites(pages, sites, spark.createDataFrame([], NO_CACHE), F.lit(FETCHED), rules)


def sites_stats(spark, d):
    return _run_sites(spark, d).stats.select("site", "visited", "unchanged", "failed", "documents", "saved")


def sites_saved(spark, d):
    return _run_sites(spark, d).saved.select("file_name", F.sha2("payload", 256).alias("payload_sha256"))


def js_render_needed(spark, d):
    return _pages(spark, d).select("page_id", route.js_render_needed(F.col("html")).alias("needed"))


def session_expired(spark, d):
    return _pages(spark, d).select(
        "page_id", route.session_expired(F.col("html")).alias("expired"),
        route.session_expired(F.concat("html", F.lit('<input TYPE="password">')), F.lit("login_then_headless")).alias("with_form")
    )


# --- texts ---


def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_hash(F.col("text")).alias("content_hash"))


def pii_email(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.clean_pii(F.col("text"), ["remove_email"]), 256).alias("masked"))


def pii_ip(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.clean_pii(F.col("text"), ["remove_ip"]), 256).alias("masked"))


def pii_pnr(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.clean_pii(F.col("text"), ["remove_pnr"]), 256).alias("masked"))


def pii_phone(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.clean_pii(F.col("text"), ["remove_phone"]), 256).alias("masked"))


def pii_masked(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_pii(F.col("text")).alias("masked"))


def _chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.text_chunks(F.col("text"))).alias("c"))


def chunks(spark, d):
    return _chunks(spark, d).select(
        "doc_id", _long(F.col("c.chunk_index")).alias("chunk_index"),
        _long(F.col("c.total_chunks")).alias("total_chunks"), F.sha2("c.content", 256).alias("content_sha256")
    )


def chunk_stats(spark, d):
    """A document's chunks are an array: nothing is shuffled."""
    own = settled(_docs(spark, d).select("doc_id", "text"), c=T.text_chunks(F.col("text"))).where(F.size("c") > 0)
    sizes = settled(
        own.select("doc_id", "c"),
        n=F.transform("c", lambda c: F.struct(F.length(c["content"]).alias("chars"), F.size(T.words(c["content"])).alias("words")))
    )
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    return sizes.select(
        "doc_id", _long(F.size("c")).alias("n_chunks"), total.alias("n_chars"),
        _long(F.array_max("n.words")).alias("most_words")
    )


def chunk_headings(spark, d):
    return _chunks(spark, d).select("doc_id", _long(F.col("c.chunk_index")).alias("chunk_index"), F.col("c.heading").alias("heading"))


def masked_chunks(spark, d):
    """Flagship: documents without personal data of any kind, hashed and chunked."""
    clean = settled(_docs(spark, d).select("doc_id", "text"), text=T.clean_pii(F.col("text")))
    return clean.select(
        "doc_id", T.clean_hash(F.col("text")).alias("content_hash"), F.explode(T.text_chunks(F.col("text"))).alias("c")
    ).select(
        "doc_id", "content_hash", _long(F.col("c.chunk_index")).alias("chunk_index"),
        F.col("c.heading").alias("heading"), F.col("c.content").alias("content")
    )


def slug_filename(spark, d):
    h = T.clean_hash(F.col("html"))
    return _pages(spark, d).select(
        "page_id", U.slugify(U.parts(F.col("url"))["path"]).alias("slug"),
        U.page_file_name(U.normalize_url(F.col("url")), h, ".md").alias("file_name")
    )


# --- cache, index, statistics ---


def _at(c):
    return F.timestamp_seconds(F.lit(1767225600) + c).cast("timestamp_ntz")


def _cache(spark, d):
    """Documents as pages, and an old cache of them all: some under another address, some with another hash, some from later than now."""
    base = F.lit("https://site.example/")
    docs = _docs(spark, d).select(
        F.concat(
            base, F.lit("doc/"), F.col("doc_id").cast("string")
        ).alias("url"), "doc_id", T.clean_hash(F.col("text")).alias("content_hash"), F.col("source").alias("title"),
        _at(F.col("doc_id")).alias("crawled_at"), _long(F.length("text")).alias("content_length"), "lang",
    )
    old = docs.withColumns(
        {
            "url": F.when(F.col("lang") == "en", F.col("url")).otherwise(F.concat(base, F.lit("arkiv/"), F.col("doc_id").cast("string"))),
            "content_hash": F.when(F.col("content_length") % 10 == 0, F.lit("0" * 64)).otherwise(F.col("content_hash")),
            "crawled_at": F.when(F.col("title") == "src1", _at(F.col("doc_id") + 10)).otherwise(_at(F.lit(-1))),
        }
    )
    return docs, old


def cache_upsert(spark, d):
    docs, old = _cache(spark, d)
    return incremental.upsert(old, docs)


def cache_scan(spark, d):
    """All of the cache in order of time."""
    docs, old = _cache(spark, d)
    return incremental.ordered_cache(incremental.upsert(old, docs)).select("url", "title", "crawled_at", "content_hash", "place")


def incremental_status(spark, d):
    docs, old = _cache(spark, d)
    return incremental.with_status(docs.select("url", "content_hash"), old)


def index_csv(spark, d):
    """The index, and each line's place in it."""
    docs, _ = _cache(spark, d)
    names = {"page": "URL", "titel": "Titel", "fetched": "Hämtad_Datum", "filnamn": "Filnamn"}
    lines = incremental.index_rows(docs, ".md").select(*(F.col(old).alias(new) for new, old in names.items()))
    return placed(lines, F.desc("fetched"), "page")


def crawl_stats(spark, d):
    """Events as outcomes of pages."""
    events = spark.read.parquet(f"{d}/events.parquet").select(
        F.concat(F.lit("site"), (F.col("user_id") % 7).cast("string")).alias("site"),
        F.element_at(
            F.array(*(F.lit(x) for x in ("new", "changed", "unchanged", "failed", "expired", "document", "skipped"))),
            (F.pmod("event_id", F.lit(7)) + 1).cast("int")
        ).alias("status"),
        (F.col("value") > 50).alias("rendered")
    )
    return stats.run_stats(events, "site")


def crawl_rate(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("user_id") % 7).alias("site")).agg(
        F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("visited")
    )
    s = stats.duration_seconds(F.col("a"), F.col("z"), F.col("z"))
    return rows.select("site", s.alias("seconds"), F.round(stats.pages_per_second(F.col("visited"), s), 6).alias("rate"))


def summary_lines(spark, d):
    return stats.summary_line(crawl_stats(spark, d))


def eta(spark, d):
    rows = spark.createDataFrame(
        [
            (1, 2, 5.0, 10, 0), (2, 3, 30.0, 0, 0), (3, 10, 20.0, 5, 0), (4, 10, 500.0, 4, 0), (5, 10, 5000.0, 12, 0),
            (6, 10, 50.0, 100, 12), (7, 10, 50.0, 100, 10)
        ],
        "id long, visited long, seconds double, waiting long, max_pages long"
    )
    return rows.select("id", stats.eta(F.col("visited"), F.col("seconds"), F.col("waiting"), F.col("max_pages")).alias("eta"))


def rate_limit_schedule(spark, d):
    req = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("domain"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("arrive_us")
    )
    return schedule.schedule(req, F.lit(600.0)).select("id", "start_us", "wait_us")


def delay_resolution(spark, d):
    rows = spark.createDataFrame(
        [(1, 0.5, None), (2, 0.01, None), (3, 2.0, 1), (4, 0.5, 10), (5, 0.5, 0)],
        "id long, configured double, robots int"
    )
    return rows.select("id", schedule.effective_delay(F.col("configured"), F.col("robots")).alias("delay"))


def backoff_schedule(spark, d):
    return spark.range(0, 5).select(
        F.col("id").alias("attempts"),
        F.array_join(
            F.transform(schedule.backoff_seconds(F.col("id").cast("int")), lambda x: x.cast("int").cast("string")), ","
        ).alias("seconds")
    )


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def eta_events(spark, d):
    """Each event as a crawl at some moment."""
    visited, waiting, most = F.col("event_id") % 50, F.col("user_id") % 40, (F.col("event_id") % 3) * 30
    return _events(spark, d).select("event_id", stats.eta(visited, F.col("value") * 40, waiting, most).alias("eta"))


def delay_events(spark, d):
    robots_delay = F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 3 - 1).cast("int"))
    return _events(spark, d).select("event_id", schedule.effective_delay(F.col("value") / 1000, robots_delay).alias("delay"))


def route_events(spark, d):
    """Each event as a response of some type; every second site wants documents."""
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), (F.pmod("event_id", F.lit(len(TYPES))) + 1).cast("int"))
    return _events(spark, d).select("event_id", route.content_route(kind, F.col("user_id") % 2 == 0).alias("route"))


# --- routing and sinks ---

TYPES = [
    "text/html; charset=utf-8", "IMAGE/png", "application/pdf", "application/vnd.ms-excel", "application/zip",
    "application/json", "application/octet-stream", "application/x-unknown", None, "font/woff2", "application/xml"
]


def content_route(spark, d):
    rows = spark.createDataFrame(list(enumerate(TYPES)), "id long, content_type string")
    return rows.select(
        "id", route.content_route(F.col("content_type")).alias("route"),
        route.content_route(F.col("content_type"), True).alias("route_documents")
    )


def status_label(spark, d):
    rows = spark.range(0, 16)
    bit = lambda k: F.col("id").bitwiseAND(F.lit(1 << k)) != 0
    return rows.select("id", route.status_label(bit(0), bit(1), bit(2), bit(3)).alias("label"))


def save_gate(spark, d):
    return _docs(spark, d).select(
        "doc_id", route.save_gate(F.col("text")).alias("saved"),
        route.save_gate(F.col("text"), "Ingen text").alias("saved_no_text")
    )


def _records(spark, d):
    docs = _docs(spark, d).where(route.save_gate(F.col("text")))
    return docs.select(
        "doc_id", F.col("source").alias("title"),
        F.concat(F.lit("https://site.example/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("").alias("author"), F.col("text").alias("plain_text")
    )


def sink_json(spark, d):
    return _records(spark, d).select("doc_id", sinks.json_payload(["title", "url", "author"]).alias("payload"))


def sink_md(spark, d):
    return _records(spark, d).select(
        "doc_id",
        F.sha2(sinks.markdown_payload(F.col("title"), F.col("url"), F.col("plain_text")), 256).alias("payload_sha256")
    )


# --- inline vectors ---

PII_TEXTS = [
    "19900101-1234 och 900161+1234", "ring 070-123 45 67 nu", "+46 (0)8 123 45 67", "0046 70 1234567", "inget 123",
    "9913311234", "12345678901234567890"
]


def pii_texts(spark, d):
    """Cases that the tables don't have."""
    rows = spark.createDataFrame(list(enumerate(PII_TEXTS)), "id long, t string")
    return rows.select("id", T.clean_pii(F.col("t"), ["remove_pnr"]).alias("pnr"), T.clean_pii(F.col("t"), ["remove_phone"]).alias("phone"))


METADATA = [
    (1, '<html lang="sv"><head><title> T1 </title><meta name="Keywords" content="a, b,,c"><meta name="DESCRIPTION" content=" d "><meta name="author" content="A"><meta property="og:type" content="article">'
        '<meta property="article:published_time" content="2020-01-01"><meta itemprop="dateModified" content="2020-02-02"></head></html>'),
    (
        2,
        '<title>T2</title><meta name="DC.creator" content="B"><meta name="pubdate" content="2019"><p>x</p><time class="last-update" datetime="2021-03-04">mars</time>'
    ),
    (3, '<title>T3</title><script type="application/ld+json">{"datePublished": "2018-05-06", "dateModified" : "2018-07-08"}</script>'),
    (4, '<title>T4</title><p>Senast uppdaterad: 3 maj 2021</p>'),
    (5, '<title>T5</title><p>Publicerad 2019-02-03</p><time itemprop="dateModified">i dag</time>'),
    (6, '<p>utan titel</p>'),
    (7, '<title></title><p>tom titel</p>'),
    (8, '<title>skriv till a@b.se</title><meta name="keywords" content="x@y.se">'),
]


def page_metadata(spark, d):
    pages = spark.createDataFrame([(i, f"https://a.se/{i}", h) for i, h in METADATA], "id long, url string, html string")
    records = extract.page_records(extract.parse_pages(pages, "id"), F.lit(FETCHED))
    return records.select(
        "id", "title", F.array_join("keywords", "|").alias("keywords"), "description", "author", "published_date",
        "modified_date", "language", "og_type", F.col("error").isNotNull().alias("failed")
    )


SECTIONS = [
    (
        1,
        '<title>t</title><p>foto</p><p>inledning har</p><h2>Lista</h2><ul><li>ett <a href="/x">lank</a></li><li>tva<ul><li>inre</li></ul></li></ul><h5>ej rubrik</h5>'
    ),
    (
        2,
        '<title>t</title><h1>Tabell</h1><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><div class="cookie-bar"><p>bort med detta</p></div>'
    ),
    (
        3,
        '<title>t</title><h1>R</h1><nav><p>meny meny</p></nav><p>text med <b>fet</b> och <a href="y?z=1">mer</a></p><form><p>formular</p></form>'
    ),
]


def page_shapes(spark, d):
    """Sections of pages of other shapes than the tables have."""
    pages = spark.createDataFrame([(i, "https://a.se/d/s", h) for i, h in SECTIONS], "id long, url string, html string")
    records = extract.page_records(extract.parse_pages(pages, "id"), F.lit(FETCHED))
    return records.select("id", F.posexplode("sections").alias("position", "s")).select(
        "id", _long(F.col("position")).alias("position"), "s.heading", "s.text"
    )


CAPTURED = [
    (
        1, "https://a.se/sida", "text/html; charset=utf-8", 200, None, "x" * 1200, None, 1
    ), (
        2, "https://a.se/kort", "text/html", 200, None, "kort", "<html>ritad</html>", 2
    ), (3, "https://a.se/kort2", "text/html", 200, None, "kort", None, 3),
    (
        4, "https://a.se/f/a.pdf", "application/pdf", 200, 'attachment; filename="Bil aga.PDF"', "P1", None, 5
    ), (5, "https://a.se/f/a.pdf", "application/pdf", 200, None, "P2", None, 4), (
        6, "https://a.se/f/b.doc", "application/msword", 404, None, "D", None, 6
    ),
    (7, "https://a.se/bild", "image/png", 200, None, "B", None, 7), (8, "https://a.se/okand", "x/y", 200, None, "", None, 8), (
        9, "https://a.se/klar", "application/vnd.ms-excel", 200, None, "K", None, 9
    ),
]


def _captured(spark):
    rows = spark.createDataFrame(
        CAPTURED,
        "id long, url string, content_type string, status int, disposition string, body string, rendered_html string, fetched_at long"
    )
    return rows.withColumn("body", F.col("body").cast("binary"))


def responses_routed(spark, d):
    return responses.routed(_captured(spark), True).select("id", "route", "rendered", F.length("html").cast("long").alias("n_html"))


def responses_documents(spark, d):
    got = responses.documents(_captured(spark), spark.createDataFrame([("https://a.se/klar",)], "url string"))
    return got.select("url", "file_name", F.col("body").cast("string").alias("body"))


def head_probes(spark, d):
    rows = spark.createDataFrame(
        [(1, 200, "Text/HTML"), (2, 403, "text/html"), (3, 405, None), (4, 200, None), (5, 404, "image/PNG")],
        "id long, status int, content_type string"
    )
    return rows.select("id", route.probed_type(F.col("status"), F.col("content_type")).alias("content_type"))


def cookie_headers(spark, d):
    rows = spark.createDataFrame([(1, [("a", "1"), ("b", "x=y")]), (2, [])], "id long, cookies array<struct<name:string,value:string>>")
    return rows.select("id", report.cookie_header(F.col("cookies")).alias("header"))


def newest_events(spark, d):
    """What a table of the newest hundred shows."""
    return report.newest(spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id", "event_type"), "ts")


def table_titles(spark, d):
    rows = spark.createDataFrame([(1, "a\x00b"), (2, ""), (3, None), (4, "Titel")], "id long, title string")
    return rows.select("id", route.table_title(F.col("title")).alias("title"))


def keyword_lists(spark, d):
    rows = spark.createDataFrame([(1, " Spam, ,PILLER ,å b"), (2, ""), (3, None)], "id long, typed string")
    return rows.select("id", F.array_join(config.keyword_list(F.col("typed")), "|").alias("words"))


def json_files(spark, d):
    rows = spark.createDataFrame(
        [("T \"x\"", ["a", "b\\"], [("H", "rad 1\nrad 2", 1, 1)]), ("tom", [], [])],
        "title string, keywords array<string>, chunks array<struct<heading:string,content:string,chunk_index:int,total_chunks:int>>"
    )
    return rows.select(sinks.pretty_json_payload(["title", "keywords", "chunks"]).alias("payload"))


def md_sections(spark, d):
    rows = spark.createDataFrame([(1, "inled\n# A\ntext a\n## B\n### C  \nc1\nc2"), (2, "#utan blank\nx"), (3, "")], "id long, md string")
    return rows.select(
        "id", F.posexplode(T.markdown_sections(F.col("md"))).alias("position", "s")
    ).select("id", _long(F.col("position")).alias("position"), "s.heading", "s.text")


def md_links(spark, d):
    rows = spark.createDataFrame(
        [(1, "se [a](/x) och [b](y.html) [c](https://o.se/) [d](#top) [e](mailto:a@b.se) [f](../up?q=1)"), (2, "inga")],
        "id long, md string"
    )
    return rows.select("id", T.absolute_markdown_links(F.col("md"), F.lit("https://a.se/dir/page")).alias("md"))


def page_date_cascade(spark, d):
    rows = spark.createDataFrame(
        [
            (1, "2020-01-01", "", "Senast uppdaterad: 3 maj 2021"),
            (2, "", "", "Publicerad 2019-02-03 text Uppdaterad 4 juni 2020"), (3, "", "", "Publicerad 2019-02-03"),
            (4, "", "", "Ändrad 2018-01-02"), (5, None, "x", "inget")
        ],
        "id long, p string, m string, v string"
    )
    pub, mod = page_dates(F.col("p"), F.col("m"), F.col("v"))
    return rows.select("id", pub.alias("published"), mod.alias("modified"))


def doc_filename(spark, d):
    rows = spark.createDataFrame(
        [
            (1, "https://a.se/f/Rapport%20två.PDF", None),
            (2, "https://a.se/f/x", 'attachment; filename="Å-fil.v2.docx"'), (3, "https://a.se/", None)
        ],
        "id long, url string, disposition string"
    )
    return rows.select("id", U.document_file_name(F.col("url"), F.col("disposition")).alias("file_name"))


ROBOTS = "User-agent: *\nDisallow: /privat\nAllow: /privat/ok\nDisallow:\nCrawl-delay: 7\nSitemap:https://a.se/s1.xml\nsitemap: https://a.se/s2.xml\n\nUser-agent: *\nDisallow: /\n"


def robots_allow(spark, d):
    urls = spark.createDataFrame(
        [(1, "a", "https://a.se/privat/ok"), (2, "a", "https://a.se/"), (3, "a", "https://a.se/x?privat"), (4, "b", "https://b.se/privat")],
        "id long, site string, url string"
    )
    files = spark.createDataFrame([("a", ROBOTS)], "site string, robots_txt string")
    return robots.allowed(urls, files).select("id", "allowed")


def robots_pages(spark, d):
    """All pages under one robots.txt: the first rule that fits decides."""
    text = "User-agent: *\nAllow: /en/12\nDisallow: /en/1\nDisallow: /de/4\nDisallow: /fr/7\nAllow: /fr\n"
    files = spark.createDataFrame([("alla", text)], "site string, robots_txt string")
    return robots.allowed(_pages(spark, d).select("page_id", "url", F.lit("alla").alias("site")), files).select("page_id", "allowed")


def robots_sitemaps(spark, d):
    files = spark.createDataFrame([("a", ROBOTS)], "site string, robots_txt string")
    return files.select(
        "site", F.explode(robots.sitemap_urls(F.col("robots_txt"))).alias("sitemap"),
        robots.policy(F.col("robots_txt"))["crawl_delay"].alias("crawl_delay")
    )


def sitemap_urls(spark, d):
    import gzip

    index = b'<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://a.se/1.xml.gz </loc></sitemap><sitemap><loc>https://a.se/i.xml</loc></sitemap></sitemapindex>'
    leaf = gzip.compress(
        b"<urlset><url><loc>https://a.se/p?x=1&amp;y=2</loc><lastmod>2020</lastmod></url><url><loc>https://a.se/q.css</loc></url></urlset>",
        mtime=0
    )
    files = spark.createDataFrame([("https://a.se/i.xml", index), ("https://a.se/1.xml.gz", leaf)], "url string, body binary")
    found = sitemap.sitemap_pages(files, spark.createDataFrame([("https://a.se/i.xml",)], "url string"))
    return found.where(U.is_valid_url(F.col("url"), F.lit("a.se"))).select("sitemap", _long(F.col("position")).alias("position"), "url")


def sitemap_accepted(spark, d):
    """All pages' URLs as those of two sitemaps: how many a crawl takes over from each."""
    pages = _pages(spark, d).select(
        F.when(F.contains("url", F.lit("/en/")), "b").otherwise("a").alias("sitemap"),
        F.col("page_id").alias("position"), "url"
    )
    seen = frontier.normalized(_pages(spark, d).where(F.contains("url", F.lit("/fr/"))).select("url"))
    return sitemap.accepted_counts(pages, exclude=F.array(F.lit("/de/")), seen=seen)


def site_settings(spark, d):
    rows = spark.createDataFrame(
        [("Min Sajt Å", "https://WWW.a.se/x", ["SPAM"])],
        "name string, start_url string, exclude_keywords array<string>"
    )
    full = rows.select(
        "*",
        *(F.lit(None).cast(t).alias(c) for c, t in (x.strip().split(" ") for x in config.SCHEMA.split(", ")) if c not in rows.columns)
    )
    return config.with_defaults(full).select(
        "name", "domain", "output_dir", "delay", "incremental", F.element_at("exclude_keywords", 1).alias("exclude")
    )


def queries() -> dict:
    names = """url_normalize url_distinct url_valid url_keywords frontier_score frontier_topk frontier_dedup links_extracted links_resolved links_parsed links_new
        frontier_expand expand_gate crawl_visits page_title page_lang page_title_parsed page_sections page_record page_main_text page_metadata page_shapes run_pages run_pages_json sites_stats
        sites_saved js_render_needed session_expired content_hash pii_email pii_pnr pii_phone pii_ip pii_masked pii_texts chunks chunk_stats chunk_headings masked_chunks slug_filename
        cache_upsert cache_scan incremental_status index_csv crawl_stats crawl_rate summary_lines eta eta_events rate_limit_schedule delay_resolution delay_events route_events backoff_schedule content_route status_label
        save_gate sink_json sink_md json_files responses_routed responses_documents head_probes cookie_headers newest_events table_titles keyword_lists md_sections md_links page_date_cascade doc_filename robots_allow robots_pages
        robots_sitemaps sitemap_urls sitemap_accepted site_settings""".split()
    return {n: globals()[n] for n in names}
