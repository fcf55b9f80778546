import json
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.runs import run_site, run_sites
from corpusloom.sources import config, report, responses, robots, shared, sinks, sitemap

CACHE = "url string, content_hash string, title string, crawled_at string, content_length long"


def test_sites(spark, tmp_path):
    path = tmp_path / "sites.json"
    path.write_text(
        json.dumps(
            [
                {"name": "Å b", "start_url": "https://WWW.a.se/", "exclude_keywords": ["X"], "remove_email": True},
                {"start_url": "http://b.se", "max_pages": 3, "incremental": False}
            ]
        )
    )
    rows = {r["name"]: r for r in config.read_sites(spark, str(path)).collect()}
    assert rows["Å b"]["domain"] == "www.a.se" and rows["Å b"]["exclude_keywords"] == ["x"] and rows["Å b"]["output_dir"] == "server_data/a-b" and rows["Å b"]["incremental"]
    assert rows["Unknown"]["max_pages"] == 3 and not rows["Unknown"]["incremental"] and rows["Unknown"]["require_keywords"] == []


def test_robots(spark):
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /a/b\nDisallow: /a\nDisallow: /q?x\nCrawl-delay: 4\nSitemap:https://s/1\n\nUser-agent: *\nDisallow: /z"
    urls = [("https://s/a/b/c", True), ("https://s/a", False), ("https://s/q?x=1", False), ("https://s/z", True), ("https://s", True)]
    df = spark.createDataFrame([("s", u) for u, _ in urls] + [("t", "https://t/a")], "site string, url string")
    got = {r["url"]: r["allowed"] for r in robots.allowed(df, spark.createDataFrame([("s", text)], "site string, robots_txt string")).collect()}
    assert got == dict(urls) | {"https://t/a": True}
    assert robots.read_policy(text)["crawl_delay"] == 4 and robots.read_policy(None) == {"rules": [], "crawl_delay": None}


def test_sitemap_loop_and_damage(spark):
    index = b'<s:sitemapindex xmlns:s="x"><s:sitemap><s:loc>i</s:loc></s:sitemap><s:sitemap><s:loc>p</s:loc></s:sitemap><s:sitemap><s:loc>bad.gz</s:loc></s:sitemap></s:sitemapindex>'
    files = [
        ("i", index), ("p", b"<urlset><url><loc><![CDATA[https://a/x]]></loc></url><url><loc></loc></url></urlset>"),
        ("bad.gz", b"no gzip")
    ]
    got = sitemap.sitemap_pages(spark.createDataFrame(files, "url string, body binary"), spark.createDataFrame([("i",)], "url string"))
    assert [tuple(r) for r in got.collect()] == [("p", 0, "https://a/x")]


def test_responses(spark):
    rows = [
        (
            "u1", "GET", 200, "text/html", None, b"<p>kort</p>", "<html>ritad</html>"
        ), (
            "u2", "GET", 200, "application/pdf", 'filename="A b.pdf"', b"%PDF", None
        ), ("u2", "GET", 200, "application/pdf", None, b"%PDF2", None),
        ("u3", "GET", 404, "application/pdf", None, b"x", None), ("u4", "GET", 200, "image/png", None, b"x", None),
    ]
    df = spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        "url string, method string, status int, content_type string, disposition string, body binary, rendered_html string, fetched_at long"
    )
    routed = {(r["url"], r["route"], r["rendered"], r["html"]) for r in responses.routed(df).collect()}
    assert (
        "u1", "page", True, "<html>ritad</html>"
    ) in routed and ("u2", "skip_document", False, None) in routed and ("u4", "drop", False, None) in routed
    got = responses.documents(df).collect()
    assert [(r["url"], bytes(r["body"])) for r in got] == [("u2", b"%PDF")] and got[0]["file_name"].startswith("a-b_")
    assert responses.documents(df, spark.createDataFrame([("u2",)], "url string")).count() == 0


def page(title, text):
    return f"<html lang='sv'><title>{title}</title><body><h1>{title}</h1><p>{text}</p><a href='/n'>n</a></body></html>"


def test_run_and_second_run(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            ("https://a.se/x/", page("X", "ord " * 30)), ("https://a.se/kort", page("K", "för kort")),
            ("https://a.se/fel", "<title></title>"), ("https://a.se/b.png", "x")
        ],
        "url string, html string"
    )
    first = run_site(pages, spark.createDataFrame([], CACHE), F.lit("2026-01-01"))
    assert {r["url"]: r["status"] for r in first.records.collect()} == {
        "https://a.se/x": "new", "https://a.se/kort": "new", "https://a.se/fel": "failed"
    }
    saved = first.saved.collect()
    assert len(saved) == 1 and saved[0]["payload"].startswith("# X\nKälla: https://a.se/x\n\n## X\nord ord")
    sinks.write_files(first.saved, str(tmp_path / "texter"))
    assert (tmp_path / "texter" / saved[0]["file_name"]).read_text() == saved[0]["payload"]
    cache = spark.read.parquet(sinks.write_cache(first.cache, str(tmp_path / "cache")))
    second = run_site(pages, cache, F.lit("2026-01-02"))
    assert second.saved.count() == 0 and second.stats.first().asDict() == {
        "visited": 2, "unchanged": 2, "failed": 1, "documents": 0, "playwright_fallbacks": 0, "saved": 0
    }
    assert {r["crawled_at"] for r in second.cache.collect()} == {"2026-01-02"}
    sinks.write_index(cache, str(tmp_path / "index"))
    head = [p.read_text().splitlines()[0] for p in (tmp_path / "index").glob("*.csv")]
    assert head and set(head) == {"URL,Titel,Hämtad_Datum,Filnamn"}


def test_json_sink(spark):
    pages = spark.createDataFrame([("https://a.se/x", page("X", "ord " * 30))], "url string, html string")
    payload = json.loads(run_site(pages, spark.createDataFrame([], CACHE), F.lit("nu"), ".json").saved.first()["payload"])
    assert [*payload] == sinks.JSON_FIELDS and payload["chunks"][0]["total_chunks"] == 1 and payload["author"] == ""


def test_many_sites(spark):
    sites = config.with_defaults(
        spark.createDataFrame(
            [("A", "https://www.a.se/", ["hemlig"], True), ("B", "https://b.se/", None, False)],
            "name string, start_url string, exclude_keywords array<string>, remove_email boolean"
        ).select(
            "*",
            *(F.lit(None).cast(t).alias(c) for c, t in (x.strip().split(" ") for x in config.SCHEMA.split(", ")) if c not in ("name", "start_url", "exclude_keywords", "remove_email"))
        )
    )
    mail = "skriv till a@b.se " * 5
    pages = spark.createDataFrame(
        [
            ("https://a.se/1", page("T", mail)), ("https://a.se/hemlig", page("T", mail)),
            ("https://b.se/1", page("T", mail)), ("https://c.se/1", page("T", mail))
        ],
        "url string, html string"
    )
    run = run_sites(pages, sites, spark.createDataFrame([], CACHE), F.lit("nu"))
    assert {(r["site"], r["visited"]) for r in run.stats.collect()} == {("A", 1), ("B", 1)}
    assert {r["site"]: "a@b.se" in r["plain_text"] for r in run.records.collect()} == {"A": False, "B": True}


def settings(spark, rows, schema):
    given = spark.createDataFrame(rows, schema)
    types = dict(x.strip().split(" ") for x in config.SCHEMA.split(", "))
    return config.with_defaults(given.select("*", *(F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in given.columns)))


def test_each_site_has_its_own_settings(spark):
    sites = settings(
        spark, [
            ("A", "https://a.se/", False, False, ".json", False, "headless", True),
            ("B", "https://b.se/", True, True, ".txt", True, "login_then_headless", False)
        ],
        "name string, start_url string, strict_domain boolean, respect_robots boolean, save_format string, incremental boolean, headless_mode string, download_docs boolean",
    )
    text = "ord " * 30
    login = "<html><title>in</title><input type='password' name=\"password\"></html>"
    pages = spark.createDataFrame(
        [
            ("A", "https://a.se/1", page("T", text)), ("A", "https://x.se/privat", page("T", text)),
            ("A", "https://a.se/in", login), ("B", "https://b.se/1", page("T", text)),
            ("B", "https://x.se/1", page("T", text)), ("B", "https://b.se/privat", page("T", text)),
            ("B", "https://b.se/in", login)
        ],
        "site string, url string, html string",
    )
    robots_txt = spark.createDataFrame(
        [("A", "User-agent: *\nDisallow: /privat"), ("B", "User-agent: *\nDisallow: /privat")],
        "site string, robots_txt string"
    )
    captured = spark.createDataFrame(
        [(s, f"https://{s}.se/d.pdf", 200, "application/pdf", None, b"P", 1) for s in "AB"],
        "site string, url string, status int, content_type string, disposition string, body binary, fetched_at long"
    )
    first = run_sites(pages, sites, spark.createDataFrame([], CACHE), F.lit("2026-01-01"), robots_txt, captured).keep()
    assert {(r["site"], r["url"].removeprefix("https://"), r["status"]) for r in first.records.collect()} == {
        ("A", "a.se/1", "new"), ("A", "x.se/privat", "new"), ("A", "a.se/in", "new"), ("B", "b.se/1", "new"), ("B", "b.se/in", "expired"),
    }
    saved = {r["file_name"].rpartition(".")[2]: r["payload"] for r in first.saved.collect()}
    assert set(saved) == {"json", "txt"} and json.loads(saved["json"])["url"].startswith("https://") and saved["txt"].startswith("# T\nKälla: https://b.se/1")
    assert [(r["site"], r["url"]) for r in first.documents.collect()] == [("A", "https://A.se/d.pdf")]
    again = run_sites(pages, sites, first.cache, F.lit("2026-01-02"), robots_txt)
    assert {(r["site"], r["saved"], r["unchanged"]) for r in again.stats.collect()} == {("A", 3, 0), ("B", 0, 1)}
    first.release()


def test_pretty_json(spark):
    rows = [("T", ["a", 'b"\\'], [("H", "x\ny\tå", 1, 2), ("I", "", 2, 2)]), (None, [], [])]
    schema = "title string, keywords array<string>, chunks array<struct<heading:string,content:string,chunk_index:int,total_chunks:int>>"
    got = spark.createDataFrame(rows, schema).select(sinks.pretty_json_payload(["title", "keywords", "chunks"]).alias("p")).collect()
    keys = ("heading", "content", "chunk_index", "total_chunks")
    want = [{"title": t, "keywords": k, "chunks": [dict(zip(keys, c, strict=True)) for c in own]} for t, k, own in rows]
    assert [r["p"] for r in got] == [json.dumps(w, ensure_ascii=False, indent=2) for w in want]


def test_no_folder_of_its_own_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from corpusloom.sources.shared import shared_folder

    context = lambda master: SimpleNamespace(
        master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None
    )
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=context("spark://host:7077")))
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=context("local-cluster[2,1,1024]")))
    assert shared_folder(SimpleNamespace(sparkContext=context("local[4]"))).startswith("file://")


def test_reports(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.handle_request, daemon=True).start()
    stats = spark.createDataFrame([("b", 3, 1), ("a", 2, 0)], "site string, visited long, failed long")
    text = report.summary(stats)
    assert report.post(f"http://127.0.0.1:{server.server_port}/x", text) and got == [
        {"text": " - a: 2 besökta, 0 fel.\n - b: 3 besökta, 1 fel."}
    ]
    server.server_close()
    assert not report.post("http://127.0.0.1:9/x", text, 1) and not report.post("ingen adress", text)
    log = report.run_log(str(tmp_path), "en")
    log.info("klart")
    assert report.run_log(str(tmp_path), "en") is log and len(log.handlers) == 1
    assert (tmp_path / "logs" / "en.log").read_text().strip().endswith("INFO klart")


def test_deep_sitemaps(spark):
    xml = lambda i: f"<x><sitemap><loc>https://a.se/{i + 1}.xml</loc></sitemap><url><loc>https://a.se/p{i}</loc></url></x>".encode()
    files = spark.createDataFrame([(f"https://a.se/{i}.xml", xml(i)) for i in range(22)], "url string, body binary")
    got = sitemap.sitemap_pages(files, spark.createDataFrame([("https://a.se/0.xml",)], "url string"))
    assert {r["url"] for r in got.collect()} == {f"https://a.se/p{i}" for i in range(22)}


def test_what_is_written_leaves_no_shuffle_files(spark):
    sc = spark.sparkContext

    def shuffles() -> set[str]:
        files = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while files.hasNext():
            names.add(files.next().getName())
        return {x for x in names if x.startswith("shuffle_")}

    before = shuffles()
    df = spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    kept = shared.written(df)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    # the frame itself, still held, and what was written can both be read again
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect())) == [(k, sum(range(k, 1000, 7))) for k in range(7)]
    assert sorted(map(tuple, shared.written(df).collect())) == sorted(map(tuple, kept.collect()))
