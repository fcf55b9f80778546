import pytest
from pyspark.sql import functions as F

from corpusloom.operators import frontier, incremental, route, schedule, settle, stats


def site(spark):
    links = {
        "/": ["/om-oss", "/nyheter", "#x"], "/om-oss": ["/", "/djup"], "/nyheter": ["/djup", "/saknas"],
        "/djup": ["/slut", "/bild.png"], "/slut": [], "/ensam": ["/"]
    }
    rows = [(f"https://a.se{u}", [(h, f"https://a.se{h}") for h in own]) for u, own in links.items()]
    return spark.createDataFrame(rows, "url string, links array<struct<href:string,target:string>>")


def test_crawl_of_a_small_site(spark):
    got = {(r["url"].removeprefix("https://a.se"), r["depth"], r["round"]) for r in frontier.crawl(spark, site(spark), ["https://A.se/index.html"]).collect()}
    assert got == {("/", 0, 0), ("/om-oss", 1, 1), ("/nyheter", 1, 1), ("/djup", 2, 2), ("/slut", 3, 3)}


def test_crawl_limits_and_sitemap(spark):
    extra = spark.createDataFrame([("https://a.se/ensam", 0)], "url string, seq long")
    shallow = frontier.crawl(spark, site(spark), ["https://a.se/"], extra, max_depth=1)
    assert {r["url"].removeprefix("https://a.se") for r in shallow.collect()} == {"/", "/ensam", "/om-oss", "/nyheter"}
    few = frontier.crawl(spark, site(spark), ["https://a.se/"], max_pages=2)
    assert [r["url"].removeprefix("https://a.se") for r in few.orderBy("round").collect()] == ["/", "/om-oss"]


def test_crawl_keeps_to_its_site_words_and_robots(spark):
    links = {
        "https://a.se/": ["https://b.se/", "https://www.a.se/ok", "/spam/1", "/privat/x", "/utan"], "https://b.se/": [],
        "https://www.a.se/ok": ["/djup"], "https://a.se/spam/1": [], "https://a.se/privat/x": [],
        "https://a.se/utan": []
    }
    full = lambda h: h if h.startswith("https") else f"https://a.se{h}"
    pages = spark.createDataFrame(
        [(u, [(h, full(h)) for h in own]) for u, own in links.items()],
        "url string, links array<struct<href:string,target:string>>"
    )
    seen = lambda **k: {r["url"].removeprefix("https://") for r in frontier.crawl(spark, pages, ["https://a.se/"], **k).collect()}
    everywhere = {"a.se/", "b.se/", "www.a.se/ok", "a.se/spam/1", "a.se/privat/x", "a.se/utan"}
    assert seen(strict_domain=False) == everywhere and seen() == everywhere - {"b.se/"}
    assert seen(exclude=["spam"], robots_txt="User-agent: *\nDisallow: /privat") == {"a.se/", "www.a.se/ok", "a.se/utan"}
    assert seen(require=["ok"]) == {"a.se/", "www.a.se/ok"}


def test_crawl_takes_links_of_equal_score_as_they_were_met(spark):
    order = [f"/p{(7 * i) % 20:02d}" for i in range(20)]
    rows = [("https://a.se/", [(h, f"https://a.se{h}") for h in order])] + [(f"https://a.se{h}", []) for h in sorted(order)]
    got = frontier.crawl(
        spark, spark.createDataFrame(rows, "url string, links array<struct<href:string,target:string>>"),
        ["https://a.se/"], max_pages=9
    )
    assert [r["url"].removeprefix("https://a.se") for r in got.orderBy("round", "place").collect()] == ["/", *order[:8]]


def test_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 5).alias("y")).repartition(7)
    got = settle.placed(rows, F.desc("y"), "x").collect()
    assert [r["place"] for r in sorted(got, key=lambda r: (-r["y"], r["x"]))] == list(range(1, 1001))


def test_plans_stay_short(spark, sf):
    """URL logic is worked out once: a filter over what links lead to doesn't repeat it."""
    from corpusloom import queries

    for f in (queries.links_new, queries.frontier_expand, queries.links_resolved):
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert len(plan) < 60_000 and plan.count("regexp_extract") < 60, (f.__name__, len(plan), plan.count("regexp_extract"))


def test_crawl_does_not_stop_silently(spark):
    with pytest.raises(RuntimeError):
        frontier.crawl(spark, site(spark), ["https://a.se/"], max_rounds=2)


def test_first_and_last(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "url string, seq long, v string")
    assert {tuple(r) for r in frontier.first_wins(rows).collect()} == {("a", 1, "y"), ("b", 1, None)}
    assert {tuple(r) for r in frontier.last_wins(rows, "url", "seq").collect()} == {("a", 2, "x"), ("b", 1, None)}


def test_change_detection(spark):
    schema = "url string, content_hash string, title string, crawled_at string, content_length long"
    cache = spark.createDataFrame([("a", "1", "t", "2020", 1), ("b", "1", "t", "2020", 1)], schema)
    rows = spark.createDataFrame([("a", "1", "ny", "2021", 1), ("b", "2", "t", "2021", 1), ("c", "1", "t", "2021", 1)], schema)
    assert {r["url"]: r["status"] for r in incremental.with_status(rows, cache).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r["status"] for r in incremental.with_status(rows, cache, force=True).collect()} == {"changed", "new"}
    after = {r["url"]: (r["content_hash"], r["title"], r["crawled_at"]) for r in incremental.upsert(cache, rows).collect()}
    assert after == {"a": ("1", "ny", "2021"), "b": ("2", "t", "2021"), "c": ("1", "t", "2021")}
    assert incremental.upsert(incremental.upsert(cache, rows), rows).count() == 3


def test_save_gate(spark):
    rows = spark.createDataFrame(
        [("x" * 50, "new"), ("x" * 51, "new"), ("x" * 51, "unchanged"), (None, "new")],
        "plain_text string, status string"
    )
    assert incremental.to_save(rows).count() == 1 and incremental.to_save(rows, "No text").count() == 0


def test_schedule_golden(spark):
    rows = [("a", 0, 1), ("a", 0, 2), ("a", 100_000, 3), ("a", 5_000_000, 4), ("b", 0, 5)]
    got = {r["id"]: r["start_us"] for r in schedule.schedule(spark.createDataFrame(rows, "domain string, arrive_us long, id long"), F.lit(0.5)).collect()}
    assert got == {1: 0, 2: 500_000, 3: 1_000_000, 4: 5_000_000, 5: 0}


def test_schedule_over_slots(spark):
    """A domain's requests in many slots, against the recurrence."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40_000_000), i) for i in range(400)]
    want, last = {}, {}
    for d, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[i] = last[d] = max(at, last.get(d, -(10**18)) + 150_000)
    df = spark.createDataFrame(rows, "domain string, arrive_us long, id long")
    for slot in (1, 7, 3600):
        assert {r["id"]: r["start_us"] for r in schedule.schedule(df, F.lit(0.15), slot_s=slot).collect()} == want


def test_schedule_keeps_distance(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(10_000_000), i) for i in range(300)]
    got = schedule.schedule(
        spark.createDataFrame(rows, "domain string, arrive_us long, id long"), F.lit(0.25)
    ).orderBy("domain", "start_us").collect()
    for x, y in zip(got, got[1:], strict=False):
        assert y["start_us"] >= y["arrive_us"] and (x["domain"] != y["domain"] or y["start_us"] - x["start_us"] >= 250_000)


def test_routes_and_labels(spark):
    rows = spark.createDataFrame([("text/html",), ("image/svg+xml",), ("application/zip",)], "c string")
    assert [r["r"] for r in rows.select(route.content_route(F.col("c")).alias("r")).collect()] == ["page", "drop", "drop"]
    html = spark.createDataFrame([("x" * 999,), ("x" * 1000,), ("x" * 1000 + "Enable JavaScript",), (None,)], "h string")
    assert [r["r"] for r in html.select(route.js_render_needed(F.col("h")).alias("r")).collect()] == [True, False, True, False]


def test_stats(spark):
    rows = spark.createDataFrame(
        [("s", x, x == "new") for x in ("new", "new", "unchanged", "failed", "expired", "document", "skipped")],
        "site string, status string, rendered boolean"
    )
    got = stats.run_stats(rows, "site").first().asDict()
    assert got == {"site": "s", "visited": 3, "unchanged": 1, "failed": 2, "documents": 1, "playwright_fallbacks": 2, "saved": 2}
    assert stats.summary_line(stats.run_stats(rows, "site")).first()["line"] == " - s: 3 besökta, 2 fel."
