"""The crawl frontier as tables: candidates, what was seen, and rounds of expansion.

A crawl's queue depends on timing; here rounds are level-synchronous and ties are broken by (score, sequence, depth, url), so
a run can be repeated. The sequence is the order in which links are met: by round, then by their page's place in the round,
then by their place on the page. The first time a URL is found fixes its score and depth.
"""

from __future__ import annotations

import itertools
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import LINK, SITEMAP, START, frontier_score, is_followed, is_valid_url, normalize_url, parts_struct, strip
from ..sources import robots
from ..sources.shared import written
from .settle import settled

ENTRY = ["url", "depth", "score", "seq"]


def first_wins(candidates: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """One row for each key, the one that came first: a partial aggregate, so frequent keys are reduced before the shuffle."""
    rest = [c for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("_first")
    ).select(key, "_first.*").select(candidates.columns)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("_last")
    ).select(key, "_last.*").select(rows.columns)


def normalized(rows: DataFrame, url: str = "url") -> DataFrame:
    """rows with the URL in its normal form."""
    known = settled(rows, _p=parts_struct(strip(F.col(url))))
    return settled(known, **{url: normalize_url(F.col(url), of=F.col("_p"))}).drop("_p")


def accepted(
    rows: DataFrame, domain: Column | None = None, exclude: Column | None = None, require: Column | None = None, rules: Column | None = None, url: str = "url"
) -> DataFrame:
    """The rows whose URL may be taken, as it was found; domain, keywords and robots rules can be columns of rows."""
    known = settled(rows, _p=parts_struct(F.col(url)))
    kept = known.where(is_valid_url(F.col(url), domain, exclude, require, of=F.col("_p"))).drop("_p")
    return kept if rules is None else kept.withColumn("_key", robots.match_key(F.col(url))).where(
        robots.is_allowed(rules, F.col("_key"))
    ).drop("_key")


def candidates(
    found: DataFrame, base: int = LINK, depth: Column | int = 0, domain: Column | None = None, exclude: Column | None = None, require: Column | None = None, rules: Column | None = None
) -> DataFrame:
    """Frontier entries of (url, seq): filtered as found, then normalised and scored, one for each normal form."""
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    kept = normalized(accepted(found.withColumn("depth", depth.cast("int")), domain, exclude, require, rules))
    return first_wins(kept.withColumn("score", frontier_score(F.col("url"), base, F.col("depth"))).select(ENTRY))


def unseen(entries: DataFrame, seen: DataFrame) -> DataFrame:
    return entries.join(seen.select("url"), "url", "left_anti")


def top(entries: DataFrame, n: int) -> DataFrame:
    """The n entries to be taken next, with `rank`."""
    order = ["score", "seq", "depth", "url"]
    picked = entries.orderBy(*order).limit(n)
    # n rows: their rank is found after the limit
    from pyspark.sql.window import Window

    return picked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def expand(
    links: DataFrame, max_depth: int = 0, domain: Column | None = None, exclude: Column | None = None, require: Column | None = None, rules: Column | None = None
) -> DataFrame:
    """Entries for the targets of (depth, seq, href, target); max_depth 0: no limit."""
    rows = links.where(is_followed(F.col("href")))
    if max_depth:
        rows = rows.where(F.col("depth") < max_depth)
    return candidates(
        rows.select(F.col("target").alias("url"), "seq", F.col("depth").alias("_d")), LINK, F.col("_d") + 1, domain,
        exclude, require, rules
    )


def _words(keywords: list[str] | None) -> Column | None:
    return F.array(*(F.lit(k) for k in keywords)) if keywords else None


def _rules(text: str | None) -> Column | None:
    """Of one site's robots.txt, as a literal; None: no rules."""
    own = robots.read_policy(text)["rules"]
    return F.array(*(F.struct(F.lit(r["allow"]).alias("allow"), F.lit(r["path"]).alias("path")) for r in own)) if own else None


def crawl(
    spark, pages: DataFrame, start: list[str], sitemap: DataFrame | None = None, max_pages: int = 0, max_depth: int = 0, max_rounds: int = 0, checkpoint=None,
    strict_domain: bool = True, exclude: list[str] | None = None, require: list[str] | None = None, robots_txt: str | None = None,
) -> DataFrame:
    """The pages that a crawl of captured pages (url, links: array<struct<href,target>>) visits: url, depth, score, round, place.

    A round takes all of the frontier that is captured, in order of score up to max_pages, and expands it. State is a
    table of URLs; each round is written by `checkpoint` (DataFrame -> DataFrame), so plans stay short. Rounds go on until
    nothing is left (max_rounds 0), or raise if there is more after max_rounds.

    Links and sitemaps' URLs, though not the start, must be of the first start URL's domain (strict_domain), hold none of the
    excluded and one of the required words, and be allowed by robots_txt. `place` is a page's order in its round, from 0 on
    with gaps. Of captured pages with one normal form the one whose URL sorts first counts; of equal URLs the one with the least
    `seq`, if pages have that column.
    """
    checkpoint = checkpoint or written
    domain = F.lit(urlsplit(start[0].strip()).netloc.lower()) if strict_domain and start else None
    gates = domain, _words(exclude), _words(require), _rules(robots_txt)
    order = lambda number, place, at: F.struct(
        number.cast("int").alias("round"), place.cast("long").alias("place"), at.cast("int").alias("at")
    )
    own = ["seq"] if "seq" in pages.columns else []
    known = normalized(pages.select(F.col("url").alias("raw"), "url", "links", *own))
    known = known.groupBy("url").agg(F.min_by("links", F.struct("raw", *own, F.xxhash64("links"))).alias("links"))
    begin = spark.createDataFrame(
        [(u, i) for i, u in enumerate(start)], "url string, seq long"
    ).withColumn("url", normalize_url(F.col("url")))
    front = first_wins(
        begin.withColumns(
            {"depth": F.lit(0), "score": frontier_score(F.col("url"), START, 0), "seq": order(F.lit(-2), F.col("seq"), F.lit(0))}
        ).select(ENTRY)
    )
    if sitemap is not None:
        more = candidates(sitemap.select("url", order(F.lit(-1), F.col("seq"), F.lit(0)).alias("seq")), SITEMAP, 0, *gates)
        front = first_wins(front.unionByName(more))
    seen, visited, taken = checkpoint(front), None, 0
    front = seen
    for number in itertools.count():
        here = front.join(known, "url").orderBy("score", "seq", "depth", "url")
        if max_pages:
            here = here.limit(max_pages - taken)
        # numbers that grow along the order
        here = checkpoint(here.withColumns({"round": F.lit(number), "place": F.monotonically_increasing_id()}))
        count = here.count()
        if not count:
            break
        if max_rounds and number >= max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        taken += count
        got = here.select("url", "depth", "score", "round", "place")
        visited = got if visited is None else visited.unionByName(got)
        if max_pages and taken >= max_pages:
            break
        links = here.select("depth", "place", F.posexplode("links").alias("at", "link")).select(
            "depth", order(F.lit(number), F.col("place"), F.col("at")).alias("seq"), "link.href", "link.target"
        )
        front = checkpoint(unseen(expand(links, max_depth, *gates), seen))
        seen = checkpoint(seen.unionByName(front))
    return visited if visited is not None else spark.createDataFrame([], "url string, depth int, score int, round int, place long")
