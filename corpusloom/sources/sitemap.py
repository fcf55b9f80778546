"""Sitemaps: captured XML files, gzipped or not, that may lead to further sitemaps."""

from __future__ import annotations

import gzip
import itertools
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def _unpack(urls: pd.Series, bodies: pd.Series) -> pd.Series:
    def one(url: str, body: bytes | None) -> str | None:
        if body is None:
            return None
        try:
            return (gzip.decompress(body) if (url or "").lower().endswith(".gz") else bytes(body)).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None

    return pd.Series([one(u, b) for u, b in zip(urls, bodies, strict=True)], dtype=object)


def sitemap_xml(url: Column, body: Column) -> Column:
    """The text of a sitemap's body; gunzipped if the URL ends in .gz; null if that fails."""
    return F.pandas_udf(_unpack, "string")(url, body)


def _replacing(old: str, new: str):
    return lambda x: F.replace(x, F.lit(old), F.lit(new))


def _locations(xml: Column, kind: str) -> Column:
    each = F.regexp_extract_all(xml, F.lit(rf"(?is)<(?:\w+:)?{kind}\b[^>]*>(.*?)</(?:\w+:)?{kind}\s*>"), F.lit(1))
    loc = F.transform(
        each,
        lambda x: F.trim(
            F.regexp_replace(
                F.regexp_extract(x, r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</(?:\w+:)?loc\s*>", 1),
                r"(?s)\A<!\[CDATA\[(.*)\]\]>\z", "$1"
            )
        )
    )
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        loc = F.transform(loc, _replacing(entity, plain))
    return F.filter(loc, lambda u: u != "")


def page_locations(xml: Column) -> Column:
    """array<string>: of <url> elements, in order."""
    return _locations(xml, "url")


def child_locations(xml: Column) -> Column:
    """array<string>: of <sitemap> elements, in order."""
    return _locations(xml, "sitemap")


def sitemap_pages(files: DataFrame, start: DataFrame, max_rounds: int = 0) -> DataFrame:
    """(sitemap, position, url) of all sitemaps that lead on from start (url); files: captured (url, body binary).

    A round for each level; a sitemap that was met before isn't followed again, so loops end.
    Rounds go on until nothing is left (max_rounds 0), or raise if there is more after max_rounds.
    """
    xml = written(files.select("url", sitemap_xml(F.col("url"), F.col("body")).alias("xml")))
    front = start.select("url").distinct()
    seen, out = front, None
    for number in itertools.count():
        here = written(xml.join(front, "url"))
        if here.isEmpty():
            break
        if max_rounds and number >= max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        pages = here.select(F.col("url").alias("sitemap"), F.posexplode(page_locations(F.col("xml"))).alias("position", "url"))
        out = pages if out is None else out.unionByName(pages)
        front = written(here.select(F.explode(child_locations(F.col("xml"))).alias("url")).distinct().join(seen, "url", "left_anti"))
        seen = seen.unionByName(front)
    return out if out is not None else files.sparkSession.createDataFrame([], "sitemap string, position int, url string")


def accepted_counts(
    pages: DataFrame, domain: Column | None = None, exclude: Column | None = None, require: Column | None = None,
    seen: DataFrame | None = None
) -> DataFrame:
    """(sitemap, n): how many URLs of (sitemap, position, url) a crawl takes over: valid, not seen (url, normalised) before, each
    once, for the sitemap that sorts first."""
    from ..operators.frontier import accepted, first_wins, normalized

    kept = normalized(accepted(pages.select("sitemap", "position", "url"), domain, exclude, require))
    own = first_wins(kept.select("url", F.struct("sitemap", "position").alias("seq")))
    if seen is not None:
        own = own.join(seen.select("url"), "url", "left_anti")
    return own.groupBy(F.col("seq.sitemap").alias("sitemap")).agg(F.count("*").alias("n"))
