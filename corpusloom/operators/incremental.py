"""Change detection against a page cache: url, content_hash, title, crawled_at, content_length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frontier import last_wins
from .route import save_gate
from .settle import placed

CACHE = ["url", "content_hash", "title", "crawled_at", "content_length"]


def cache_rows(records: DataFrame, text: str = "plain_text", content_hash: Column | None = None) -> DataFrame:
    """The cache's columns of page records, with the hash of the cleaned text."""
    from ..functions.text import clean_hash

    h = clean_hash(F.col(text)) if content_hash is None else content_hash
    return records.select("url", h.alias("content_hash"), "title", "crawled_at", F.length(text).cast("long").alias("content_length"))


def with_status(rows: DataFrame, cache: DataFrame, incremental: Column | bool = True, force: bool = False) -> DataFrame:
    """rows (url, content_hash, ...) and `status`: new, changed or unchanged. Not incremental, or force: nothing counts as unchanged."""
    wanted = incremental if isinstance(incremental, Column) else F.lit(incremental)
    known = cache.select("url", F.col("content_hash").alias("_cached"))
    same = F.col("_cached").eqNullSafe(F.col("content_hash")) & F.col("_cached").isNotNull() & wanted & F.lit(not force)
    status = F.when(F.col("_cached").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return rows.join(known, "url", "left").withColumn("status", status).drop("_cached")


def upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache after rows: for each url the latest of all; of rows alike in time, the one with the larger hash."""
    order = F.struct("crawled_at", F.col("_new"), "content_hash")
    both = cache.select(*CACHE, F.lit(0).alias("_new")).unionByName(rows.select(*CACHE, F.lit(1).alias("_new")))
    return last_wins(both.withColumn("_order", order), "url", "_order").select(CACHE)


def to_save(rows: DataFrame, save_format: Column | str = ".md", text: str = "plain_text") -> DataFrame:
    """What becomes a file: new or changed, long enough, in a format that has text."""
    return rows.where((F.col("status") != "unchanged") & save_gate(F.col(text), save_format))


def ordered_cache(cache: DataFrame) -> DataFrame:
    """All of the cache, newest first, with `place` from 1 on; of rows alike in time the one whose URL sorts first."""
    return placed(cache.select(CACHE), F.desc("crawled_at"), "url")


def index_rows(cache: DataFrame, save_format: str = ".md") -> DataFrame:
    """The index: URL, Titel, Hämtad_Datum, Filnamn, newest first."""
    from ..functions.urls import page_file_name

    name = page_file_name(F.col("url"), F.col("content_hash"), save_format)
    return cache.orderBy(F.desc("crawled_at"), "url").select(
        F.col("url").alias("URL"), F.col("title").alias("Titel"),
        F.col("crawled_at").cast("string").alias("Hämtad_Datum"), name.alias("Filnamn")
    )
