"""Captured responses and downloaded documents: what a fetcher left behind, as tables.

Live fetching isn't part of any operator. RESPONSES is what one would write: a row for each request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import document_file_name
from ..operators.route import content_route, js_render_needed

RESPONSES = "url string, method string, status int, content_type string, disposition string, body binary, rendered_html string, fetched_at timestamp"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).parquet(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of files in a folder: the raw GET."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("content").alias("body"))


def routed(responses: DataFrame, download_documents: bool = False, hybrid: bool = True) -> DataFrame:
    """responses with `route` and, for pages, `html`: the rendered one where it is needed (always, if not hybrid) and there."""
    html = F.col("body").cast("string")
    need = js_render_needed(html) if hybrid else F.lit(True)
    page = F.col("route") == "page"
    return responses.withColumn("route", content_route(F.col("content_type"), download_documents)).withColumns(
        {
            "rendered": page & need & F.col("rendered_html").isNotNull(),
            "html": F.when(page, F.when(need, F.coalesce("rendered_html", html)).otherwise(html))
        }
    )


def documents(responses: DataFrame, done: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(the columns of by, url, file_name, body): fetched documents, each URL once, without those already downloaded (the columns of by, url)."""
    key = [*by, "url"]
    got = responses.where((content_route(F.col("content_type"), True) == "document") & (F.col("status") == 200))
    first = got.groupBy(*key).agg(F.min_by(F.struct("disposition", "body"), F.struct("fetched_at", "disposition", "body")).alias("r"))
    if done is not None:
        first = first.join(done.select(*key), key, "left_anti")
    return first.select(*key, document_file_name(F.col("url"), F.col("r.disposition")).alias("file_name"), F.col("r.body").alias("body"))
