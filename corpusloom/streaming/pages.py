"""Pages that keep arriving: records, and the cache kept up to date batch by batch.

A cache folder holds one part for each micro-batch, with what that batch brought. A batch that is run again after a failure
writes the same part anew. Reading takes the latest row of each URL; `compact` puts the parts into one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import page_records, parse_pages
from ..operators.frontier import accepted, last_wins, normalized
from ..operators.incremental import CACHE, cache_rows

STORED = "url string, content_hash string, title string, crawled_at string, content_length long, batch long"


def arriving_pages(
    spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string", files_per_trigger: int = 8
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def valid_pages(pages: DataFrame) -> DataFrame:
    """Pages that may be taken, with normalised URLs; every version of each."""
    return normalized(accepted(pages))


def batch_rows(pages: DataFrame, crawled_at: Column) -> DataFrame:
    """The cache's rows of one batch, a row for each URL; of versions alike in time, the one with the larger hash."""
    rows = cache_rows(
        page_records(parse_pages(valid_pages(pages)), crawled_at).where("error IS NULL")
    ).withColumn("crawled_at", F.col("crawled_at").cast("string"))
    return last_wins(rows.withColumn("_order", F.struct("crawled_at", "content_hash")), "url", "_order").select(CACHE)


def start(pages: DataFrame, cache_folder: str, checkpoint: str, crawled_at: Column | None = None) -> StreamingQuery:
    """Writes each micro-batch's part of the cache."""
    at = F.current_timestamp() if crawled_at is None else crawled_at

    def keep(batch: DataFrame, number: int) -> None:
        batch_rows(batch, at).write.mode("overwrite").parquet(f"{cache_folder}/batch={number}")

    return pages.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, cache_folder: str) -> DataFrame:
    try:
        return spark.read.schema(STORED).parquet(cache_folder)
    except AnalysisException:  # before the first batch there is no folder
        return spark.createDataFrame([], STORED)


def current_cache(spark: SparkSession, cache_folder: str) -> DataFrame:
    """The latest row of each URL: by time, then by batch. Empty before the first batch."""
    order = F.struct("crawled_at", "batch", "content_hash")
    return last_wins(_parts(spark, cache_folder).withColumn("_order", order), "url", "_order").select(CACHE)


def compact(spark: SparkSession, cache_folder: str, into: str) -> None:
    """The current cache as the one part of a new folder, as of the latest batch: later parts can be written beside it."""
    latest = _parts(spark, cache_folder).agg(F.max("batch")).first()[0]
    if latest is not None:
        current_cache(spark, cache_folder).write.mode("overwrite").parquet(f"{into}/batch={latest}")
