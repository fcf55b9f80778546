"""Statistics of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def run_stats(pages: DataFrame, *by: str) -> DataFrame:
    """Counters of page outcomes (status: new, changed, unchanged, failed, expired, document, skipped; rendered boolean),
    by e.g. site. Unchanged pages count as visited, documents and skipped ones don't; expired ones are failed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    out = pages.groupBy(*by).agg(
        n("new", "changed", "unchanged")("visited"), n("unchanged")("unchanged"), n("failed", "expired")("failed"), n("document")("documents"),
        F.count_if(F.coalesce(F.col("rendered"), F.lit(False))).alias("playwright_fallbacks"),
    )
    return out.withColumn("saved", F.col("visited") - F.col("unchanged"))


def duration_seconds(start: Column, end: Column, now: Column) -> Column:
    return (_micros(F.coalesce(end, now)) - _micros(start)) / 1_000_000


def pages_per_second(visited: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, visited / seconds).otherwise(0.0)


def eta(visited: Column, seconds: Column, waiting: Column, max_pages: Column | int = 0) -> Column:
    """What is left, in words. waiting: queued and active pages."""
    most = max_pages if isinstance(max_pages, Column) else F.lit(max_pages)
    left = F.when(most > 0, F.least(waiting, most - visited)).otherwise(waiting)
    s = seconds / visited * left
    whole = lambda x: F.floor(x).cast("string")
    text = (
        F.when(left <= 0, "Klar snart")
        .when(s > 3600, F.concat(whole(s / 3600), F.lit("h "), whole((s - F.floor(s / 3600) * 3600) / 60), F.lit("m")))
        .when(s > 60, F.concat(whole(s / 60), F.lit("m "), whole(s - F.floor(s / 60) * 60), F.lit("s")))
        .otherwise(F.concat(whole(s), F.lit("s")))
    )
    return F.when(visited > 2, text).otherwise("Beräknar...")


def summary_line(stats: DataFrame, name: str = "site") -> DataFrame:
    """One row for each site: `line`."""
    return stats.select(
        name,
        F.concat(
            F.lit(" - "), F.col(name), F.lit(": "), F.col("visited").cast("string"), F.lit(" besökta, "),
            F.col("failed").cast("string"), F.lit(" fel.")
        ).alias("line")
    )
