"""When requests may start: per-domain delays and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_DELAY = 0.1


def effective_delay(configured: Column, robots: Column | None = None) -> Column:
    """Seconds. A delay that robots.txt asks for replaces the configured one, even a longer one; 0 or null asks for none."""
    own = F.greatest(configured.cast("double"), F.lit(LEAST_DELAY))
    return own if robots is None else F.coalesce(F.nullif(robots.cast("double"), F.lit(0.0)), own)


def schedule(
    requests: DataFrame, delay_s: Column, domain: str = "domain", arrive: str = "arrive_us", tie: str = "id",
    slot_s: int = 3600
) -> DataFrame:
    """requests and start_us, wait_us: start = max(arrival, start before it + delay) in each domain.

    In closed form: with k requests before it, start = k * delay + max over all up to it of (arrival - its k * delay), in
    whole microseconds; delay must be the same for all rows of a domain. Such maxima compose, so a domain is cut into
    slots of arrival times: each slot is numbered by itself, and all that goes from slot to slot is its number of requests
    and its maximum. A task sorts the requests of a domain that arrive in slot_s seconds, not all of them.
    """
    before = Window.partitionBy("_domain", "_slot").orderBy(arrive, tie)
    rows = requests.withColumns(
        {
            "_domain": F.struct(domain),
            "_slot": F.coalesce(F.floor(F.col(arrive) / F.lit(slot_s * 1_000_000)), F.lit(-1).cast("long")),
            "_delay": F.round(delay_s * 1_000_000).cast("long")
        }
    )
    numbered = rows.withColumn("_k", (F.row_number().over(before) - 1).cast("long")).withColumn(
        "_own", F.col(arrive) - F.col("_delay") * F.col("_k")
    )
    running = numbered.withColumn("_most", F.max("_own").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    slots = numbered.groupBy("_domain", "_slot").agg(F.count("*").alias("_n"), F.max("_own").alias("_top"), F.first("_delay").alias("_d"))
    earlier = Window.partitionBy("_domain").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    shifted = slots.withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))
    ).withColumn("_top", F.col("_top") - F.col("_before") * F.col("_d"))
    both = running.join(shifted.select("_domain", "_slot", "_before", F.max("_top").over(earlier).alias("_held")), ["_domain", "_slot"])
    gone = F.col("_before") * F.col("_delay")
    start = F.greatest(F.col("_most") - gone, F.col("_held")) + gone + F.col("_k") * F.col("_delay")
    return both.withColumn("start_us", start).withColumn(
        "wait_us", F.col("start_us") - F.col(arrive)
    ).select(*requests.columns, "start_us", "wait_us")


def backoff_seconds(attempts: Column) -> Column:
    """array<double>: 1, 2, 4 ... seconds before each further attempt; none for 0."""
    return F.when(
        attempts > 0, F.transform(F.sequence(F.lit(0), attempts - 1), lambda i: F.pow(F.lit(2.0), i))
    ).otherwise(F.array().cast("array<double>"))
