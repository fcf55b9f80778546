"""Columns that are worked out once, and places in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def settled(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with the made columns, each worked out once however often it is used further on.

    The optimiser merges projections, so an expression stands in a plan as often as what is made of it uses it, and so do all
    expressions inside it; it does not look through a generator.
    """
    kept = [c for c in rows.columns if c not in made]
    return rows.select(*kept, F.inline(F.array(F.struct(*(c.alias(k) for k, c in made.items())))))


def placed(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """rows and their place in the given order, from 1 on; rows alike in it in any order.

    Rows are dealt out by ranges and numbered in each part; all that is gathered is a row for each part.
    """
    sorted_ = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + inside + 1).select(*rows.columns, name)
