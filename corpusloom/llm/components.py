"""Connected components by alternating stars (Kiveris et al., 2014), in DataFrame joins.

No node's edges are gathered: minima are partial aggregates, and the joins that spread them can be split by Spark where
one node has a large part of all edges. Each round is written to the shared folder. Nodes without edges aren't listed;
an empty table gives an empty one. Null ends are left out; self-links and repeated links do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contract(batches):
    """Each partition's edges as stars around the least node of each of its own components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up] if up in root else up
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = np.array([x for x in root if find(x) != x], np.int64)
    tops = np.array([find(x) for x in nodes.tolist()], np.int64)
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(tops[i : i + (1 << 16)])], schema=EDGES)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (a, b) with a > b."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = edges.unionAll(turned) if large else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        spread = turned.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        spread = edges.join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).unionAll(least.select("a", F.col("m").alias("b")))
    return spread.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node of each node's component, for the nodes of edges (a, b)."""
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    now = written(ends.mapInArrow(_contract, "a long, b long").distinct())
    state = None
    for _ in range(max_rounds):
        now = written(_star(_star(now, large=True), large=False))
        # where nothing changes any more, each edge leads to the least node
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = after
    raise RuntimeError(f"no end after {max_rounds} rounds")
