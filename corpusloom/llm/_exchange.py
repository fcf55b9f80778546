"""Exchanges between batches of documents and buckets of fingerprints.

Exact repeat search needs to know, for each fingerprint of a text, what other texts have it. Here a batch (some MB of
whole documents, dealt by doc_id) first makes its own fingerprints distinct, so a passage that a third of all documents
share costs one entry a batch, not one a document. Entries travel as packed numpy arrays in binary columns, dealt to
buckets by fingerprint; a bucket answers to the batches that asked. Documents are dealt once: all steps read the same
exchange, and everything is one lazy plan, which Spark recomputes by itself where an executor is lost.

How many batches and buckets there are follows the bytes of the texts, so a worker holds some tens of MB of documents at a
time. As each batch sends a row to each bucket, their number grows only with the root beyond some TB: at 100 TB a batch has
0.5 GB. Rows without doc_id are dealt by their texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import REMAKEABLE, let_go, texts

#: A packed entry: to bucket r, of or for batch b.
PACKED = "r int, b int, kind int, data binary"
PACKED_ARROW = pa.schema([("r", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the polynomial hashes (odd, so it has an inverse modulo 2^64).
BASE = np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: np.unique goes through a hash table, which is many times slower when most values differ."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


_POWERS: list[np.ndarray] = []
REMAKEABLE.append(_POWERS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = -(-n // (1 << 18)) * (1 << 18)  # in steps: lengths vary a little
        up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * BASE**position, modulo 2^64."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    up, _ = powers(len(symbols))
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def hash_of(prefix: np.ndarray, begin: np.ndarray, size) -> np.ndarray:
    """The hash of `size` symbols from each begin: equal for equal symbols."""
    _, down = powers(len(prefix))
    return (prefix[begin + size] - prefix[begin]) * down[begin]


def pack(*arrays: np.ndarray) -> bytes:
    head, body = [len(arrays).to_bytes(1, "little")], []
    for x in arrays:
        head += [x.dtype.str[1:].encode(), len(x).to_bytes(8, "little")]
        body.append(x.tobytes())
    return b"".join(head + body)


def unpack(data: bytes) -> list[np.ndarray]:
    n, out = data[0], []
    at = 1 + 10 * n
    for i in range(n):
        kind = np.dtype(bytes(data[1 + 10 * i : 3 + 10 * i]).decode())
        size = int.from_bytes(data[3 + 10 * i : 11 + 10 * i], "little")
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


def buckets(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys by bucket (and by key within), and where each bucket begins."""
    order = np.lexsort((keys, keys % np.uint64(n)))
    return order, np.searchsorted(keys[order] % np.uint64(n), np.arange(n + 1, dtype=np.uint64))


class Rows:
    """Collects packed entries."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, bytes]] = []

    def add(self, r: int, b: int, kind: int, data: bytes) -> None:
        self.rows.append((r, b, kind, data))

    def table(self) -> pa.Table:
        cols = list(zip(*self.rows, strict=True)) or [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PACKED_ARROW, strict=True)], schema=PACKED_ARROW)


class Batch:
    """The documents of one batch in ascending order of doc_id (equal ids by text): bytes end to end. Rows without doc_id have one of their own (see dealt)."""

    def __init__(self, table: pa.Table):
        import pyarrow.compute as pc

        self.b = table.column("b")[0].as_py()
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        table = table.take(order)
        self.null = table.column("no_id").to_numpy().astype(bool)
        self.doc_id = table.column("doc_id").to_numpy().astype(np.int64)
        self.texts = [x or b"" for x in table.column("text").to_pylist()]
        self.size = np.array([len(x) for x in self.texts], np.int64)
        self.again = np.zeros(len(self.texts), np.int64)  # which of the rows with this doc_id
        for i in np.flatnonzero(self.doc_id[1:] == self.doc_id[:-1]) + 1:
            self.again[i] = self.again[i - 1] + 1

    def __len__(self) -> int:
        return len(self.texts)

    def ids(self) -> pa.Array:
        return pa.array(self.doc_id, mask=self.null)


def _partition(label: int, n: int) -> int:
    """Where Spark's hash partitioning puts an int: Murmur3 (x86, 32 bits) with seed 42."""
    m = 0xFFFFFFFF

    def turn(x: int, by: int) -> int:
        return ((x << by) | (x >> (32 - by))) & m

    h = 42 ^ (turn(label * 0xCC9E2D51 & m, 15) * 0x1B873593 & m)
    h = (turn(h, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % n


@lru_cache(16)
def even_labels(groups: int, partitions: int) -> tuple[int, ...]:
    """Group numbers that Spark's hashing deals evenly: plain numbers leave some partitions empty and put many groups into others."""
    room = [groups // partitions + (i < groups % partitions) for i in range(partitions)]
    out, label = [], 0
    while len(out) < groups:
        p = _partition(label, partitions)
        if room[p]:
            room[p] -= 1
            out.append(label)
        label += 1
    return tuple(out)


def _evenly(number: Column, groups: int, partitions: int) -> Column:
    """The label of a group; beyond some thousand groups, where a list of labels is no longer short, the number itself."""
    if groups > 8192:
        return number
    return F.element_at(F.array(*(F.lit(x) for x in even_labels(groups, partitions))), number + 1)


#: Bytes of documents for each bucket, and the least for each pair of a batch and a bucket.
GROUP_BYTES, PAIR_BYTES = 64 << 20, 4096


class Deal(NamedTuple):
    """How rows are dealt: Spark's partitions, batches of documents, buckets of fingerprints; and how many rows there are."""

    partitions: int
    batches: int
    buckets: int
    rows: int


def dealing(docs: DataFrame) -> Deal:
    """Two batches and a bucket for each shuffle partition, more if they would be large."""
    p = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, size = texts(docs).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0).cast("long"))).first()
    n = max(p, min(-(-size // GROUP_BYTES), isqrt(size // (2 * PAIR_BYTES))))
    return Deal(p, 2 * n, n, rows)


#: At most so many keys, and none with fewer rows, are joined by broadcast.
MOST_HOT, LEAST_HOT = 50_000, 1000


def told(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows left joined with table on a binary key. table has a row for each key and n, the number of rows with it; total: of all rows.

    Keys with over total / MOST_HOT rows, which are at most MOST_HOT, are broadcast; their rows, and those without a key, go
    to the join of the others under keys of their own, so no key's rows meet in one task. rows has doc_id.
    """
    bound = max(LEAST_HOT, total // MOST_HOT)
    own = [c for c in table.columns if c not in (key, "n")]
    hot = table.where(F.col("n") > bound).select(key, F.struct(*own).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    spread = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(
        F.concat(F.lit(b"hot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    )
    cold = table.where(F.col("n") <= bound).select(F.col(key).alias("_key"), F.struct(*own).alias("_cold"))
    found = F.coalesce("_hot", "_cold")
    return marked.withColumn("_key", spread).join(cold, "_key", "left").select(*rows.columns, *(found[c].alias(c) for c in own))


def dealt(docs: DataFrame, deal: Deal) -> DataFrame:
    """(b, doc_id, text as bytes, no_id). Rows without doc_id get the least ones there are, by a hash of their text: they come before all others."""
    own = F.lit(-(1 << 63)).cast("long") + F.pmod(F.xxhash64("text"), F.lit(1 << 62).cast("long"))
    rows = texts(docs).select(F.coalesce("doc_id", own).alias("doc_id"), "text", F.col("doc_id").isNull().cast("int").alias("no_id"))
    return rows.select(
        _evenly(F.pmod(F.xxhash64("doc_id"), F.lit(deal.batches)).cast("int"), deal.batches, deal.partitions).alias("b"),
        "doc_id", "text", "no_id"
    )


def by_batch(docs: DataFrame, side: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(Batch, {kind: [entries]}) -> pa.Table for each batch with documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        if not left.num_rows:
            return to_arrow_schema(StructType.fromDDL(schema)).empty_table()
        given: dict[int, list[list[np.ndarray]]] = {}
        for kind, data in zip(right.column("kind").to_pylist(), right.column("data"), strict=True):
            given.setdefault(kind, []).append(unpack(data.as_buffer()))
        out = fn(Batch(left), given)
        del given, left, right
        let_go()
        return out

    return docs.groupBy("b").cogroup(side.groupBy("b")).applyInArrow(run, schema)


def by_bucket(entries: DataFrame, fn: Callable, deal: Deal) -> DataFrame:
    """fn(r, [(b, kind, arrays)], Rows) for each bucket; PACKED rows out."""

    def run(table: pa.Table) -> pa.Table:
        out = Rows()
        cols = (table.column(k).to_pylist() for k in ("b", "kind"))
        fn(table.column("r")[0].as_py(), [(b, k, unpack(d.as_buffer())) for b, k, d in zip(*cols, table.column("data"), strict=True)], out)
        made = out.table()
        del out, table, cols
        let_go()
        return made

    return entries.select(
        _evenly(F.col("r"), deal.buckets, deal.partitions).alias("label"), *PACKED_ARROW.names
    ).groupBy("label").applyInArrow(run, PACKED)


#: The kind of the entries of copies().
COPIES = 9


def copies(batches: DataFrame, deal: Deal) -> DataFrame:
    """PACKED entries for batches: the doc_ids of rows whose whole text a row with a smaller doc_id has too.

    Counted by text hash with partial sums; of groups of two or more only (hash, least id) goes back.
    """
    keyed = batches.where("text IS NOT NULL").select("b", "doc_id", F.unhex(F.sha2("text", 256)).alias("h"))
    first = keyed.groupBy("h").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    ).where("first < last").select("h", "first", "n")
    later = told(keyed, first, "h", deal.rows).where("doc_id > first").select("b", "doc_id")

    def run(table: pa.Table) -> pa.Table:
        out = Rows()
        out.add(0, table.column("b")[0].as_py(), COPIES, pack(np.sort(table.column("doc_id").to_numpy().astype(np.int64))))
        return out.table()

    return later.groupBy("b").applyInArrow(run, PACKED)


def is_copy(batch: Batch, given: dict) -> np.ndarray:
    """Of the batch's rows; a repeated row (same doc_id again) is never called a copy here, its repeats are found as any others."""
    own = [x[0] for x in given.get(COPIES, ())]
    return np.isin(batch.doc_id, np.concatenate(own)) & (batch.again == 0) & ~np.append(batch.again[1:] > 0, False) if own and len(batch) else np.zeros(len(batch), bool)
