"""Near-duplicate classes: BagMinHash signatures, bands, exact check of weighted Jaccard similarity, components.

A document is the bag of its 5-word shingles (one shingle of all words if there are fewer). Two documents are linked if
the weighted Jaccard similarity of their bags, sum of least counts / sum of largest counts, is 0.8 or more.

Signature (after Ertl's BagMinHash): a shingle's weight axis is cut into the intervals [0,1), [1,2), [2,4), [4,8) ... On each
runs a Poisson process whose rate is the interval's length, seeded by shingle and interval; every point has a time, a
component of the signature, and a height in its interval. A bag with count c sees the points below c: whole intervals
need no test, the one that holds c is split at c. A component keeps its earliest point, so two bags agree in it with
exactly their weighted Jaccard similarity. Processes are followed in rounds, for all documents of a slice at once, and each
only while its next point can still be earlier than the document's latest component.

Bands of 4 of the 64 components are sorted by (band's hash, sketch of the next components) over a range partitioning, so
a bucket that holds a third of all documents is spread over many tasks. First each document of a bucket is paired with the
first one, and, unless both agree well with that, with its neighbours in sketch order, and the pairs are checked on the
bags themselves. A bucket whose documents are then in one component has nothing more to tell. In every other one, all
documents outside its largest component are compared with all of the bucket, on the bags and block by block; in large
buckets the document with most links is tried with all others before that, which joins the copies of one original. So each
pair that shares a band is compared, or its documents are known to be in one class. What is left for blocks can grow with
the square of a bucket of documents that are alike but under 0.8. Equal texts are put together beforehand and count as one.
The chance that a single pair at 0.8 shares no band is 0.0002; one at 0.9 shares one but for 4e-8.

Texts without words (null, empty) and rows without doc_id are in no group: their class is their own doc_id. Rows with one
doc_id are one document: a link of any of them is its link. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_texts, texts, values
from ._exchange import hash_of, mix, told
from ..sources.shared import written
from .components import components
from .passage_dedup import Words

SHINGLE = 5
PARTS, ROWS = 64, 4
BANDS = PARTS // ROWS
#: Components in a sketch (a byte each), and how many must agree: for a pair; with the first of a bucket to need no neighbours.
SKETCH, LEAST, SURE = 32, 16, 28
#: Neighbours in sketch order.
NEAR = 4
#: Documents and bytes of bags in a block; rounds that try a large bucket's document with most links first.
BLOCK, BLOCK_BYTES, HUBS = 1024, 8 << 20, 3
#: The similarity as a fraction, so that the check is in whole numbers.
OVER, UNDER = 4, 5


def bags(raw: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) in order of document and shingle."""
    words = Words(raw)
    start, doc = words.starts(shingle)
    h = words.hashes(start, shingle)
    short = np.flatnonzero((words.count > 0) & (words.count < shingle))
    if len(short):
        n = words.count[short]
        doc, h = np.append(doc, short), np.append(h, mix(hash_of(words.prefix, words.first[short], n) ^ n.astype(np.uint64)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[fresh], h[fresh], np.diff(np.append(fresh, len(h)))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(doc: np.ndarray, item: np.ndarray, count: np.ndarray, n: int, parts: int = PARTS) -> np.ndarray:
    """n x parts signature; rows of documents without items are 0."""
    top = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # the last interval below the count
    process = np.repeat(np.arange(len(doc)), top + 1)
    level = np.arange(len(process)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    inside = np.minimum(count[process] - low, width)
    seed = mix(item[process] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    owner, time = doc[process], np.zeros(len(process))
    first = np.full(n * parts, np.inf)
    winner = np.zeros(n * parts, np.uint64)
    step = 1
    while len(owner):
        a = mix(seed + np.uint64(step * 0xA0761D6478BD642F % (1 << 64)))
        b = mix(a + np.uint64(0xE7037ED1A0B428DB))
        time = time - np.log(_unit(a)) / width
        slot = owner * parts + (b % np.uint64(parts)).astype(np.int64)
        ok = time < first[slot]
        partly = inside < width
        if partly.any():
            ok &= ~partly | ((_unit(mix(b)) * width).astype(np.int64) < inside)
        s, t = slot[ok], time[ok]
        np.minimum.at(first, s, t)
        won = t == first[s]
        winner[s[won]] = b[ok][won]
        live = time < first.reshape(n, parts).max(axis=1)[owner]
        owner, time, seed, width, inside = owner[live], time[live], seed[live], width[live], inside[live]
        step += 1
    return winner.reshape(n, parts)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text; null without words), sig: one row per row of docs."""

    def fn(batch):
        raw = values(batch)
        doc, item, count = bags(raw)
        sig = (bag_min_hash(doc, item, count, len(raw)) >> np.uint64(32)).astype("<u4")
        some = np.bincount(doc, minlength=len(raw)) > 0
        return {
            "doc_id": batch.column("doc_id"),
            "key": [xxhash.xxh3_128_digest(t) if ok else None for t, ok in zip(raw, some.tolist(), strict=True)],
            "sig": [x.tobytes() if ok else None for x, ok in zip(sig, some.tolist(), strict=True)],
        }

    return map_texts(texts(docs), fn, "doc_id long, key binary, sig binary")


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, PARTS)
        ids = batch.column("doc_id").to_numpy()
        low = np.concatenate([sig, sig], axis=1).astype(np.uint8)
        for band in range(BANDS):
            key = np.zeros(len(sig), np.uint64) + np.uint64(band)
            for i in range(ROWS):
                key = mix(key ^ sig[:, band * ROWS + i])
            sketch = np.ascontiguousarray(low[:, (band + 1) * ROWS : (band + 1) * ROWS + SKETCH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(ids)],
                ["key", "sketch", "id"]
            )


PAIRS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _pairs(batches):
    """First pairs (null, a, b) of a partition that is sorted by key and sketch, and the members (key, a, null) of buckets.

    What a bucket leaves for the next batch is its first document and its last few. All rows are members but those whose
    bucket is seen to have no other: a bucket that goes on in another batch or partition is whole.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        skip = 0
        if held is not None and held[0][0] == key[0]:
            key, ids, sketch = (np.concatenate(x) for x in zip(held, (key, ids, sketch), strict=True))
            skip = len(held[0])
        n = len(key)
        begin = np.searchsorted(key, key) if (key[1:] >= key[:-1]).all() else np.maximum.accumulate(
            np.where(np.append(True, key[1:] != key[:-1]), np.arange(n), 0)
        )
        agree = (sketch == sketch[begin]).sum(axis=1)
        mine = np.flatnonzero((begin < np.arange(n)) & (np.arange(n) >= skip) & (agree >= LEAST))
        a, b = [ids[begin[mine]]], [ids[mine]]
        for d in range(1, NEAR + 1):
            later = np.arange(max(d, skip), n)
            x = later - d
            ok = (x > begin[later]) & ((agree[later] < SURE) | (agree[x] < SURE))
            later, x = later[ok], x[ok]
            ok = (sketch[later] == sketch[x]).sum(axis=1) >= LEAST
            a.append(ids[x[ok]])
            b.append(ids[later[ok]])
        last = begin[-1]
        keep = np.unique(np.append(last, np.arange(max(last, n - NEAR), n)))
        held = key[keep], ids[keep], sketch[keep]
        a, b = np.concatenate(a), np.concatenate(b)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        same = np.concatenate([[True], key[1:] == key[:-1], [True]])
        member = np.flatnonzero((same[1:] | same[:-1] | (key == key[0]) | (key == key[-1])) & (np.arange(n) >= skip))
        yield pa.RecordBatch.from_arrays([pa.nulls(found.shape[1], pa.int64()), pa.array(found[0]), pa.array(found[1])], schema=PAIRS)
        yield pa.RecordBatch.from_arrays([pa.array(key[member]), pa.array(ids[member]), pa.nulls(len(member), pa.int64())], schema=PAIRS)


def buckets(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, sig): first pairs a < b of doc_ids that share a band and look alike; (key, id) of the buckets of more than one document."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("doc_id", "sig").mapInArrow(_bands, "key long, sketch binary, id long")
    both = written(
        rows.repartitionByRange(n, "key", "sketch").sortWithinPartitions("key", "sketch", "id").mapInArrow(_pairs, "key long, a long, b long")
    )
    return both.where("key IS NULL").select("a", "b").distinct(), both.where("key IS NOT NULL").select("key", F.col("a").alias("id")).distinct()


def _bag_rows(docs: DataFrame) -> DataFrame:
    def fn(batch):
        raw = values(batch)
        doc, item, count = bags(raw)
        edges = np.searchsorted(doc, np.arange(len(raw) + 1))
        return {
            "doc_id": batch.column("doc_id"),
            "bag": [
                item[i:j].tobytes() + count[i:j].astype("<u4").tobytes() for i, j in zip(
                    edges[:-1].tolist(), edges[1:].tolist(), strict=True
                )
            ]
        }

    return map_texts(docs, fn, "doc_id long, bag binary")


def _similar(batches):
    def bag(data: bytes):
        n = len(data) // 12
        return np.frombuffer(data, np.uint64, n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)

    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        ok = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            (i, n), (j, m) = bag(x), bag(y)
            at = np.minimum(np.searchsorted(j, i), max(len(j) - 1, 0))
            both = j[at] == i if len(j) else np.zeros(len(i), bool)
            least = int(np.minimum(n[both], m[at[both]]).sum())
            ok.append(UNDER * least >= OVER * (int(n.sum()) + int(m.sum()) - least) and least > 0)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose bags are as similar as asked."""
    needed = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bag = _bag_rows(texts(docs).join(needed, "doc_id", "left_semi"))
    both = pairs.join(
        bag.select(F.col("doc_id").alias("a"), F.col("bag").alias("x")), "a"
    ).join(bag.select(F.col("doc_id").alias("b"), F.col("bag").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long")


def _items(data: bytes) -> np.ndarray:
    """A bag as a set: an item for each occurrence of a shingle, so the sizes of sets are those of bags."""
    n = len(data) // 12
    item, count = np.frombuffer(data, np.uint64, n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item = np.repeat(item, count)
    return np.where(level > 0, mix(item ^ mix(level.astype(np.uint64))), item)


def _alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """left x right: are the sets as similar as asked?"""
    size = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    row = [np.repeat(np.arange(len(n)), n) for n in size]
    shared = np.intersect1d(*flat)
    least = np.zeros((len(left), len(right)), np.int64)
    if len(shared):
        at = [np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in flat]
        ok = [shared[a] == x for a, x in zip(at, flat, strict=True)]
        at, row = [a[k] for a, k in zip(at, ok, strict=True)], [r[k] for r, k in zip(row, ok, strict=True)]
        for begin in range(0, len(shared), 2048):
            width = min(2048, len(shared) - begin)
            parts = []
            for n, a, r in zip(size, at, row, strict=True):
                mine = (a >= begin) & (a < begin + width)
                part = np.zeros((len(n), width), np.float32)  # sums of at most 2048 ones are exact
                part[r[mine], a[mine] - begin] = 1
                parts.append(part)
            least += (parts[0] @ parts[1].T).astype(np.int64)
    return (UNDER * least >= OVER * (size[0][:, None] + size[1][None, :] - least)) & (least > 0)


def _block_links(rows: list[dict]):
    """Links between the sides of a block pair, or inside a block of one side: a forest of those that join two components."""
    sides = [[r for r in rows if r["side"] == k] for k in (0, 1)]
    left, right = sides[0], sides[1] or sides[0]
    if not left:
        return
    class_of = [np.array([r["class"] for r in side], np.int64) for side in (left, right)]
    other = class_of[0][:, None] != class_of[1][None, :]
    use = np.flatnonzero(other.any(axis=1)), np.flatnonzero(other.any(axis=0))
    if not len(use[0]):
        return
    items = [_items(left[i]["bag"]) for i in use[0]]
    more = items if right is left else [_items(right[i]["bag"]) for i in use[1]]
    ok = _alike(items, more) & other[np.ix_(*use)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up] if up in root else up
            x = up
        return x

    for i in np.flatnonzero(ok.any(axis=1)):
        a = left[use[0][i]]
        # one link to each class is enough
        for j in use[1][ok[i]][np.unique(class_of[1][use[1][ok[i]]], return_index=True)[1]]:
            x, y = find(a["class"]), find(right[j]["class"])
            if x != y:
                root[max(x, y)] = min(x, y)
                yield a["doc_id"], right[j]["doc_id"]


def _blocks(batches):
    """Links of partitions that are sorted by key, i and j."""
    at, rows = None, []

    def out():
        found = list(_block_links(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"]
        )

    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        for r in batch.to_pylist():
            if (here := (r["key"], r["i"], r["j"])) != at:
                if rows:
                    yield out()
                at, rows = here, []
            rows.append(r)
    if rows:
        yield out()


def _unsettled(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of more than one component: (key, id, class) and (key, main, total, most), the largest component and the numbers of documents. Of equal buckets one."""
    named = members.join(
        found.select(F.col("node").alias("id"), "component"), "id", "left"
    ).select("key", "id", F.coalesce("component", "id").alias("class"))
    each = named.groupBy("key", "class").agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"),
        F.bit_xor(F.xxhash64("id")).alias("hash")
    )
    some = each.groupBy("key").agg(
        F.count("*").alias("classes"), F.max_by("class", F.struct("n", "class")).alias("main"),
        F.sum("n").alias("total"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.bit_xor("hash").alias("hash")
    )
    some = written(
        some.where("classes > 1").groupBy("total", "low", "high", "hash").agg(
            F.min(F.struct("key", "main", "most")).alias("m")
        ).select("m.key", "m.main", "total", "m.most")
    )
    return written(named.join(some.select("key"), "key")), some


def _hub_pairs(named: DataFrame, large: DataFrame, links: DataFrame) -> DataFrame:
    """Each large bucket's document with most links, with those of its bucket that are in other components."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    inside = named.join(large.select("key"), "key")
    hub = inside.join(degree, "id").groupBy("key").agg(F.max_by(F.struct("id", "class"), F.struct("n", "id")).alias("hub"))
    return inside.join(hub, "key").where("class <> hub.class").select(
        F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")
    ).distinct()


def _exhaustive(docs: DataFrame, named: DataFrame, some: DataFrame) -> DataFrame:
    """Links of all pairs of a bucket that aren't in one component: documents outside the largest, by blocks, with each other and with the largest."""
    bag = written(
        _bag_rows(
            texts(docs).join(named.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        ).select("doc_id", "bag", F.length("bag").cast("long").alias("size"))
    )
    rows = named.join(some.select("key", "main"), "key").withColumn("rest", F.col("class") != F.col("main")).join(
        bag.select(F.col("doc_id").alias("id"), "size"), "id"
    )
    blocks = lambda rest: F.greatest(
        F.lit(1), F.ceil(F.greatest(F.sum(F.when(rest, 1)) / BLOCK, F.sum(F.when(rest, F.col("size"))) / BLOCK_BYTES))
    ).cast("long")
    number = rows.groupBy("key").agg(blocks(F.col("rest")).alias("r"), blocks(~F.col("rest")).alias("m"))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("m")))
    # j is a block of the rest under r, and one of the largest component from there on; side 0 is block i
    placed = rows.select("key", "id", "class", "rest").distinct().join(number, "key").withColumn("k", mine)
    first = F.transform(
        F.sequence("k", F.col("r") + F.col("m") - 1),
        lambda j: F.struct(F.col("k").alias("i"), j.alias("j"), F.lit(0).alias("side"))
    )
    second = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("k")),
        lambda i: F.struct(i.alias("i"), F.col("k").alias("j"), F.lit(1).alias("side"))
    )
    against = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("r") - 1),
        lambda i: F.struct(i.alias("i"), (F.col("r") + F.col("k")).alias("j"), F.lit(1).alias("side"))
    )
    at = F.when(F.col("rest"), F.concat(first, F.filter(second, lambda x: x["i"] < x["j"]))).otherwise(against)
    pairs = placed.select(
        "key", F.col("id").alias("doc_id"), "class", F.explode(at).alias("at")
    ).select("key", "doc_id", "class", "at.*").join(bag.select("doc_id", "bag"), "doc_id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select(
        "key", "i", "j", "side", "doc_id", "class", "bag"
    ).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(_blocks, "a long, b long")


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(node, component) of the links between the doc_ids of (doc_id, sig) that share a band."""
    pairs, members = buckets(distinct)
    linked = written(verified(docs, pairs))
    found = components(linked)
    edges = lambda new: found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(new)
    named, some = _unsettled(members, found)
    for _ in range(HUBS):
        large = some.where(F.col("total") - F.col("most") > BLOCK)
        if large.isEmpty():
            break
        new = written(verified(docs, _hub_pairs(named, large, linked)))
        if new.isEmpty():
            break
        linked, found = linked.unionAll(new), components(edges(new))
        named, some = _unsettled(members, found)
    if some.isEmpty():
        return found
    new = written(_exhaustive(docs, named, some))
    return found if new.isEmpty() else components(edges(new))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (the least doc_id with this very text), class_id (the least of all that links lead to): one row per row of docs."""
    sig = written(signatures(docs))
    some = sig.where("key IS NOT NULL AND doc_id IS NOT NULL")
    least = written(
        some.groupBy("key").agg(
            F.min(F.struct("doc_id", "sig")).alias("m"), F.count("*").alias("n")
        ).select("key", "m.doc_id", "m.sig", "n")
    )
    found = links(docs, least).select(F.col("node").alias("text_id"), F.col("component").alias("class_id"))
    # a row for each text; only texts with copies, and only texts with links, have anything to tell
    classes = least.select(
        "key", F.col("doc_id").alias("text_id"), "n"
    ).join(found, "text_id", "left").where("n > 1 OR class_id IS NOT NULL")
    named = told(
        sig.select("doc_id", "key"),
        written(classes.select("key", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), "n")), "key",
        sig.count()
    )
    return named.select("doc_id", F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def brute_force(rows: list[tuple[int, str]]) -> dict[int, int]:
    """doc_id -> class_id, from the definition."""
    from collections import Counter

    own: dict[int, Counter] = {}
    for d, text in rows:
        w = (text or "").encode().split()
        own[d] = Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else Counter()
    holders: dict[tuple, list[int]] = {}
    for d in sorted(own):
        for s in own[d]:
            holders.setdefault(s, []).append(d)
    root = {d: d for d in own}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(own):
        for e in {e for s in own[d] for e in holders[s] if e > d}:
            low = (own[d] & own[e]).total()
            if 5 * low >= 4 * (own[d].total() + own[e].total() - low):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in own}
