"""Hashed character n-grams of words, and the bounded samples that classifiers of them are fitted on."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrow import texts
from ._exchange import hash_of, mix, prefix_hashes

WORD = re.compile(r"\w+")


def words_of(text: bytes) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall(text.decode("utf-8", "replace").lower())


def word_features(words: list[str], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) for each n-gram of low to high characters of " word ", and for the word itself (feature as of its own length)."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    symbols = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    begins = np.cumsum(size) - size
    prefix = prefix_hashes(symbols)
    owners, keys = [], []
    for n in range(low, high + 1):
        count = np.maximum(size - n + 1, 0)
        owner = np.repeat(np.arange(len(words)), count)
        start = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(count) - count), count)
        owners.append(owner)
        keys.append(mix(hash_of(prefix, start, n) ^ np.uint64(n)))
    longer = np.flatnonzero((size > high) | (size < low))
    owners.append(longer)
    keys.append(mix(hash_of(prefix, begins[longer], size[longer]) ^ size[longer].astype(np.uint64)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], (np.concatenate(keys) % np.uint64(buckets)).astype(np.int64)[order]


def all_features(words: list[str], low: int, high: int, buckets: int, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(where each word's features begin, features): word_features of many words in little memory."""
    features, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for i in range(0, len(words), at_once):
        part = words[i : i + at_once]
        owner, feature = word_features(part, low, high, buckets)
        features.append(feature.astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(part)))
    return np.cumsum(np.concatenate(counts)), np.concatenate(features)


class Vocabulary:
    """Numbers for words, with a table row for each that `fill(words)` works out; forgets all beyond `limit` words or a table of 64 MB."""

    def __init__(self, fill, width: int, limit: int = 150_000):
        self.fill, self.width, self.limit = fill, width, min(limit, (8 << 20) // max(width, 1))
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, width))

    def look_up(self, texts: list[list[str]]) -> list[list[int]]:
        if len(self.number) > self.limit:
            self.number.clear()
            self.table = self.table[:0]
        number = self.number
        fresh = list(dict.fromkeys(w for own in texts for w in own if w not in number))
        if fresh:
            self.table = np.concatenate([self.table, self.fill(fresh).reshape(len(fresh), self.width)])
            number.update(zip(fresh, range(len(number), len(number) + len(fresh)), strict=True))
        return [[number[w] for w in own] for own in texts]


HASHES = 1 << 20
#: Classes that are learned at most: the most frequent ones.
MOST_CLASSES = 200


def chosen_ids(rows: DataFrame, max_rows: int, seed: int) -> list[tuple[int, object]]:
    """(doc_id, class) of at most max_rows different doc_ids a class, those with the least hashes, from (doc_id, class).

    Classes are counted first, so that only ids with hashes under a bound, about 1.3 * max_rows + 100 a class, come to the
    driver. Of more than MOST_CLASSES classes the most frequent are taken, of equal ones those that sort first.
    """
    counts = rows.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(MOST_CLASSES)
    bound = counts.select(
        "class",
        F.least(F.lit(HASHES), F.ceil(F.lit(HASHES) * (1.3 * max_rows + 100) / F.col("n"))).cast("long").alias("bound")
    )
    near = rows.join(F.broadcast(bound), "class").where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(HASHES)) < F.col("bound"))  # MOST_CLASSES rows
    held: dict[object, list[tuple[int, int]]] = {}
    for r in near.select("class", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(HASHES)).alias("hash"), "doc_id").distinct().collect():
        held.setdefault(r["class"], []).append((r["hash"], r["doc_id"]))
    return [(doc, k) for k, own in held.items() for _, doc in sorted(own)[:max_rows]]


def chosen_texts(
    docs: DataFrame, ids: list[tuple[int, object]], kind: str, max_text: int, max_bytes: int
) -> list[tuple[object, int, bytes]]:
    """(class, doc_id, text) in order, of (doc_id, class) in order of preference: the first max_text bytes of texts.

    Each class has an equal share of max_bytes, and has its texts as far as that goes: the last is cut. Of rows with one
    doc_id the text that sorts first counts.
    """
    if not ids:
        return []
    share = max_bytes // len({k for _, k in ids})
    known = docs.sparkSession.createDataFrame([(d, k, i) for i, (d, k) in enumerate(ids)], f"doc_id long, class {kind}, place long")
    begun = texts(docs).withColumn("text", F.coalesce(F.substring("text", 1, max_text), F.lit(b""))).join(F.broadcast(known), "doc_id")  # max_rows a class
    one = begun.groupBy("class", "place", "doc_id").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("class").orderBy("place")) - F.octet_length("text")  # max_rows rows
    cut = one.withColumn("left", (F.lit(share) - before).cast("int")).where("left > 0").select(
        "class", "doc_id", F.expr("substring(text, 1, left)").alias("text")
    )
    return sorted((r["class"], r["doc_id"], bytes(r["text"])) for r in cut.collect())
