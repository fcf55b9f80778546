"""Benchmark decontamination by multi-pattern search in the manner of Wu and Manber (1994).

A document becomes its lower-cased words with one space before, between and after them, and so does each window of a
benchmark item (8 consecutive words, or all words of a shorter item). A window then occurs in a document exactly where
its bytes do. Windows are put into classes by length; each class has a shift table over hashed blocks of bytes (how far
the search may move on without missing a window), buckets by the hash of a window's last block, and a first-block test;
what passes all three is compared byte by byte. Many texts are searched at once, one cursor for each piece of text, so
that a step of all cursors is a few numpy calls.

Benchmarks are small, but that isn't taken for granted: their windows are cut into blocks of at most BLOCK_WINDOWS, each of
which goes to the executors by itself. A task goes through its documents once; where there are several blocks, it holds
some MB of documents at a time and one block's tables, and searches block after block. No document is shuffled.

Null and empty texts have no words: no hits, and never contaminated. A null item_id or an item without words is left
out. Two items with the same windows both count. Repeated document rows give repeated results. An empty benchmark hits
nothing. Other columns are not read by `decontaminate`, and stay as they were in `keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import let_go, sliced, small_batches, texts, values

SPAN = 8
#: Windows in one block: about 16 MB of patterns, 60 MB of tables in a worker.
BLOCK_WINDOWS = 200_000
#: Bytes of documents that a task holds while it searches several blocks.
HELD_BYTES = 32 << 20
#: A-Z become a-z; what isn't a digit, a letter or beyond ASCII becomes a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def windows_of(words: list[bytes], span: int = SPAN) -> list[bytes]:
    return [b" %s " % b" ".join(words[i : i + span]) for i in range(max(1, len(words) - span + 1))] if words else []


class _Class:
    """The windows of at least `m` bytes that share one shift table."""

    BITS = 18

    def __init__(self, patterns: list[bytes], m: int):
        self.m, self.block = m, min(6, m)
        self.top = m - self.block + 1
        raw = np.frombuffer(b"".join(patterns), np.uint8)
        sizes = np.array([len(p) for p in patterns])
        ends = np.cumsum(sizes)
        self.shift = np.full(1 << self.BITS, self.top, np.int64)
        for back in range(self.top - 1, -1, -1):  # the last m bytes of a window
            keys = self._keys(raw, ends - back)
            self.shift[keys] = np.minimum(self.shift[keys], back)
        tails = self._keys(raw, ends)
        order = np.argsort(tails, kind="stable")
        self.bucket = np.searchsorted(tails[order], np.arange((1 << self.BITS) + 1))
        self.which, self.sizes = order, sizes[order]
        self.tail, self.head = self._words(raw, ends)[order], self._words(raw, ends - sizes + self.block)[order]

    def _words(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ends), np.uint64)
        for i in range(1, self.block + 1):
            out = (out << np.uint64(8)) | raw[ends - i]
        return out

    def _keys(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return ((self._words(raw, ends) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def candidates(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, piece: int = 2048):
        """(position after the end, pattern) of what the tables can't rule out, in texts raw[begins[i]:ends[i]]."""
        first = begins + self.m
        n = np.maximum(0, -(-(ends - first + 1) // piece))
        lane = np.repeat(first, n) + piece * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        floor = np.repeat(begins, n)
        stop = np.minimum(lane + piece, np.repeat(ends, n) + 1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(lane):
            keys = self._keys(raw, lane)
            move = self.shift[keys]
            if len(hit := np.flatnonzero(move == 0)):
                low, high = self.bucket[keys[hit]], self.bucket[keys[hit] + 1]
                count = high - low
                who = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at, least = np.repeat(lane[hit], count), np.repeat(floor[hit], count)
                ok = (at - self.sizes[who] >= least) & (self.tail[who] == self._words(raw, at))
                at, who = at[ok], who[ok]
                ok = self.head[who] == self._words(raw, at - self.sizes[who] + self.block)
                found.append((at[ok], self.which[who[ok]]))
            lane = lane + np.maximum(move, 1)
            live = lane < stop
            lane, floor, stop = lane[live], floor[live], stop[live]
        return (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


class WuManber:
    """Finds every occurrence of every pattern. Patterns are distinct and not empty."""

    #: Least lengths of the classes; a class's own shortest pattern sets its shift.
    STEPS = (1, 4, 8, 16, 24, 32, 48)

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        which: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            which.setdefault(max(s for s in self.STEPS if s <= len(p)), []).append(i)
        self.classes = [(np.array(own), _Class([patterns[i] for i in own], min(len(patterns[i]) for i in own))) for own in which.values()]

    def search(self, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(begin, pattern) of each occurrence inside raw[begins[i]:ends[i]], sorted."""
        out, view = [], np.frombuffer(raw, np.uint8)
        for own, kind in self.classes:
            at, who = kind.candidates(view, begins, ends)
            for e, p in zip(at.tolist(), own[who].tolist(), strict=True):
                want = self.patterns[p]
                if raw[e - len(want) : e] == want:
                    out.append((e - len(want), p))
        return sorted(out)


def _blocks(benchmark: DataFrame, span: int, block_windows: int):
    """(patterns, the items of each) a block at a time; the driver holds one block."""

    def cut(batches):
        for batch in batches:
            rows = [
                (w, i) for i, t in zip(
                    batch.column("item").to_pylist(), values(batch), strict=True
                ) for w in dict.fromkeys(windows_of(plain_words(t), span))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                ["w", "item"]
            )

    items = benchmark.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")
    )
    block: dict[bytes, set[str]] = {}
    for row in items.mapInArrow(cut, "w binary, item string").orderBy("w").toLocalIterator():
        w = bytes(row["w"])
        if w not in block and len(block) >= block_windows:
            yield block
            block = {}
        block.setdefault(w, set()).add(row["item"])
    if block:
        yield block


class _Block:
    """The search for one block's windows in whole texts."""

    def __init__(self, patterns: list[bytes], items: list[list[str]]):
        self.finder, self.items, self.n_words = WuManber(patterns), items, [p.count(b" ") - 1 for p in patterns]

    def hits(self, lines: list[bytes]) -> Iterator[tuple[int, int, int, list[str]]]:
        """(text, first word, words, items) of each occurrence in the texts' lines of plain words."""
        size = np.array([len(x) for x in lines], np.int64)
        begins, joined = np.cumsum(size) - size, b"".join(lines)
        found = self.finder.search(joined, begins, begins + size) if len(lines) else []
        if not found:
            return
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.array([x[0] for x in found], np.int64)
        owner = np.searchsorted(begins, starts, "right") - 1  # the last of those that begin alike: texts before it are empty
        word = np.searchsorted(spaces, starts) - np.searchsorted(spaces, begins[owner])
        for (_, p), d, w in zip(found, owner.tolist(), word.tolist(), strict=True):
            yield d, w, self.n_words[p], self.items[p]


def _opened(shared) -> _Block:
    """A block's tables; what a worker read for them isn't kept."""
    block = _Block(*shared.value)
    shared.__dict__.pop("_value", None)
    return block


def _searcher(docs: DataFrame, benchmark: DataFrame, span: int, block_windows: int):
    """A function for tasks: (batch, its texts' numbers of words, hits and items) of all batches, a few MB at a time."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(([*block], [sorted(x) for x in block.values()])) for block in _blocks(benchmark, span, block_windows)]

    def found(batches):
        only = _opened(shared[0]) if len(shared) == 1 else None
        for batch in sliced(batches, HELD_BYTES) if len(shared) > 1 else sliced(batches):
            raw = batch.column("text").to_pylist()
            words = [plain_words(x.encode("utf-8", "replace") if isinstance(x, str) else x or b"") for x in raw]
            lines = [b" %s " % b" ".join(w) if w else b"" for w in words]
            who, hit = [set() for _ in raw], [[] for _ in raw]
            for one in [only] if only else shared:
                for d, first, n, items in (only or _opened(one)).hits(lines):
                    who[d].update(items)
                    hit[d].append((first, n))
            yield batch, [len(w) for w in words], hit, [sorted(x) for x in who]
        del only
        let_go()

    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, block_windows: int = BLOCK_WINDOWS, min_items: int = 2
) -> DataFrame:
    """doc_id, text (bytes), n_words, hits (word ranges: first word, words), items, n_hit, n_items, contaminated: one row per row of docs."""
    search = _searcher(docs, benchmark, span, block_windows)
    hits = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        for batch, n_words, hit, items in search(batches):
            ranges = pa.array([[{"first": f, "words": n} for f, n in sorted(set(x))] for x in hit], hits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), ranges,
                    pa.array(items, pa.list_(pa.string()))
                ],
                ["doc_id", "text", "n_words", "hits", "items"]
            )

    whole = texts(docs).mapInArrow(
        run, "doc_id long, text binary, n_words long, hits array<struct<first:long,words:long>>, items array<string>"
    )
    marks = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), h["first"] + h["words"] - F.greatest(s["end"], h["first"]))).alias("n"),
            F.greatest(s["end"], h["first"] + h["words"]).alias("end")
        ),
    )
    return whole.select(
        "doc_id", "text", "n_words", "hits", "items", marks["n"].alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), (F.size("items") >= min_items).alias("contaminated")
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, block_windows: int = BLOCK_WINDOWS, min_items: int = 1
) -> DataFrame:
    """The rows of docs that hold windows of fewer than min_items items, all columns as they were, in the same pass."""
    search = _searcher(docs, benchmark, span, block_windows)

    def run(batches):
        for batch, _, _, items in search(batches):
            yield batch.filter(pa.array([len(x) < min_items for x in items], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def decontaminate_digest(found: DataFrame) -> DataFrame:
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated")
