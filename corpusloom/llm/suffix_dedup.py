"""Exact repeats of 100-byte strings, over all documents, by sorting suffixes.

A window of SPAN bytes is a repeat if the same bytes also start earlier (smaller doc_id, or same document and earlier
start; among rows with one doc_id, the smaller text counts as earlier; rows without doc_id count as earliest, in the order
of a hash of their texts). Every byte under a repeat goes.

1. Anchors. Each window chooses, of the SPAN - GRAM + 1 grams in it, the one whose hash is least: equal windows choose
   the same one at the same offset. Neighbouring windows mostly choose alike, so about one position in 32 is an anchor.
2. Which grams are anchors in more than one place: distinct grams of each batch, counted in buckets.
3. Only the runs of windows at such anchors travel on, as the bytes that the run covers (a run equal to an earlier one
   of its batch stays: it is all repeats). A gram with over HOT runs is dealt window by window instead, so that the
   many different surroundings of one frequent passage don't meet in one bucket.
4. In a bucket the windows are suffixes of the runs' bytes, put together by anchor and offset, and mergesorted. To
   compare two, prefix polynomial hashes and a binary search give their common extension; the first differing byte
   decides. Neighbours with SPAN bytes in common form a class; its earliest member stays, the others are repeats. Each
   member is compared with its neighbour byte by byte; a class that fails this is sorted again by the bytes themselves.
5. Each document's repeats are put together and its other bytes kept.

Null and empty texts, and texts of under SPAN bytes, keep all bytes. Whole copies of an earlier text lose all bytes
without further search. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import slices
from ._exchange import PACKED, Batch, Rows, buckets, by_batch, by_bucket, copies, dealing, dealt, hash_of, is_copy, mix, pack, prefix_hashes

SPAN = 100
GRAM = 37
CHOICES = SPAN - GRAM + 1  # 64: a power of two
#: A gram with more runs than this is dealt window by window.
HOT = 4096
#: Bytes of documents, or of runs, that are hashed at once.
CHUNK = 1 << 20
#: Kinds of entries: grams to count; runs to sort; repeats found.
GRAMS, RUNS, REPEATS = 0, 1, 2
AGAIN_BITS = 40


def window_runs(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    """(prefix hashes, run's first window, run's windows, anchor, hash of its gram) for texts raw[begins[i]:][:sizes[i]]."""
    prefix = prefix_hashes(raw)
    n = len(raw) - SPAN + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return prefix, none, none, none, np.zeros(0, np.uint64)
    grams = mix(hash_of(prefix, np.arange(len(raw) - GRAM + 1), GRAM))
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < CHOICES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    edge = np.zeros(n + 1, np.int32)
    long = sizes >= SPAN
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, np.minimum(begins[long] + sizes[long] - SPAN + 1, n), -1)
    start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(start)))
    return prefix, start[first], count, anchor[first], grams[anchor[first]]


def _chunks(batch: Batch, skip: np.ndarray):
    """(rows, bytes, where each row begins) without the skipped rows."""
    rows = np.flatnonzero(~skip & (batch.size >= SPAN))
    for a, b in slices(batch.size[rows], CHUNK):
        own = rows[a:b]
        begins = np.cumsum(batch.size[own]) - batch.size[own]
        yield own, np.frombuffer(b"".join(batch.texts[i] for i in own), np.uint8), begins


def _gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    return raw[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)]


def _count_grams(n: int):
    def fn(batch: Batch, given: dict) -> pa.Table:
        out, found = Rows(), []
        for own, raw, begins in _chunks(batch, is_copy(batch, given)):
            found.append(window_runs(raw, begins, batch.size[own])[4])
        if found:
            grams, count = np.unique(np.concatenate(found), return_counts=True)
            order, edges = buckets(grams, n)
            grams, count = grams[order], np.minimum(count[order], 65535).astype(np.uint16)
            for r in np.flatnonzero(np.diff(edges)).tolist():
                out.add(r, batch.b, GRAMS, pack(grams[edges[r] : edges[r + 1]], count[edges[r] : edges[r + 1]]))
        return out.table()

    return fn


def _repeated_grams(r: int, entries: list, out: Rows) -> None:
    grams, where = np.unique(np.concatenate([x[2][0] for x in entries]), return_inverse=True)
    total = np.bincount(where, np.concatenate([x[2][1] for x in entries])).astype(np.int64)
    at = 0
    for b, _, (own, _) in entries:
        count = total[where[at : at + len(own)]]
        at += len(own)
        if (count > 1).any():
            out.add(r, b, GRAMS, pack(own[(count > 1) & (count <= HOT)], own[count > HOT]))


class _Runs:
    """Runs of windows as they travel: key, doc_id, position of the first window, windows, anchor's offset in it, bytes."""

    def __init__(self, arrays: list[np.ndarray]):
        self.key, self.doc_id, self.at, self.count, self.offset, self.raw = arrays
        self.count = self.count.astype(np.int64)
        self.size = self.count + SPAN - 1
        self.begin = np.cumsum(self.size) - self.size

    def pick(self, which: np.ndarray) -> list[np.ndarray]:
        return [
            self.key[which], self.doc_id[which], self.at[which], self.count[which].astype(np.uint8), self.offset[which],
            _gather(self.raw, self.begin[which], self.size[which])
        ]

    def earlier_order(self) -> np.ndarray:
        return np.lexsort((self.at, self.doc_id))

    def same(self, i: int, j: int) -> bool:
        return bytes(
            self.raw[self.begin[i] : self.begin[i] + self.size[i]]
        ) == bytes(self.raw[self.begin[j] : self.begin[j] + self.size[j]])

    def repeated(self) -> np.ndarray:
        """Which runs have the bytes of an earlier one."""
        out = np.zeros(len(self.key), bool)
        if not len(out):
            return out
        content = np.zeros(len(out), np.uint64)
        for a, b in slices(self.size, CHUNK):
            lo = self.begin[a]
            prefix = prefix_hashes(self.raw[lo : self.begin[b - 1] + self.size[b - 1]])
            content[a:b] = hash_of(prefix, self.begin[a:b] - lo, self.size[a:b])
        order = np.lexsort((self.at, self.doc_id, content, self.count, self.key))
        x, y = order[:-1], order[1:]
        for i in np.flatnonzero((self.key[x] == self.key[y]) & (self.count[x] == self.count[y]) & (content[x] == content[y])).tolist():
            out[y[i]] = self.same(x[i], y[i])
        return out


def _ship_runs(n: int):
    def fn(batch: Batch, given: dict) -> pa.Table:
        out = Rows()
        skip = is_copy(batch, given)
        asked = given.get(GRAMS, ())
        common = np.sort(np.concatenate([x[0] for x in asked])) if asked else np.zeros(0, np.uint64)
        hot = np.sort(np.concatenate([x[1] for x in asked])) if asked else np.zeros(0, np.uint64)
        parts: list[list[np.ndarray]] = []
        for own, raw, begins in _chunks(batch, skip) if asked else ():
            prefix, first, count, anchor, gram = window_runs(raw, begins, batch.size[own])
            very = np.isin(gram, hot)
            for which, single in ((np.flatnonzero(np.isin(gram, common)), False), (np.flatnonzero(very), True)):
                f, c, a, key = first[which], count[which], anchor[which], gram[which]
                if single:
                    f = np.repeat(f - (np.cumsum(c) - c), c) + np.arange(c.sum())
                    a, c = np.repeat(a, c), np.ones(len(f), np.int64)
                    key = mix(hash_of(prefix, f, SPAN) ^ np.uint64(SPAN))
                doc = np.searchsorted(begins, f, "right") - 1
                row = own[doc]
                at = f - begins[doc] + (batch.again[row] << AGAIN_BITS)
                parts.append([key, batch.doc_id[row], at, c.astype(np.uint8), (a - f).astype(np.uint8), _gather(raw, f, c + SPAN - 1)])
        if parts:
            runs = _Runs([np.concatenate(x) for x in zip(*parts, strict=True)])
            again = runs.repeated()
            if again.any():
                which = np.flatnonzero(again)
                out.add(batch.b % n, batch.b, REPEATS, pack(runs.doc_id[which], runs.at[which], _full(runs.count[which])))
            which = np.flatnonzero(~again)
            order, edges = buckets(runs.key[which], n)
            which = which[order]
            for r in np.flatnonzero(np.diff(edges)).tolist():
                out.add(r, batch.b, RUNS, pack(*runs.pick(which[edges[r] : edges[r + 1]])))
        return out.table()

    return fn


def _full(count: np.ndarray) -> np.ndarray:
    """A bit for each window of a run."""
    return np.where(count >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (count.astype(np.uint64) & np.uint64(63))) - np.uint64(1))


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes the suffixes at x and y share, up to limit, by binary search over hashes."""
    low = np.where(hash_of(prefix, x, limit) == hash_of(prefix, y, limit), limit, 0)
    open_ = np.flatnonzero(low < limit)
    lo, hi = np.zeros(len(open_), np.int64), np.full(len(open_), limit - 1)
    x, y = x[open_], y[open_]
    while (live := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = hash_of(prefix, x, mid) == hash_of(prefix, y, mid)
        lo, hi = np.where(live & same, mid, lo), np.where(live & ~same, mid - 1, hi)
    low[open_] = lo
    return low


def sort_suffixes(raw: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, segment: np.ndarray, limit: int = SPAN) -> np.ndarray:
    """The stable order of suffixes by segment and then by their first `limit` bytes.

    A bottom-up mergesort of all segments at once: an element's place after a merge is its place in its own half plus
    the number of elements of the other half before it, which a binary search finds. segment must ascend.
    """
    order = np.arange(len(suffix))
    begin = np.searchsorted(segment, segment)
    end = np.searchsorted(segment, segment, "right")
    most, width = int((end - begin).max(initial=1)), 1
    while width < most:
        place = np.arange(len(order))
        half = (place - begin) // width
        other = begin + (half ^ 1) * width
        lo, hi = np.minimum(other, end), np.minimum(other + width, end)
        base, left = lo.copy(), (half & 1) == 0
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) >> 1
            x, y = suffix[order[live]], suffix[order[mid]]
            n = common_extension(prefix, x, y, limit)
            over = np.minimum(n, limit - 1)
            # of equals, those of the left half come first
            before = np.where(n >= limit, ~left[live], raw[y + over] < raw[x + over])
            lo[live] = np.where(before, mid + 1, lo[live])
            hi[live] = np.where(before, hi[live], mid)
        target = begin + (half >> 1) * 2 * width + (place - begin - half * width) + (lo - base)
        merged = np.empty_like(order)
        merged[target] = order
        order, width = merged, width * 2
    return order


def _mark(runs: _Runs, which: np.ndarray) -> np.ndarray:
    """For runs `which` (in order of place), a bit for each window that an earlier run has too."""
    key, count = runs.key[which], runs.count[which]
    raw = _gather(runs.raw, runs.begin[which], runs.size[which])
    begin = np.cumsum(runs.size[which]) - runs.size[which]
    prefix = prefix_hashes(raw)
    run = np.repeat(np.arange(len(which)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    offset = runs.offset[which].astype(np.int64)[run] - step
    order = np.lexsort((run, offset, key[run]))  # by anchor's gram and offset, in order of place
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[run[order[1:]]] != key[run[order[:-1]]]) | (offset[order[1:]] != offset[order[:-1]])
    segment = np.cumsum(fresh) - 1
    shared = np.bincount(segment)[segment] > 1
    order, segment = order[shared], segment[shared]
    masks = np.zeros(len(which), np.uint64)
    if not len(order):
        return masks
    suffix = (begin[run] + step)[order]
    rank = sort_suffixes(raw, prefix, suffix, segment)
    x, y = rank[:-1], rank[1:]
    tied = np.flatnonzero((segment[x] == segment[y]) & (hash_of(prefix, suffix[x], SPAN) == hash_of(prefix, suffix[y], SPAN)))
    wrong = np.zeros(0, np.int64)
    span = np.arange(SPAN)
    for a in range(0, len(tied), 1 << 15):
        part = tied[a : a + (1 << 15)]
        differ = (raw[suffix[x[part]][:, None] + span] != raw[suffix[y[part]][:, None] + span]).any(axis=1)
        wrong = np.append(wrong, part[differ])
    again = np.zeros(len(order), bool)
    again[y[tied]] = True
    for s in np.unique(segment[x[wrong]]).tolist():  # hashes that collided: by the bytes themselves
        seen: set[bytes] = set()
        for i in np.flatnonzero(segment == s).tolist():
            own = raw[suffix[i] : suffix[i] + SPAN].tobytes()
            again[i] = own in seen
            seen.add(own)
    hit = order[again]
    np.bitwise_or.at(masks, run[hit], np.uint64(1) << step[hit].astype(np.uint64))
    return masks


def _sort_bucket(r: int, entries: list, out: Rows) -> None:
    for b, kind, arrays in entries:
        if kind == REPEATS:
            out.add(r, b, kind, pack(*arrays))
    entries = [x for x in entries if x[1] == RUNS]
    if not entries:
        return
    runs = _Runs([np.concatenate(x) for x in zip(*(e[2] for e in entries), strict=True)])
    source = np.repeat([e[0] for e in entries], [len(e[2][0]) for e in entries])
    masks = np.zeros(len(runs.key), np.uint64)
    again = runs.repeated()
    masks[again] = _full(runs.count[again])
    which = np.flatnonzero(~again)
    which = which[np.lexsort((runs.at[which], runs.doc_id[which], runs.key[which]))]
    key = runs.key[which]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    for a, b in slices(np.add.reduceat(runs.size[which], first) * (size > 1) if len(first) else size, CHUNK):
        rows = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in range(a, b) if size[i] > 1] or [np.zeros(0, np.int64)])
        if len(rows):
            masks[which[rows]] = _mark(runs, which[rows])
    found = np.flatnonzero(masks)
    order = found[np.argsort(source[found], kind="stable")]
    for b in np.unique(source[order]).tolist():
        own = order[source[order] == b]
        out.add(r, b, REPEATS, pack(runs.doc_id[own], runs.at[own], masks[own]))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
RESULT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
)


def _apply(batch: Batch, given: dict) -> pa.Table:
    skip = is_copy(batch, given)
    found = [np.concatenate(x) for x in zip(*given.get(REPEATS, ()), strict=True)]
    n_removed, n_spans, kept = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), []
    if found:
        order = np.lexsort((found[1], found[0]))
        doc, at, mask = (x[order] for x in found)
    for i, text in enumerate(batch.texts):
        n = len(text)
        if skip[i] and n >= SPAN:
            n_removed[i], n_spans[i] = n, 1
            kept.append(b"")
            continue
        gone = None
        if found and n >= SPAN:
            a, b = np.searchsorted(doc, batch.doc_id[i]), np.searchsorted(doc, batch.doc_id[i], "right")
            own = np.arange(a, b)[at[a:b] >> AGAIN_BITS == batch.again[i]]
            if len(own):
                bits = np.unpackbits(mask[own].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, step = np.nonzero(bits)
                start = (at[own] & ((1 << AGAIN_BITS) - 1))[which] + step
                edge = np.bincount(start, minlength=n + 1) - np.bincount(start + SPAN, minlength=n + 1)
                gone = np.cumsum(edge[:n]) > 0
        if gone is None:
            kept.append(text)
            continue
        n_removed[i] = gone.sum()
        n_spans[i] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
    return pa.Table.from_arrays(
        [batch.ids(), pa.array(batch.size), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.binary())],
        schema=RESULT_ARROW
    )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes: one row per row of docs."""
    deal = dealing(docs)
    n, batches = deal.buckets, dealt(docs, deal)
    same = copies(batches, deal)
    grams = by_bucket(by_batch(batches, same, _count_grams(n), PACKED), _repeated_grams, deal)
    runs = by_batch(batches, grams.unionAll(same), _ship_runs(n), PACKED)
    found = by_bucket(runs, _sort_bucket, deal)
    return by_batch(batches, found.unionAll(same), _apply, RESULT)


def suffix_dedup_digest(result: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], span: int = SPAN) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), from the definition."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(rows):
        gone = bytearray(len(text))
        for i in range(len(text) - span + 1):
            w = text[i : i + span]
            if w in seen:
                gone[i : i + span] = b"\x01" * span
            seen.add(w)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc_id] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
