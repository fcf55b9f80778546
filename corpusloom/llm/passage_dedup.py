"""Repeated passages: runs of 50 or more words that an earlier document has too, by fixed-block anchors.

A window is SPAN consecutive words of one document. A word goes if a window covers it whose words also start in a
document with a smaller doc_id (rows with one doc_id are one document here, and don't remove each other's words; rows
without doc_id count as earliest, in the order of a hash of their texts, equal ones as one document).

1. Index. Each document is cut into blocks of BLOCK = SPAN / 2 words that don't overlap: whatever window another
   document shares with it holds one of these blocks whole.
2. Probe. Every rolling window of BLOCK words, of every document, is looked up in the index. Probes travel as sorted
   32-bit fingerprints by bucket (the bucket holds the rest of the hash), distinct in their batch; a bucket answers each
   batch with the blocks that another batch probes too. Repeats inside a batch are found there.
3. Extend. Every window around a hit takes, of the hits in it, the one with the least hash as its anchor: equal windows
   take the same one at the same place. Neighbouring windows with one anchor are a run of at most SPAN - BLOCK + 1, and
   travel as the run's words to the anchor's bucket (runs alike in a batch once, with their least doc_id). There each run
   is held against the runs of smaller documents at the same anchor that it may have windows in common with: the match is
   grown from the anchor to the left and to the right, word by word, as far as both agree, and all windows inside it are
   repeats. Runs' repeats that touch are one maximal repeat of the document. Windows whose anchor over HOT batches have are
   dealt by themselves, by two hashes (96 bits), so that the many different surroundings of a frequent passage don't meet in
   one bucket.

Hashes are 64-bit polynomial hashes of word hashes. They find hits, anchors and partners; whether two occurrences agree is
seen by their words (64 bits each), inside a batch by two hashes of all of a run's words. Words are runs of bytes other than space and \\t\\n\\v\\f\\r, unchanged.
Null and empty texts have no words; a text of under SPAN words keeps all. Whole copies of an earlier text of SPAN words
or more lose all words. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices
from ._exchange import ODD, PACKED, Batch, Rows, buckets, by_batch, by_bucket, copies, dealing, dealt, distinct, hash_of, is_copy, mix, pack, prefix_hashes

SPAN = 50
BLOCK = SPAN // 2
CHUNK = 2 << 20
#: Windows around a hit.
AROUND = SPAN - BLOCK + 1
#: Kinds of entries: blocks of the index and probes, hits; runs, windows of frequent anchors, repeats.
PROBES, HITS, RUNS, WINDOWS, REPEATS = 0, 1, 2, 3, 4
#: Batches that have an anchor, beyond which it is frequent.
HOT = 32
#: Pairs of runs that are compared at once.
PAIRS = 1 << 13
#: The bytes that separate words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~SEPARATOR[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


class Words:
    """The words of some documents, end to end; documents never share a word, a space is put between them."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(size) - size
        self.begin, self.end = word_spans(raw)
        self.first = np.searchsorted(self.begin, np.append(begins, len(raw) + 1))
        self.count = np.diff(self.first)
        self.ids = mix(hash_of(prefix_hashes(raw), self.begin, self.end - self.begin) ^ (self.end - self.begin).astype(np.uint64))
        self.prefix = prefix_hashes(self.ids)
        self.begins = begins

    def starts(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, document) of each window."""
        n = np.maximum(self.count - span + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return np.arange(len(doc)) + np.repeat(self.first[:-1] - (np.cumsum(n) - n), n), doc

    def hashes(self, start: np.ndarray, span: int) -> np.ndarray:
        return mix(hash_of(self.prefix, start, span) ^ np.uint64(span))


def _chunks(batch: Batch, skip: np.ndarray):
    rows = np.flatnonzero(~skip & (batch.size >= 2 * SPAN - 1))
    for a, b in slices(batch.size[rows], CHUNK):
        yield rows[a:b], Words([batch.texts[i] for i in rows[a:b]])


def _narrow(sorted_: np.ndarray) -> list[np.ndarray]:
    """Ascending 32-bit values as differences, in planes of their low, middle and high bytes (a fourth if one is large)."""
    step = np.diff(sorted_, prepend=np.uint32(0))
    planes = step.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(planes[:, i]) for i in range(4 if planes[:, 3].any() else 3)]


def _widen(planes: list[np.ndarray]) -> np.ndarray:
    return np.cumsum(sum(p.astype(np.uint32) << np.uint32(8 * i) for i, p in enumerate(planes)), dtype=np.uint32)


def _fingers(hashes: np.ndarray, n: int) -> np.ndarray:
    """What identifies a hash in its bucket: 32 bits that the bucket's number doesn't tell."""
    return (hashes // np.uint64(n)).astype(np.uint32)


def _index_and_probe(n: int):
    def fn(batch: Batch, given: dict) -> pa.Table:
        out, blocks, probes = Rows(), [], []
        for _, words in _chunks(batch, is_copy(batch, given)):
            start, doc = words.starts(BLOCK)
            h = words.hashes(start, BLOCK)
            probes.append(distinct(h))
            blocks.append(h[(start - words.first[doc]) % BLOCK == 0])
        if probes:
            by_r: list[list[list[np.ndarray]]] = [[] for _ in range(n)]
            for found in (blocks, probes):
                h = distinct(np.concatenate(found))
                order, edges = buckets(h, n)
                h = h[order]
                for r in range(n):
                    by_r[r].append(_narrow(distinct(_fingers(h[edges[r] : edges[r + 1]], n))))
            for r, (block, probe) in enumerate(by_r):
                if len(probe[0]):
                    out.add(r, batch.b, PROBES, pack(np.array([len(block)], np.uint8), *block, *probe))
        return out.table()

    return fn


def _answer_probes(r: int, entries: list, out: Rows) -> None:
    index = distinct(np.concatenate([_widen(x[1 : 1 + int(x[0][0])]) for _, _, x in entries]))
    if not len(index):
        return
    asked = np.zeros(len(index), np.int64)
    hits = []
    for b, _, x in entries:
        probe = _widen(x[1 + int(x[0][0]) :])
        at = np.searchsorted(index, probe)
        at[at == len(index)] = 0
        hits.append((b, at[index[at] == probe]))
        asked[hits[-1][1]] += 1
    for b, at in hits:
        shared = _narrow(index[at[asked[at] > 1]])
        if len(shared[0]):
            out.add(r, b, HITS, pack(np.array([r, len(shared)], np.int32), *shared, *_narrow(index[at[asked[at] > HOT]])))


def _hits(given: dict) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and buckets (32 bits each) of what was answered, and of what is frequent; sorted."""
    out = []
    for frequent in (False, True):
        found = [
            (
                _widen(planes[k:] if frequent else planes[:k]).astype(np.uint64) << np.uint64(32)
            ) | np.uint64(r) for (r, k), *planes in given.get(HITS, ())
        ]
        out.append(np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64))
    return out[0], out[1]


def _key(h: np.ndarray, n: int) -> np.ndarray:
    return (_fingers(h, n).astype(np.uint64) << np.uint64(32)) | (h % np.uint64(n))


def _own_hits(batch: Batch, skip: np.ndarray) -> np.ndarray:
    """Hashes of the batch's own blocks that two of its documents have."""
    blocks, found = [], []
    for rows, words in _chunks(batch, skip):
        start, doc = words.starts(BLOCK)
        h = words.hashes(start, BLOCK)
        order = np.argsort(h, kind="stable")  # documents of one block stay in order
        edge = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = np.append(edge[1:], len(h)) - 1 if len(h) else edge
        found.append((h[order[edge]], rows[doc[order[edge]]], rows[doc[order[last]]]))
        blocks.append(distinct(h[(start - words.first[doc]) % BLOCK == 0]))
    own = np.zeros(0, np.uint64)
    if found:
        h, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, edge = h[order], np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(h) else np.zeros(0, np.int64)
        if len(h):
            several = np.minimum.reduceat(low[order], edge) < np.maximum.reduceat(high[order], edge)
            own = np.intersect1d(h[edge][several], distinct(np.concatenate(blocks)), assume_unique=True)
    return own


def _anchors(words: Words, at: np.ndarray, h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The hit with the least hash, of equal ones the first, in each window that begins at `start`; -1: none. at, h: hits."""
    least = np.full(len(words.begin) + AROUND, np.iinfo(np.uint64).max)
    least[at] = np.minimum(h, np.iinfo(np.uint64).max - np.uint64(1))
    place, width = np.arange(len(least)), 1

    def later(by: int) -> None:
        nonlocal least, place
        ahead = np.append(least[by:], np.full(by, np.iinfo(np.uint64).max))
        take = ahead < least
        least, place = np.where(take, ahead, least), np.where(take, np.append(place[by:], place[:by]), place)

    while 2 * width <= AROUND:
        later(width)
        width *= 2
    later(AROUND - width)
    return np.where(least[start] < np.iinfo(np.uint64).max, place[start], -1)


class _Runs:
    """All runs of a batch: row, first word, windows, anchor's offset, hashes of the anchor and (two) of all words, bytes in the row's text.

    A window of a frequent anchor is a run of its own, and its own anchor.
    """

    NAMES = ("hot", "row", "first", "count", "offset", "anchor", "content", "check", "begin", "end")

    def __init__(self, batch: Batch, given: dict, n: int):
        skip = is_copy(batch, given)
        (keys, frequent), own = _hits(given), _own_hits(batch, skip)
        parts: list[list[np.ndarray]] = []
        for rows, words in _chunks(batch, skip):
            at, _ = words.starts(BLOCK)
            h = words.hashes(at, BLOCK)
            hit = np.isin(_key(h, n), keys) | np.isin(h, own)
            start, doc = words.starts(SPAN)
            anchor = _anchors(words, at[hit], h[hit], start)
            start, doc, anchor = (x[anchor >= 0] for x in (start, doc, anchor))
            hot = np.isin(_key(words.hashes(anchor, BLOCK), n), frequent)
            anchor = np.where(hot, start, anchor)
            opens = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(anchor) != 0))) if len(start) else np.zeros(0, np.int64)
            count = np.diff(np.append(opens, len(start)))
            hot, first, doc, anchor = hot[opens], start[opens], doc[opens], anchor[opens]
            content, check = (hash_of(x, first, count + SPAN - 1) for x in (words.prefix, prefix_hashes(mix(words.ids + ODD))))
            key = np.where(hot, words.hashes(first, SPAN), words.hashes(anchor, BLOCK))
            shift = words.begins[doc]
            whole = words.begin[first] - shift, words.end[first + count + SPAN - 2] - shift
            parts.append([hot, rows[doc], first - words.first[doc], count, anchor - first, key, content, check, *whole])
        for name, x in zip(self.NAMES, zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * len(self.NAMES), strict=True):
            setattr(self, name, np.concatenate(x))
        self.doc_id = batch.doc_id[self.row]
        # of runs alike, the one with the least doc_id speaks for all; in order of bucket
        r = self.anchor.astype(np.uint64) % np.uint64(n)
        order = np.lexsort((self.doc_id, self.check, self.content, self.offset, self.count, self.anchor, self.hot, r))
        x, y = order[:-1], order[1:]
        fresh = np.append(
            True,
            np.any([getattr(self, k)[x] != getattr(self, k)[y] for k in ("hot", "anchor", "count", "offset", "content", "check")], axis=0)
        ) if len(order) else np.zeros(0, bool)
        self.leaders = order[fresh]
        self.leader = np.zeros(len(order), np.int64)  # place of each run's leader among the leaders
        self.leader[order] = np.cumsum(fresh) - 1
        self.edges = np.searchsorted(r[self.leaders], np.arange(n + 1, dtype=np.uint64))


def _ship_runs(n: int):
    def fn(batch: Batch, given: dict) -> pa.Table:
        out, runs = Rows(), _Runs(batch, given, n)
        for r in np.flatnonzero(np.diff(runs.edges)).tolist():
            both = runs.leaders[runs.edges[r] : runs.edges[r + 1]]
            own, alone = both[runs.hot[both] == 0], both[runs.hot[both] != 0]
            if len(alone):
                ids, which = np.unique(runs.doc_id[alone], return_inverse=True)
                out.add(
                    r, batch.b, WINDOWS,
                    pack(runs.anchor[alone], (runs.check[alone] >> np.uint64(32)).astype(np.uint32), ids, which.astype(np.uint32))
                )
            if len(own):
                ids, which = np.unique(runs.doc_id[own], return_inverse=True)
                places = zip(runs.row[own].tolist(), runs.begin[own].tolist(), runs.end[own].tolist(), strict=True)
                said = np.frombuffer(b" ".join(batch.texts[row][a:b] for row, a, b in places), np.uint8)
                shape = runs.count[own].astype(np.uint8), runs.offset[own].astype(np.uint8)
                out.add(r, batch.b, RUNS, pack(*shape, ids, which.astype(np.uint32), said))
        return out.table()

    return fn


def _grown(ids: np.ndarray, x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree to the left of the words x and y, at most `left`, and from them on to the right, at most `right`."""
    out = []
    for most, sign, shift in ((left, -1, 1), (right, 1, 0)):
        step = np.arange(int(most.max(initial=0)))
        inside = step < most[:, None]
        near = [np.where(inside, at[:, None] + sign * (step + shift), 0) for at in (x, y)]
        agree = inside & (ids[near[0]] == ids[near[1]])
        out.append(np.where(agree.all(axis=1), len(step), np.argmin(agree, axis=1)) if len(step) else np.zeros(len(x), np.int64))
    return np.minimum(out[0], left), np.minimum(out[1], right)


def _later_windows(entries: list) -> np.ndarray:
    """Which windows of all entries, end to end, a smaller document has too."""
    h, check = (np.concatenate([x[i] for x in entries]) for i in (0, 1))
    doc = np.concatenate([ids[which] for _, _, ids, which in entries])
    order = np.lexsort((doc, check, h))
    x, y = order[:-1], order[1:]
    fresh = np.append(True, (h[x] != h[y]) | (check[x] != check[y])) if len(order) else np.zeros(0, bool)
    later = np.zeros(len(h), bool)
    later[order] = doc[order] > doc[order[np.flatnonzero(fresh)]][np.cumsum(fresh) - 1]
    return later


def _answer_runs(r: int, entries: list, out: Rows) -> None:
    """A mask for each run, and then for each window, of a batch's entry."""
    told: dict[int, list[np.ndarray]] = {}
    for kind, fn in ((RUNS, _extend), (WINDOWS, _later_windows)):
        own = [(b, x) for b, k, x in entries if k == kind]
        if own:
            mask, at = fn([x for _, x in own]).astype(np.uint32), 0
            for b, x in own:
                told.setdefault(b, [np.zeros(0, np.uint32)]).append(mask[at : at + len(x[0])])
                at += len(x[0])
    for b, masks in told.items():
        if any(m.any() for m in masks):
            out.add(r, b, REPEATS, pack(np.array([r], np.int32), np.concatenate(masks)))


def _extend(entries: list) -> np.ndarray:
    """A mask of windows that a smaller document has too, for each run of all entries, end to end."""
    count, offset = (np.concatenate([x[i] for x in entries]).astype(np.int64) for i in (0, 1))
    doc = np.concatenate([ids[which] for _, _, ids, which, _ in entries])
    ids = np.concatenate([Words([raw.tobytes()]).ids for *_, raw in entries])
    size = count + SPAN - 1
    first = np.cumsum(size) - size
    prefix = prefix_hashes(ids)
    # windows of all runs; those of one hash, with the least document first
    run = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    h = hash_of(prefix, first[run] + step, SPAN)
    order = np.lexsort((doc[run], h))
    fresh = np.append(True, h[order[1:]] != h[order[:-1]]) if len(order) else np.zeros(0, bool)
    partner = np.zeros(len(run), np.int64)
    partner[order] = run[order[np.flatnonzero(fresh)]][np.cumsum(fresh) - 1]
    some = np.flatnonzero(doc[run] > doc[partner])
    mask = np.zeros(len(count), np.uint32)
    # each run with each of its partners: the match around their anchors
    pair, where = np.unique(run[some] * np.int64(len(count)) + partner[some], return_inverse=True)
    i, j = pair // max(len(count), 1), pair % max(len(count), 1)
    left, right = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    for a in range(0, len(pair), PAIRS):
        x, y = i[a : a + PAIRS], j[a : a + PAIRS]
        left[a : a + PAIRS], right[a : a + PAIRS] = _grown(
            ids, first[x] + offset[x], first[y] + offset[y], np.minimum(offset[x], offset[y]),
            np.minimum(size[x] - offset[x], size[y] - offset[y])
        )
    back = offset[run[some]] - step[some]  # words of the window before the anchor
    good = (back <= left[where]) & (SPAN - back <= right[where])
    np.bitwise_or.at(mask, run[some[good]], np.uint32(1) << step[some[good]].astype(np.uint32))
    for k in np.unique(h[some[~good]]).tolist():  # equal hashes of other words: by the words themselves
        seen: dict[bytes, int] = {}
        for w in order[np.searchsorted(h[order], k) : np.searchsorted(h[order], k, "right")].tolist():
            words = ids[first[run[w]] + step[w] :][:SPAN].tobytes()
            if seen.setdefault(words, doc[run[w]]) < doc[run[w]]:
                mask[run[w]] |= np.uint32(1 << int(step[w]))
    return mask


RESULT = "doc_id long, n_words long, n_removed long, kept binary, text_sha256 string"
RESULT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("text_sha256", pa.string())]
)


def _apply(n: int, keep_space: bool):
    def fn(batch: Batch, given: dict) -> pa.Table:
        skip, runs = is_copy(batch, given), _Runs(batch, given, n)
        told = np.zeros(len(runs.leaders), np.uint32)
        for (r,), mask in given.get(REPEATS, ()):
            told[runs.edges[r] : runs.edges[r + 1]] = mask
        # what a smaller document of the batch has too is a repeat as a whole
        again = runs.doc_id > runs.doc_id[runs.leaders[runs.leader]]
        mask = np.where(again, (np.uint32(1) << runs.count.astype(np.uint32)) - np.uint32(1), told[runs.leader])
        run, step = np.nonzero(np.unpackbits(mask.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))
        row, start = runs.row[run], runs.first[run] + step
        order = np.argsort(row, kind="stable")
        row, start = row[order], start[order]
        gone: dict[int, np.ndarray] = {}
        edges = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(row)], strict=False):
            own = start[a:b]
            edge = np.bincount(own, minlength=own.max() + SPAN + 1)
            edge[SPAN:] -= edge[:-SPAN].copy()
            gone[int(row[a])] = np.cumsum(edge) > 0
        count, removed, kept = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), []
        for i, text in enumerate(batch.texts):
            begin, end = word_spans(np.frombuffer(text, np.uint8)) if i in gone else (None, None)
            if begin is None:
                words = text.split()
                count[i] = len(words)
                if skip[i] and len(words) >= SPAN:
                    removed[i] = len(words)
                    words = []
                kept.append(text if keep_space and not removed[i] else b" ".join(words))
                continue
            out = np.zeros(len(begin), bool)
            out[: len(gone[i])] = gone[i][: len(out)]
            count[i], removed[i] = len(begin), out.sum()
            if not keep_space:
                kept.append(b" ".join(text[a:b] for a, b in zip(begin[~out].tolist(), end[~out].tolist(), strict=True)))
            else:  # a removed run goes with the space behind it
                runs = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                pieces, at = [], 0
                for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
                    pieces.append(text[at : begin[a]])
                    at = int(begin[b]) if b < len(begin) else len(text)
                kept.append(b"".join([*pieces, text[at:]]))
        return pa.Table.from_arrays(
            [
                batch.ids(), pa.array(count), pa.array(removed), pa.array(kept, pa.binary()),
                pa.array([hashlib.sha256(t).hexdigest() for t in batch.texts])
            ],
            schema=RESULT_ARROW
        )

    return fn


def passage_dedup(docs: DataFrame, keep_space: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, the kept text, and text_sha256 (of the whole text): one row per row of docs.

    kept: the words joined by one space; with keep_space the text as it was, without the removed words.
    """
    deal = dealing(docs)
    n, batches = deal.buckets, dealt(docs, deal)
    same = copies(batches, deal)
    hits = by_bucket(by_batch(batches, same, _index_and_probe(n), PACKED), _answer_probes, deal).unionAll(same)
    found = by_bucket(by_batch(batches, hits, _ship_runs(n), PACKED), _answer_runs, deal)
    return by_batch(batches, found.unionAll(hits), _apply(n, keep_space), RESULT)


def passage_dedup_digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], span: int = SPAN) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_words, n_removed, kept_sha256), from the definition."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for doc_id, text in sorted(rows):
        words = text.split()
        own = [tuple(words[i : i + span]) for i in range(len(words) - span + 1)]
        gone = bytearray(len(words))
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + span] = b"\x01" * span
        seen.update(own)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
