"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text is cut into units where no piece of the vocabulary goes across: before spaces, around line breaks, and between an
ASCII letter or digit and a full stop or the like. (That none does is tested when the vocabulary is read; kinds of places
where one does aren't cut at.) Units of over LONG bytes are cut further, wherever none of their own edges goes across.
Over each unit lies a lattice: an edge for every substring that is a piece of the vocabulary, and for a character that is
none, an edge of its UTF-8 bytes' pieces. So the ways through a text's units are all ways through
the text's one lattice.

An edge weighs (1 + rank)^-sharpness, where rank is the piece's place in the vocabulary's scores. Forward filtering
sums the weights of all ways to each position; backward sampling then draws, from the unit's end, the last piece in
proportion to the ways that end in it, and goes on from where that begins: a segmentation is drawn exactly as often as the
product of its weights says. Lattices of distinct units are filtered together, position by position, and kept for the next
texts; all units of a slice are sampled together, step by step. Random numbers are hashes of (seed, doc_id, unit, step):
the same row gets the same segmentation in any run, partition or order.

Spaces become U+2581; a U+2581 in the text itself goes by its bytes, so decoding gives back every text exactly. Null texts
have null ids and decode to null; empty texts have none. A null doc_id seeds as 0. Repeated rows are sampled alike. An empty
table gives an empty one. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import let_go, sliced, slices, texts
from ._exchange import hash_of, mix, prefix_hashes

SHARPNESS = 1.0
#: Hashes of units that are tried before it counts as an error that pieces don't give back their text.
TRIES = 8
SEED = 20
#: Fixed value: SentencePiece's mark for a space.
SPACE = "▁"
#: Units of more bytes are cut where no edge goes across.
LONG = 192
#: Units also end between an ASCII letter or digit and one of these.
POINT, LETTER = np.zeros(256, bool), np.zeros(256, bool)
POINT[list(b".,;:!?\"')]}*%&#$")] = True
LETTER[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


class Pieces:
    """The vocabulary: piece hashes and weights for encoding, bytes for decoding."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain, self.raw, self.byte = [], [b""] * n, np.zeros(256, np.int64)
        byte_ids = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
                byte_ids.append(i)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = piece.replace(SPACE, " ").encode()
                plain.append((i, piece))
        order = sorted(plain, key=lambda x: (-model.get_score(x[0]), x[0]))
        rank = np.full(n, len(order), np.float64)
        rank[[i for i, _ in order]] = np.arange(len(order))
        self.weight = -sharpness * np.log1p(rank)
        self.longest = max(len(p) for _, p in plain)
        size = np.array([len(p) for _, p in plain])
        symbols = np.frombuffer("".join(p for _, p in plain).encode("utf-32-le"), "<u4").astype(np.uint64)
        h = mix(hash_of(prefix_hashes(symbols), np.cumsum(size) - size, size) ^ size.astype(np.uint64))
        self.maybe = np.zeros(self.BITS + 1, bool)  # of what pieces begin with, by the lowest bits of the hash: what isn't here needn't be looked up or made longer
        prefix, begin = prefix_hashes(symbols), np.cumsum(size) - size
        for n in range(1, self.longest + 1):
            self.maybe[self.low(mix(hash_of(prefix, begin[size >= n], n) ^ np.uint64(n)))] = True
        by = np.argsort(h)
        self.hash, self.id = h[by], np.array([i for i, _ in plain])[by]
        low, count = np.unique(self.low(self.hash), return_counts=True)
        self.slot = np.zeros(self.BITS + 1, np.int32)  # where a hash with these lowest bits would be; len(hash): ask for it
        self.slot[self.low(self.hash)] = np.arange(len(self.hash))
        self.slot[low[count > 1]] = len(self.hash)
        self.size = np.array([len(x) for x in self.raw])
        self.pool = np.frombuffer(b"".join(self.raw), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        # kinds of places that a piece goes across aren't cut at
        self.point, self.space, self.line = POINT.copy(), True, True
        for i, _ in plain:
            own = np.frombuffer(self.raw[i], np.uint8)
            self.point[own[1:][LETTER[own[:-1]]]] = False
            self.space &= not ((own[1:] == 0x20) & (own[:-1] != 0x20)).any()
            self.line &= len(own) == 1 or not (own == 0x0A).any()

    BITS = (1 << 20) - 1

    def low(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces' ids; -1: none."""
        at = self.slot[self.low(h)]
        if len(shared := np.flatnonzero(at == len(self.hash))):
            at[shared] = np.minimum(np.searchsorted(self.hash, h[shared]), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.id[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        return self.pool[np.repeat(self.begin[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()


@lru_cache(4)
def vocabulary(path: str, sharpness: float = SHARPNESS) -> Pieces:
    """A worker's own, read once."""
    return Pieces(path, sharpness)


class Lattices:
    """The filtered lattices of units met so far: nodes are positions in units, edges lead back from each."""

    def __init__(self, pieces: Pieces, limit: int = 70_000, at_once: int = 1 << 17):
        self.pieces, self.limit, self.at_once, self.salt = pieces, limit, at_once, 0
        self._clear()

    def _clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # units' hashes, in order, and numbers
        self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)  # node of each unit's beginning and end
        self.edge = np.zeros(1, np.int32)  # where each node's edges begin
        self.share, self.source = np.zeros(0, np.float32), np.zeros(0, np.int32)  # of each edge: cumulative probability; node before
        self.ids, self.id_begin = np.zeros(0, np.int32), np.zeros(1, np.int32)  # of each edge: its pieces

    def collided(self) -> None:
        self.salt += 1
        self._clear()

    def numbers(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the units raw[begin:][:size]."""
        if len(self.known) > self.limit:
            self._clear()
        h = mix(hash_of(prefix_hashes(raw ^ np.uint8(self.salt & 255)), begin, size) ^ size.astype(np.uint64))
        which, different = pd.factorize(h)
        at = np.searchsorted(self.known, different)
        at[at == len(self.known)] = 0
        old = self.known[at] == different if len(self.known) else np.zeros(len(different), bool)
        number = np.where(old, self.number[at] if len(self.known) else 0, 0)
        if not old.all():
            fresh = np.flatnonzero(~old)
            number[fresh] = len(self.first) + np.arange(len(fresh))
            first = np.zeros(len(different), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            where = first[fresh]
            n = size[where]
            made = []
            for a, b in slices(n, self.at_once):
                own = n[a:b]
                made.append(
                    self._filtered(raw[np.repeat(begin[where[a:b]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))], own)
                )
            self._add(made)
            self.known, self.number = np.append(self.known, different[fresh]), np.append(self.number, number[fresh])
            order = np.argsort(self.known)
            self.known, self.number = self.known[order], self.number[order]
        return number[which]

    def _add(self, made: list[tuple[np.ndarray, ...]]) -> None:
        grown: list[list[np.ndarray]] = [
            [self.first], [self.last], [self.edge[:-1]], [self.share], [self.source], [self.ids], [self.id_begin]
        ]
        nodes, edges, ids = len(self.edge) - 1, len(self.source), len(self.ids)
        for first, last, edge, share, source, own_ids, many in made:
            new = first + nodes, last + nodes, edge[:-1] + edges, share, source + nodes, own_ids, ids + np.cumsum(many)
            nodes, edges, ids = nodes + len(edge) - 1, edges + len(source), ids + len(own_ids)
            for old, x in zip(grown, new, strict=True):
                old.append(x.astype(old[0].dtype))
        grown[2].append(np.array([edges], np.int32))
        self.first, self.last, self.edge, self.share, self.source, self.ids, self.id_begin = (np.concatenate(x) for x in grown)

    def joints(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where in the units raw[begin:][:size] no edge goes across: byte positions of characters that begin there."""
        out = []
        for a, b in slices(size, self.at_once):
            where = np.repeat(begin[a:b] - (np.cumsum(size[a:b]) - size[a:b]), size[a:b]) + np.arange(int(size[a:b].sum()))
            own = raw[where]
            symbols, _, _, starts, lengths, _ = self._edges(own, size[a:b])
            across = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(across, np.concatenate([s + 1 for s in starts]), 1)
            np.add.at(across, np.concatenate([s + n for s, n in zip(starts, lengths, strict=True)]), -1)
            out.append(where[np.flatnonzero((own & 0xC0) != 0x80)[np.cumsum(across)[: len(symbols)] == 0]])
        return np.concatenate(out)

    def _edges(self, raw: np.ndarray, n_bytes: np.ndarray):
        """Of units, whose bytes stand end to end: (symbols, characters, units' numbers of characters, beginnings of edges, their lengths, their pieces), the last three by length."""
        p = self.pieces
        # a space is the mark; the mark itself is a character that no piece holds
        real = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        symbols = np.where(real == 0x2581, 0xE000, np.where(real == 0x20, 0x2581, real)).astype(np.uint64)
        size = np.add.reduceat((raw & 0xC0) != 0x80, np.cumsum(n_bytes) - n_bytes, dtype=np.int64)
        end = np.repeat(np.cumsum(size), size)
        prefix = prefix_hashes(symbols)
        starts, lengths, found = [], [], []
        mark_own = (symbols == 0xE000) & (real == 0x2581)
        at = np.arange(len(symbols))
        for n in range(1, min(p.longest, int(size.max())) + 1):
            at = at[at + n <= end[at]]
            h = mix(hash_of(prefix, at, n) ^ np.uint64(n))
            alive = p.maybe[p.low(h)]
            at, h = at[alive], h[alive]
            piece = p.find(h)
            ok = piece >= 0
            if n == 1:
                ok &= ~mark_own[at]
            starts.append(at[ok])
            lengths.append(np.full(int(ok.sum()), n))
            found.append(piece[ok])
        return symbols, real, size, starts, lengths, found

    def _filtered(self, raw: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of new units, whose bytes stand end to end: first and last nodes, where nodes' edges begin, edges' cumulative probabilities and sources, ids, ids of each edge."""
        p = self.pieces
        symbols, real, size, starts, lengths, found = self._edges(raw, n_bytes)
        begin = np.cumsum(size) - size
        unit = np.repeat(np.arange(len(size)), size)
        single = np.zeros(len(symbols), bool)
        single[starts[0]] = True
        other = np.flatnonzero(~single)  # by bytes
        coded = [chr(c).encode() for c in real[other].tolist()]
        start = np.concatenate([*starts, other])
        length = np.concatenate([*lengths, np.ones(len(other), np.int64)])
        many = np.concatenate([np.ones(sum(len(x) for x in found), np.int64), np.array([len(x) for x in coded], np.int64)])
        ids = np.concatenate([*found, p.byte[np.frombuffer(b"".join(coded), np.uint8)]])
        id_begin = np.cumsum(many) - many
        weight = np.add.reduceat(p.weight[ids], id_begin)
        # nodes: one more than characters in each unit
        node0 = begin + np.arange(len(size))
        source = start + unit[start]
        target = source + length
        order = np.argsort(target, kind="stable")
        source, target, weight, many, old = source[order], target[order], weight[order], many[order], id_begin[order]
        ids = ids[np.repeat(old - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        n_nodes = len(symbols) + len(size)
        edge = np.searchsorted(target, np.arange(n_nodes + 1))
        position = np.arange(n_nodes) - np.repeat(node0, size + 1)
        ways = np.zeros(n_nodes)
        by_position = np.argsort(position, kind="stable")
        at = np.searchsorted(position[by_position], np.arange(1, int(size.max()) + 2))
        score = np.zeros(len(source))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            nodes = by_position[a:b]
            count = edge[nodes + 1] - edge[nodes]
            begins = np.cumsum(count) - count
            own = np.repeat(edge[nodes] - begins, count) + np.arange(int(count.sum()))
            z = ways[source[own]] + weight[own]
            top = np.maximum.reduceat(z, begins)
            ways[nodes] = top + np.log(np.add.reduceat(np.exp(z - np.repeat(top, count)), begins))
            score[own] = np.exp(z - np.repeat(ways[nodes], count))
        # the likeliest edge of a node first; then its own and all likelier ones' probability, the same in whatever company a unit comes
        order = np.argsort(target + 0.75 * (1 - np.minimum(score, 1)), kind="stable")
        source, score, many, old = source[order], score[order], many[order], (np.cumsum(many) - many)[order]
        ids = ids[np.repeat(old - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        own, last = edge[:-1], edge[1:]
        while len(own):
            more = own + 1 < last
            own, last = own[more] + 1, last[more]
            score[own] += score[own - 1]
        return node0, node0 + size, edge, score, source, ids, many

    def sample(self, number: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, each unit's number of ids); key: a random 64-bit number for each unit."""
        lane, node = np.arange(len(number)), self.last[number]
        lanes, edges, steps, step = [], [], [], 0
        while len(lane):
            u = (mix(key[lane] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e, last = self.edge[node], self.edge[node + 1] - 1
            on = np.flatnonzero(u >= self.share[e])
            while len(on):
                on = on[e[on] < last[on]]
                e[on] += 1
                on = on[u[on] >= self.share[e[on]]]
            lanes.append(lane)
            edges.append(e)
            steps.append(np.full(len(lane), -step))
            node = self.source[e]
            more = node != self.first[number[lane]]
            lane, node, step = lane[more], node[more], step + 1
        if not lanes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lane, edge = np.concatenate(lanes), np.concatenate(edges)
        order = np.lexsort((np.concatenate(steps), lane))
        lane, edge = lane[order], edge[order]
        many = self.id_begin[edge + 1] - self.id_begin[edge]
        ids = self.ids[np.repeat(self.id_begin[edge] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        return ids, np.bincount(lane, many, len(number)).astype(np.int64)


class Sampler:
    def __init__(self, path: str, seed: int = SEED, sharpness: float = SHARPNESS):
        self.pieces = vocabulary(path, sharpness)
        self.lattices, self.seed = Lattices(self.pieces), seed

    def __call__(self, keys: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and end): texts that aren't UTF-8 raise."""
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        size = np.array([len(t) for t in raw], np.int64)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
        begins = np.cumsum(size) - size
        space, line = (data == 0x20) & self.pieces.space, (data == 0x0A) & self.pieces.line
        opens = space | line
        opens[1:] &= ~(space[:-1] & space[1:])  # a run of spaces and what follows it are one unit
        opens[1:] |= line[:-1]
        opens[1:] |= LETTER[data[:-1]] & self.pieces.point[data[1:]]
        opens[begins[size > 0]] = True
        begin = np.flatnonzero(opens)
        length = np.diff(np.append(begin, len(data)))
        if len(long := np.flatnonzero(length > LONG)):
            opens[self.lattices.joints(data, begin[long], length[long])] = True
            begin = np.flatnonzero(opens)
            length = np.diff(np.append(begin, len(data)))
        first = np.searchsorted(begin, np.append(begins, len(data)))
        doc = np.repeat(np.arange(len(raw)), np.diff(first))
        place = np.arange(len(begin)) - first[doc]
        row = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(self.seed * 0xD1342543DE82EF95 % (1 << 64)))
        key = mix(row[doc] ^ mix(place.astype(np.uint64) + np.uint64(1)))
        for _ in range(TRIES):
            ids, count = self.lattices.sample(self.lattices.numbers(data, begin, length), key)
            if self.pieces.decode(ids) == joined:
                return ids, np.append(0, np.cumsum(np.bincount(doc, count, len(raw)).astype(np.int64)))
            self.lattices.collided()  # two units with one hash: with another one, they differ
        raise ValueError("the texts can't be put together from their pieces")


def encode_pieces(docs: DataFrame, model: str, seed: int = SEED, sharpness: float = SHARPNESS, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array<int>): one row per row of docs. decoded: and text, decoded from the ids in the same pass."""

    def run(batches):
        sampler = Sampler(model, seed, sharpness)
        for batch in sliced(batches, 1 << 20):
            raw = batch.column("text").to_pylist()
            keys = batch.column("doc_id").fill_null(0).to_numpy()
            ids, edges = sampler(keys, [x or b"" for x in raw])
            lists = pa.ListArray.from_arrays(
                pa.array(edges, pa.int32()), pa.array(ids, pa.int32()),
                mask=pa.array([x is None for x in raw], pa.bool_())
            )
            cols = {"doc_id": batch.column("doc_id"), "ids": lists}
            if decoded:
                cols["text"] = pa.array(
                    [None if x is None else sampler.pieces.decode(ids[a:b]).decode() for x, a, b in zip(raw, edges[:-1].tolist(), edges[1:].tolist(), strict=True)],
                    pa.string()
                )
            yield pa.RecordBatch.from_pydict(cols)
            del raw, ids, lists, cols
        del sampler
        let_go()

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text."""

    def run(batches):
        pieces = vocabulary(model)
        for batch in batches:
            lists = batch.column("ids")
            flat = np.asarray(lists.values.fill_null(0) if lists.values.null_count else lists.values, np.int64)
            edges, null = np.asarray(lists.offsets), lists.is_null().to_pylist()
            out = [None if n else pieces.decode(flat[a:b]).decode("utf-8", "replace") for n, a, b in zip(null, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(out, pa.string())], ["doc_id", "ids", "text"])
            del lists, flat, out
        let_go()

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, text string")


def brute_force(
    rows: list[tuple[int | None, str | None]], model: str, seed: int = SEED, sharpness: float = SHARPNESS
) -> list[tuple[int | None, list[int] | None]]:
    """(doc_id, ids), from the definition: one text and one position at a time, with the same random numbers."""
    import math

    p, whole = vocabulary(model, sharpness), (1 << 64) - 1
    known = {raw.decode(): i for i, raw in enumerate(p.raw) if raw and i not in set(p.byte.tolist())}

    def mixed(x: int) -> int:
        return int(mix(np.array([x & whole], np.uint64))[0])

    def edges(text: str, end: int) -> list[tuple[int, list[int]]]:
        """(beginning, ids) of the edges that end there, shortest first."""
        out = [(b, [known[text[b:end]]]) for b in range(end - 1, max(0, end - p.longest) - 1, -1) if text[b:end] in known and SPACE not in text[b:end]]
        return out if out and out[0][0] == end - 1 else [*out, (end - 1, [int(p.byte[x]) for x in text[end - 1].encode()])]

    def units(text: str) -> list[str]:
        cuts = [0]
        for i in range(1, len(text)):
            a, b = text[i - 1], text[i]
            point = a.isascii() and LETTER[ord(a)] and b.isascii() and p.point[ord(b)]
            if (b == " " and a != " ") or "\n" in (a, b) or point:
                cuts.append(i)
        out = []
        for unit in (text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True)):
            inner = {
                i for end in range(1, len(unit) + 1) for b, _ in edges(unit, end) for i in range(b + 1, end)
            } if len(unit.encode()) > LONG else set(range(1, len(unit)))
            joints = [0, *(i for i in range(1, len(unit)) if i not in inner), len(unit)]
            out += [unit[i:j] for i, j in zip(joints[:-1], joints[1:], strict=True)]
        return out

    out = []
    for doc, text in rows:
        ids: list[int] = []
        row = mixed((0 if doc is None else doc) + seed * 0xD1342543DE82EF95)
        for place, unit in enumerate(units(text) if text else []):
            key = mixed(row ^ mixed(place + 1))
            ways, ranked = [0.0], [[]]
            for end in range(1, len(unit) + 1):
                own = [(ways[b] + sum(p.weight[i] for i in found), b, found) for b, found in edges(unit, end)]
                top = max(z for z, _, _ in own)
                ways.append(top + math.log(sum(math.exp(z - top) for z, _, _ in own)))
                ranked.append(sorted(((math.exp(z - ways[end]), b, found) for z, b, found in own), key=lambda x: -x[0]))
            at, step, drawn = len(unit), 0, []
            while at:
                u, total, pick = (mixed(key + step * 0x9E3779B97F4A7C15) >> 11) * 2.0**-53, 0.0, ranked[at][-1]
                for x in ranked[at]:
                    total += x[0]
                    if u < total:
                        pick = x
                        break
                at, step = pick[1], step + 1
                drawn[:0] = pick[2]
            ids += drawn
        out.append((doc, None if text is None else ids))
    return out


def pieces_digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_hash (xxhash64 of the ids), text_sha256 (of the decoded text)."""
    return decoded.select(
        "doc_id", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_ids"),
        F.when(F.col("ids").isNotNull(), F.xxhash64("ids")).alias("ids_hash"), F.sha2("text", 256).alias("text_sha256")
    )
