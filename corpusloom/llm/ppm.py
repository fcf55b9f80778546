"""Language-model scores of texts: prediction by partial matching over bytes, and a unigram base.

A text is its words (runs of bytes other than space and \\t\\n\\v\\f\\r, A-Z in lower case) joined by one space, then one end
symbol; before it stand ORDER spaces. The model is a trie of byte contexts of up to ORDER symbols with counts of what
follows them. A symbol's probability: from the longest context that was seen, count / (T + q), where T is the sum and q
the number of the context's successors; a symbol that never followed costs the escape q / (T + q) and goes on in the next
shorter context, with the successors already ruled out taken away from T and q; below the empty context all symbols never
seen are alike. (Escape method C with exclusion.)

Pretrained: counts come from all texts that are learned from. Batches of documents send the grams they have, with counts
(0 where they only need the probability), to the bucket of the two latest context symbols, which so holds all nodes from
order 2 to ORDER that any of its symbols needs; orders 0 and 1 are a table of at most 257 x 257 counts that goes to
everyone. The bucket answers each batch with a log probability for each gram. Word counts travel alike. What is sent
grows with the distinct grams and words of batches, not with the number of equal ones.

Adaptive: `adaptive_score` learns along each text from an empty trie, symbol by symbol.

Null and empty texts have the end symbol only. A null doc_id counts as learned from. Rows are scored one by one, repeated
ones alike; if nothing is learned from, all symbols are alike and no token is known. An empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_texts, sliced, slices, texts, values
from ._exchange import PACKED, Batch, Rows, by_batch, by_bucket, dealing, dealt, mix, pack
from ..sources.shared import written
from .passage_dedup import Words

ORDER = 4
END, SYMBOLS, BITS = 256, 257, 9
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Kinds of entries.
GRAMS, WORDS, DISTINCT = 0, 1, 2
CHUNK = 1 << 20


def held_out(doc_id: int | None, parts: int = 7, part: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == part


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(LOWER).split())


def grams(plains: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(document, gram) of each symbol; a gram holds the symbol in its lowest bits, then the context from the latest on."""
    size = np.array([len(x) for x in plains], np.int64) + order + 1
    begins = np.cumsum(size) - size
    symbols = np.frombuffer(b"".join(b" " * order + x + b"\x00" for x in plains), np.uint8).astype(np.int64)
    symbols[begins + size - 1] = END
    code = symbols.copy()
    for i in range(1, order + 1):
        code[i:] |= symbols[:-i] << (BITS * i)
    doc = np.repeat(np.arange(len(plains)), size)
    real = np.arange(len(symbols)) - begins[doc] >= order
    return doc[real], code[real]


class _Level:
    """The counts of one context length: entries (context << BITS | symbol) and nodes."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        self.code, where = np.unique(code, return_inverse=True)
        self.count = np.bincount(where, count, len(self.code)).astype(np.int64) if len(code) else np.zeros(0, np.int64)
        self.node, self.of = np.unique(self.code >> BITS, return_inverse=True)
        self.total = np.bincount(self.of, self.count, len(self.node)).astype(np.int64)
        self.distinct = np.bincount(self.of, minlength=len(self.node))
        self.gone = np.zeros(len(self.node), np.int64)  # the sum that a node's successors have in the next shorter context

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_, x)
        at[at == len(sorted_)] = 0
        return np.where(sorted_[at] == x, at, -1) if len(sorted_) else np.full(len(x), -1)

    def nodes(self, context: np.ndarray) -> np.ndarray:
        return self._find(self.node, context)

    def counts(self, code: np.ndarray) -> np.ndarray:
        at = self._find(self.code, code)
        return np.where(at >= 0, self.count[at], 0) if len(self.count) else np.zeros(len(code), np.int64)


def _mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


def log_probabilities(
    code: np.ndarray, seen: np.ndarray, count: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray,
    order: int = ORDER
) -> np.ndarray:
    """log10 of each gram's probability. seen, count: all grams of the model with these grams' two latest context symbols;
    pairs, pair_counts: all its grams of one context symbol."""
    levels = [
        _Level(pairs & _mask(1), pair_counts), _Level(pairs, pair_counts)
    ] + [_Level(seen & _mask(k + 1), count) for k in range(2, order + 1)]
    for k in range(1, order + 1):
        own = levels[k]
        own.gone = np.bincount(own.of, levels[k - 1].counts(own.code & _mask(k)), len(own.node)).astype(np.int64)
    out = np.zeros(len(code))
    todo = np.arange(len(code))
    gone, less = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    for k in range(order, -1, -1):
        own, c = levels[k], code[todo]
        node = own.nodes((c & _mask(k + 1)) >> BITS)
        known = node >= 0
        at = np.where(known, node, 0)
        if len(own.node):
            total, distinct = own.total[at] - gone[todo], own.distinct[at] - less[todo]
            n = np.where(known, own.counts(c & _mask(k + 1)), 0)
            every = np.maximum(total + distinct, 1)
            out[todo] += np.where(
                n > 0, np.log10(np.maximum(n, 1) / every),
                np.where(known & (distinct > 0), np.log10(np.maximum(distinct, 1) / every), 0.0)
            )
            gone[todo] = np.where(known, own.gone[at], gone[todo])
            less[todo] = np.where(known, own.distinct[at], less[todo])
            todo = todo[n == 0]
    rest = SYMBOLS - len(levels[0].code)
    out[todo] -= math.log10(max(rest, 1))
    return out


def _pair_counts(docs: DataFrame, learned) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Counts of (symbol, symbol before), tokens, and texts that are learned from: at most 257 x 257 + 2 rows."""

    def run(batches):
        table = np.zeros(1 << (2 * BITS), np.int64)
        tokens = rows = 0
        for batch in sliced(batches):
            own = [plain(t) for t, d in zip(values(batch), batch.column("doc_id").to_pylist(), strict=True) if learned(d)]
            if own:
                table += np.bincount(grams(own, 1)[1], minlength=len(table))
                tokens += sum(x.count(b" ") + 2 if x else 1 for x in own)
                rows += len(own)
        code = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(code, [-1, -2])), pa.array(np.append(table[code], [tokens, rows]))], ["code", "n"]
        )

    got = dict(texts(docs).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect())
    tokens, rows = got.pop(-1, 0), got.pop(-2, 0)
    code = np.array(sorted(got), np.int64)
    return code, np.array([got[c] for c in code.tolist()], np.int64), tokens, rows


def _numbered(batch: Batch, order: int):
    """Of a batch's distinct grams and words: (values, number of each occurrence, documents of the occurrences, rows)."""
    parts = ([], [], [], [])
    for a, b in slices(batch.size + order + 1, CHUNK):
        own = [plain(t) for t in batch.texts[a:b]]
        doc, code = grams(own, order)
        words = Words(own)
        parts[0].append(code)
        parts[1].append((doc + a).astype(np.int32))
        parts[2].append(words.ids.view(np.int64))
        parts[3].append((np.repeat(np.arange(len(own)), words.count) + a).astype(np.int32))
    code, doc, word, owner = (np.concatenate(x) for x in parts)
    number, distinct = pd.factorize(code)
    which, vocabulary = pd.factorize(word)
    return (distinct, number, doc), (vocabulary, which, owner)


def _dealing(distinct: np.ndarray, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a batch asks, and where each bucket begins in it: the same whenever it is worked out."""
    key = mix((distinct >> BITS & _mask(2)).astype(np.uint64)) if kind == GRAMS else distinct.view(np.uint64)
    r = (key % np.uint64(n)).astype(np.int64)
    order = np.lexsort((distinct, r))
    return order, np.searchsorted(r[order], np.arange(n + 1))


def _ask(n: int, order: int, learned):
    def fn(batch: Batch, given: dict) -> pa.Table:
        out = Rows()
        train = np.array([learned(None if null else d) for d, null in zip(batch.doc_id.tolist(), batch.null.tolist(), strict=True)], bool)
        for kind, (distinct, number, doc) in zip((GRAMS, WORDS), _numbered(batch, order), strict=True):
            count = np.bincount(number[train[doc]], minlength=len(distinct)).astype(np.uint32)
            how, edges = _dealing(distinct, kind, n)
            for r in np.flatnonzero(np.diff(edges)).tolist():
                own = how[edges[r] : edges[r + 1]]
                out.add(r, batch.b, kind, pack(distinct[own], count[own]))
        return out.table()

    return fn


def _answer(shared, order: int):
    def fn(r: int, entries: list, out: Rows) -> None:
        for kind in (GRAMS, WORDS):
            own = [(b, x) for b, k, x in entries if k == kind]
            if not own:
                continue
            key, where = np.unique(np.concatenate([x[0] for _, x in own]), return_inverse=True)
            count = np.bincount(where, np.concatenate([x[1] for _, x in own]), len(key)).astype(np.int64)
            if kind == GRAMS:
                some = count > 0
                answer = log_probabilities(key, key[some], count[some], *shared.value, order)
            else:
                answer = count.astype(np.uint32) if count.max(initial=0) < 1 << 32 else count
                out.add(r, -1, DISTINCT, pack(np.array([(count > 0).sum()], np.int64)))
            at = 0
            for b, x in own:
                out.add(r, b, kind, pack(np.array([r], np.int32), answer[where[at : at + len(x[0])]]))
                at += len(x[0])

    return fn


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, order: int, learned, tokens: int, rows: int, vocabulary: int):
    def fn(batch: Batch, given: dict) -> pa.Table:
        sums = []
        for kind, (distinct, number, doc) in zip((GRAMS, WORDS), _numbered(batch, order), strict=True):
            how, edges = _dealing(distinct, kind, n)
            told = np.zeros(len(distinct))
            for (r,), answer in given.get(kind, ()):
                told[how[edges[r] : edges[r + 1]]] = answer
            each = told[number]
            if kind == WORDS:
                sums.append(np.bincount(doc[each > 0], minlength=len(batch)))
                sums.append(np.bincount(doc, minlength=len(batch)))
                each = np.log10(each + 1)
            sums.append(np.bincount(doc, each, len(batch)))
        score, known, words, base = sums
        count = words + 1
        base = base + math.log10(rows + 1) - count * math.log10(tokens + vocabulary + 1)
        train = [learned(None if null else d) for d, null in zip(batch.doc_id.tolist(), batch.null.tolist(), strict=True)]
        cols = [
            batch.ids(), pa.array([not x for x in train]), pa.array(count), pa.array(known + (rows > 0)),
            pa.array(np.full(len(batch), tokens)), pa.array(base), pa.array(score)
        ]
        return pa.Table.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])

    return fn


def lm_score(docs: DataFrame, order: int = ORDER, learned=lambda d: not held_out(d)) -> DataFrame:
    """RESULT, one row per row of docs. learned: whether a doc_id's text is learned from."""
    deal = dealing(docs)
    n, batches = deal.buckets, dealt(docs, deal)
    code, count, tokens, rows = _pair_counts(docs, learned)
    shared = docs.sparkSession.sparkContext.broadcast((code, count))  # at most 257 x 257 entries
    none = batches.select(F.lit(0).alias("r"), "b", F.lit(0).alias("kind"), F.lit(b"").alias("data")).limit(0)
    answers = written(by_bucket(by_batch(batches, none, _ask(n, order, learned), PACKED), _answer(shared, order), deal))
    distinct = sum(  # one row a bucket
        int.from_bytes(bytes(x["data"])[-8:], "little") for x in answers.where(F.col("kind") == DISTINCT).select("data").collect()
    )
    return by_batch(batches, answers.where("b >= 0"), _score(n, order, learned, tokens, rows, distinct + (rows > 0)), RESULT)


class Trie:
    """The same model as a trie of nodes, for one text at a time."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, {}

    def learn(self, context: tuple[int, ...], symbol: int) -> None:
        for k in range(self.order + 1):
            self.nodes.setdefault(context[:k], Counter())[symbol] += 1

    def log10(self, context: tuple[int, ...], symbol: int) -> float:
        """context: latest symbol first."""
        out, ruled = 0.0, set()
        for k in range(self.order, -1, -1):
            if own := self.nodes.get(context[:k]):
                left = {s: n for s, n in own.items() if s not in ruled}
                total, q = sum(left.values()), len(left)
                if symbol in left:
                    return out + math.log10(left[symbol] / (total + q))
                if q:
                    out += math.log10(q / (total + q))
                ruled |= own.keys()
        return out - math.log10(max(SYMBOLS - len(self.nodes.get((), ())), 1))

    def run(self, text: bytes, score: bool = True, learn: bool = False) -> float:
        out, context = 0.0, (32,) * self.order
        for s in [*plain(text), END]:
            if score:
                out += self.log10(context, s)
            if learn:
                self.learn(context, s)
            context = ((s, *context))[: self.order]
        return out


def adaptive_score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, score: log10 of the probability that each text has under a model that learns along it alone."""
    return map_texts(
        texts(docs),
        lambda batch: {"doc_id": batch.column("doc_id"), "score": [Trie(order).run(t, learn=True) for t in values(batch)]},
        "doc_id long, score double"
    )


def brute_force(rows: list[tuple[int, bytes]], order: int = ORDER) -> dict[int, tuple]:
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score, score), from the definitions."""
    trie, counts = Trie(order), Counter()
    for d, t in rows:
        if not held_out(d):
            trie.run(t, score=False, learn=True)
            counts.update([*plain(t).split(), None])
    n, v = counts.total(), len(counts)
    out = {}
    for d, t in rows:
        tokens = [*plain(t).split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out[d] = (held_out(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, trie.run(t))
    return out
