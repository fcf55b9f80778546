"""Token ids as shards of Simple-8b words.

A shard file is: magic, version, ids a block, counts of documents, ids and blocks; the documents' ids (8 bytes each), their
lengths in tokens (4 bytes each), the blocks' offsets in 64-bit words; then the words. Each 64-bit word holds a selector in
its top 4 bits and 240, 120, 60, 30, ... or 1 ids below (Anh & Moffat's Simple-8b); selectors 0 and 1 stand for runs of
zeros. An id from 2^60 - 1 on takes two words: selector 15 with all bits set, and the id itself. Blocks of
BLOCK ids are coded by themselves, so that any can be decoded alone, and all words of a shard with numpy at once.

Documents are sorted by doc_id over a range partitioning; a partition writes shards of about SHARD_IDS ids. Shards are kept
as binary rows of a table in the shared folder (Spark's writer commits them, so a retried task leaves no half file), and
`read_shards` decodes them. Where a document's ids start is the sum over all shards before it: a shard's row says how many
ids its part has before it, and the sums of the parts, a row for each partition, are all that is put in order and sent
to everyone.

The text's words are encoded once in each task and then looked up: the tokenizer drops white space and never merges over
it. Null and empty texts have no ids but END_ID. Null doc_ids come first. Rows with one doc_id each keep their ids, in
order of their text. An empty table gives no shards. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrow import let_go, sliced, texts, values
from ._exchange import hash_of, mix, prefix_hashes
from ..sources.shared import shared_folder

END_ID = 1
BLOCK = 1 << 12
SHARD_IDS = 1 << 20
MAGIC = b"S8BTOKEN"
HEAD = struct.Struct("<8sIIQQQ")
#: Fixed values of Simple-8b: ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 64) - 1
#: doc_id of documents without one, in a file.
NO_ID = np.iinfo(np.int64).min


def _largest(bits: np.ndarray, count: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """The largest of each `count` neighbouring values, from that of fewer; as long as bits, the last count - 1 have no meaning."""
    if count not in known:
        half = max(k for k in known if k < count)
        rest = max(k for k in known if k <= half and k >= count - half) if half < count - half else half
        if half + rest < count:
            _largest(bits, half + rest, known)
            return _largest(bits, count, known)
        x = known[half].copy()
        np.maximum(x[: len(x) - (count - rest)], known[rest][count - rest :], out=x[: len(x) - (count - rest)])
        known[count] = x
    return known[count]


def encode_blocks(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(the 64-bit words of all blocks, where each block's begin) of unsigned 64-bit ids.

    How much each selector could take from each position is worked out for all positions at once; then the chains of words
    that are really used are followed, a step for all blocks at once, and each selector's words put together by shifts.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    bits[ids >= np.uint64((1 << 60) - 1)] = 61  # an escape, as is the word that the last of these would have
    begins = np.arange(0, n, block)
    ends = np.minimum(begins + block, n)
    room = (np.repeat(ends, ends - begins) - np.arange(n)).astype(np.int32)
    chosen = np.full(n, -1, np.int8)
    known = {1: bits}
    for selector in range(15, -1, -1):  # the last that fits holds the most
        count = int(COUNTS[selector])
        if count <= min(block, n):
            np.putmask(chosen, (_largest(bits, count, known) <= WIDTHS[selector]) & (room >= count), selector)
    step = np.where(chosen < 0, 1, COUNTS[chosen])
    at, found = begins, []
    while len(at):
        found.append(at)
        at = at + step[at]
        live = at < ends
        at, ends = at[live], ends[live]
    starts = np.sort(np.concatenate(found))
    kind = chosen[starts].astype(np.int64)
    size = np.where(kind < 0, 2, 1)
    target = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for selector in np.flatnonzero(np.bincount(kind + 1)) - 1:
        own = np.flatnonzero(kind == selector)
        if selector < 0:
            out[target[own]], out[target[own] + 1] = np.uint64(ESCAPE), ids[starts[own]]
            continue
        width, count = int(WIDTHS[selector]), int(COUNTS[selector])
        word = np.full(len(own), np.uint64(int(selector) << 60))
        if width:
            for k in range(count):
                word |= ids[starts[own] + k] << np.uint64(k * width)
        out[target[own]] = word
    return out, np.append(target, len(out))[np.searchsorted(starts, np.append(begins, n))]


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks end to end."""
    words = np.asarray(words, np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64)
    # a word after an escape is an id, whatever it looks like: of a run of all-ones words every second is an escape
    full = words == np.uint64(ESCAPE)
    place = np.arange(len(words))
    begin = np.maximum.accumulate(np.where(full & ~np.append(False, full[:-1]), place, 0))
    escape = full & ((place - begin) % 2 == 0)
    plain = np.append(False, escape[:-1])
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(escape, 0, np.where(plain, 1, COUNTS[selector]))
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    out[first[plain]] = words[plain]
    coded = ~escape & ~plain
    for s in np.flatnonzero(np.bincount(selector[coded], minlength=16)).tolist():
        if width := int(WIDTHS[s]):
            own = np.flatnonzero(coded & (selector == s))
            begin, word = first[own], words[own]
            for k in range(int(COUNTS[s])):
                out[begin + k] = (word >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return out


def encode_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets = encode_blocks(ids, block)
    head = HEAD.pack(MAGIC, 1, block, len(doc_ids), len(ids), len(offsets) - 1)
    return b"".join(
        [
            head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), offsets.astype("<u8").tobytes(),
            words.astype("<u8").tobytes()
        ]
    )


def decode_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids)."""
    magic, version, _, n_docs, n_ids, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a shard of token ids")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 12 * n_docs)
    ids = decode_words(np.frombuffer(data, "<u8", int(offsets[-1]), at + 12 * n_docs + 8 * (n_blocks + 1)))
    if len(ids) != n_ids or lengths.sum() != n_ids:
        raise ValueError("a shard's ids don't fit its counts")
    return doc_ids, lengths, ids


def read_block(data: bytes, number: int) -> np.ndarray:
    """One block's ids, without decoding those before it."""
    _, _, _, n_docs, _, n_blocks = HEAD.unpack_from(data)
    at = HEAD.size + 12 * n_docs
    begin, end = np.frombuffer(data, "<u8", 2, at + 8 * number).tolist()
    return decode_words(np.frombuffer(data, "<u8", end - begin, at + 8 * (n_blocks + 1) + 8 * begin))


#: White space that words are cut at. Other kinds stay inside words, where the tokenizer sees to them.
CUT = np.zeros(256, bool)
CUT[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Beside an ASCII letter or digit, these are always tokens of their own.
POINT, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
POINT[list(b".,;:!?")] = True
PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


class WordEncoder:
    """Ids of texts by way of their words: a word's ids are worked out once and kept as arrays, for about `limit` words.

    Words are known by 64-bit hashes of their bytes.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _add(self, words: list[bytes]) -> list[int]:
        """The order in which words were added. They go to the tokenizer many at a time: those of letters alone with spaces
        between, as each ends in an id that ends a word; others with a special token between; those that may hold one by themselves."""
        special = max(self.special.values(), default=None)
        mark = next((k for k, v in self.special.items() if v == special), None)
        plain = [w.decode("utf-8", "replace") for w in words]
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(plain):
            letters = w.isalpha() and (w.isascii() or unicodedata.normalize("NFC", w).lower().isalpha())
            kinds[0 if letters else 2 if mark is None or any(k in w for k in self.special) else 1].append(i)
        order, ids, sizes = [], [], []
        for kind, between in ((0, " "), (1, mark)):
            for a in range(0, len(kinds[kind]), 512):
                part = kinds[kind][a : a + 512]
                own = np.array(self._encode(between.join([plain[i] for i in part])), np.int32)
                if kind:
                    stop = own == special
                    size = np.diff(np.flatnonzero(np.concatenate([[True], stop, [True]]))) - 1
                    own = own[~stop]
                else:
                    size = np.diff(np.append(0, np.flatnonzero(self.ends[own]) + 1))
                if len(size) != len(part) or size.sum() != len(own):  # the tokenizer sees words otherwise than expected here
                    kinds[2].extend(part)
                    continue
                order += part
                ids.append(own)
                sizes.append(size)
        for i in kinds[2]:
            order.append(i)
            ids.append(np.array(self._encode(plain[i]), np.int32))
            sizes.append(np.array([len(ids[-1])]))
        self.ids = np.concatenate([self.ids, *ids])
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes)))
        return order

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __call__(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's number of ids), with END_ID."""
        if len(self.known) > self.limit:
            self._clear()
        joined = b" ".join([*raw, b""])
        if b"<|" not in joined:  # the tokenizer goes by lower case, but for its special tokens
            joined = joined.lower()
        data = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~CUT[data]
        apart = np.zeros(len(data) + 1, bool)
        point, plain = POINT[data], PLAIN[data]
        apart[1:-1] = (plain[:-1] & point[1:]) | (point[:-1] & plain[1:])
        begin, end = np.flatnonzero(inside[1:] & (~inside[:-1] | apart)), np.flatnonzero(inside[:-1] & (~inside[1:] | apart))
        size = end - begin
        which, different = pd.factorize(mix(hash_of(prefix_hashes(data), begin, size) ^ size.astype(np.uint64)))
        at = np.searchsorted(self.known, different)
        at[at == len(self.known)] = 0
        old = self.known[at] == different if len(self.known) else np.zeros(len(different), bool)
        number = np.where(old, self.number[at] if len(self.known) else 0, 0)
        if len(fresh := np.flatnonzero(~old)):
            first = np.zeros(len(different), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            base = len(self.begin) - 1
            added = self._add([joined[i:j] for i, j in zip(begin[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)])
            number[fresh[added]] = base + np.arange(len(fresh))
            order = np.argsort(different[fresh])
            new = different[fresh][order]
            at = np.searchsorted(self.known, new)
            self.known, self.number = np.insert(self.known, at, new), np.insert(self.number, at, number[fresh][order])
        number = number[which]
        many = self.begin[number + 1] - self.begin[number]
        flat = self.ids[np.repeat(self.begin[number] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        ends = np.cumsum([len(t) + 1 for t in raw])
        lengths = np.bincount(np.searchsorted(ends, begin, "right"), many, len(raw)).astype(np.int64)[: len(raw)]
        return np.insert(flat, np.cumsum(lengths), END_ID).astype(np.uint64), lengths + 1


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    """A worker's own: words stay known from task to task."""
    return WordEncoder(path)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shard_ids: int = SHARD_IDS) -> None:
    """Writes (part, number, before, n_tokens, data) rows: shards in order of (part, number); before: the part's ids in earlier ones."""
    from pyspark import TaskContext

    def run(batches):
        encode, number = _encoder(tokenizer), 0
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = before = 0

        def shard():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            data = encode_shard(*cols)
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x]) for x in (part, number, before, len(cols[2]))), pa.array([data], pa.binary())],
                ["part", "number", "before", "n_tokens", "data"]
            )

        for batch in sliced(batches):
            ids, lengths = encode(values(batch))
            held.append((batch.column("doc_id").fill_null(NO_ID).to_numpy(), lengths, ids))
            size += len(ids)
            if size >= shard_ids:
                yield shard()
                held.clear()
                before, size, number = before + size, 0, number + 1
        if held:
            yield shard()
        held.clear()
        let_go()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "part long, number long, before long, n_tokens long, data binary").write.mode("overwrite").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian, 32 bits each) of all documents."""
    shards = spark.read.parquet(folder)
    # a row for each partition that wrote
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    earlier = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("earlier"))

    def run(batches):
        for batch in batches:
            for data, first in zip(batch.column("data"), batch.column("first").to_pylist(), strict=True):
                doc_ids, lengths, ids = decode_shard(data.as_buffer())
                ends = np.cumsum(lengths)
                raw, ends_l = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                cols = [
                    pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(first + ends - lengths), pa.array(lengths),
                    pa.array([raw[i:j] for i, j in zip([0, *ends_l[:-1]], ends_l, strict=True)], pa.binary())
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])

    joined = shards.select("part", "before", "data").join(F.broadcast(earlier), "part")
    return joined.select(
        "data", (F.col("earlier") + F.col("before")).alias("first")
    ).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def tokenize(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the shards and reads them back. folder: where to; one of its own in the shared folder if not given."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer, folder)
    return read_shards(spark, folder)


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
