"""Texts as PNG pictures in a binary column, and perceptual hashes of pictures.

A payload becomes an 8-bit greyscale PNG of 64 samples a row: one filter for all rows (none, left or above,
whichever leaves the smallest differences), one zlib stream, and the length of the text in a private ancillary chunk.
Reading tests every chunk's checksum, inflates, and undoes any of the five filters with numpy. The feature is the sign
pattern of the lowest 8 x 8 cosine terms of the picture averaged down to 32 x 32, against their median.

Null and empty texts give a payload of 64 zero bytes. Equal texts give equal pictures and features. Repeated rows give
repeated results; an empty table gives an empty one; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_texts, texts

WIDTH = 64
SIDE, LOW = 32, 8
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LENGTH_CHUNK = b"txLn"


class BadPicture(ValueError):
    pass


def padded(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, n_bytes: int | None = None, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left, above = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    above[1:] -= rows[:-1]
    best = min(((np.abs(x.view(np.int8).astype(np.int16)).sum(), k, x) for k, x in enumerate((rows, left, above))), key=lambda x: x[:2])
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = best[1], best[2]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    size = b"" if n_bytes is None else _chunk(LENGTH_CHUNK, struct.pack(">Q", n_bytes))
    return SIGNATURE + _chunk(b"IHDR", head) + size + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the filters of 8-bit greyscale lines; runs of lines with the same simple filter go at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    ends = np.append(np.flatnonzero(np.diff(kinds)) + 1, len(kinds))
    begin = 0
    for end in ends.tolist():
        kind, part = int(kinds[begin]), out[begin:end]
        before = out[begin - 1] if begin else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            part[0] += before
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (3, 4):
            for line in part:
                a = c = 0
                for i, b in enumerate(before.tolist()):
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    a, c = (int(line[i]) + guess) & 255, b
                    line[i] = a
                before = line
        elif kind:
            raise BadPicture(f"filter {kind}")
        begin = end
    return out


def decode_png(media: bytes) -> tuple[np.ndarray, int | None]:
    """Samples (rows x width) and the stored length of the text; BadPicture if a checksum or the layout is wrong."""
    if media[:8] != SIGNATURE:
        raise BadPicture("signature")
    at, body, size, shape = 8, [], None, None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        part = media[at + 8 : at + 8 + n]
        if len(part) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + part)):
            raise BadPicture(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if (depth, colour, interlace) != (8, 0, 0):
                raise BadPicture("only plain 8-bit greyscale")
            shape = (height, width + 1)
        elif kind == LENGTH_CHUNK:
            (size,) = struct.unpack(">Q", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if shape is None or not body:
        raise BadPicture("no picture")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != shape[0] * shape[1]:
        raise BadPicture("size")
    return _unfilter(raw.reshape(shape)), size


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def picture_hash(samples: np.ndarray) -> str:
    """16 hex digits."""
    h, w = samples.shape
    small = np.concatenate([np.zeros((1, w)), np.cumsum(samples, axis=0, dtype=np.float64)])
    for axis, n in ((0, h), (1, w)):
        if axis:
            small = np.concatenate([np.zeros((SIDE, 1)), np.cumsum(small, axis=1)], axis=1)
        low = np.arange(SIDE) * n // SIDE
        high = np.maximum(low + 1, np.arange(1, SIDE + 1) * n // SIDE)
        small = (np.take(small, high, axis) - np.take(small, low, axis)) / (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
    terms = np.round(_cosines() @ small @ _cosines().T, 6).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and its picture, as a binary column `media`."""

    def fn(batch):
        raw = [x or b"" for x in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "media": [encode_png(padded(x), len(x)) for x in raw]}

    return map_texts(texts(docs), fn, "doc_id long, media binary")


def _digest(samples: np.ndarray, size: int | None, media: bytes) -> dict:
    payload = samples.tobytes()
    return {
        "n_bytes": len(payload) if size is None else size, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": picture_hash(samples),
    }


def _whole(samples: np.ndarray, size: int | None, media: bytes) -> dict:
    return {
        "n_bytes": samples.size if size is None else size, "payload": samples.tobytes(),
        "feature": picture_hash(samples), "media": media
    }


def _read(pictures: DataFrame, tell, columns: dict[str, str]) -> DataFrame:
    def fn(batch):
        out: dict[str, list] = {k: [] for k in (*columns, "error")}
        for media in batch.column("text").to_pylist():
            try:
                row = tell(*decode_png(media or b""), media or b"") | {"error": None}
            except (BadPicture, struct.error, zlib.error) as e:
                row = {"media": media, "error": f"{type(e).__name__}: {e}"}
            for k, own in out.items():
                own.append(row.get(k))
        return {"doc_id": batch.column("doc_id")} | out

    schema = ", ".join(f"{k} {v}" for k, v in ({"doc_id": "long"} | columns | {"error": "string"}).items())
    return map_texts(pictures.select("doc_id", F.col("media").alias("text")), fn, schema)


def read_media(pictures: DataFrame) -> DataFrame:
    """The payload and the feature of each picture (doc_id, media). A null or broken picture gives nulls beside `error`."""
    return _read(pictures, _whole, {"n_bytes": "long", "payload": "binary", "feature": "string", "media": "binary"})


def media_digest(pictures: DataFrame) -> DataFrame:
    """Sizes, checksums and the feature of what is read back from each picture (doc_id, media); nulls where it is broken."""
    columns = {
        "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long",
        "media_bytes": "long", "media_sha256": "string", "feature": "string"
    }
    return _read(pictures, _digest, columns).drop("error")
