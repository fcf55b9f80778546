"""Where records go: JSON, Markdown and text payloads, the index, the cache."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import page_file_name
from ..operators.incremental import CACHE, index_rows

#: The keys of a page's JSON file, in order: the plain text isn't among them.
JSON_FIELDS = [
    "title", "url", "crawled_at", "author", "published_date", "modified_date", "language", "og_type", "description",
    "keywords", "chunks"
]


def json_payload(fields: list[str] = JSON_FIELDS) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "pretty": "false"})


def _indented(depth: int, lines: list[Column] | Column, opening: str, closing: str) -> Column:
    """A JSON array or object over several lines; lines: its parts, or a column with an array of them."""
    parts = lines if isinstance(lines, Column) else F.array(*lines)
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    return F.when(F.size(parts) == 0, opening + closing).otherwise(
        F.concat(F.lit(opening + inner), F.array_join(parts, "," + inner), F.lit(outer + closing))
    )


def _json_string(x: Column) -> Column:
    """Quoted, or null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(x), {"ignoreNullFields": "false"}), r"(?s)\A\[(.*)\]\z", 1), F.lit("null"))


def pretty_json_payload(fields: list[str] = JSON_FIELDS) -> Column:
    """The same over lines, indented by two. keywords: array<string>; chunks: array of chunks; the rest: strings."""

    def chunk(c: Column) -> Column:
        own = [(k, _json_string(c[k]) if k in ("heading", "content") else c[k].cast("string")) for k in ("heading", "content", "chunk_index", "total_chunks")]
        return _indented(2, [F.concat(F.lit(f'"{k}": '), v) for k, v in own], "{", "}")

    def value(name: str) -> Column:
        if name in ("keywords", "chunks"):
            return _indented(1, F.transform(name, _json_string if name == "keywords" else chunk), "[", "]")
        return _json_string(F.col(name).cast("string"))

    return _indented(0, [F.concat(F.lit(f'"{k}": '), value(k)) for k in fields], "{", "}")


def markdown_payload(title: Column, url: Column, text: Column) -> Column:
    """The body of Markdown and text files alike."""
    return F.concat(F.lit("# "), title, F.lit("\nKälla: "), url, F.lit("\n\n"), text)


def payloads(saved: DataFrame, save_format: Column | str = ".md") -> DataFrame:
    """(file_name, payload) of records that are to be saved (see incremental.to_save), which have content_hash."""
    form = save_format if isinstance(save_format, Column) else F.lit(save_format)
    body = F.when(form == ".json", pretty_json_payload()).otherwise(markdown_payload(F.col("title"), F.col("url"), F.col("plain_text")))
    return saved.select(page_file_name(F.col("url"), F.col("content_hash"), form).alias("file_name"), body.alias("payload"))


def write_payloads(rows: DataFrame, folder: str) -> None:
    """As a table: at scale a file a page is no service to a file system. write_files makes single files."""
    rows.write.mode("overwrite").parquet(folder)


def write_files(rows: DataFrame, folder: str) -> None:
    """One file for each row, under its name, in a folder that all executors mount (a path of the operating system, not an
    object store: see write_payloads for those); a file appears whole or not at all."""

    def put(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, payload in zip(batch.column("file_name").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(payload or "")
                os.replace(part, f"{folder}/{name}")
        yield from ()

    rows.select("file_name", "payload").mapInArrow(put, "file_name string").write.format("noop").mode("overwrite").save()


def write_index(cache: DataFrame, path: str, save_format: str = ".md") -> None:
    """index.csv, newest first, as one sorted set of parts."""
    index_rows(cache, save_format).write.mode("overwrite").csv(path, header=True)


def write_cache(cache: DataFrame, folder: str) -> str:
    """A new version beside the old ones; its path. Readers of the old one aren't disturbed."""
    path = f"{folder}/version-{uuid.uuid4().hex}"
    cache.select(CACHE).write.parquet(path)
    return path
