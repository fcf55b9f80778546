"""Arrow plumbing shared by the operators: whole texts in, one row per document out, a few MB at a time."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator handles at once in Python.
SLICE_BYTES = 2 << 20


#: Tables that are made anew when they are needed.
REMAKEABLE: list[list] = []


def let_go() -> None:
    """Gives memory back to the system: idle Python workers otherwise keep what their last task needed."""
    for table in REMAKEABLE:
        table.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch between Spark and its Python workers: both sides hold some at a time.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches at most BATCH_BYTES large; smaller ones stay as they are set."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([bkmgt]?)b?\s*", str(spark.conf.get(BATCH_SETTING, "64m")).lower()).groups()
    size = int(number) << 10 * ("bkmgt".index(unit) if unit else 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes, and the named columns: whatever else docs holds is never read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `limit` bytes; a longer row is a range of its own."""
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def byte_sizes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(column), 0)
    return (n.combine_chunks() if isinstance(n, pa.ChunkedArray) else n).to_numpy(zero_copy_only=False).astype(np.int64)


def sliced(batches, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(byte_sizes(batch.column("text")), limit):
            yield batch.slice(a, b - a)


def map_texts(rows: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, prepare: Callable | None = None) -> DataFrame:
    """fn over slices of the rows' batches, giving columns by name. prepare() runs once in each task; fn gets what it returns."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        own, kind = (prepare(),) if prepare else (), to_arrow_schema(target)
        for piece in sliced(batches):
            made = fn(piece, *own)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in kind], schema=kind
            )
            del made
        del own
        let_go()

    return rows.mapInArrow(run, schema)


def values(batch: pa.RecordBatch) -> list[bytes]:
    """The texts; null is empty."""
    return [x or b"" for x in batch.column("text").to_pylist()]
