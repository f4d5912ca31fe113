"""Helpers shared by the corpus operators: reading, lineage cuts, Arrow text access, files."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: What a worker keeps from task to task, under the name of what fills it: functions that drop it.
KEPT: dict[str, Callable[[], None]] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: add a query builder (and its DuckDB SQL, where SQL can say it)."""

    def wrap(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder URI for an operator's files inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """(pyarrow filesystem, path) of a URI; a plain path is a local file system."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks: list) -> None:
    """Write a file under a temporary name, then rename it: retried or speculative tasks
    never leave a torn file, and equal attempts replace each other."""
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp, compression=None) as out:
        for c in chunks:
            out.write(c)
    store.move(tmp, path)


def utf8_views(column: pa.Array | pa.ChunkedArray) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    null = np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), dtype=bool)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + n + 1]
    return memoryview(data) if data is not None else memoryview(b""), offsets, null


def small_batches(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch of about ``limit`` text bytes each (a longer text stands alone)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + int(n) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back(keep: str | None = None) -> None:
    """Return freed memory of this worker to the system: allocators keep it for a next use that may never come,
    and Spark's workers live from one stage to the next. What earlier stages keep for more tasks of theirs
    is dropped first, all but ``keep``: every idle worker has a copy, as tasks go to them in turn."""
    for name, drop in KEPT.items():
        if name != keep:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows: the JVM holds one at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: Rows that Spark sends to Python at once; its own default of 10,000 long texts would be 100s of MB.
ARROW_ROWS = 1000


def small_arrow_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batch size to ``ARROW_ROWS`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= ARROW_ROWS:
        df.sparkSession.conf.set(key, str(ARROW_ROWS))
    return df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator works on, under fixed names: other columns can't clash."""
    return small_arrow_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"), *more)


#: Bits of the filter on ids: 8 MB at most, whatever the input.
FILTER_BITS = 1 << 26


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): the mark tells texts with one id apart."""
    return small_arrow_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))


def _maybe(docs: DataFrame, wanted: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FILTER_BITS))
    asked = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS))
    bits = wanted.select(asked.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    bit = F.expr("coalesce(shiftright(cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) & 1, 0)")
    marked = docs.withColumn("__p", spot).withColumn("__bucket", F.bitmap_bucket_number("__p")).withColumn("__at", F.bitmap_bit_position("__p"))
    return marked.join(F.broadcast(bits), "__bucket", "left"), bit


def near_ids(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents whose id may be among ``wanted.doc_id``: a bit set of fixed size keeps most other
    texts from being shuffled. What it lets through wrongly, the join that follows drops."""
    marked, bit = _maybe(docs, wanted, id_col)
    return marked.filter(bit == 1).select(*docs.columns)


def split_ids(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents whose id may be wanted, all others); together they are ``docs``."""
    marked, bit = _maybe(docs, wanted, id_col)
    return marked.filter(bit == 1).select(*docs.columns), marked.filter(bit == 0).select(*docs.columns)
