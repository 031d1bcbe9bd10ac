"""Helpers the operators share: Arrow batch mapping, flat byte buffers, word caches."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parley.sources.tables import read_table

#: Words of the contracts: runs of anything but space and \t \n \v \f \r.
WORD_BREAKS = b" \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts of one task are worked through in slices of about this many bytes, so
#: that working memory does not follow the number of rows in an Arrow batch.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch: both sides of a Python task hold a few batches outside the heap.
BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Bound the rows of Arrow batches in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, name)


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: nothing else is read, and other columns of any name do no harm."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def tidy(run):
    """``run`` for ``mapInArrow``, giving freed memory back to the system at the
    task's end: Python workers live on and would hold it beside the next stage's."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:
                pass  # another C library
    return wrapped


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` where ``make()`` is called once a task and gives a function
    from a slice of rows (of about ``limit`` text bytes) to a dict of columns (in any array form)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, limit=limit):
                work = work or make()
                out = work(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out
    return df.mapInArrow(tidy(run), schema)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` text bytes; a longer text is a run of its own."""
    n = batch.num_rows
    if n == 0:
        return
    i = batch.schema.get_field_index(column)
    if i < 0:
        yield batch
        return
    ends = np.cumsum(lengths(batch.column(i)))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``limit`` text bytes, whatever the batches' sizes."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, limit):
            n = int(lengths(part.column(part.schema.get_field_index(column))).sum())
            if held and size + n > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held)


def lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts as ``str``, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def flat(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column as one flat UTF-8 buffer; a null is empty."""
    import pyarrow.compute as pc
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets; empty segments are 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start+1, … for each (start, count), in order."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def rows_kept(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """The rows of ``df``, with all its columns, for which the task's function
    gives True; rows are judged in their Arrow batch, so nothing is shuffled."""
    def run(batches):
        work = None
        for batch in batches:
            for part in slices(batch):
                work = work or make()
                yield part.filter(pa.array(work(part)))
    return df.mapInArrow(tidy(run), df.schema)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, compressed."""
    sizes = np.array([a.nbytes for a in arrays], "<i8")
    raw = sizes.tobytes() + b"".join(a.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of ``pack``, by their types."""
    raw = pa.decompress(memoryview(blob)[8:], int(np.frombuffer(blob, "<i8", 1)[0]), codec="zstd", asbytes=True)
    sizes = np.frombuffer(raw, "<i8", len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out
