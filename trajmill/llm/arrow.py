"""Running Python over Arrow batches: columns in, rows out in batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 4096
OUT_BYTES = 8 << 20
IN_ROWS = 512
#: Bytes of rows that a worker is sent at once.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send workers about ``BATCH_BYTES`` at once; Spark's own limits are 10,000 rows and 64 MB.

    What is sent lies outside the executor's heap, and in the worker again.  A query is planned when its rows are
    asked for, so the setting stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return what a task has freed to the system; its worker lives on beside the next stages, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim:
        trim(0)


class Out:
    """Collects rows and hands them on as Arrow batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of so few rows that their Python objects are small."""
    for batch in batches:
        for at in range(0, batch.num_rows, IN_ROWS):
            yield batch.slice(at, IN_ROWS)


def values(column: pa.Array) -> Iterator[object]:
    """The values one by one; only so many of them are Python objects at once as ``parts`` has rows."""
    for at in range(0, len(column), IN_ROWS):
        yield from column.slice(at, IN_ROWS).to_pylist()


def text_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[object, str]]]:
    """Rows ``(id, text)`` in lists of about ``size`` characters; a null text is empty."""
    rows, held = [], 0
    for part in parts(batches):
        for key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            rows.append((key, text or ""))
            held += len(rows[-1][1])
            if held > size:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _size(value: object) -> int:
    """About how many bytes a value takes."""
    return len(value) if isinstance(value, (bytes, str)) else 64 * len(value) if isinstance(value, list) else 8


def map_rows(df: DataFrame, start: Callable[[], Callable[[tuple], Iterator[tuple]]], schema: StructType, finish: str | None = None) -> DataFrame:
    """Apply a Python function to every row of ``df``, a partition at a time.

    ``start`` runs once in a task and returns the function from a row to its output rows.  With
    ``finish``, the function has a method of that name that yields what is left at the end.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, out = start(), Out(arrow)
        for part in parts(batches):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for made in each(row):
                    out.add(made, sum(map(_size, made)))
                    if out.full():
                        yield out.batch()
        for made in getattr(each, finish)() if finish else ():
            out.add(made)
            if out.full():
                yield out.batch()
        yield out.batch()
        del each, out
        give_back()

    return df.mapInArrow(run, schema)
