"""Helpers shared by the operators of this package."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.session import materialize

#: Texts are handed to numpy code in slices of about this many bytes.
SLICE_BYTES = 4 << 20

#: What this worker keeps from one task to the next, and what of it the task
#: that runs has asked for.
_KEPT: dict[tuple, object] = {}
_ASKED: set[tuple] = set()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it read back."""
    return materialize(df, f"llm-{name}")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, kept for the worker's later tasks until one of
    ``with_text_columns`` comes that does not ask for it."""
    _ASKED.add(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def started(factory: Callable[[], Callable]) -> Callable:
    """``factory()`` for a task that begins.  Spark runs the tasks of one step
    after another in the same worker: what earlier steps kept goes."""
    _ASKED.clear()
    compute = factory()
    for key in _KEPT.keys() - _ASKED:
        del _KEPT[key]
    return compute


def give_back() -> None:
    """Free memory goes back to the system: a worker that waits for its next
    task, or whose step is done, counts with what it still holds."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the latter: all of malloc's
        pool.release_unused()


def text_slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of bounded text; a null text is empty.
    Texts become Python objects a slice at a time, however large the batch."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = min(int(np.searchsorted(ends, before + SLICE_BYTES)) + 1, len(ends))
            yield batch.slice(start, stop - start), [value or b"" for value in column.slice(start, stop - start).to_pylist()]
            start = stop


def with_text_columns(df: DataFrame, text: str, fields: list[T.StructField],
                      factory: Callable[[], Callable[[list[bytes]], list[pa.Array]]]) -> DataFrame:
    """Every row of ``df`` plus ``fields``, which ``factory()`` (called once in
    each task) computes from slices of the whole texts, as UTF-8 bytes."""
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = started(factory)
        for batch, raw in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(raw)],
                                             names=[*batch.schema.names, *names])
        compute = batch = raw = None
        give_back()

    return df.mapInArrow(run, schema)


def documents_only(docs: DataFrame) -> DataFrame:
    """doc_id and text; other columns, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
