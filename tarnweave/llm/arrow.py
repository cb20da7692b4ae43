"""Batch helpers for the operators that need Python: Arrow in, Arrow out, never a row at a time across the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnweave.session import ship

KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "ids": pa.list_(pa.int32()), "longs": pa.list_(pa.int64()), "doubles": pa.list_(pa.float64()), "strings": pa.list_(pa.string()), "binary": pa.binary()}
DDL = {"ids": "array<int>", "longs": "array<long>", "doubles": "array<double>", "strings": "array<string>"}


#: Bytes of input that are turned into Python objects at once: long texts come in fewer rows.
SLICE_BYTES = 4_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, SLICE_BYTES)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterator[list]], schema: dict[str, str], arrow: tuple[str, ...] = ()) -> DataFrame:
    """`fn` gets an iterator over batches, each a list of Python columns (Arrow's for those named in `arrow`), and yields batches of columns (Python's, numpy's or Arrow's) in `schema`'s order."""
    ship(df.sparkSession)
    names, kinds = list(schema), list(schema.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn([c if n in arrow else c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)] for batch in batches for b in _slices(batch)):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=KINDS[k]) for c, k in zip(out, kinds, strict=True)], names=names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {DDL.get(k, k)}" for n, k in schema.items()))


def ragged(values: np.ndarray, sizes: np.ndarray, kind: type = np.float64) -> pa.Array:
    """A column of lists (`doubles`, unless `kind` is another): so many of the values, in their order, a row."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.ascontiguousarray(values, kind).ravel())


def flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, one after another, and their number a row."""
    return column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


class Memo(dict):
    """A bounded cache: `memo[x]` computes once; emptied when it holds `size` entries."""

    def __init__(self, fn: Callable, size: int = 300_000):
        super().__init__()
        self.fn, self.size = fn, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.fn(key)
        return value
