"""Groups of rows in Python, many small ones at a time.

A group's rows meet in one task, as with ``applyInPandas``, but what Python gets is a table of many whole groups, so that
the cost of a call is shared by them. Memory is ``ROWS`` rows, or the rows of the largest group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of whole groups that are handed over at a time.
ROWS = 20_000


def codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each row's place among the column's different values, and these values in order; nulls are a value, the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    found = column.dictionary_encode(null_encoding="encode")
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    order = pc.sort_indices(found.dictionary, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[found.indices.to_numpy()], found.dictionary.take(pa.array(order))


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of whole numbers without nulls."""
    return column.to_numpy().astype(np.int64, copy=False)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before in one of the columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def within(begins: np.ndarray, total: int) -> np.ndarray:
    """The group of every row, from where groups begin."""
    return np.repeat(np.arange(len(begins)), np.diff(np.append(begins, total)))


def _same(table: pa.Table, keys: tuple[str, ...], i: int, j: int) -> bool:
    return all(table.column(k)[i].as_py() == table.column(k)[j].as_py() for k in keys)


def _last_group(table: pa.Table, keys: tuple[str, ...]) -> int:
    """Where the last group begins."""
    low, high = 0, table.num_rows - 1
    # Rows of one key stand together, so those that equal the last row are a suffix.
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _same(table, keys, middle, table.num_rows - 1) else (middle + 1, high)
    return low


def by_group(rows: DataFrame, keys: tuple[str, ...], run: Callable[[pa.Table], pa.Table | None], schema: str, most: int = ROWS) -> DataFrame:
    """``run`` over tables of whole groups of ``rows``, in which each group's rows stand together."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            ends = pa.Table.from_batches([held[0].slice(0, 1), batch.slice(batch.num_rows - 1)])
            if _same(ends, keys, 0, 1):
                continue
            table = pa.Table.from_batches(held)
            cut = _last_group(table, keys)
            found = run(table.slice(0, cut))
            if found is not None:
                yield from found.to_batches()
            held = table.slice(cut).to_batches()
            n = table.num_rows - cut
        if n:
            found = run(pa.Table.from_batches(held))
            if found is not None:
                yield from found.to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)
