"""Sorted rows that pass a task in batches, by whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts(batch: pa.RecordBatch, *by: str) -> np.ndarray:
    """Whether a row has another value than the row before it in any of these columns; the first row has."""
    out = np.arange(batch.num_rows) == 0
    for c in by:
        out |= np.diff(batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1) != 0
    return out


def whole(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by these columns, again in batches, but none begins or ends within a group. Memory is that of a batch and a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.flatnonzero(starts(batch, *by))
        if held and all(held[-1].column(c)[-1] == batch.column(c)[0] or not (held[-1].column(c)[-1].is_valid or batch.column(c)[0].is_valid) for c in by):
            cut = cut[1:]
        if len(cut):  # what is before the last group of a batch is whole
            held.append(batch.slice(0, cut[-1]))
            yield from _one(held)
            held = []
        held.append(batch.slice(cut[-1] if len(cut) else 0))
    if held:
        yield from _one(held)


def _one(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()
