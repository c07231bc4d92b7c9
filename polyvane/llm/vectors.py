"""Vectors of whole numbers: embeddings scaled and floored, packed as doubles so that tasks read them as matrices without conversion.

Components are floor(scale * x) with x as double, exact for every finite x; beyond 2 ** 53 they count as 2 ** 53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest component that the vectorised paths take; larger ones go through Python integers.
WIDE, TOP = 1 << 26, float(1 << 53)
#: Doubles of one block of rows.
ENTRIES = 1 << 20


def pack(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Doubles, one after the other, as one binary value a row."""
    offsets = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def clean(vectors: DataFrame, vector: str, dims: int | None = None, scale: int = 256) -> DataFrame:
    """The rows whose vector is not null, has ``dims`` components (any number for None) and none null or non-finite, with the vector packed as ``x``.
    The other columns stay as they are."""
    others = [c for c in vectors.columns if c != vector]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != vector)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            offs = column.offsets.to_numpy()
            value = column.values.to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
            keep = np.asarray(column.is_valid()) & (bad[offs[1:]] == bad[offs[:-1]])
            sizes = np.diff(offs)
            if dims is not None:
                keep &= sizes == dims
            inside = np.repeat(keep, sizes)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(value[offs[0]:offs[-1]][inside] * scale), -TOP, TOP)
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(rows) for k in range(len(others))] + [pack(whole, sizes[keep])], [*others, "x"])

    source = vectors.select(*others, F.col(vector).cast("array<double>").alias("x"))
    return source.mapInArrow(run, f"{kinds}{', ' if kinds else ''}x binary")


def _bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All packed doubles of a column, and the n + 1 offsets of its rows in them."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]].view(np.float64) if len(column) and data is not None and offs[-1] > offs[0] else np.zeros(0)
    return flat, (offs - offs[0]) // 8 if len(column) else np.zeros(1, np.int64)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Packed vectors as rows of a matrix; shorter ones are filled up with zeros."""
    flat, offs = _bounds(column)
    sizes = np.diff(offs)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offs[:-1], sizes)] = flat
    return out


def chunks(batch: pa.RecordBatch, column: str, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose matrix has at most ENTRIES doubles, or of one row."""
    size, a = np.diff(_bounds(batch.column(batch.schema.get_field_index(column)))[1]), 0
    while a < batch.num_rows:
        part = size[a:a + rows]
        filled = np.maximum.accumulate(part) * np.arange(1, len(part) + 1)
        b = a + max(1, int(np.searchsorted(filled, ENTRIES, side="right")))
        yield batch.slice(a, b - a)
        a = b
