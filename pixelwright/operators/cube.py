"""Three-dimensional lookup tables, applied to colour rows batch by batch.

A table of n entries a side is flat, red fastest (as in its file): entry (r, g, b) is at
(b * n + g) * n + r. It is shared with the workers once; 256 a side is the largest, 400 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def positions(c: np.ndarray, n: int, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Components 0 to 65535 as places in cells of the table."""
    return c * (n - 1) / 65536.0 / (high - low) - low


def _cells(t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = np.clip(np.trunc(t).astype(np.int64), 0, n - 1)
    return base, np.minimum(base + 1, n - 1), t - base


def _entry(table: np.ndarray, n: int, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return table[(b * n + g) * n + r]


def tetrahedral(t: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """From the cell's first corner along the axes in falling order of their fractions; each step adds its fraction of a difference."""
    base, after, part = _cells(t, n)
    order = np.argsort(-part, axis=1, kind="stable")
    at = base.copy()
    rows = np.arange(len(t))
    value = before = _entry(table, n, *at.T)
    for step in range(3):
        axis = order[:, step]
        at[rows, axis] = after[rows, axis]
        here = _entry(table, n, *at.T)
        value = value + part[rows, axis][:, None] * (here - before)
        before = here
    return value


def trilinear(t: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """The mean of the cell's eight corners, weighted by the fractions."""
    base, after, part = _cells(t, n)
    out = 0.0
    for corner in range(8):
        at = [np.where(corner >> k & 1, after[:, k], base[:, k]) for k in range(3)]
        weight = np.prod([part[:, k] if corner >> k & 1 else 1 - part[:, k] for k in range(3)], axis=0)
        out = out + weight[:, None] * _entry(table, n, *at)
    return out


METHODS = {"tetrahedral": tetrahedral, "trilinear": trilinear}


def apply(df: DataFrame, entries: list[tuple[float, float, float]], n: int, strength: float = 1.0, method: str = "tetrahedral", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """df with columns r, g, b (0 to 65535) looked up and mixed with what they were; other columns stay."""
    if len(entries) != n**3:
        raise ValueError(f"{len(entries)} entries in a table of {n} a side")
    shared = df.sparkSession.sparkContext.broadcast(np.array(entries, np.float64))
    names = df.columns
    places = [names.index(c) for c in "rgb"]
    look = METHODS[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in places], axis=1).astype(np.float64)
            found = np.clip(np.trunc(np.round(look(positions(c, n, low, high), shared.value, n) * 65535.0, 6)), 0, 65535)
            mixed = np.trunc(np.round(c * (1 - strength) + found * strength, 6)).astype(np.int64)
            columns = list(batch.columns)
            for k, place in enumerate(places):
                columns[place] = pa.array(mixed[:, k], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{f.name}` {'bigint' if f.name in 'rgb' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, fields)
