"""White balance picker: the temperature and tint that make a picked colour grey."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Temperatures, and tints in tenths.
TEMPERATURES, TINTS = np.arange(2300, 10001, 10), np.arange(-100, 101)


def grid_gains(knots: Sequence[tuple[float, float, float, float]]) -> np.ndarray:
    """Gains (temperatures x tints x 3) as the white balance applies them, the least being 1."""
    table = np.array(knots)
    k = np.clip(TEMPERATURES.astype(np.float64), table[0, 0], table[-1, 0])
    low = np.minimum(np.searchsorted(table[:, 0], k, side="right") - 1, len(table) - 2)
    w = ((table[low + 1, 0] - k) / (table[low + 1, 0] - table[low, 0]))[:, None]
    plain = table[low, 1:] * w + table[low + 1, 1:] * (1 - w)
    t = TINTS / 10.0
    shaped = np.sign(t) * np.abs(t / 10.0) ** 1.75 * 10.0
    out = np.repeat(plain[:, None, :], len(TINTS), axis=1)
    out[:, :, 0] += shaped / 19.0
    out[:, :, 2] += shaped / 11.0
    return out / out.min(axis=2, keepdims=True)


def pick(colours: DataFrame, knots: Sequence[tuple[float, float, float, float]], gamma: float) -> DataFrame:
    """frame, r, g, b (mean colour, whole numbers) to frame, kelvin, tint (tenths), delta: the first of the least channel spreads after gains and gamma.

    One row a frame comes in, and one goes out: the grid of 771 x 201 stays inside the kernel.
    """
    gains = grid_gains(knots)
    curve = np.trunc(np.round((np.arange(65536) / 65535.0) ** (1 / gamma) * 65535.0, 6)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for colour in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                lit = curve[np.minimum(np.trunc(np.round(gains * np.array(colour, np.float64), 6)), 65535).astype(np.int64)]
                delta = np.abs(lit[:, :, 0] - lit[:, :, 1]) + np.abs(lit[:, :, 1] - lit[:, :, 2]) + np.abs(lit[:, :, 0] - lit[:, :, 2])
                t, i = divmod(int(delta.argmin()), len(TINTS))
                for column, v in zip(out, (int(TEMPERATURES[t]), int(TINTS[i]), int(delta[t, i]))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in out)], names=["frame", "kelvin", "tint", "delta"])

    return colours.select("frame", "r", "g", "b").mapInArrow(run, "frame long, kelvin long, tint long, delta long")
