"""Dense per-frame kernels without a relational form, one frame per row through Arrow.

Each takes and returns (frame, h, w, data). A kernel sees one frame at a time, so memory is
bounded by the frame and no shuffle is needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "frame long, h int, w int, data array<bigint>"


def run(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a 2-D integer kernel to every frame."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, hs, ws = [], [], []
            for h, w, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                frame = np.asarray(data.values.to_numpy(zero_copy_only=False), np.int64).reshape(h, w)
                made = kernel(frame)
                hs.append(made.shape[0])
                ws.append(made.shape[1])
                out.append(made.reshape(-1).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()), pa.array(out, pa.list_(pa.int64()))],
                names=["frame", "h", "w", "data"],
            )

    return df.select("frame", "h", "w", "data").mapInArrow(batches, SCHEMA)


def lower_median(values: np.ndarray) -> int:
    return int(np.sort(values)[(len(values) - 1) // 2])


def edge_aware_rows(frame: np.ndarray, threshold: int, reach: int) -> np.ndarray:
    """For each pixel the lower median of its row from both sides up to a jump of more than the threshold."""
    h, w = frame.shape
    out = frame.copy()
    for y in range(h):
        jumps = np.abs(np.diff(frame[y])) > threshold
        cuts = np.concatenate([[0], np.flatnonzero(jumps) + 1, [w]])
        run_of = np.searchsorted(cuts, np.arange(w), side="right") - 1
        for x in range(w):
            a, b = max(cuts[run_of[x]], x - reach), min(cuts[run_of[x] + 1], x + reach + 1)
            out[y, x] = lower_median(frame[y, a:b])
    return out


def edge_aware_blur(df: DataFrame, threshold: int, reach: int) -> DataFrame:
    return run(df, lambda f: edge_aware_rows(f, threshold, reach))


#: Cells of the chroma filters: how many steps of two pixels they reach, and whether the corners count.
CHROMA = {"2x2": (1, False), "3x3": (1, True), "5x5": (2, True)}
EV = 65536


def _evs(f: np.ndarray, black: int) -> np.ndarray:
    return np.trunc(np.log2(np.maximum(1, f - black).astype(np.float64)) * EV).astype(np.int64)


def smooth_chroma(f: np.ndarray, black: int, white: int, size: str = "3x3", near: int = 64) -> np.ndarray:
    """Red and blue of each RGGB cell follow the median difference to green over the neighbouring cells, in EV.

    Green is interpolated along rows or along columns, whichever has the smaller summed difference
    of its pairs over all cells; close to black, or where both agree to within ``near``, both
    are averaged. White samples stay, and so do cells too close to the border.
    """
    reach, corners = CHROMA[size]
    cells = [(i, j) for j in range(-2 * reach, 2 * reach + 1, 2) for i in range(-2 * reach, 2 * reach + 1, 2) if corners or abs(i) + abs(j) < 4]
    h, w = f.shape
    m = 2 * reach
    ys, xs = np.arange(2 + m, h - 3 - m, 2), np.arange(2 + m, w - 2 - m, 2)
    if not len(ys) or not len(xs):
        return f.copy()
    ev = _evs(f, black)
    at = lambda dy, dx, a=ev: a[np.ix_(ys + dy, xs + dx)]
    half = lambda v: np.trunc(v / 2).astype(np.int64)
    # (first, second) green neighbours of red, and of blue, along each direction
    pairs = {"row": (((0, 1), (0, -1)), ((1, 0), (1, 2))), "column": (((1, 0), (-1, 0)), ((0, 1), (2, 1)))}
    error, red, blue, at_red, at_blue = {}, {}, {}, {}, {}
    for name, (of_red, of_blue) in pairs.items():
        total, dr, db = 0, [], []
        for i, j in cells:
            (r1, r2), (b1, b2) = ([at(j + dy, i + dx) for dy, dx in of] for of in (of_red, of_blue))
            total = total + np.abs(r1 - r2) + np.abs(b1 - b2)
            dr.append(at(j, i) - half(r1 + r2))
            db.append(at(j + 1, i + 1) - half(b1 + b2))
        error[name] = total
        red[name], blue[name] = (np.sort(np.stack(d), axis=0)[len(cells) // 2] for d in (dr, db))
        at_red[name], at_blue[name] = (half(at(*of[0]) + at(*of[1])) for of in (of_red, of_blue))
    by_column = error["column"] < error["row"]
    pick = lambda d: np.where(by_column, d["column"], d["row"])
    r0, b0 = at(0, 0, f), at(1, 1, f)
    flat = (r0 < black + near) | (b0 < black + near)
    for d in (red, at_red, at_blue):
        flat |= np.abs(d["column"] - d["row"]) < near
    quarter = lambda cells_: np.trunc(sum(at(*c) for c in cells_) / 4).astype(np.int64)
    to_red = np.where(flat, quarter([(0, 1), (1, 0), (0, -1), (-1, 0)]) + half(red["row"] + red["column"]), pick(at_red) + pick(red))
    to_blue = np.where(flat, quarter([(0, 1), (1, 0), (1, 2), (2, 1)]) + half(blue["row"] + blue["column"]), pick(at_blue) + pick(blue))
    raw = lambda e: np.trunc(black + np.exp2(np.clip(e, -10 * EV, 14 * EV - 1) / EV)).astype(np.int64)
    out = f.copy()
    out[np.ix_(ys, xs)] = np.where(r0 < white, raw(to_red), r0)
    out[np.ix_(ys + 1, xs + 1)] = np.where(b0 < white, raw(to_blue), b0)
    return out


def chroma_smooth(df: DataFrame, black: int, white: int, size: str = "3x3") -> DataFrame:
    return run(df, lambda f: smooth_chroma(f, black, white, size))


def bilateral_sweeps(x: np.ndarray, distance: np.ndarray, alpha: float, sigma: float, top: float) -> np.ndarray:
    """One direction pair of the recursive bilateral filter along axis 1 of (rows, columns, channels); distance is between neighbours."""
    rho = (alpha * np.exp(-distance / (sigma * top)))[:, :, None]
    n = x.shape[1]

    def sweep(values: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, f = np.empty_like(values), np.ones_like(values[:, :, :1])
        y[:, 0] = values[:, 0]
        for k in range(1, n):
            y[:, k] = (1 - alpha) * values[:, k] + keep[:, k - 1] * y[:, k - 1]
            f[:, k] = (1 - alpha) + keep[:, k - 1] * f[:, k - 1]
        return y, f

    y1, f1 = sweep(x, rho)
    y2, f2 = sweep(x[:, ::-1], rho[:, ::-1])
    return (y1 + y2[:, ::-1]) / (f1 + f2[:, ::-1])


def joint_distance(x: np.ndarray) -> np.ndarray:
    """Colour distance of neighbours along axis 1: red and blue a quarter each, green half; of one channel its own."""
    d = np.abs(np.diff(x, axis=1)).astype(np.int64)
    return d[:, :, 0] if x.shape[2] == 1 else ((d[:, :, 0] + d[:, :, 2]) >> 2) + (d[:, :, 1] >> 1)


def bilateral(x: np.ndarray, sigma_space: float, sigma_range: float, top: float) -> np.ndarray:
    """Rows, then columns; the distances down the columns are those of the unfiltered image."""
    alpha = math.exp(-math.sqrt(2) / (sigma_space * top))
    turned = x.transpose(1, 0, 2)
    rows = bilateral_sweeps(x.astype(np.float64), joint_distance(x), alpha, sigma_range, top)
    return bilateral_sweeps(rows.transpose(1, 0, 2), joint_distance(turned), alpha, sigma_range, top).transpose(1, 0, 2)


def recursive_bilateral(df: DataFrame, sigma_space: float, sigma_range: float, top: int) -> DataFrame:
    """One channel."""
    return run(df, lambda f: np.floor(bilateral(f[:, :, None], sigma_space, sigma_range, top)[:, :, 0] + 0.5).astype(np.int64))


def run_rgb(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a kernel on (rows, columns, 3) to frames with arrays r, g and b; the size stays."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            planes: list[list] = [[], [], []]
            for h, w, *channels in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), *(batch.column(k) for k in (3, 4, 5))):
                made = kernel(np.stack([np.asarray(c.values.to_numpy(zero_copy_only=False), np.int64).reshape(h, w) for c in channels], axis=2))
                for k in range(3):
                    planes[k].append(made[:, :, k].reshape(-1).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), *(pa.array(p, pa.list_(pa.int64())) for p in planes)], names=["frame", "h", "w", "r", "g", "b"]
            )

    return df.select("frame", "h", "w", "r", "g", "b").mapInArrow(batches, "frame long, h int, w int, r array<bigint>, g array<bigint>, b array<bigint>")


def joint_bilateral(df: DataFrame, sigma_space: float, sigma_range: float, top: int) -> DataFrame:
    """Three channels with one joint distance, so that colours don't part at edges."""
    return run_rgb(df, lambda x: np.floor(bilateral(x, sigma_space, sigma_range, top) + 0.5).astype(np.int64))


def clamp_runs(row: np.ndarray, threshold: int) -> np.ndarray:
    """Between a rise and the fall after it (or the reverse), values may not leave the range of the run's ends."""
    out = row.copy()
    d = np.diff(row)
    k, n = 0, len(d)
    while k < n:
        if abs(d[k]) > threshold:
            end = k + 1
            while end < n and abs(d[end]) > threshold:
                end += 1
            lo, hi = sorted((row[k], row[end]))
            out[k + 1 : end] = np.clip(row[k + 1 : end], lo, hi)
            k = end
        else:
            k += 1
    return out


def edge_clamp(df: DataFrame, threshold: int) -> DataFrame:
    def kernel(f: np.ndarray) -> np.ndarray:
        rows = np.stack([clamp_runs(r, threshold) for r in f])
        return np.stack([clamp_runs(c, threshold) for c in rows.T]).T

    return run(df, kernel)


def guided_row(row: np.ndarray, guide: np.ndarray, threshold: int) -> np.ndarray:
    """A colour's excess over its guide may not leave the range it has at both ends of each edge run of the guide."""
    excess, out = row - guide, row.copy()
    d = np.abs(np.diff(guide)) > threshold
    k, n = 0, len(d)
    while k < n:
        if not d[k]:
            k += 1
            continue
        end = k + 1
        while end < n and d[end]:
            end += 1
        lo, hi = sorted((excess[k], excess[end]))
        out[k + 1 : end] = guide[k + 1 : end] + np.clip(excess[k + 1 : end], lo, hi)
        k = end
    return out


def guided_clamp(df: DataFrame, threshold: int) -> DataFrame:
    """Red and blue fringes at green's edges, along rows and then columns."""

    def kernel(x: np.ndarray) -> np.ndarray:
        out, g = x.copy(), x[:, :, 1]
        for c in (0, 2):
            rows = np.stack([guided_row(r, e, threshold) for r, e in zip(x[:, :, c], g)])
            out[:, :, c] = np.stack([guided_row(r, e, threshold) for r, e in zip(rows.T, g.T)]).T
        return out

    return run_rgb(df, kernel)


#: The 37 places of a disc of same-colour samples. Terms of the blur, as offset (two pixels a step) and weight in 1/1024.
DISC = [(2 * j, 2 * i) for j in range(-3, 4) for i in range(-3, 4) if abs(j) + abs(i) < 5]
BLUR = ((0, 0, 1024), (0, 1, 820), (1, 1, 657), (0, 1, 421), (1, 1, 2 * 337), (1, 1, 173), (0, 3, 139), (1, 3, 111), (1, 3, 57))


def build_alias_map(full: np.ndarray, half: np.ndarray, bright: np.ndarray, black: int, noise: int, most: int = 15000) -> np.ndarray:
    """Where both images differ beyond the noise: difference in light and EV, its 5th largest of 37, blurred, the largest of each 2x2.

    Places bright enough for full resolution anyway (its curve above 0.8) take no part.
    """
    h, w = full.shape
    ev = np.log2(np.maximum(bright - black, 1).astype(np.float64))
    used = (1 - np.cos(np.pi * np.clip(ev - 4, 0, 4) / 4)) / 2 <= 0.8
    linear = np.maximum(np.abs(full - half) - noise * 3 // 2, 0) // 2
    out = np.where(used, np.minimum(np.minimum(linear, np.abs(_evs(full, black) - _evs(half, black)) // 16), 65530), 0)
    inner = np.zeros_like(used)
    inner[6 : h - 6, 6 : w - 6] = True
    inner &= used
    if h > 12 and w > 12:
        part = lambda a, dy, dx: a[6 + dy : h - 6 + dy, 6 + dx : w - 6 + dx]
        ranked = out.copy()
        ranked[6:-6, 6:-6] = np.sort(np.stack([part(out, *o) for o in DISC]), axis=0)[-5]
        ranked = np.where(inner, ranked, out)
        blurred = np.zeros((h - 12, w - 12), np.int64)
        for a, b, k in BLUR:
            places = {(2 * s * y, 2 * t * x) for y, x in ((a, b), (b, a)) for s in (-1, 1) for t in (-1, 1)}
            blurred += sum(part(ranked, *o) for o in places) * k // 1024
        out[6:-6, 6:-6] = np.where(inner[6:-6, 6:-6], blurred, out[6:-6, 6:-6])
    ys, xs = (np.arange(2, n - 3, 2) for n in (h, w))
    if len(ys) and len(xs):
        quads = np.stack([out[np.ix_(ys + dy, xs + dx)] for dy in (0, 1) for dx in (0, 1)]).max(axis=0)
        for dy in (0, 1):
            for dx in (0, 1):
                out[np.ix_(ys + dy, xs + dx)] = np.minimum(quads, most)
    return out


def alias_map(df: DataFrame, black: int, noise: int) -> DataFrame:
    """df: full, half and bright frames as arrays r, g and b (in this order); the map comes as ``data``."""
    made = run_rgb(df, lambda x: np.repeat(build_alias_map(x[:, :, 0], x[:, :, 1], x[:, :, 2], black, noise)[:, :, None], 3, axis=2))
    return made.selectExpr("frame", "h", "w", "r as data")


def lanczos(n: int, m: int, lobes: int = 3) -> np.ndarray:
    """Weights (m x n) of a windowed-sinc resampling, widened when it makes smaller; rows add up to 1, edges are replicated."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    reach = int(np.ceil(lobes * scale))
    out = np.zeros((m, n))
    for k, c in enumerate(centre):
        at = np.arange(int(np.floor(c)) - reach, int(np.floor(c)) + reach + 2)
        t = (at - c) / scale
        weight = np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)
        np.add.at(out[k], np.clip(at, 0, n - 1), weight)
    return out / out.sum(axis=1, keepdims=True)


def resize_fine(df: DataFrame, height: int, width: int, top: int = 65535) -> DataFrame:
    """High-quality resampling by a windowed sinc along both axes."""
    return run(df, lambda f: np.clip(np.floor(np.round(lanczos(f.shape[0], height) @ f @ lanczos(f.shape[1], width).T, 6) + 0.5), 0, top).astype(np.int64))

