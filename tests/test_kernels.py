"""The Arrow kernels against plain loops, and the growth of dense operators with the frame."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwright.functions import exprs as X
from pixelwright.operators import cube, hdr, kernels, repair, stats, whitebalance
from pixelwright.operators import stencil as S
from pixelwright.plans.point_queries import CAMERA, GAMUT, KNOTS

BLACK, WHITE = 2048, 15000


def image(seed, h=20, w=22, low=1500, high=16000):
    return np.random.default_rng(seed).integers(low, high, (h, w))


def ev(v):
    return int(math.log2(max(1, int(v) - BLACK)) * 65536)


def cut(v):
    return int(v / 2)


@pytest.mark.parametrize("size", ["2x2", "3x3", "5x5"])
def test_chroma_smoothing_cell_by_cell(size):
    f = image(1)
    h, w = f.shape
    reach, corners = kernels.CHROMA[size]
    m = 2 * reach
    want = f.copy()
    for y in range(2 + m, h - 3 - m, 2):
        for x in range(2 + m, w - 2 - m, 2):
            e = lambda dy, dx: ev(f[y + dy, x + dx])
            sums, reds, blues = [0, 0], [[], []], [[], []]
            for j in range(-m, m + 1, 2):
                for i in range(-m, m + 1, 2):
                    if not corners and abs(i) + abs(j) == 4:
                        continue
                    ways = ((((0, 1), (0, -1)), ((1, 0), (1, 2))), (((1, 0), (-1, 0)), ((0, 1), (2, 1))))
                    for k, (r, b) in enumerate(ways):
                        (r1, r2), (b1, b2) = ([e(j + dy, i + dx) for dy, dx in p] for p in (r, b))
                        sums[k] += abs(r1 - r2) + abs(b1 - b2)
                        reds[k].append(e(j, i) - cut(r1 + r2))
                        blues[k].append(e(j + 1, i + 1) - cut(b1 + b2))
            middle = lambda v: sorted(v)[len(v) // 2]
            dr, db = [middle(v) for v in reds], [middle(v) for v in blues]
            gr = [cut(e(0, 1) + e(0, -1)), cut(e(1, 0) + e(-1, 0))]
            gb = [cut(e(1, 0) + e(1, 2)), cut(e(0, 1) + e(2, 1))]
            r0, b0 = f[y, x], f[y + 1, x + 1]
            if r0 < BLACK + 64 or b0 < BLACK + 64 or abs(dr[1] - dr[0]) < 64 or abs(gr[1] - gr[0]) < 64 or abs(gb[1] - gb[0]) < 64:
                er = int((e(0, 1) + e(1, 0) + e(0, -1) + e(-1, 0)) / 4) + cut(dr[0] + dr[1])
                eb = int((e(0, 1) + e(1, 0) + e(1, 2) + e(2, 1)) / 4) + cut(db[0] + db[1])
            else:
                k = int(sums[1] < sums[0])
                er, eb = gr[k] + dr[k], gb[k] + db[k]
            raw = lambda v: int(BLACK + 2 ** (max(-10 * 65536, min(14 * 65536 - 1, v)) / 65536))
            want[y, x] = raw(er) if r0 < WHITE else r0
            want[y + 1, x + 1] = raw(eb) if b0 < WHITE else b0
    got = kernels.smooth_chroma(f, BLACK, WHITE, size)
    assert np.abs(got - want).max() <= 1 and (got != f).any()  # the last bit of a power may differ


def test_joint_bilateral_by_loops():
    x = image(2, 5, 6)[:, :, None] + np.array([0, 300, -200])
    space, sigma, top = 0.0005, 0.1, 16383
    alpha = math.exp(-math.sqrt(2) / (space * top))

    def line(values, guide):
        n = len(values)
        rho = [alpha * math.exp(-(((abs(a[0] - b[0]) + abs(a[2] - b[2])) >> 2) + (abs(a[1] - b[1]) >> 1)) / (sigma * top)) for a, b in zip(guide, guide[1:])]
        sums, weights = [[0.0] * 3 for _ in range(n)], [0.0] * n
        for order, keep in ((range(n), lambda k: rho[k - 1]), (range(n - 1, -1, -1), lambda k: rho[k])):
            y = f = None
            for k in order:
                y, f = (list(values[k]), 1.0) if y is None else ([(1 - alpha) * v + keep(k) * p for v, p in zip(values[k], y)], (1 - alpha) + keep(k) * f)
                sums[k] = [a + b for a, b in zip(sums[k], y)]
                weights[k] += f
        return [[v / w for v in s] for s, w in zip(sums, weights)]

    ints = x.tolist()
    rows = [line(r, r) for r in ints]
    columns = [line([r[k] for r in rows], [r[k] for r in ints]) for k in range(6)]
    want = np.array(columns).transpose(1, 0, 2)
    assert np.allclose(kernels.bilateral(x, space, sigma, top), want)


def test_guided_clamp():
    """The edge run goes from place 1 to 3, where the excess is 100 and -1000: between, it may not leave that range."""
    g = np.array([0, 0, 5000, 9000, 9000, 9000])
    row = np.array([100, 100, 9000, 8000, 9200, 9200])
    assert kernels.guided_row(row, g, 1000).tolist() == [100, 100, 5100, 8000, 9200, 9200]
    assert kernels.guided_row(row, np.zeros(6, int), 1000).tolist() == row.tolist()


def test_alias_map_by_loops():
    full, half, bright = image(3, 20, 18), image(4, 20, 18), image(5, 20, 18, 2049, 2200)
    h, w = full.shape
    noise = 40
    used = [[(1 - math.cos(math.pi * min(max(math.log2(max(bright[y, x] - BLACK, 1)) - 4, 0), 4) / 4)) / 2 <= 0.8 for x in range(w)] for y in range(h)]
    a = [[min(max(abs(int(full[y, x] - half[y, x])) - noise * 3 // 2, 0) // 2, abs(ev(full[y, x]) - ev(half[y, x])) // 16, 65530) if used[y][x] else 0 for x in range(w)] for y in range(h)]
    ranked = [r[:] for r in a]
    for y in range(6, h - 6):
        for x in range(6, w - 6):
            if used[y][x]:
                ranked[y][x] = sorted((a[y + 2 * j][x + 2 * i] for j in range(-3, 4) for i in range(-3, 4) if abs(i) + abs(j) < 5), reverse=True)[4]
    out = [r[:] for r in a]
    for y in range(6, h - 6):
        for x in range(6, w - 6):
            if used[y][x]:
                at = lambda dy, dx: ranked[y + dy][x + dx]
                total = 0
                for p, q, k in kernels.BLUR:
                    ring = {(s * 2 * u, t * 2 * v) for u, v in ((p, q), (q, p)) for s in (1, -1) for t in (1, -1)}
                    total += sum(at(*o) for o in ring) * k // 1024
                out[y][x] = total
    for y in range(2, h - 3, 2):
        for x in range(2, w - 3, 2):
            most = min(max(out[y][x], out[y + 1][x], out[y][x + 1], out[y + 1][x + 1]), 15000)
            for dy in (0, 1):
                for dx in (0, 1):
                    out[y + dy][x + dx] = most
    got = kernels.build_alias_map(full, half, bright, BLACK, noise)
    assert len(kernels.DISC) == 37 and (got == np.array(out)).all() and got.any()


def test_resampling():
    for n, m in ((8, 5), (5, 8), (7, 7), (100, 9)):
        weights = kernels.lanczos(n, m)
        assert weights.shape == (m, n) and np.allclose(weights.sum(axis=1), 1)
    assert np.allclose(kernels.lanczos(7, 7), np.eye(7))
    t = np.linspace(0, 1, 64)
    assert np.abs(kernels.lanczos(64, 16) @ t - (np.arange(16) + 0.5) / 16 * 64 / 63 + 0.5 / 63)[2:-2].max() < 0.01


def test_white_balance_matrix_by_numpy():
    gains, made = X.white_balance(5200.0, -3.0, KNOTS, CAMERA, GAMUT)
    m = lambda v: np.array(v).reshape(3, 3)
    cones, camera, gamut = m(X.CONES), m(CAMERA), m(GAMUT)
    plain = np.array(X.gains_at(5200.0, KNOTS))
    adapt = np.diag(cones @ X.daylight_xyz(6500.0) / (cones @ X.daylight_xyz(5200.0)))
    want = gamut @ np.linalg.inv(cones) @ adapt @ cones @ np.linalg.inv(camera) @ np.diag(1 / plain)
    assert np.allclose(m(made), want) and min(gains) == 1
    x, _, z = X.daylight_xyz(6504.0)
    assert abs(x - 0.9504) < 0.002 and abs(z - 1.0888) < 0.004
    assert np.allclose(X.daylight_xyz(2856.0), [1.0985, 1, 0.3558], atol=0.003)  # illuminant A, a black body
    assert np.allclose(X.daylight_xyz(5003.0), [0.9642, 1, 0.8251], atol=0.003)  # illuminant D50


def test_pseudo_inverse_by_numpy():
    rows = np.random.default_rng(1).normal(size=(5, 3))
    assert np.allclose(np.array(X.pseudo_inverse(rows.tolist())).T, np.linalg.pinv(rows))


def test_picker_finds_what_was_set():
    gains = whitebalance.grid_gains(KNOTS)
    assert gains.shape == (771, 201, 3) and np.allclose(gains.min(axis=2), 1)
    got, _ = X.white_balance(5210.0, 3.3, KNOTS, CAMERA, GAMUT)
    assert np.allclose(gains[(5210 - 2300) // 10, 133], got)


def test_cube_methods(spark):
    n = 5
    line = [(i / 4, j / 4, k / 4) for k in range(n) for j in range(n) for i in range(n)]
    t = np.random.default_rng(2).random((200, 3)) * 4
    for look in cube.METHODS.values():
        assert np.allclose(look(t, np.array(line), n), t / 4)
    assert np.allclose(cube.tetrahedral(np.array([[4.0, 4.0, 4.0]]), np.array(line), n), 1)
    df = spark.createDataFrame([(1, 100, 40000, 65535, "z")], "id long, r long, g long, b long, k string")
    same = cube.apply(df, line, n, strength=0.0).first()
    assert tuple(same) == (1, 100, 40000, 65535, "z")
    with pytest.raises(ValueError):
        cube.apply(df, line[:-1], n)


def dense(spark, side, n=2):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(k, side, side, rng.integers(1500, 16000, side * side).tolist()) for k in range(n)], "frame long, h int, w int, data array<bigint>").repartition(1).cache()


LINEAR = {
    "deflicker": lambda d: stats.deflicker(d, 512.0), "column_noise": lambda d: stats.column_noise(d, 500, WHITE), "box_blur": lambda d: S.box_blur(d, 1), "median": lambda d: S.median_filter(d, 3),
    "corrected_demosaic": lambda d: S.corrected_demosaic(d, 16383), "around": lambda d: repair.repair(d, lambda y, x: x % 3 == 0, "around", BLACK), "merge": lambda d: hdr.merge(d, BLACK, WHITE, 14000, 3.0, 11.0, 40.0),
    "stripes": lambda d: stats.stripe_gains(d, BLACK, WHITE), "chroma": lambda d: kernels.chroma_smooth(d, BLACK, WHITE),
}


@pytest.mark.parametrize("name", sorted(LINEAR))
def test_work_is_linear_in_pixels(spark, name):
    """Sixteen times the pixels take far less than the 256 times of a quadratic operator."""

    def seconds(side):
        d = dense(spark, side)
        d.count()
        run = lambda: LINEAR[name](d).write.format("noop").mode("overwrite").save()
        run()
        best = []
        for _ in range(2):
            began = time.perf_counter()
            run()
            best.append(time.perf_counter() - began)
        return min(best)

    small, large = seconds(32), seconds(128)
    assert large < 60 * max(small, 0.05), (small, large)


def test_deflicker_on_larger_frames(spark):
    d = dense(spark, 40)
    for r in stats.deflicker(d, 512.0).collect():
        v = np.array([x for x in d.where(F.col("frame") == r["frame"]).first()["data"]])
        median = sorted((v >> 6).tolist())[len(v) // 2]
        assert r["median"] == median and r["data"] == [min(65535, int(x * (512.0 / median))) for x in v.tolist()]


def test_overlap():
    assert [hdr.overlap(c, 11.0) for c in (1.0, 3.0, 6.0, 12.0)] == [7.0, 5.0, 3.0, 3.0]
