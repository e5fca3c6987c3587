"""Properties of the operators and NumPy re-derivations of the kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwright import tables as T
from pixelwright.functions import exprs as X
from pixelwright.operators import grade, joins, kernels, stats
from pixelwright.operators import stencil as S


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(3)
    rows = [(k, 6, 7, [int(v) for v in rng.integers(0, 16384, 42)]) for k in range(4)]
    rows.append((9, 6, 7, [5000] * 42))
    return spark.createDataFrame(rows, "frame long, h int, w int, data array<bigint>")


def frames(df):
    return {r["frame"]: np.array(r["data"]).reshape(r["h"], r["w"]) for r in df.collect()}


def test_shape_changes(dense):
    want = frames(dense)
    for k, f in frames(S.transpose(dense)).items():
        assert (f == want[k].T).all()
    assert all((f == want[k]).all() for k, f in frames(S.transpose(S.transpose(dense))).items())
    assert all((f == want[k][::-1, ::-1]).all() for k, f in frames(S.rotate_180(dense)).items())
    long = T.to_dense(T.to_long(dense).orderBy(F.rand(1)))
    assert all((f == want[k]).all() for k, f in frames(long).items())


def test_constants_stay(dense):
    flat = dense.where("frame = 9")
    for made in (S.box_blur(flat, 2), S.median_filter(flat, 3), S.sharpen(flat, 0.5), kernels.recursive_bilateral(flat, 0.0005, 0.1, 16383), kernels.edge_aware_blur(flat, 10, 25)):
        assert np.abs(frames(made)[9] - 5000).max() <= 2


def test_blur_by_numpy(dense):
    for k, f in frames(S.box_blur(dense, 1)).items():
        g = frames(dense)[k]
        p = np.pad(g, ((0, 0), (1, 1)), mode="edge")
        rows = (p[:, :-2] + p[:, 1:-1] + p[:, 2:]) // 3
        p = np.pad(rows, ((1, 1), (0, 0)), mode="edge")
        assert (f == (p[:-2] + p[1:-1] + p[2:]) // 3).all()


def test_kernels_by_numpy(dense):
    src = frames(dense)
    for k, f in frames(kernels.edge_aware_blur(dense, 3000, 2)).items():
        for y in range(6):
            for x in range(7):
                a = x
                while a > 0 and x - a < 2 and abs(int(src[k][y, a]) - int(src[k][y, a - 1])) <= 3000:
                    a -= 1
                b = x
                while b < 6 and b - x < 2 and abs(int(src[k][y, b + 1]) - int(src[k][y, b])) <= 3000:
                    b += 1
                run = np.sort(src[k][y, a : b + 1])
                assert f[y, x] == run[(len(run) - 1) // 2]
    same = frames(kernels.resize_fine(dense, 6, 7))
    assert all((f == src[k]).all() for k, f in same.items())
    half = frames(kernels.resize_fine(dense.where("frame = 9"), 3, 3))[9]
    assert half.shape == (3, 3) and (half == 5000).all()
    for k, f in frames(kernels.edge_clamp(dense, 20000)).items():
        assert (f == src[k]).all()


def test_bilateral_is_symmetric(dense):
    a = frames(kernels.recursive_bilateral(dense, 0.0005, 0.1, 16383))
    b = frames(kernels.recursive_bilateral(S.rotate_180(dense), 0.0005, 0.1, 16383))
    assert all(np.abs(a[k] - b[k][::-1, ::-1]).max() <= 1 for k in a)


def test_matrix():
    m = [2.0, 0.5, 0.1, 0.3, 1.5, 0.2, 0.1, 0.4, 1.1]
    assert np.allclose(np.array(X.compose(m, X.invert(m))).reshape(3, 3), np.eye(3))


def test_neutral_settings_add_nothing(spark):
    assert grade.steps(grade.Settings()) == []
    names = [n for n, _ in grade.steps(grade.Settings(gamma=2.2, saturation=1.2, exposure=-1.0))]
    assert names == ["gains", "gamma", "saturation"]


def test_log_round_trip(spark):
    d = spark.range(2600, 16000, 97).select(F.col("id").alias("v"))
    e = X.log_encode(F.col("v"), 2048, 16383)
    worst = d.select(F.max(F.abs(X.log_decode(e, 2048, 16383) - F.col("v")) / F.col("v"))).first()[0]
    assert worst < 0.002


def test_medians_differ(spark):
    h = spark.createDataFrame([(1, b, 1) for b in (10, 20, 30, 40)], "k int, bin int, n int")
    assert stats.upper_median(h, "k").first()["median"] == 30
    assert h.groupBy("k").agg(stats.lower_median("bin").alias("m")).first()["m"] == 20
    assert stats.weighted_median(h, "k").first()["median"] == 20


def test_as_of(spark):
    a = spark.createDataFrame([(1, 1, 5), (2, 1, 1), (3, 2, 9)], "id long, k long, t long")
    b = spark.createDataFrame([(7, 1, 2, "x"), (8, 1, 5, "y"), (9, 1, 6, "z")], "id long, k long, t long, v string")
    got = {r["id"]: r["out"] for r in joins.as_of(a, b, "k", "t", "id", "v", "out").collect()}
    assert got == {1: "y", 2: None, 3: None}


def test_grain_is_repeatable(spark):
    from pixelwright.plans import registry
    from tests.conftest import SF

    q = registry.queries()["p25_grain"]
    a, b = q(spark, SF).repartition(3).collect(), q(spark, SF).collect()
    assert sorted(a) == sorted(b)
    worst = max(abs(r["val"] - v) for r, v in zip(sorted(a), [x["val"] for x in T.px(spark, SF).orderBy("frame", "y", "x").collect()]))
    assert 0 < worst <= 100
