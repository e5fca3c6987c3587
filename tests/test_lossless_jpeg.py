import numpy as np
import pytest

from pixelwright.sources import lossless_jpeg as J


def images(bits):
    rng = np.random.default_rng(bits)
    top = (1 << bits) - 1
    y, x = np.mgrid[0:13, 0:17]
    yield np.zeros((1, 1), int)
    yield np.full((5, 4), top)
    yield rng.integers(0, top + 1, (9, 11))
    yield np.clip(top // 2 + 20 * x - 13 * y + rng.integers(-3, 4, x.shape), 0, top)
    yield np.where((x + y) % 2, 0, top)


@pytest.mark.parametrize("bits", [8, 10, 12, 14, 16])
@pytest.mark.parametrize("selection", range(1, 8))
def test_round_trip(bits, selection):
    for image in images(bits):
        back, depth = J.decode(J.encode(image, bits, selection))
        assert depth == bits and (back[:, :, 0] == image).all()


@pytest.mark.parametrize("parts", [2, 3])
def test_components(parts):
    x = np.random.default_rng(parts).integers(0, 4096, (6, 5, parts))
    assert (J.decode(J.encode(x, 12))[0] == x).all()


def test_code_lengths_are_a_prefix_code():
    for counts in ([1], [5, 1], [1 << k for k in range(17)], [0, 3, 0, 9], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597]):
        lengths = J.code_lengths(np.array(counts))
        used = lengths[np.array(counts) > 0]
        assert used.min() >= 1 and used.max() <= 16 and sum(2.0 ** -n for n in used) < 1


def test_smooth_images_shrink():
    y, x = np.mgrid[0:64, 0:64]
    assert len(J.encode(5000 + 3 * x + 2 * y, 14)) < 64 * 64 * 14 / 8 / 4


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"\xff\xd8\xff\xc0\x00\x04ab", b"junk"])
def test_errors(data):
    with pytest.raises(J.JpegError):
        J.decode(data)


def test_frames(spark):
    rows = [(k, 4, 5, [int(v) for v in np.random.default_rng(k).integers(0, 16384, 20)]) for k in range(6)]
    dense = spark.createDataFrame(rows, "frame long, h int, w int, data array<bigint>")
    back = J.decode_frames(J.encode_frames(dense, 14))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, dense.collect()))
