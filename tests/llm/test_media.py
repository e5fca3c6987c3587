import hashlib
import zlib

import numpy as np
import pytest

from pixelwright.llm import media
from pixelwright.llm.common import table
from tests.conftest import SF
from tests.llm.helpers import documents, empty


@pytest.mark.parametrize("n,want", [(0, 64), (1, 64), (64, 64), (65, 128)])
def test_padding(n, want):
    assert len(media.pad(b"x" * n)) == want


def test_wav_is_lossless():
    data = bytes(range(256)) * 3
    assert media.read_wav(media.store_wav(data)) == data


def brute_landmarks(samples):
    """The definition, one frame and one band at a time."""
    x = np.frombuffer(samples, np.uint8).astype(float)
    x = np.concatenate([x, np.zeros(max(0, media.FRAME - len(x)))])
    peaks = []
    for start in range(0, len(x) - media.FRAME + 1, media.HOP):
        part = x[start : start + media.FRAME]
        power = np.abs(np.fft.rfft((part - part.mean()) * np.hanning(media.FRAME))) ** 2
        row = []
        for lo, hi in media.BANDS:
            k = int(power[lo:hi].argmax())
            row.append(lo + k if power[lo + k] > media.STANDS_OUT * power[lo:hi].mean() + 1e-6 else None)
        peaks.append(row)
    found = [(f, b, p) for f, row in enumerate(peaks) for b, p in enumerate(row) if p is not None]
    out = []
    for f, b, p in found:
        zone = [(g, q) for g, c, q in found if (g, c) > (f, b) and g - f <= media.ZONE]
        out += [(f, p, q, g - f) for g, q in zone[: media.FAN_OUT]]
    return sorted(out)


@pytest.mark.parametrize("n", [64, 512, 5000, 40_000])
def test_landmarks(n):
    t = np.arange(n)
    data = (128 + 60 * np.sin(t * 0.3) + 40 * np.sin(t * 1.1)).astype(np.uint8).tobytes()
    assert sorted(map(tuple, media.landmarks(data).tolist())) == brute_landmarks(data)


def test_rows(spark):
    got = media.documents_digests(documents(spark)).collect()
    by = {}
    for r, d in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(documents(spark).collect(), key=lambda r: r["doc_id"])):
        data = (d["text"] or "").encode()
        padded = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (d["doc_id"], len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["media_bytes"] == len(padded) + 44
        assert by.setdefault(data, tuple(r)[1:]) == tuple(r)[1:]
    assert len({v[-2] for v in by.values()}) >= 4
    assert media.documents_digests(empty(spark)).count() == 0


def test_media_column(spark):
    df = documents(spark).selectExpr("doc_id", "cast(text as binary) as payload", "key")
    out = media.media_column(df, "payload").collect()
    assert all(media.read_wav(bytes(r["media"])) == media.pad(bytes(r["payload"] or b"")) for r in out)
    assert any(len(r["landmarks"]) for r in out) and {r["key"] for r in out} == {0, 1, 2}


def test_all_documents(spark):
    n = table(spark, SF, "documents").count()
    out = media.op2(spark, SF)
    assert out.count() == n and out.where("feature = ''").count() < n / 10


@pytest.mark.parametrize("n,want", [(64, 768), (256, 768), (512, 1024), (576, 1280), (704, 1280), (768, 1280), (832, 1536)])
def test_frames_cover_both_ends(n, want):
    got = media.whole_frames(b"x" * n)
    assert got == bytes(media.HOP) + b"x" * n + bytes(want - n - media.HOP) and (len(got) - media.FRAME) % media.HOP == 0


@pytest.mark.parametrize("n", [576, 640, 704, 5056])
def test_the_last_bytes_count(spark, n):
    """Payloads that differ only in their tails."""
    t = np.arange(n)
    one = (128 + 60 * np.sin(t * 0.3) + 40 * np.sin(t * 1.1)).astype(np.uint8).tobytes()
    end = (n - media.FRAME) // media.HOP * media.HOP + media.FRAME
    other = one[:end] + (128 + 100 * np.sin(t[end:] * 2.0)).astype(np.uint8).tobytes()
    df = spark.createDataFrame([(1, bytearray(one)), (2, bytearray(other))], "doc_id long, payload binary")
    got = {r["doc_id"]: r["landmarks"] for r in media.media_column(df, "payload").collect()}
    assert got[1] != got[2] and sorted(got[2]) == sorted(media.time_codes(np.array(brute_landmarks(media.whole_frames(other)))).tolist())


def test_the_last_bytes_of_a_text_count(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(512))
    got = media.documents_digests(documents(spark, [(1, text + "a" * 192), (2, text + "ab~Z" * 48)])).collect()
    assert len({r["feature"] for r in got}) == 2


def test_target_zone():
    t = np.arange(8192)
    data = (128 + sum(25 * np.sin(2 * np.pi * k * t / media.FRAME) for k in (8, 30, 80, 180))).astype(np.uint8).tobytes()
    pairs = media.landmarks(data)
    assert set(pairs[:, 3].tolist()) == {0, 1, 2} and np.bincount(pairs[:, 0]).max() == 4 * media.FAN_OUT
    assert len(set(media.time_codes(pairs).tolist())) == len(pairs) and media.landmarks(bytes(4096)).shape == (0, 4)


def test_one_changed_last_byte_can_change_the_feature(spark):
    for n in (2047, 2048, 2240):
        text = "".join(chr(97 + k * k % 23) for k in range(n - 1))
        got = media.documents_digests(documents(spark, [(1, text + "a"), *((k, text + chr(k)) for k in range(33, 127))])).collect()
        assert len({r["feature"] for r in got}) > 1
