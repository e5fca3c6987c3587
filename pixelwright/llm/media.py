"""Media columns: payloads kept as 8-bit WAV, analysed by short-time Fourier transforms.

``store_wav`` wraps a binary column into WAV files, ``read_wav`` gets the samples back with
the standard wave reader, ``landmarks`` turns samples into spectral-peak pair fingerprints:
an array of (time code, first bin, second bin, distance) entries. Only whole frames are read, and a
frame's ends count little, so samples meet it with zeros around them (``whole_frames``); stored files don't.

Cases: null payload = empty; an empty payload is one block of 64 zero bytes; silence has no
peaks, so its array is empty; ties between equal magnitudes go to the lower bin; equal payloads
give equal files and fingerprints, since each row is transformed on its own.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, pick, table, utf8

BLOCK = 64
RATE = 8000
FRAME = 512
HOP = 256
#: Frequency bands (bin ranges) that give one peak each per frame.
BANDS = ((4, 16), (16, 48), (48, 112), (112, 257))
#: A peak's target zone: the later bands of its own frame and all bands of so many following frames.
ZONE = 3
#: Each peak is paired with so many peaks of its zone, the nearest in time first, then the lowest band.
FAN_OUT = 5
#: A peak stands out if its power is over so many times its band's mean.
STANDS_OUT = 2.0
#: Frames transformed at once, so that memory stays bounded for very long payloads.
FRAMES_AT_ONCE = 4096
_WINDOW = np.hanning(FRAME).astype(np.float64)


def pad(payload: bytes) -> bytes:
    """Append zero bytes up to a positive multiple of BLOCK."""
    return payload + bytes(-len(payload) % BLOCK if payload else BLOCK)


def store_wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The sample bytes of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def whole_frames(samples: bytes) -> bytes:
    """The samples, for analysis, between HOP zero bytes and at least as many, up to a whole frame: each sample is near some frame's middle, where the window is not zero."""
    return bytes(HOP) + samples + bytes(HOP + -len(samples) % HOP)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per frame and band the strongest bin, and whether it stands out of its band's mean."""
    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        x = np.concatenate([x, np.full(FRAME - len(x), 0, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, strong = [], []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[at : at + FRAMES_AT_ONCE].astype(np.float64)
        part -= part.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(part * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        rows = np.arange(len(part))
        top = np.empty((len(part), len(BANDS)), np.int32)
        good = np.empty((len(part), len(BANDS)), bool)
        for k, (lo, hi) in enumerate(BANDS):
            band = power[:, lo:hi]
            best = band.argmax(axis=1)
            top[:, k] = best + lo
            good[:, k] = band[rows, best] > STANDS_OUT * band.mean(axis=1) + 1e-6
        bins.append(top)
        strong.append(good)
    return np.concatenate(bins), np.concatenate(strong)


def landmarks(samples: bytes) -> np.ndarray:
    """Peak pairs as rows (frame, anchor's bin, partner's bin, frame distance), in time order."""
    top, good = peaks(samples)
    frame, band = np.nonzero(good)  # by frame, then band: the nearest peaks of a zone come next
    bins = top[frame, band]
    out = [np.empty((0, 4), np.int64)]
    for k in range(1, FAN_OUT + 1):
        distance = frame[k:] - frame[:-k]
        near = distance <= ZONE
        out.append(np.stack([frame[:-k][near], bins[:-k][near], bins[k:][near], distance[near]], axis=1))
    pairs = np.concatenate(out)
    return pairs[np.lexsort((pairs[:, 2], pairs[:, 3], pairs[:, 1], pairs[:, 0]))]


def time_codes(pairs: np.ndarray) -> np.ndarray:
    """One long per pair: frame << 32 | first bin << 18 | second bin << 4 | distance."""
    p = pairs.astype(np.int64)
    return (p[:, 0] << 32) | (p[:, 1] << 18) | (p[:, 2] << 4) | p[:, 3]


def feature(codes: np.ndarray) -> str:
    """A time-coded array as text: gap in frames, then the pair's 28 bits, in hex."""
    if not len(codes):
        return ""
    gaps = np.diff(codes >> 32, prepend=0)
    return " ".join(f"{g:x}.{c:x}" for g, c in zip(gaps.tolist(), (codes & 0xFFFFFFFF).tolist()))


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, feature string, n_pairs long"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            payload = payload.as_py()
            media = store_wav(pad(payload))
            back = read_wav(media)
            codes = time_codes(landmarks(whole_frames(back)))
            rows.append((
                key, len(payload), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]),
                len(media), hashlib.sha256(media).hexdigest(), feature(codes), len(codes),
            ))
            if len(rows) == 512:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pairs", pa.int64()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


def media_column(df: DataFrame, payload: str, media: str = "media", codes: str = "landmarks") -> DataFrame:
    """``df`` plus the stored WAV (binary) and its time-coded fingerprint (array of long)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                files = [store_wav(pad(p or b"")) for p in part.column(part.schema.get_field_index(payload)).to_pylist()]
                marks = [time_codes(landmarks(whole_frames(read_wav(f)))) for f in files]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(files, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
                    names=[*part.schema.names, media, codes],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(add, f"{fields}, `{media}` binary, `{codes}` array<bigint>")


def documents_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: sizes and digests of the payload, its stored form and its fingerprint."""
    return docs.select(key, utf8(text).alias("payload")).mapInArrow(_digests, SCHEMA)


def op2(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return documents_digests(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
