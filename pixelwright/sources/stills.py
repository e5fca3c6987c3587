"""Single frames as files: PNG for colour images, DNG (a TIFF of sensor samples) for raw ones.

Both have a reader of what the writer makes, so that files can be checked and used again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import lossless_jpeg, samples

# -- PNG -----------------------------------------------------------------------------------------

PNG_START = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(image: np.ndarray, bits: int = 16) -> bytes:
    """An image (h, w, 3) of 8 or 16 bits a component; rows are filtered by the one above (type 2), which smooth images like."""
    h, w, _ = image.shape
    raw = np.ascontiguousarray(image, ">u2" if bits == 16 else "u1").view(np.uint8).reshape(h, -1)
    filtered = raw.copy()
    filtered[1:] -= raw[:-1]
    body = zlib.compress(np.concatenate([np.full((h, 1), 2, np.uint8), filtered], axis=1).tobytes(), 6)
    head = struct.pack(">IIBBBBB", w, h, bits, 2, 0, 0, 0)
    return PNG_START + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[np.ndarray, int]:
    """The image and its bits; chunks with a wrong checksum are an error. Filters 0 and 2 only."""
    if data[:8] != PNG_START:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + part):
            raise ValueError("checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    w, h, bits = head[:3]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, -1)
    out = np.empty((h, rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for y in range(h):
        above = out[y] = rows[y, 1:] + above if rows[y, 0] == 2 else rows[y, 1:]
    return out.reshape(-1).view(">u2" if bits == 16 else "u1").astype(np.int64).reshape(h, w, 3), bits


# -- DNG -----------------------------------------------------------------------------------------

#: Tag numbers of TIFF and DNG that the writer uses, in ascending order.
TAGS = {
    "NewSubfileType": 254, "ImageWidth": 256, "ImageLength": 257, "BitsPerSample": 258, "Compression": 259, "Photometric": 262, "Make": 271, "Model": 272, "StripOffsets": 273,
    "Orientation": 274, "SamplesPerPixel": 277, "RowsPerStrip": 278, "StripByteCounts": 279, "PlanarConfig": 284, "Software": 305, "DateTime": 306, "CFARepeatPatternDim": 33421, "CFAPattern": 33422,
    "ExposureTime": 33434, "ISOSpeed": 34855, "DNGVersion": 50706, "UniqueCameraModel": 50708, "BlackLevel": 50714, "WhiteLevel": 50717, "ColorMatrix1": 50721, "AsShotNeutral": 50728,
    "CalibrationIlluminant1": 50778, "TimeCodes": 51043, "FrameRate": 51044,
}
_NAMES = {v: k for k, v in TAGS.items()}
#: Types of a tag's values: byte, text, u16, u32, unsigned and signed fractions.
BYTE, ASCII, SHORT, LONG, RATIONAL, SRATIONAL = 1, 2, 3, 4, 5, 10
_SIZE = {BYTE: 1, ASCII: 1, SHORT: 2, LONG: 4, RATIONAL: 8, SRATIONAL: 8}
RAW_SAMPLES, LOSSLESS = 1, 7


@dataclass
class Still:
    """What a raw frame's file says besides its samples."""

    bits: int = 14
    black: int = 2048
    white: int = 15000
    camera: str = "camera"
    matrix: tuple[float, ...] = (1, 0, 0, 0, 1, 0, 0, 0, 1)
    neutral: tuple[float, ...] = (1, 1, 1)
    fps: float = 24.0
    iso: int = 100
    exposure: float = 0.02
    date: str = "1970:01:01 00:00:00"
    extra: dict = field(default_factory=dict)


def timecode_bytes(frame: int, fps: float) -> bytes:
    """Eight bytes of a frame's time code: frames, seconds, minutes, hours in decimal digits by nibbles, then zeros."""
    rate = max(1, round(fps))
    seconds, rest = divmod(frame, rate)
    parts = (rest, seconds % 60, seconds // 60 % 60, seconds // 3600 % 24)
    return bytes(p // 10 << 4 | p % 10 for p in parts) + bytes(4)


def _fraction(v: float, signed: bool) -> bytes:
    f = Fraction(v).limit_denominator(10_000)
    return struct.pack("<ii" if signed else "<II", f.numerator, f.denominator)


def _value(kind: int, values) -> tuple[int, bytes]:
    if kind == ASCII:
        body = values.encode() + b"\0"
        return len(body), body
    if kind == BYTE:
        return len(values), bytes(values)
    if kind in (RATIONAL, SRATIONAL):
        return len(values), b"".join(_fraction(v, kind == SRATIONAL) for v in values)
    return len(values), struct.pack(f"<{len(values)}{'H' if kind == SHORT else 'I'}", *values)


def write_dng(image: np.ndarray, frame: int, still: Still, compressed: bool = False) -> bytes:
    """Samples (h, w) of a mosaic of red, green, green and blue as a DNG file: packed bits or lossless JPEG."""
    h, w = image.shape
    if compressed:
        strip = lossless_jpeg.encode(image.reshape(h, w // 2, 2), still.bits)
    else:
        strip = samples.pack(image.reshape(-1), still.bits, big_endian=True)
    entries = {
        "NewSubfileType": (LONG, [0]), "ImageWidth": (LONG, [w]), "ImageLength": (LONG, [h]), "BitsPerSample": (SHORT, [still.bits]), "Compression": (SHORT, [LOSSLESS if compressed else RAW_SAMPLES]),
        "Photometric": (SHORT, [32803]), "Make": (ASCII, still.camera.split(" ")[0]), "Model": (ASCII, still.camera), "StripOffsets": (LONG, [0]), "Orientation": (SHORT, [1]), "SamplesPerPixel": (SHORT, [1]),
        "RowsPerStrip": (LONG, [h]), "StripByteCounts": (LONG, [len(strip)]), "PlanarConfig": (SHORT, [1]), "Software": (ASCII, "pixelwright"), "DateTime": (ASCII, still.date),
        "CFARepeatPatternDim": (SHORT, [2, 2]), "CFAPattern": (BYTE, [0, 1, 1, 2]), "ExposureTime": (RATIONAL, [still.exposure]), "ISOSpeed": (SHORT, [still.iso]), "DNGVersion": (BYTE, [1, 4, 0, 0]),
        "UniqueCameraModel": (ASCII, still.camera), "BlackLevel": (LONG, [still.black]), "WhiteLevel": (LONG, [still.white]), "ColorMatrix1": (SRATIONAL, still.matrix), "AsShotNeutral": (RATIONAL, still.neutral),
        "CalibrationIlluminant1": (SHORT, [21]), "TimeCodes": (BYTE, timecode_bytes(frame, still.fps)), "FrameRate": (SRATIONAL, [still.fps]),
    }
    made = [(TAGS[n], kind, *_value(kind, v)) for n, (kind, v) in entries.items()]
    at = 8 + 2 + 12 * len(made) + 4
    places, behind = {}, b""
    for tag, _, _, body in made:
        if len(body) > 4:
            places[tag] = at + len(behind)
            behind += body + bytes(len(body) % 2)
    start = at + len(behind)
    out = bytearray(struct.pack("<2sHIH", b"II", 42, 8, len(made)))
    for tag, kind, count, body in made:
        body = struct.pack("<I", start) if tag == TAGS["StripOffsets"] else struct.pack("<I", places[tag]) if tag in places else body.ljust(4, b"\0")
        out += struct.pack("<HHI", tag, kind, count) + body
    return bytes(out) + bytes(4) + behind + strip


def read_dng(data: bytes) -> tuple[np.ndarray, dict]:
    """Samples and tags by name of a file of one strip."""
    if data[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF")
    at = struct.unpack_from("<I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, count = struct.unpack_from("<HHI", data, at + 2 + 12 * k)
        place = at + 2 + 12 * k + 8
        if count * _SIZE[kind] > 4:
            place = struct.unpack_from("<I", data, place)[0]
        body = data[place : place + count * _SIZE[kind]]
        if kind == ASCII:
            value = body.rstrip(b"\0").decode()
        elif kind in (RATIONAL, SRATIONAL):
            pairs = struct.unpack(f"<{2 * count}{'i' if kind == SRATIONAL else 'I'}", body)
            value = [a / b for a, b in zip(pairs[::2], pairs[1::2])]
        else:
            value = list(struct.unpack(f"<{count}{ {BYTE: 'B', SHORT: 'H', LONG: 'I'}[kind]}", body))
        tags[_NAMES.get(tag, tag)] = value
    h, w, bits = tags["ImageLength"][0], tags["ImageWidth"][0], tags["BitsPerSample"][0]
    strip = data[tags["StripOffsets"][0] :][: tags["StripByteCounts"][0]]
    if tags["Compression"][0] == LOSSLESS:
        return lossless_jpeg.decode(strip)[0].reshape(h, w).astype(np.int64), tags
    words = np.frombuffer(strip, np.uint16).byteswap().tobytes()
    return samples.unpack(words, bits, h * w).astype(np.int64).reshape(h, w), tags


# -- frames as files -----------------------------------------------------------------------------


def _files(df: DataFrame, columns: list[str], made: Callable[[int, list[np.ndarray]], bytes]) -> DataFrame:
    """frame and content (one file each) of dense frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for frame, h, w, *planes in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), *(batch.column(3 + k) for k in range(len(columns)))):
                out.append(made(frame, [np.asarray(p.values.to_numpy(zero_copy_only=False), np.int64).reshape(h, w) for p in planes]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["frame", "content"])

    return df.select("frame", "h", "w", *columns).mapInArrow(run, "frame long, content binary")


def dng_files(dense: DataFrame, still: Still, compressed: bool = False) -> DataFrame:
    return _files(dense, ["data"], lambda frame, planes: write_dng(planes[0], frame, still, compressed))


def png_files(dense: DataFrame, bits: int = 16) -> DataFrame:
    """Of frames with arrays r, g and b."""
    return _files(dense, ["r", "g", "b"], lambda _, planes: write_png(np.stack(planes, axis=2), bits))
