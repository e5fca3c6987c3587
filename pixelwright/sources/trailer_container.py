"""Containers with an index at their end and JSON metadata.

Layout, little-endian: ``MOTION `` and a version byte; items of (type u32, size u32, content);
the last item is the frame index: magic, count, place of the (offset, time in ns) pairs. A frame
is a data item followed by a metadata item. Times become microseconds on reading.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
IDENT, VERSION, MAGIC = b"MOTION ", 3, 0x8A905612
INDEX, INDEX_DATA, BUFFER, METADATA, AUDIO_INDEX, AUDIO_DATA, AUDIO_METADATA = range(7)
ITEM = struct.Struct("<II")
TRAILER = struct.Struct("<IIIiq")
PAIR = np.dtype([("offset", "<i8"), ("ns", "<i8")])

CAMERA = (
    "apertures array<double>, focalLengths array<double>, whiteLevel double, blackLevel array<double>, sensorArrangment string,"
    " colorMatrix1 array<double>, colorMatrix2 array<double>, forwardMatrix1 array<double>, forwardMatrix2 array<double>,"
    " extraData struct<audioChannels: int, audioSampleRate: int>, deviceSpecificProfile struct<deviceModel: string>"
)
FRAME = "iso int, width int, height int, originalWidth int, originalHeight int, exposureTime double, orientation int, compressionType int, asShotNeutral array<double>"


class ContainerError(ValueError):
    """The bytes are not a container of this kind."""


def read_index(data: bytes) -> np.ndarray:
    """The frames' (offset, ns) pairs in order of time, ties in order of arrival."""
    if data[:7] != IDENT or len(data) < 8 + TRAILER.size or data[7] != VERSION:
        raise ContainerError("header")
    kind, _, magic, count, at = TRAILER.unpack_from(data, len(data) - TRAILER.size)
    if kind != INDEX or magic != MAGIC or at < 0 or at + count * PAIR.itemsize > len(data):
        raise ContainerError("index")
    pairs = np.frombuffer(data, PAIR, count, at)
    return pairs[np.argsort(pairs["ns"], kind="stable")]


def _item(data: bytes, at: int, kind: int) -> bytes | None:
    if at + 8 > len(data):
        return None
    found, size = ITEM.unpack_from(data, at)
    return data[at + 8 : at + 8 + size] if found == kind else None


def read_audio(data: bytes, after: int) -> Iterator[tuple[int, bytes]]:
    """(ns or -1, samples) of the audio blocks that the audio index lists; looked for behind the last frame."""
    at = after
    while at + 8 <= len(data):
        kind, size = ITEM.unpack_from(data, at)
        if kind == AUDIO_INDEX:
            count = struct.unpack_from("<q", data, at + 8)[0]
            for pair in np.frombuffer(data, PAIR, count, at + 24):
                body = _item(data, int(pair["offset"]), AUDIO_DATA)
                if body is not None:
                    yield int(pair["ns"]), body
            return
        if kind not in (BUFFER, METADATA, AUDIO_DATA, AUDIO_METADATA):
            return
        at += 8 + size


def build(camera: str, frames: list[tuple[int, str, bytes]], audio: list[tuple[int, bytes]] = ()) -> bytes:
    """A container from (ns, JSON, data) frames and (ns, samples) audio blocks."""
    item = lambda kind, body: ITEM.pack(kind, len(body)) + body
    out = bytearray(IDENT + bytes([VERSION]) + item(METADATA, camera.encode()))
    heard = []
    for ns, body in audio:
        heard.append((len(out), ns))
        out += item(AUDIO_DATA, body)
    seen = []
    for ns, meta, body in frames:
        seen.append((len(out), ns))
        out += item(BUFFER, body) + item(METADATA, meta.encode())
    if heard:
        pairs = np.array(heard, PAIR).tobytes()
        out += ITEM.pack(AUDIO_INDEX, 16 + len(pairs)) + struct.pack("<qq", len(heard), 0) + pairs
    at = len(out) + 8
    pairs = np.array(seen, PAIR).tobytes()
    out += ITEM.pack(INDEX_DATA, len(pairs)) + pairs + TRAILER.pack(INDEX, 16, MAGIC, len(seen), at)
    return bytes(out)


SCHEMA = "clip string, kind string, number long, offset long, ts long, meta string, payload binary"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of kind clip (camera metadata), frame, audio and error, through Spark's binaryFile source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mcraw").load(path)
    return parse_files(files, payload)


def parse_files(files: DataFrame, payload: bool = True) -> DataFrame:
    """The same of files given as rows (path, content)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("clip", pa.string()), ("kind", pa.string()), ("number", pa.int64()), ("offset", pa.int64()), ("ts", pa.int64()), ("meta", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for clip, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, rows = content.as_py(), []
                try:
                    pairs = read_index(data)
                    camera = _item(data, 8, METADATA)
                    rows.append((clip, "clip", 0, 8, None, camera.decode("utf-8", "replace") if camera else None, None))
                    last = 8
                    for number, pair in enumerate(pairs):
                        at = int(pair["offset"])
                        body = _item(data, at, BUFFER)
                        if body is None:
                            rows.append((clip, "error", number, at, int(pair["ns"]) // 1000, "no frame here", None))
                            continue
                        meta = _item(data, at + 8 + len(body), METADATA)
                        rows.append((clip, "frame", number, at, int(pair["ns"]) // 1000, meta.decode("utf-8", "replace") if meta else None, body if payload else None))
                        last = max(last, at)
                    rows += [(clip, "audio", k, -1, ns // 1000, None, body if payload else None) for k, (ns, body) in enumerate(read_audio(data, last))]
                except (ContainerError, struct.error, ValueError) as e:
                    rows.append((clip, "error", 0, 0, None, str(e), None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return files.select("path", "content").mapInArrow(parse, SCHEMA)


def frames(rows: DataFrame) -> DataFrame:
    """Frames with their typed metadata."""
    f = rows.where("kind = 'frame'").select("clip", "number", "ts", F.from_json("meta", FRAME).alias("m"), "payload")
    return f.select("clip", "number", "ts", "m.*", "payload")


def cameras(rows: DataFrame) -> DataFrame:
    """One row per clip; a missing colour matrix is taken from the other one, or is the identity."""
    c = rows.where("kind = 'clip'").select("clip", F.from_json("meta", CAMERA).alias("m")).select("clip", "m.*")
    whole = lambda name: F.when(F.size(name) >= 9, F.col(name))
    identity = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    return c.withColumns({a: F.coalesce(whole(a), whole(b), identity) for a, b in (("colorMatrix1", "colorMatrix2"), ("colorMatrix2", "colorMatrix1"))})


def frame_rate(rows: DataFrame) -> DataFrame:
    """Frames a second from the mean distance of the frames, rounded, 1 at least."""
    g = rows.where("kind = 'frame'").groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    mean = (F.col("b") - F.col("a")) / (F.col("n") - 1)
    return g.where("n > 1").select("clip", F.greatest(F.lit(1).cast("long"), F.round(F.try_divide(F.lit(1e6), mean)).cast("long")).alias("rate"))
