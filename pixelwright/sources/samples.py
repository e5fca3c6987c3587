"""Sample payloads: packed bits, frames of a container, linearisation, and what an export keeps.

A payload is a stream of 16-bit little-endian words whose bits, from the highest down, hold the
samples one after the other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .container import headers

#: Fixed values of the format: where a raw-image block's payload keeps its numbers (32-bit each).
RAW_FIELDS = {"height": 12, "width": 16, "bits": 28, "black": 32, "white": 36}
VIDEO_LEAD = struct.Struct("<IHHHHI")


def unpack(payload: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` samples of ``bits`` bits."""
    words = np.frombuffer(payload, "<u2", -(-count * bits // 16)).astype(">u2")
    flags = np.unpackbits(words.view(np.uint8))[: count * bits].reshape(count, bits)
    return flags @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def pack(samples: np.ndarray, bits: int, big_endian: bool = False) -> bytes:
    """Samples as a payload; with ``big_endian`` the words' bytes are swapped."""
    flags = (np.asarray(samples, np.int64)[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    stream = flags.astype(np.uint8).reshape(-1)
    stream = np.concatenate([stream, np.zeros(-len(stream) % 16, np.uint8)])
    words = np.packbits(stream).view(">u2")
    return words.astype(">u2" if big_endian else "<u2").tobytes()


def video_samples(payload: bytes, bits: int, count: int) -> np.ndarray:
    """The samples of a video block, behind its numbers and the space they name."""
    return unpack(payload[VIDEO_LEAD.size + VIDEO_LEAD.unpack_from(payload)[-1] :], bits, count)


def video_payload(number: int, samples: np.ndarray, bits: int) -> bytes:
    return VIDEO_LEAD.pack(number, 0, 0, 0, 0, 0) + pack(samples, bits)


def raw_info(found: DataFrame) -> DataFrame:
    """height, width, bits, black and white of each clip, from its last raw-image block."""

    def number(at: int):
        part = lambda k: F.conv(F.hex(F.substring(F.col("payload"), at + 1 + k, 1)), 16, 10).cast("long")
        return (part(0) + part(1) * 256 + part(2) * 65536 + part(3) * 16777216).cast("int")

    h = headers(found).where("type = 'RAWI'")
    return h.select("clip", *[number(at).alias(n) for n, at in RAW_FIELDS.items()])


def raw_block(height: int, width: int, bits: int, black: int, white: int) -> bytes:
    """Payload of a raw-image block."""
    out = bytearray(struct.pack("<HH", width, height) + bytes(200))
    for name, value in (("height", height), ("width", width), ("bits", bits), ("black", black), ("white", white)):
        struct.pack_into("<i", out, RAW_FIELDS[name], value)
    return bytes(out)


def frames(found: DataFrame) -> DataFrame:
    """Dense frames (clip, frame, h, w, data) of uncompressed video blocks, one row each; frame counts in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("clip").orderBy("ts", "chunk", "offset")
    video = found.where("type = 'VIDF'").withColumn("frame", (F.row_number().over(w) - 1).cast("long"))
    info = raw_info(found).select("clip", "height", "width", "bits")
    rows = video.join(info, "clip").select("clip", "frame", "height", "width", "bits", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clip, frame, h, width, bits, payload in zip(*(batch.column(k).to_pylist() for k in range(6))):
                data = video_samples(payload, bits, h * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([clip]), pa.array([frame], pa.int64()), pa.array([h], pa.int32()), pa.array([width], pa.int32()), pa.array([data], pa.list_(pa.int64()))],
                    names=["clip", "frame", "h", "w", "data"],
                )

    return rows.mapInArrow(run, "clip string, frame long, h int, w int, data array<bigint>")


def linearise(dense: DataFrame, curve: list[int]) -> DataFrame:
    """Samples through a table from the file; values beyond it take its last entry. The table has 65,536 entries at most."""
    table = F.array(*[F.lit(int(v)).cast("long") for v in curve]) if len(curve) <= 4096 else None
    if table is None:
        table = F.from_json(F.lit(str([int(v) for v in curve])), "array<bigint>")
    last = len(curve) - 1
    return dense.withColumn("data", F.get(F.transform(F.array(table), lambda t: F.transform("data", lambda v: F.get(t, F.least(v, F.lit(last)).cast("int")))), F.lit(0)))


def cut(found: DataFrame, first: int, last: int) -> DataFrame:
    """Blocks of an export: all headers, and the video frames first to last (1-based, inclusive) with the audio of their time."""
    from pyspark.sql import Window

    w = Window.partitionBy("clip", "type").orderBy("ts", "chunk", "offset")
    numbered = found.withColumn("n", F.row_number().over(w))
    spans = numbered.where(F.col("type") == "VIDF").where(F.col("n").between(first, last)).groupBy("clip").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    d = numbered.join(spans, "clip")
    keep = F.when(F.col("type") == "VIDF", F.col("n").between(first, last)).when(F.col("type") == "AUDF", F.col("ts").between(F.col("a"), F.col("b"))).when(F.col("type") == "NULL", F.lit(False)).otherwise(F.lit(True))
    return d.where(keep).select(*found.columns)


def averaged(dense: DataFrame) -> DataFrame:
    """One dense frame per clip: the half-up mean of its frames, place by place."""
    sums = dense.select("clip", "h", "w", F.posexplode("data").alias("pos", "v")).groupBy("clip", "h", "w", "pos").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = sums.withColumn("v", F.expr("(s + n div 2) div n"))
    return mean.groupBy("clip", "h", "w").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("d")).select("clip", F.lit(0).cast("long").alias("frame"), "h", "w", F.col("d.v").alias("data"))


def as_blocks(dense: DataFrame, bits: int) -> DataFrame:
    """Dense frames as video blocks again: type, ts, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = video_payload(frame, np.asarray(data.values), bits)
                yield pa.RecordBatch.from_arrays([pa.array(["VIDF"]), pa.array([frame], pa.int64()), pa.array([body], pa.binary())], names=["type", "ts", "payload"])

    return dense.select("frame", "data").mapInArrow(run, "type string, ts long, payload binary")


def unpack_blocks(video: DataFrame, h: int, w: int, bits: int) -> DataFrame:
    """Dense frames of video blocks of a known shape; a block's ts is its frame number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            data = [video_samples(p, bits, h * w) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), pa.array(data, pa.list_(pa.int64()))], names=["frame", "h", "w", "data"]
            )

    return video.selectExpr("ts as frame", "payload").mapInArrow(run, "frame long, h int, w int, data array<bigint>")
