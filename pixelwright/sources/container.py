"""Tagged-block containers: reading, index, repair after corruption, writing.

A container is a sequence of little-endian blocks: tag (4 bytes), size of the whole block (u32),
time in microseconds (u64), then the payload. Three ways in:

* ``blocks(spark, path)`` reads through Spark's binaryFile source, so any store that Spark can
  open will do; one row per file is parsed by an Arrow kernel (``parse_files``).
* ``spark.read.format("tagged_blocks")`` is a Python data source for files on a mounted file
  system: it seeks from header to header, so a header-only scan never reads payloads.
* ``frame_index(blocks)`` orders frames by time; ``save_index``/``load_index`` keep it as Parquet.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: The known block tags.
TAGS = "MLVI VIDF AUDF RAWI RAWC WAVI EXPO LENS ELNS RTCI IDNT XREF INFO DISO MARK STYL ELVL WBAL DARK CURV NULL DEBG VERS BKUP".split()
HEADER = struct.Struct("<4sIQ")
BLOCK_SCHEMA = "clip string, chunk int, offset long, type string, size long, ts long, payload binary"
#: How far a lost reader looks for the next known tag.
RESYNC = 128 << 20
RESYNC_TAGS = tuple(t.encode() for t in ("VIDF", "AUDF", "NULL", "RTCI"))
INDEX_VERSION = 1


def chunk_of(path: str) -> tuple[str, int]:
    """Clip and chunk number of a file name: .MLV is chunk 0, .M00 chunk 1 and so on."""
    stem, ext = os.path.splitext(path)
    m = re.fullmatch(r"\.[mM](\d\d)", ext)
    return stem, int(m[1]) + 1 if m else 0


def walk(data: bytes, first: int = 0) -> Iterator[tuple[int, str, int, int, bytes]]:
    """(offset, tag, size, time, payload) of each block; skips to the next known tag after garbage."""
    at, known = first, {t.encode() for t in TAGS}
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        head = 52 if tag == b"MLVI" else 16
        if tag not in known or size < min(head, 16) or at + size > len(data):
            nearest = [p for t in RESYNC_TAGS if (p := data.find(t, at + 1, at + RESYNC)) >= 0]
            if not nearest:
                return
            at = min(nearest)
            continue
        ts = 0 if tag == b"MLVI" else HEADER.unpack_from(data, at)[2]
        yield at, tag.decode(), size, ts, data[at + (8 if tag == b"MLVI" else 16) : at + size]
        at += size


def block(tag: str, ts: int, payload: bytes) -> bytes:
    return HEADER.pack(tag.encode(), 16 + len(payload), ts) + payload


def blocks(spark: SparkSession, path: str, max_frames: int | None = None, payload: bool = True) -> DataFrame:
    """All blocks of all files under a path (spanned chunks by their names)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(mlv|m\d\d)$"))
    return parse_files(files, max_frames, payload)


def parse_files(files: DataFrame, max_frames: int | None = None, payload: bool = True) -> DataFrame:
    """All blocks of files given as rows (path, content); with ``max_frames`` up to so many video frames of each."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                clip, chunk = chunk_of(name)
                rows, frames = [], 0
                for offset, tag, size, ts, body in walk(content.as_py()):
                    rows.append((clip, chunk, offset, tag, size, ts, body if payload else None))
                    frames += tag == "VIDF"
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                    if max_frames is not None and frames >= max_frames:
                        break
                yield _rows(rows)

    return files.select("path", "content").mapInArrow(parse, BLOCK_SCHEMA)


def little_endian(value: Column, size: int) -> Column:
    """A number as so many bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def block_bytes(tag: Column, ts: Column, payload: Column) -> Column:
    """A whole block: tag, size, time, payload (binary)."""
    return F.concat(F.encode(tag, "utf-8"), little_endian(F.octet_length(payload) + 16, 4), little_endian(ts, 8), payload)


def chunk_files(rows: DataFrame, path: str, *order: str) -> DataFrame:
    """One row (path, content) per file from rows with that path, columns of order, and ``block`` (binary); a file is one value by its nature."""
    held = rows.groupBy(F.col(path).alias("path")).agg(F.sort_array(F.collect_list(F.struct(*order, "block"))).alias("b"))
    return held.select("path", F.expr("aggregate(b, X'', (acc, x) -> acc || x.block)").alias("content"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("clip", pa.string()), ("chunk", pa.int32()), ("offset", pa.int64()), ("type", pa.string()), ("size", pa.int64()), ("ts", pa.int64()), ("payload", pa.binary())])
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def contiguous_chunks(found: DataFrame) -> DataFrame:
    """Blocks of chunks 0, 1, ... up to the first missing chunk of each clip."""
    chunks = found.select("clip", "chunk").distinct()
    after = chunks.groupBy("clip").agg(F.array_sort(F.collect_set("chunk")).alias("c"))
    runs = after.select("clip", F.explode(F.filter("c", lambda v, i: v == i)).alias("chunk"))
    return found.join(runs, ["clip", "chunk"], "left_semi")


def frame_index(found: DataFrame) -> DataFrame:
    """One row per video or audio frame, numbered by time; ties by place in the clip."""
    from pyspark.sql import Window

    kinds = found.where(F.col("type").isin("VIDF", "AUDF"))
    w = Window.partitionBy("clip", "type").orderBy("ts", "chunk", "offset")
    return kinds.select("clip", F.when(F.col("type") == "VIDF", 1).otherwise(2).cast("short").alias("frame_type"), "chunk", (F.row_number().over(w) - 1).alias("frame_number"), F.col("size").alias("frame_size"), "offset", F.col("ts").alias("frame_time"))


#: Tags of which a clip's first block counts; of the others the last one does.
FIRST_WINS = ("LENS", "ELNS", "WBAL", "STYL", "RTCI", "CURV")


def headers(found: DataFrame) -> DataFrame:
    """The block that counts of each header type per clip."""
    place = F.struct("chunk", "offset")
    h = found.where(~F.col("type").isin("VIDF", "AUDF", "NULL")).groupBy("clip", "type").agg(F.min_by("payload", place).alias("first"), F.max_by("payload", place).alias("last"))
    return h.select("clip", "type", F.when(F.col("type").isin(*FIRST_WINS), F.col("first")).otherwise(F.col("last")).alias("payload"))


def clock(found: DataFrame) -> DataFrame:
    """Wall-clock time of each clip from its broken-down time block."""

    def field(k: int):
        low, high = (F.conv(F.hex(F.substring(F.col("payload"), 2 * k + 1 + d, 1)), 16, 10).cast("int") for d in (0, 1))
        return low + high * 256

    h = headers(found).where("type = 'RTCI'")
    return h.select("clip", F.make_timestamp(field(5) + 1900, field(4) + 1, field(3), field(2), field(1), field(0).cast("decimal(8,6)")).alias("recorded"))


def audio(found: DataFrame) -> DataFrame:
    """Whole audio of each clip in time order and its size; a clip's audio is one value by its nature."""
    a = found.where("type = 'AUDF'").groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("ts", "chunk", "offset", "payload"))).alias("b"))
    return a.select("clip", F.expr("aggregate(b, X'', (acc, x) -> acc || substring(x.payload, 9))").alias("pcm"))


def save_index(index: DataFrame, path: str) -> None:
    index.withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved index, or None if there is none of this version."""
    try:
        found = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if "version" not in found.columns or found.where(F.col("version") != INDEX_VERSION).limit(1).count():
        return None
    return found.drop("version")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.max_frames = int(options.get("maxframes", options.get("maxFrames", "0")))

    def partitions(self) -> list[InputPartition]:
        root = self.path.removeprefix("file://")
        names = [root] if os.path.isfile(root) else [os.path.join(d, f) for d, _, files in os.walk(root) for f in files]
        return [_File(n) for n in sorted(names) if re.search(r"\.(mlv|m\d\d)$", n, re.I)]

    def read(self, partition: InputPartition):
        clip, chunk = chunk_of(partition.path)
        frames = 0
        with open(partition.path, "rb") as f:
            end = os.fstat(f.fileno()).st_size
            at = 0
            while at + 16 <= end:
                f.seek(at)
                tag, size, ts = HEADER.unpack(f.read(16))
                if tag.decode("latin1") not in TAGS or size < 16 or at + size > end:
                    f.seek(at + 1)
                    look = f.read(min(RESYNC, end - at - 1))
                    nearest = [p for t in RESYNC_TAGS if (p := look.find(t)) >= 0]
                    if not nearest:
                        return
                    at += 1 + min(nearest)
                    continue
                lead = 8 if tag == b"MLVI" else 16
                body = None
                if self.payload:
                    f.seek(at + lead)
                    body = f.read(size - lead)
                yield clip, chunk, at, tag.decode(), size, 0 if tag == b"MLVI" else ts, body
                frames += tag == b"VIDF"
                if self.max_frames and frames >= self.max_frames:
                    return
                at += size


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _BlockWriter(DataSourceWriter):
    """Each task writes one chunk next to the others under a temporary name; the commit renames them in order."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        name = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}")
        with open(name, "wb") as f:
            for row in rows:
                body = bytes(row["payload"] or b"")
                f.write(block(row["type"], row["ts"], body) if row["type"] != "MLVI" else b"MLVI" + struct.pack("<I", 8 + len(body)) + body)
        return _Written(name)

    def commit(self, messages) -> None:
        written = sorted(m.path for m in messages if m is not None and os.path.getsize(m.path))
        for k, name in enumerate(written):
            os.replace(name, os.path.join(self.path, "clip.MLV" if k == 0 else f"clip.M{k - 1:02d}"))
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class TaggedBlocks(DataSource):
    """``spark.dataSource.register(TaggedBlocks)``; options path, payload, maxFrames."""

    @classmethod
    def name(cls) -> str:
        return "tagged_blocks"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BlockWriter(self.options)
