"""Pixel maps, cube lookup tables, presets, edit lists, property files, JSON metadata, audio and session tables."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pixel_map(spark: SparkSession, path: str) -> DataFrame:
    """``x y`` per line, optional ``#FPM <hex id>`` line; the camera and frame size come from the name of the file, or of the folder that Spark wrote it as."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    name = F.regexp_extract("path", r"([^/]+)\.[fb]pm(?:/part-[^/]*)?$", 1)
    d = lines.select(
        F.regexp_extract("value", r"^\s*(\d+)\s+(\d+)", 1).alias("x"), F.regexp_extract("value", r"^\s*(\d+)\s+(\d+)", 2).alias("y"),
        F.regexp_extract(name, r"^([0-9a-fA-F]+)_", 1).alias("camera"), F.regexp_extract(name, r"_(\d+)x", 1).cast("int").alias("width"), F.regexp_extract(name, r"x(\d+)$", 1).cast("int").alias("height"),
    )
    return d.where("x <> ''").select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "camera", "width", "height")


def write_pixel_map(pixels: DataFrame, path: str) -> None:
    pixels.select(F.concat_ws(" \t ", F.col("x").cast("string"), F.col("y").cast("string")).alias("value")).write.mode("overwrite").text(path)


class CubeError(ValueError):
    """A lookup table file that cannot be used; code names the reason."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def cube_lut(spark: SparkSession, path: str) -> dict:
    """A .cube file: title, dimension (1 or 3), size, domain, entries. At most 3 * 256^3 numbers, so it is read to the driver."""
    lines = [r[0].strip() for r in spark.read.text(path, wholetext=True).selectExpr("explode(split(value, '\\\\r?\\\\n')) AS l").collect()]
    out: dict = {"title": "", "dimension": 0, "size": 0, "domain": ([0.0] * 3, [1.0] * 3), "entries": []}
    for line in lines:
        word, _, rest = line.partition(" ")
        if not line or line.startswith("#"):
            continue
        if word == "TITLE":
            out["title"] = rest.strip().strip('"')
        elif word in ("LUT_1D_SIZE", "LUT_3D_SIZE"):
            out["dimension"], out["size"] = int(word[4]), int(rest)
        elif word in ("DOMAIN_MIN", "DOMAIN_MAX"):
            out["domain"][word == "DOMAIN_MAX"][:] = [float(v) for v in rest.split()]
        else:
            try:
                out["entries"].append(tuple(float(v) for v in line.split()))
            except ValueError:
                raise CubeError("bad_line") from None
    if not out["dimension"]:
        raise CubeError("no_size")
    limit = 65536 if out["dimension"] == 1 else 256
    if not 2 <= out["size"] <= limit:
        raise CubeError("bad_size")
    if any(a >= b for a, b in zip(*out["domain"])):
        raise CubeError("bad_domain")
    if len(out["entries"]) != out["size"] ** out["dimension"] or any(len(e) != 3 for e in out["entries"]):
        raise CubeError("wrong_count")
    return out


#: Settings of a preset that the grade builder understands, with their defaults.
PRESET_SCHEMA = T.StructType(
    [T.StructField("_version", T.IntegerType())]
    + [T.StructField(n, T.IntegerType()) for n in "exposure contrast pivot temperature tint clarity vibrance saturation ds dr ls lr lightening shadows highlights sharpen gamma tonemap gamut toning agx".split()]
    + [T.StructField(n, T.StringType()) for n in "gradationCurve hueVsHue hueVsSaturation hueVsLuminance lumaVsSaturation transferFunction".split()]
)
PRESET_DEFAULTS = {"contrast": 0, "pivot": 75, "temperature": 6000, "tint": 0, "vibrance": 0, "saturation": 0, "gamma": 315}


def presets(spark: SparkSession, path: str) -> DataFrame:
    """XML presets; missing tags get their defaults, unknown ones are left out."""
    d = spark.read.format("xml").option("rowTag", "receipt").schema(PRESET_SCHEMA).load(path)
    return d.select(F.col("_version").alias("version"), *[F.coalesce(F.col(f.name), F.lit(PRESET_DEFAULTS[f.name])).alias(f.name) if f.name in PRESET_DEFAULTS else F.col(f.name) for f in PRESET_SCHEMA.fields[1:]])


def write_presets(rows: DataFrame, path: str) -> None:
    rows.withColumnRenamed("version", "_version").write.mode("overwrite").format("xml").option("rootTag", "receipts").option("rowTag", "receipt").save(path)


def session(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a session file: file, relative path, mark."""
    schema = "_file string, _relative string, _mark int"
    return spark.read.format("xml").option("rowTag", "clip").schema(schema).load(path).select(F.col("_file").alias("file"), F.col("_relative").alias("relative"), F.coalesce("_mark", F.lit(0)).alias("mark"))


def edit_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct clip names of an edit list with their first place, cut at ``.[`` and stripped of their ending."""
    text = spark.read.text(path, wholetext=True)
    by_name = F.regexp_extract_all("value", F.lit(r'<(?:clip|asset-clip|clipitem)\b[^>]*\bname="([^"]*)"'), F.lit(1))
    names = text.select(F.posexplode(by_name).alias("pos", "name"))
    cut = F.regexp_replace(F.substring_index("name", ".[", 1), r"\.[^.]*$", "")
    return names.select("pos", cut.alias("name")).groupBy("name").agg(F.min("pos").alias("pos"))


def properties(spark: SparkSession, path: str, separator: str = "=") -> DataFrame:
    """key, value of each line ``key = value``."""
    d = spark.read.text(path).where(F.col("value").contains(separator))
    return d.select(F.trim(F.substring_index("value", separator, 1)).alias("key"), F.trim(F.expr(f"substring(value, instr(value, '{separator}') + 1)")).alias("value"))


CAMERA_JSON = "iso int, width int, height int, exposureTime double, recvdTimestampMs bigint, orientation int, compressionType int, asShotNeutral array<double>"


def camera_metadata(json: Column) -> Column:
    """Typed fields of a frame's JSON metadata; the time in microseconds."""
    return F.from_json(json, CAMERA_JSON)


def map_listing(json: Column) -> Column:
    """name, size and digest of each file of a remote listing (a JSON array), as an array of structs."""
    return F.from_json(json, "array<struct<name: string, size: bigint, sha: string, download_url: string>>")


def stale(content: Column, listed_sha1: Column) -> Column:
    """Whether a file's content (binary) differs from a listing's digest of ``blob <size>\\0<content>``."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content)) != listed_sha1


def discover(spark: SparkSession, root: str, pattern: str = "*.MLV") -> DataFrame:
    """Files by name pattern at any depth: path, size, modified."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return d.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def wav(pcm: bytes, rate: int, channels: int, bits: int) -> bytes:
    """A PCM stream as a WAV file."""
    align = channels * bits // 8
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * align, align, bits, b"data", len(pcm))
    return head + pcm


def wav_cut(pcm: Column, fps: float, cut_in: int, cut_out: int, rate: int = 48000, align: int = 4) -> Column:
    """Bytes of the frames cut_in to cut_out (1-based, inclusive), whole samples only."""
    start = int((cut_in - 1) / fps * rate) * align
    end = int(cut_out / fps * rate) * align
    return F.substring(pcm, F.lit(start + 1), F.lit(end - start))


SESSION_COLUMNS = "Name Path Camera Lens Resolution Duration Frames Frame_Rate Focal_Length Shutter Aperture ISO DualISO Bit_Depth Date_Time Audio Size Data_Rate".split()


def write_session_table(clips: DataFrame, path: str) -> None:
    """The clip table as tab-separated text; missing values as a dash."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in clips.columns]
    clips.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def load_dark_frame(dark: DataFrame, clip: DataFrame) -> DataFrame:
    """A dark frame that fits a clip's frames (same height and width), else no row; both are dense."""
    sizes = clip.select("h", "w").distinct()
    return dark.join(F.broadcast(sizes.limit(2)), ["h", "w"], "left_semi")
