"""Input tables and their reading as clips and frames.

A frame lives in two forms: dense, one row (frame, h, w, data ARRAY<BIGINT>), and long, one row
per pixel (frame, y, x, val). Stencils run on the dense form without any shuffle; groupings,
joins and windows run on the long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import idiv

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Dense 8x8 frames of 14-bit samples, with other columns of their table if asked."""
    data = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 8191.5))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), data.alias("data"), *keep)


def to_long(dense: DataFrame, *keep: str) -> DataFrame:
    """One row per pixel."""
    w = F.col("w").cast("long")
    d = dense.select("frame", *keep, "w", F.posexplode("data").alias("pos", "val"))
    pos = F.col("pos").cast("long")
    return d.select("frame", *keep, idiv(pos, w).alias("y"), F.pmod(pos, w).alias("x"), "val")


def to_dense(px: DataFrame, value: str = "val") -> DataFrame:
    """One row per frame, from any order of pixels."""
    g = px.groupBy("frame").agg(
        (F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"),
        F.transform(F.sort_array(F.collect_list(F.struct("y", "x", value))), lambda s: s[value]).alias("data"),
    )
    return g


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(frames(spark, sf_dir))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour frames of 16-bit components, one pixel per RGGB quad, made within each frame's row."""
    f = frames(spark, sf_dir)
    half = SIDE // 2

    def quads(data):
        def quad(q):
            at = lambda dy, dx: F.get(data, (F.floor(q / half) * 2 + dy) * SIDE + (q % half) * 2 + dx)
            return F.struct((at(0, 0) * 4).alias("r"), (idiv(at(0, 1) + at(1, 0), 2) * 4).alias("g"), (at(1, 1) * 4).alias("b"))

        return F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), quad)

    made = F.get(F.transform(F.array("data"), quads), F.lit(0))  # binds the frame once
    d = f.select("frame", F.posexplode(made).alias("pos", "c"))
    pos = F.col("pos").cast("long")
    return d.select("frame", idiv(pos, half).alias("y"), F.pmod(pos, F.lit(half)).alias("x"), "c.*")


def rgb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour frames, dense: arrays r, g and b a frame."""
    g = rgb(spark, sf_dir).groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("s"))
    half = F.lit(SIDE // 2)
    return g.select("frame", half.alias("h"), half.alias("w"), *[F.col(f"s.{c}").alias(c) for c in "rgb"])


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 16 x 16: four of 8 x 8 whose numbers follow each other, where all four are there."""
    key = idiv(F.col("frame"), 4)
    g = frames(spark, sf_dir).groupBy(key.alias("frame")).agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "data"))), lambda s: s["data"]).alias("fs")).where(F.size("fs") == 4)
    row = lambda y: F.concat(*[F.slice(F.get("fs", (F.floor(y / SIDE) * 2 + k).cast("int")), y % SIDE * SIDE + 1, SIDE) for k in (0, 1)])
    return g.select("frame", F.lit(2 * SIDE).alias("h"), F.lit(2 * SIDE).alias("w"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2 * SIDE - 1)), row)).alias("data"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame index: event_id as frame number, ts as its time in microseconds, kind and size."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("event_type").alias("kind"), F.col("user_id").alias("clip"), F.col("value").alias("size"), "ts")
