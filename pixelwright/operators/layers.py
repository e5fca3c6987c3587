"""Blended layers as sensor frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bound, trunc


def blend_export(df: DataFrame, black: int, bits: int) -> DataFrame:
    """Dense frames of 0 to 1 as raw frames: width cut to a multiple of 8, height to one of 2, bottom row first, 0..1 as black..2^bits."""
    h, w = F.col("h"), F.col("w")
    height, width = (h - h % 2).cast("int"), (w - w % 8).cast("int")
    top = float(1 << bits)

    def made(data: Column) -> Column:
        row = lambda y: F.slice(data, (height - 1 - y) * w + 1, width)
        rows = F.flatten(F.transform(F.sequence(F.lit(0), height - 1), row))
        return F.transform(rows, lambda v: trunc(F.least(F.greatest(F.round(v * (top - black) + black, 6), F.lit(0.0)), F.lit(top))))

    return df.select("frame", height.alias("h"), width.alias("w"), bound(F.col("data"), made).alias("data"))
