"""Dual-exposure frames: pairs of rows alternate between a bright and a dark exposure."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions.exprs import bound, idiv, trunc
from . import stencil as S

#: EV above black where full resolution sets in, over how many EV; the largest value of an alias map.
FULL_START, FULL_OVER, ALIAS_MOST = 4.0, 4.0, 15000


def _ev(v: Column, black: int) -> Column:
    return F.log2(F.greatest(F.lit(1), v - black).cast("double"))


def _raw(ev: Column, black: int) -> Column:
    return trunc(F.lit(float(black)) + F.round(F.pow(F.lit(2.0), ev), 4))


def interpolate_rows(df: DataFrame, black: int, white: int) -> DataFrame:
    """Dense frames whose data holds (bright, dark) at every pixel; the missing exposure is interpolated in EV.

    Red and blue are means of the rows two above and below. Green is the mean of the two nearest
    diagonal samples of the other exposure's next row and the one two rows beyond. White
    neighbours give white, for green only if that is more than their mean.
    """

    def rule(at, y, x):
        def beside(s: int) -> Column:
            cells = [at(s, 1), at(s, -1), at(-2 * s, 0)]
            mean = _raw((_ev(cells[0], black) + _ev(cells[1], black) + _ev(cells[2], black)) / 3.0, black)
            return F.when(F.greatest(*cells) >= white, F.greatest(mean, F.lit(white))).otherwise(mean)

        above, below = at(-2, 0), at(2, 0)
        two = F.when(F.greatest(above, below) >= white, F.lit(white).cast("long")).otherwise(_raw((_ev(above, black) + _ev(below, black)) / 2.0, black))
        green = F.when(y % 2 == 0, beside(-1)).otherwise(beside(1))
        other = F.when((y + x) % 2 == 1, green).otherwise(two)
        own = y % 4 < 2
        return F.struct(F.when(own, at(0, 0)).otherwise(other).alias("bright"), F.when(own, other).otherwise(at(0, 0)).alias("dark"))

    return S.apply(df, rule)


def half_cosine(ev: Column, start: float, over: float) -> Column:
    """0 up to ``start``, 1 from ``start + over`` on, half a cosine between."""
    return F.round((1.0 - F.cos(math.pi * F.least(F.greatest(ev - start, F.lit(0.0)), F.lit(over)) / over)) / 2.0, 9)


def overlap(corr_ev: float, dark_range: float) -> float:
    """EV over which both exposures are mixed: 3 less than they share, 3 at least."""
    shared = dark_range - corr_ev
    return shared - min(3.0, shared - 3.0)


def mix(df: DataFrame, black: int, white: int, corr_ev: float, dark_range: float) -> DataFrame:
    """(bright, dark) to (k, half): an EV mix, all bright in shadows, all dark in highlights."""
    ov = overlap(corr_ev, dark_range)
    start = math.log2(white - black) - ov - corr_ev

    def mixed(c: Column) -> Column:
        return bound(half_cosine(_ev(c["bright"], black), start, ov), lambda k: F.struct(
            c["bright"].alias("bright"), c["dark"].alias("dark"), k.alias("k"), _raw(_ev(c["bright"], black) * (1.0 - k) + _ev(c["dark"], black) * k, black).alias("half"),
        ))

    return df.withColumn("data", F.transform("data", mixed))


def blurred_clipping(df: DataFrame, bright_white: int, white: int) -> DataFrame:
    """Adds ``over`` to the data: 100 where an exposure is clipped, spread to the eight neighbours; three pixels at the border keep the plain value."""

    def clipped(c: Column) -> Column:
        return F.when((c["bright"] >= bright_white) | (c["dark"] >= white), F.lit(100)).otherwise(F.lit(0))

    def rule(at, y, x):
        own = at(0, 0)
        cross = idiv((clipped(at(-1, 0)) + clipped(at(0, -1)) + clipped(at(0, 1)) + clipped(at(1, 0))) * 820, 1024)
        corners = idiv((clipped(at(-1, -1)) + clipped(at(-1, 1)) + clipped(at(1, -1)) + clipped(at(1, 1))) * 657, 1024)
        spread = F.when(S.inside(y, x, 3), clipped(own) + cross + corners).otherwise(clipped(own))
        return F.struct(own["bright"].alias("bright"), own["dark"].alias("dark"), own["k"].alias("k"), own["half"].alias("half"), spread.cast("long").alias("over"))

    return S.apply(df, rule)


def final_blend(df: DataFrame, black: int, bright_white: int, noise: float, alias: str | None = None) -> DataFrame:
    """Full resolution where there is light, aliasing or clipping, the mix elsewhere; never full resolution below the noise."""

    def rule(at, y, x):
        c = at(0, 0)
        native = F.when(y % 4 < 2, F.when(c["bright"] < bright_white, c["bright"]).otherwise(F.greatest(c["bright"], c["dark"]))).otherwise(c["dark"])
        over = F.least(c["over"] / 200.0, F.lit(1.0))
        aliased = F.least(F.get(F.col(alias), (y * F.col("w") + x).cast("int")) / float(ALIAS_MOST), F.lit(1.0)) if alias else F.lit(0.0)
        light = half_cosine(_ev(c["bright"], black), FULL_START, FULL_OVER)
        least = (idiv(c["bright"] + c["dark"], 2) - black) / (4.0 * noise)
        f = F.greatest(F.lit(0.0), F.least(F.greatest(light, over, aliased), least))
        return bound(f, lambda f: F.struct(f.alias("f"), _raw(_ev(c["half"], black) * (1.0 - f) + _ev(native, black) * f, black).alias("val")))

    return S.apply(df, rule)


def merge(df: DataFrame, black: int, white: int, bright_white: int, corr_ev: float, dark_range: float, noise: float, alias: str | None = None) -> DataFrame:
    """The whole chain: interpolation, mix, spread clipping, final blend. frame, y, x, f, val."""
    both = mix(interpolate_rows(df, black, white), black, white, corr_ev, dark_range)
    d = final_blend(blurred_clipping(both, bright_white, white), black, bright_white, noise, alias)
    return T.to_long(d).select("frame", "y", "x", F.round("val.f", 6).alias("f"), "val.val")
