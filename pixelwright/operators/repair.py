"""Sensor repair: bad pixels, listed pixels, pattern noise, stripes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions.exprs import idiv, raw_to_ev, trunc
from . import stencil as S

#: Offsets of the eight nearest pixels of the same colour.
SAME_COLOR = [(dy, dx) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if (dy, dx) != (0, 0)]


def bad_pixels(df: DataFrame, black: int, threshold: int, margin: int = 96) -> DataFrame:
    """Cold and hot pixels at least two pixels inside the frame: frame, y, x, val, kind."""

    def rule(at, y, x):
        around = F.array_sort(F.array(*[at(dy, dx) for dy, dx in SAME_COLOR]))
        v = at(0, 0)
        hot = (v > black + margin) & (raw_to_ev(v, black) - raw_to_ev(F.element_at(around, 7), black) > threshold)
        kind = F.when(v < black - margin, "cold").when(hot, "hot")
        return F.struct(v.alias("v"), F.when(S.inside(y, x, 2), kind).alias("kind"))

    return T.to_long(S.apply(df, rule)).where("val.kind is not null").select("frame", "y", "x", F.col("val.v").alias("val"), "val.kind")


def repair_listed(df: DataFrame, pixel_map: DataFrame) -> DataFrame:
    """Pixels in the map get the mean of four same-colour neighbours; a sensor's map has a fixed size, so it is broadcast."""

    def rule(at, y, x):
        return F.struct(at(0, 0).alias("v"), idiv(at(-2, 0) + at(2, 0) + at(0, -2) + at(0, 2), 4).alias("mean"))

    listed = F.broadcast(pixel_map.select("y", "x").distinct().withColumn("listed", F.lit(True)))
    d = T.to_long(S.apply(df, rule)).join(listed, ["y", "x"], "left")
    repaired = F.coalesce("listed", F.lit(False))
    return d.select("frame", "y", "x", F.when(repaired, F.col("val.mean")).otherwise(F.col("val.v")).alias("val"), repaired.alias("repaired"))


def same_color_median(df: DataFrame, listed: Callable[[Column, Column], Column]) -> DataFrame:
    """Lower median of the eight same-colour neighbours at listed places."""

    def rule(at, y, x):
        return F.when(listed(y, x), F.element_at(F.array_sort(F.array(*[at(dy, dx) for dy, dx in SAME_COLOR])), 4)).otherwise(at(0, 0))

    return S.apply(df, rule)


#: Fixed value: the largest exposure value in 1/65536 steps.
MOST_EV = 14 * 65536 - 1
#: Offsets of a colour's samples within four pixels of one.
WIDE = [(dy, dx) for dy in range(-4, 5, 2) for dx in range(-4, 5, 2) if (dy, dx) != (0, 0)]


def _from_ev(ev: Column, black: int) -> Column:
    coerced = F.least(F.greatest(ev, F.lit(0)), F.lit(MOST_EV))
    return trunc(F.lit(float(black)) + F.round(F.pow(F.lit(2.0), coerced / 65536.0), 4))


def _by_slopes(at, arms: list[tuple[int, int]], black: int) -> Column:
    """Same-colour samples two pixels along each arm, weighted by how little the other colour changes beyond the pixel next to it."""
    ev = lambda v: raw_to_ev(v, black)
    slopes = [F.abs(ev(at(3 * dy, 3 * dx)) - ev(at(dy, dx))) for dy, dx in arms]
    samples = [ev(at(2 * dy, 2 * dx)) for dy, dx in arms]

    def weighted(s: Column) -> Column:
        terms = [F.shiftright(x * idiv((s["sum"] - s[f"d{k}"]) * 256, s["sum"] * (len(arms) - 1)), 8) for k, x in enumerate(samples)]
        fallback = at(0, 2) if arms != VERTICAL else at(2, 0)
        return F.when(s["sum"] == 0, fallback).otherwise(_from_ev(sum(terms[1:], terms[0]), black))

    return S.once(F.struct(sum(slopes[1:], slopes[0]).alias("sum"), *[d.alias(f"d{k}") for k, d in enumerate(slopes)]), weighted)


VERTICAL, HORIZONTAL = [(1, 0), (-1, 0)], [(0, 1), (0, -1)]


def around(at, y: Column, x: Column, black: int) -> Column:
    """Four directions by their slopes."""
    return _by_slopes(at, VERTICAL + HORIZONTAL, black)


def vertical(at, y: Column, x: Column, black: int) -> Column:
    return _by_slopes(at, VERTICAL, black)


def horizontal(at, y: Column, x: Column, black: int) -> Column:
    return _by_slopes(at, HORIZONTAL, black)


def directional(at, y: Column, x: Column, black: int) -> Column:
    """Each direction's two sides are carried on to the pixel by the other colour's slope; the direction with the smaller jump counts more."""
    half = lambda v: F.when(v >= 0, idiv(v, 2)).otherwise(-idiv(-v, 2))

    def sides(dy: int, dx: int) -> tuple[Column, Column]:
        return tuple(at(2 * s * dy, 2 * s * dx) + half(at(s * dy, s * dx) - at(3 * s * dy, 3 * s * dx)) for s in (-1, 1))

    def value(s: Column) -> Column:
        v, h = F.abs(s["a"] - s["b"]), F.abs(s["c"] - s["d"])
        share = F.when(v + h == 0, F.lit(0.5)).otherwise(h / F.nullif(v + h, F.lit(0)))  # of the vertical mean
        made = F.round(share * half(s["a"] + s["b"]) + (1.0 - share) * half(s["c"] + s["d"]), 6)
        return F.least(F.greatest(trunc(made), F.lit(0)), F.lit(65535))

    (a, b), (c, d) = sides(1, 0), sides(0, 1)
    return S.once(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")), value)


def wide_median(at, y: Column, x: Column, black: int) -> Column:
    """Upper median of the samples of this colour within four pixels, as far as they are in the frame."""
    inside = lambda dy, dx: (y + dy >= 0) & (y + dy < F.col("h")) & (x + dx >= 0) & (x + dx < F.col("w"))
    cells = F.array_compact(F.array(*[F.when(inside(dy, dx), at(dy, dx)) for dy, dx in WIDE]))
    return S.once(F.array_sort(cells), lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int")))


METHODS = {"around": around, "vertical": vertical, "horizontal": horizontal, "directional": directional, "median": wide_median}


def repair(df: DataFrame, listed: Callable[[Column, Column], Column], method: str, black: int, border: int = 3) -> DataFrame:
    """New values at listed places at least ``border`` pixels inside (the median reaches to the edge)."""
    rule = METHODS[method]
    r = 0 if method == "median" else border
    return S.apply(df, lambda at, y, x: F.when(listed(y, x) & S.inside(y, x, r), rule(at, y, x, black)).otherwise(at(0, 0)))


#: States of a clip's pixel map: not looked at, to be generated, ready, none.
NOT_LOADED, TO_GENERATE, READY, NO_MAP = range(4)


def map_states(clips: DataFrame, maps: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each clip's way through the states of its pixel map: loaded if there is a map for its camera and mode, else generated if
    the camera's pattern is known, else none (and repair is passed by).

    clips: clip, camera, mode; maps: camera, mode; patterns: camera, pattern. Columns: clip, state, path.
    """
    d = clips.join(maps.select("camera", "mode").distinct().withColumn("has_map", F.lit(True)), ["camera", "mode"], "left")
    d = d.join(patterns.select("camera", "pattern").dropDuplicates(["camera"]), "camera", "left")
    loaded, known = F.coalesce("has_map", F.lit(False)), F.col("pattern").isNotNull()
    state = F.when(loaded | known, READY).otherwise(NO_MAP)
    path = F.when(loaded, F.lit("0>2")).when(known, F.lit("0>1>2")).otherwise(F.lit("0>1>3"))
    return d.select("clip", state.alias("state"), path.alias("path"))
