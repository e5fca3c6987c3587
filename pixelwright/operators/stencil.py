"""Stencils over dense frames: every operator stays within one frame's row, so none shuffles.

An operator takes a DataFrame (frame, h, w, data) and returns it with new data. Edge policies:
replicate (the nearest pixel), zero, and keep (border pixels stay as they are).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bound as once
from ..functions.exprs import clamp16, idiv, trunc

At = Callable[[int, int], Column]


def apply(df: DataFrame, rule: Callable[[At, Column, Column], Column], edge: str = "replicate", column: str = "data") -> DataFrame:
    """New value of each pixel by rule(at, y, x); at(dy, dx) reads a neighbour under the edge policy."""
    h, w = F.col("h"), F.col("w")

    def made(data: Column) -> Column:
        def pixel(_: Column, i: Column) -> Column:
            y, x = F.floor(i / w), i % w

            def at(dy: int, dx: int) -> Column:
                yy, xx = y + dy, x + dx
                if edge == "replicate":
                    return F.get(data, F.least(F.greatest(yy, F.lit(0)), h - 1) * w + F.least(F.greatest(xx, F.lit(0)), w - 1))
                inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
                return F.when(inside, F.get(data, yy * w + xx)).otherwise(F.lit(0))

            return rule(at, y, x)

        return F.transform(data, pixel)

    return df.withColumn(column, once(F.col(column), made))


def inside(y: Column, x: Column, r: int) -> Column:
    return (y >= r) & (y < F.col("h") - r) & (x >= r) & (x < F.col("w") - r)


def box_blur(df: DataFrame, r: int) -> DataFrame:
    """Separable mean with replicated edges and an integer division after each pass."""
    n = 2 * r + 1
    total = lambda cells: sum(cells[1:], cells[0])
    rows = apply(df, lambda at, y, x: idiv(total([at(0, k) for k in range(-r, r + 1)]), n))
    return apply(rows, lambda at, y, x: idiv(total([at(k, 0) for k in range(-r, r + 1)]), n))


def median_filter(df: DataFrame, size: int = 3, strength: float = 1.0) -> DataFrame:
    """Mix of a pixel with the median of its square; the border keeps its values."""
    r = size // 2

    def rule(at: At, y: Column, x: Column) -> Column:
        cells = F.array_sort(F.array(*[at(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]))
        mixed = trunc(F.element_at(cells, size * size // 2 + 1) * F.lit(strength) + at(0, 0) * F.lit(1 - strength))
        return F.when(inside(y, x, r), mixed).otherwise(at(0, 0))

    return apply(df, rule)


def sobel(df: DataFrame, direction: str) -> DataFrame:
    """Signed horizontal or vertical gradient with zeros beyond the edge."""
    if direction == "h":
        weights = {(dy, dx): dx * (2 - abs(dy)) for dy in (-1, 0, 1) for dx in (-1, 1)}
    else:
        weights = {(dy, dx): dy * (2 - abs(dx)) for dx in (-1, 0, 1) for dy in (-1, 1)}

    def rule(at: At, y: Column, x: Column) -> Column:
        total = F.lit(0)
        for (dy, dx), k in weights.items():
            total = total + at(dy, dx) * k
        return total

    return apply(df, rule, "zero")


def sharpen(df: DataFrame, amount: float, bias: float = 0.0) -> DataFrame:
    """Cross-shaped sharpening, one strength per axis, edges replicated."""
    s = amount**1.5 * 0.55
    sx, sy = s * (1 - bias), s * (1 + bias)

    def rule(at: At, y: Column, x: Column) -> Column:
        around = trunc(at(-1, 0) * F.lit(sy)) + trunc(at(1, 0) * F.lit(sy)) + trunc(at(0, -1) * F.lit(sx)) + trunc(at(0, 1) * F.lit(sx))
        return clamp16(trunc(at(0, 0) * F.lit(1 + 2 * sx + 2 * sy)) - around)

    return apply(df, rule)


def horizontal_gradient(df: DataFrame) -> DataFrame:
    """in[i-2] - in[i+2], 0 within two pixels of the sides."""
    return apply(df, lambda at, y, x: F.when((x >= 2) & (x < F.col("w") - 2), at(0, -2) - at(0, 2)).otherwise(F.lit(0)))


def bilinear_demosaic(df: DataFrame, color: str) -> DataFrame:
    """One colour plane of an RGGB frame: missing samples are means of the nearest of that colour, in the interior.

    Border pixels take the plane's value of the nearest interior pixel.
    """

    def mean(cells: list[Column]) -> Column:
        return idiv(sum(cells[1:], cells[0]), len(cells))

    def rule(at: At, y: Column, x: Column) -> Column:
        cross = mean([at(-1, 0), at(1, 0), at(0, -1), at(0, 1)])
        corners = mean([at(-1, -1), at(-1, 1), at(1, -1), at(1, 1)])
        rows, columns = mean([at(0, -1), at(0, 1)]), mean([at(-1, 0), at(1, 0)])
        even_y, even_x = y % 2 == 0, x % 2 == 0
        if color == "g":
            return F.when(even_y == even_x, cross).otherwise(at(0, 0))
        own, level = ((even_y & even_x), (even_y & ~even_x)) if color == "r" else ((~even_y & ~even_x), (~even_y & even_x))
        other = (~even_y & ~even_x) if color == "r" else (even_y & even_x)
        return F.when(own, at(0, 0)).when(level, rows).when(other, corners).otherwise(columns)

    plane = apply(df, rule, "replicate")
    h, w = F.col("h"), F.col("w")

    def border(data: Column, i: Column) -> Column:
        y, x = F.floor(i / w), i % w
        yy, xx = F.least(F.greatest(y, F.lit(1)), h - 2), F.least(F.greatest(x, F.lit(1)), w - 2)
        return F.get(data, yy * w + xx)

    return plane.withColumn("data", once(F.col("data"), lambda data: F.transform(data, lambda _, i: border(data, i))))


#: Gradient-corrected linear interpolation (Malvar, He and Cutler, 2004), weights in sixteenths
#: by offset. cross: green at red or blue; row: the colour whose samples lie in this row, at green;
#: diagonal: red at blue and the reverse. A column filter is the transposed row filter.
CORRECTED = {
    "cross": {(0, 0): 8, (-1, 0): 4, (1, 0): 4, (0, -1): 4, (0, 1): 4, (-2, 0): -2, (2, 0): -2, (0, -2): -2, (0, 2): -2},
    "row": {(0, 0): 10, (0, -1): 8, (0, 1): 8, (-1, -1): -2, (-1, 1): -2, (1, -1): -2, (1, 1): -2, (0, -2): -2, (0, 2): -2, (-2, 0): 1, (2, 0): 1},
    "diagonal": {(0, 0): 12, (-1, -1): 4, (-1, 1): 4, (1, -1): 4, (1, 1): 4, (-2, 0): -3, (2, 0): -3, (0, -2): -3, (0, 2): -3},
}
CORRECTED["column"] = {(x, y): k for (y, x), k in CORRECTED["row"].items()}


def corrected_demosaic(df: DataFrame, top: int) -> DataFrame:
    """All three colours of an RGGB frame: bilinear means corrected by the gradient of the colour that is known."""

    def rule(at: At, y: Column, x: Column) -> Column:
        def filtered(name: str) -> Column:
            total = F.lit(0)
            for (dy, dx), k in CORRECTED[name].items():
                total = total + at(dy, dx) * k
            return F.greatest(F.lit(0), F.least(F.lit(top), F.floor(total / 16)))

        even_y, even_x = y % 2 == 0, x % 2 == 0
        own = at(0, 0)
        red = F.when(even_y & even_x, own).when(even_y, filtered("row")).when(even_x, filtered("column")).otherwise(filtered("diagonal"))
        blue = F.when(~even_y & ~even_x, own).when(~even_y, filtered("row")).when(~even_x, filtered("column")).otherwise(filtered("diagonal"))
        green = F.when(even_y == even_x, filtered("cross")).otherwise(own)
        return F.struct(red.cast("long").alias("r"), green.cast("long").alias("g"), blue.cast("long").alias("b"))

    return apply(df, rule)


def rotate_180(df: DataFrame) -> DataFrame:
    return df.withColumn("data", F.reverse("data"))


def transpose(df: DataFrame) -> DataFrame:
    h, w = F.col("h"), F.col("w")
    turned = once(F.col("data"), lambda data: F.transform(data, lambda _, i: F.get(data, (i % h) * w + F.floor(i / h))))
    return df.withColumn("data", turned).select(*[
        F.col("w").alias("h") if c == "h" else F.col("h").alias("w") if c == "w" else F.col(c) for c in df.columns
    ])


def drop_first(df: DataFrame, rows: int = 0, columns: int = 0) -> DataFrame:
    """Shift a frame up and left by single rows or columns; the freed edge copies its second neighbour inward."""
    h, w = F.col("h"), F.col("w")

    def pixel(data: Column, i: Column) -> Column:
        y, x = F.floor(i / w) + rows, i % w + columns
        return F.get(data, F.when(y >= h, h - 2).otherwise(y) * w + F.when(x >= w, w - 2).otherwise(x))

    return df.withColumn("data", once(F.col("data"), lambda data: F.transform(data, lambda _, i: pixel(data, i))))
