"""Histograms, order statistics and fits over long pixel tables, as groupings and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bound, clamp16, idiv, trunc


def histogram(px: DataFrame, *keys: str, bin_: Column, white: int | None = None) -> DataFrame:
    """Counts per group and bin; values above white fall into its bin."""
    value = bin_ if white is None else F.least(bin_, F.lit(white))
    return px.groupBy(*keys, value.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cumulative(hist: DataFrame, *keys: str, weight: str = "n") -> DataFrame:
    """Running and whole sums of a histogram in bin order."""
    w = Window.partitionBy(*keys)
    return hist.withColumn("cum", F.sum(weight).over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(weight).over(w))


def upper_median(hist: DataFrame, *keys: str) -> DataFrame:
    """First bin whose cumulative count exceeds half of the count (integer half)."""
    return cumulative(hist, *keys).where(F.col("cum") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min("bin").alias("median"))


def weighted_median(rows: DataFrame, *keys: str) -> DataFrame:
    """First bin whose cumulative weight reaches half of the whole; rows have bin and n."""
    return cumulative(rows, *keys).where(F.col("cum") * 2 >= F.col("total")).groupBy(*keys).agg(F.min("bin").alias("median"))


def percentile(value: str, share: float) -> Column:
    """Aggregate: the smallest value at or above a share of the rows, as a long."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").cast("long")


def lower_median(value: str) -> Column:
    """Aggregate: k-th smallest with k = n/2 - 1 for even n; value is an expression text."""
    return percentile(value, 0.5)


def weighted_line(rows: DataFrame, *keys: str) -> DataFrame:
    """Weighted least squares y = a x + b per group; rows have x, y, w. Null where x does not vary."""
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    g = rows.groupBy(*keys).agg(
        F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * y).alias("swy"), F.sum(w * x * y).alias("swxy"), F.sum(w * x * x).alias("swxx")
    )
    det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    a = F.when(det != 0, (F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy")) / F.nullif(det, F.lit(0)))
    return g.select(*keys, a.alias("a"), ((F.col("swy") - a * F.col("swx")) / F.col("sw")).alias("b"))


def deflicker(df: DataFrame, target: float) -> DataFrame:
    """Dense frames with the gain that brings their 10-bit upper median to the target, and median and correction in EV.

    The sorted array and the gain are each bound once, so a frame costs one sort and one pass.
    """

    def with_median(v: Column) -> Column:
        ranked = F.array_sort(F.transform(v, lambda x: F.shiftright(x, 6)))
        return F.struct(v.alias("v"), F.get(ranked, F.floor(F.size(v) / 2)).alias("median"))

    def with_gain(m: Column) -> Column:
        return F.struct(m["v"].alias("v"), m["median"].alias("median"), (F.lit(target) / F.greatest(m["median"], F.lit(1))).alias("gain"))

    def lit_up(m: Column) -> Column:
        made = F.transform(m["v"], lambda x: clamp16(trunc(x * m["gain"])))
        return F.struct(m["median"].alias("median"), (F.round(F.log2(m["gain"]), 6) + 0.0).alias("correction"), made.alias("data"))

    made = bound(bound(bound(F.col("data"), with_median), with_gain), lit_up)
    return df.select("frame", "h", "w", made.alias("m")).select("frame", "h", "w", "m.*")


def column_noise(df: DataFrame, gradient: int, white: int, least: int = 10) -> DataFrame:
    """Column offsets out of dense frames: the negative lower median of a column's noise, less the frame's lower median offset.

    Noise is a sample less its row's mean. Places on a strong horizontal gradient or at white are
    masked; a column of fewer than ``least`` unmasked samples gets no offset.
    """
    h, w = F.col("h"), F.col("w")
    lower = lambda values: F.get(F.array_sort(values), F.floor((F.size(values) - 1) / 2).cast("int"))

    def with_noise(data: Column) -> Column:
        mean = lambda y: idiv(F.aggregate(F.slice(data, y * w + 1, w), F.lit(0).cast("long"), lambda a, v: a + v), w)
        return F.struct(data.alias("v"), F.transform(F.sequence(F.lit(0), h - 1), mean).alias("mean"))

    def with_offsets(s: Column) -> Column:
        v = s["v"]

        def offset(x: Column) -> Column:
            at = lambda y, xx: F.get(v, (y * w + xx).cast("int"))
            clear = lambda y: (F.abs(at(y, F.greatest(x - 1, F.lit(0))) - at(y, F.least(x + 1, w - 1))) <= gradient) & (at(y, x) < white)
            noise = F.transform(F.filter(F.sequence(F.lit(0), h - 1), clear), lambda y: at(y, x) - F.get(s["mean"], y))
            return bound(noise, lambda values: F.when(F.size(values) < least, F.lit(0).cast("long")).otherwise(-lower(values)))

        return F.struct(v.alias("v"), F.transform(F.sequence(F.lit(0), w - 1), offset).alias("off"))

    def with_middle(s: Column) -> Column:
        return F.struct(s["v"].alias("v"), s["off"].alias("off"), lower(s["off"]).alias("mid"))

    def applied(s: Column) -> Column:
        moved = lambda v, i: F.least(F.greatest(v + F.get(s["off"], (i % w).cast("int")), F.lit(-32767)), F.lit(32767)) - s["mid"]
        return F.transform(s["v"], lambda v, i: F.greatest(F.lit(0), F.least(F.lit(32760), moved(v, i))))

    return df.withColumn("data", bound(bound(bound(bound(F.col("data"), with_noise), with_offsets), with_middle), applied))


def _at_share(counts: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the least values at or above shares of the counts."""
    hist = counts.groupBy(key, F.col(value).alias("bin")).agg(F.sum("n").alias("n"))
    c = cumulative(hist, key)
    return c.groupBy(key).agg(*[F.min(F.when(F.col("cum") >= F.col("total") * share, F.col("bin"))).alias(name) for name, share in shares.items()])


def slope_scan(pairs: DataFrame, key: str, residual: float, low: float = 0.98, high: float = 0.999, steps: int = 601, step: float = 0.01) -> DataFrame:
    """Per key the exposure difference under which most dark samples follow their bright ones; the first best wins.

    pairs: key, b, d, n (how often). Points are those with b strictly between two shares of b; d is
    expected at md + (b - mb) / 2^ev around the medians.
    """
    limits = _at_share(pairs, key, "b", {"lo": low, "hi": high, "mb": 0.5}).join(_at_share(pairs, key, "d", {"md": 0.5}), key)
    points = pairs.join(limits, key).where("b > lo and b < hi")
    ratios = F.broadcast(pairs.sparkSession.createDataFrame([(k, round(2.0 ** (-k * step), 12)) for k in range(steps)], "step long, ratio double"))  # a grid of fixed size
    off = F.abs(F.col("d") - F.col("md") - (F.col("b") - F.col("mb")) * F.col("ratio"))
    scores = points.crossJoin(ratios).groupBy(key, "step").agg(F.sum(F.when(off < residual, F.col("n")).otherwise(0)).alias("score"))
    best = scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("step")).alias("s"))).alias("m"))
    return best.select(key, (-F.col("m.s") * step).alias("ev"), F.col("m.score").alias("score"))


def neighbourhood_mean(rgb: DataFrame, points: Sequence[tuple[int, int]], radius: int = 10) -> DataFrame:
    """Mean colour of the square around each picked point, clipped at the edges; points are given by the caller, so few."""
    picked = F.broadcast(rgb.sparkSession.createDataFrame(list(points), "py long, px long"))
    near = (F.abs(F.col("y") - F.col("py")) <= radius) & (F.abs(F.col("x") - F.col("px")) <= radius)
    return rgb.join(picked, near).groupBy("frame", "py", "px").agg(*[(F.round(F.avg(c), 6) + 0.0).alias(c) for c in "rgb"])


def export_progress(done: DataFrame, key: str, order: str, seconds: str) -> DataFrame:
    """Per exported frame of a queue: frames done and to do, seconds gone, and the estimated rest at the mean pace so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = done.withColumn("done", F.count(F.lit(1)).over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("gone", F.sum(seconds).over(w))
    rest = idiv(F.col("total") * F.col("gone"), F.col("done")) - F.col("gone")
    clock = F.format_string("ETA: %02dh%02dm%02ds", idiv(rest, 3600), idiv(rest, 60) % 60, rest % 60)
    return d.select(key, order, "done", (F.col("total") - F.col("done")).alias("to_do"), "gone", rest.alias("rest"), clock.alias("eta"))


def stripe_gains(df: DataFrame, black: int, white: int, least_weight: int = 0, period: int = 8) -> DataFrame:
    """Gain of each column of a period of eight relative to the next period's first: weighted medians of log ratios.

    Green samples only (RGGB): odd columns come from the even row, even ones from the row below. A
    column is interpolated linearly to the place of the first column of the next period, so that
    smooth gradients cancel out. Ratios are counted in bins before any shuffle: a frame sends
    at most 65,536 bins a column. Columns: c, bin, coef, needed (off by over 0.002).
    """
    w = F.col("w")

    def ratios(data: Column) -> Column:
        blocks = F.sequence(F.lit(0), (F.floor(F.col("h") / 2) * (F.floor(w / period) - 1) - 1).cast("int"))

        def block(q: Column) -> Column:
            per_row = F.floor(w / period) - 1
            top, left = F.floor(q / per_row) * 2, (q % per_row) * period
            cell = lambda row, column: F.get(data, ((top + row) * w + left + column).cast("int")) - black
            target = cell(1, period)
            other = lambda k: idiv(cell(1 - k % 2, k) * k + cell(1 - k % 2, period + k) * (period - k), period)
            return F.array(*[F.struct(F.lit(k).cast("long").alias("c"), target.alias("a"), other(k).alias("b")) for k in range(1, period)])

        return F.flatten(F.transform(blocks, block))

    d = df.select(F.explode(bound(F.col("data"), ratios)).alias("p")).select("p.*").where((F.least("a", "b") >= 32) & (F.greatest("a", "b") <= (white - black) / 1.1))
    bin_ = F.floor(F.lit(32768) + 32768 * F.round(F.log2(F.col("a").cast("double") / F.col("b")), 9))
    h = d.groupBy("c", F.least(F.greatest(bin_, F.lit(0)), F.lit(65535)).alias("bin")).agg(F.sum(trunc(F.log2(F.col("a").cast("double")))).alias("n"))
    m = weighted_median(cumulative(h, "c").where(F.col("total") >= least_weight).select("c", "bin", "n"), "c")
    coef = trunc(F.round(F.pow(F.lit(2.0), (F.col("median") - 32768) / 32768.0) * 65536, 6))
    return m.select("c", F.col("median").alias("bin"), coef.alias("coef"), (F.abs(coef / 65536.0 - 1) > 0.002).alias("needed"))
