"""Aggregates: histograms, medians, noise, fits, scopes, audio envelopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import exprs as X
from ..operators import stats as A
from ..operators import stencil as S
from ..operators import whitebalance
from .common import DENSE, PX, RGB, clamp, r6, trunc, with_dense, with_index, with_px, with_rgb
from .point_queries import KNOTS
from .registry import query

_b, _w = 2048 << 2, int((15000 << 2) * 0.993)
LEVEL = clamp(trunc(f"(val * 4 - {_b}) * CAST(65535 AS DOUBLE) / CAST({_w - _b} AS DOUBLE)"))
_flag = f"""lv AS (SELECT frame, y, x, {LEVEL} AS v FROM px),
h AS (SELECT frame, v >> 6 AS bin, count(*) AS n FROM lv GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY frame) AS total FROM h),
m AS (SELECT frame, min(bin) AS median FROM c WHERE cum > total // 2 GROUP BY frame)
SELECT frame, y, x, m.median, {r6('log2(512.0 / greatest(m.median, 1))')} AS correction, {clamp(trunc('v * (512.0 / greatest(m.median, 1))'))} AS val FROM lv JOIN m USING (frame)"""


@query("a27_deflicker", f"WITH {PX}, {_flag}")
def a27(spark, sf):
    """Levels, upper median of the 10-bit values and a gain per frame, all within the frame's row: no shuffle."""
    lv = F.transform("data", lambda v: X.levels(v * 4, 2048, 15000))

    f = A.deflicker(T.frames(spark, sf).withColumn("data", lv), target=512.0)
    return T.to_long(f, "median", "correction").select("frame", "y", "x", "median", "correction", "val")


@query("a1_histogram", with_px("SELECT frame, least(val, 12000) >> 6 AS bin, count(*) AS n FROM px GROUP BY ALL"))
def a1(spark, sf):
    return A.histogram(T.px(spark, sf), "frame", bin_=F.shiftright(F.least(F.col("val"), F.lit(12000)), 6))


@query("a2_upper_median", with_px("SELECT frame, min(bin) AS median FROM (SELECT frame, bin, sum(n) OVER (PARTITION BY frame ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY frame) AS total FROM (SELECT frame, val AS bin, count(*) AS n FROM px GROUP BY ALL)) WHERE cum > total // 2 GROUP BY frame"))
def a2(spark, sf):
    return A.upper_median(A.histogram(T.px(spark, sf), "frame", bin_=F.col("val")), "frame")


@query("a3_lower_median", with_px("SELECT frame, quantile_disc(val, 0.5) AS median, quantile_disc(val, 0.98) AS p98, list_sort(list(val))[10] AS tenth FROM px GROUP BY frame"))
def a3(spark, sf):
    """Order statistics of the dense row: k-th smallest by sorting within the frame."""
    f = T.frames(spark, sf).select("frame", F.array_sort("data").alias("s"), F.size("data").alias("n"))
    at = lambda share: F.get("s", F.ceil(F.col("n") * share).cast("int") - 1)
    return f.select("frame", at(0.5).alias("median"), at(0.98).alias("p98"), F.get("s", F.lit(9)).alias("tenth"))


_five = "list_sort([val, " + ", ".join(f"a[least(greatest(y + {dy}, 0), 7) * 8 + least(greatest(x + {dx}, 0), 7) + 1]" for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))) + "])"


@query("a4_small_medians", with_dense(f"SELECT frame, y, x, {_five}[3] AS med5, {_five}[2] AS second FROM pd"))
def a4(spark, sf):
    def rule(at, y, x):
        cells = F.array_sort(F.array(at(0, 0), at(-1, 0), at(1, 0), at(0, -1), at(0, 1)))
        return F.struct(F.element_at(cells, 3).alias("med5"), F.element_at(cells, 2).alias("second"))

    return T.to_long(S.apply(T.frames(spark, sf), rule)).select("frame", "y", "x", "val.*")


@query("a5_black_noise", with_px(f"SELECT frame, {r6('avg(val)')} AS mean, {r6('coalesce(stddev_samp(val), 8)')} AS noise FROM px WHERE x < 2 GROUP BY frame"))
def a5(spark, sf):
    d = T.px(spark, sf).where("x < 2").groupBy("frame")
    return d.agg(F.round(F.avg("val"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("val"), F.lit(8.0)), 6).alias("noise"))


@query("a6_row_class_noise", with_px(f"SELECT frame, {r6('min(s)')} AS least, {r6('max(s)')} AS most, {r6('log2(max(s) / min(s))')} AS ev FROM (SELECT frame, y % 4 AS c, stddev_samp(val) AS s FROM px GROUP BY ALL) GROUP BY frame"))
def a6(spark, sf):
    classes = T.px(spark, sf).groupBy("frame", (F.col("y") % 4).alias("c")).agg(F.stddev_samp("val").alias("s"))
    return classes.groupBy("frame").agg(F.round(F.min("s"), 6).alias("least"), F.round(F.max("s"), 6).alias("most"), (F.round(F.log2(F.max("s") / F.min("s")), 6) + 0.0).alias("ev"))


@query("a7_o2_white_level", with_px("SELECT frame, c, least(greatest(val - 100, 6000), 16383) AS white FROM (SELECT frame, y % 4 AS c, val, row_number() OVER (PARTITION BY frame, y % 4 ORDER BY val DESC, y, x) AS k FROM px) WHERE k = 4"))
def a7(spark, sf):
    """The brightest three of each row class are left out."""
    w = Window.partitionBy("frame", "c").orderBy(F.desc("val"), "y", "x")
    d = T.px(spark, sf).withColumn("c", F.col("y") % 4).withColumn("k", F.row_number().over(w)).where("k = 4")
    return d.select("frame", "c", X.clamp(F.col("val") - 100, 6000, 16383).alias("white"))


_disp = "(100 * ln(n) + n / 10.0)"


@query("a8_channel_histogram", f"WITH {RGB}, u AS (SELECT frame, 'r' AS channel, r >> 8 AS bin FROM rgb UNION ALL SELECT frame, 'g', g >> 8 FROM rgb UNION ALL SELECT frame, 'b', b >> 8 FROM rgb), h AS (SELECT channel, bin, count(*) AS n FROM u GROUP BY ALL) SELECT channel, bin, n, {r6(f'{_disp} / max(CASE WHEN bin BETWEEN 3 AND 252 THEN {_disp} END) OVER (PARTITION BY channel)')} AS shown FROM h")
def a8(spark, sf):
    """One unpivot, one grouping; the display scale is a window over 256 bins a channel."""
    u = T.rgb(spark, sf).select(F.expr("stack(3, 'r', r, 'g', g, 'b', b) AS (channel, v)"))
    h = u.groupBy("channel", F.shiftright("v", 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    shown = 100 * F.ln("n") + F.col("n") / 10.0
    top = F.max(F.when(F.col("bin").between(3, 252), shown)).over(Window.partitionBy("channel"))
    return h.select("channel", "bin", "n", (F.round(shown / top, 6) + 0.0).alias("shown"))


@query("a9_a10_waveform_parade", with_rgb("SELECT x // 2 AS bucket, 'r' AS channel, r >> 8 AS level, count(*) AS n FROM rgb WHERE x % 2 = 0 GROUP BY ALL UNION ALL SELECT x // 2, 'g', g >> 8, count(*) FROM rgb WHERE x % 2 = 0 GROUP BY ALL UNION ALL SELECT x // 2, 'b', b >> 8, count(*) FROM rgb WHERE x % 2 = 0 GROUP BY ALL"))
def a9(spark, sf):
    d = T.rgb(spark, sf).where("x % 2 = 0").select(X.idiv(F.col("x"), 2).alias("bucket"), F.expr("stack(3, 'r', r, 'g', g, 'b', b) AS (channel, v)"))
    return d.groupBy("bucket", "channel", F.shiftright("v", 8).alias("level")).agg(F.count(F.lit(1)).alias("n"))


_u = trunc("128 + (-0.169 * (r >> 8) - 0.331 * (g >> 8) + 0.5 * (b >> 8))")
_v = trunc("128 + (0.5 * (r >> 8) - 0.419 * (g >> 8) - 0.081 * (b >> 8))")


@query("a11_vector_scope", with_rgb(f"SELECT u, v, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY 4 * r + 11 * g + b DESC, r DESC, g DESC, b DESC) AS k FROM (SELECT r, g, b, {_u} AS u, {_v} AS v FROM rgb)) WHERE k = 1"))
def a11(spark, sf):
    """The lightest colour of each cell, by a map-side aggregate instead of a ranked sort."""
    r8, g8, b8 = (F.shiftright(c, 8) for c in "rgb")
    u, v = X.trunc(F.lit(128) + (r8 * -0.169 - g8 * 0.331 + b8 * 0.5)), X.trunc(F.lit(128) + (r8 * 0.5 - g8 * 0.419 - b8 * 0.081))
    light = F.struct((F.col("r") * 4 + F.col("g") * 11 + F.col("b")).alias("l"), "r", "g", "b")
    return T.rgb(spark, sf).groupBy(u.alias("u"), v.alias("v")).agg(F.max(light).alias("m")).select("u", "v", "m.r", "m.g", "m.b")


@query("a12_phase_cdf_difference", with_px("SELECT a.c AS c, CAST(sum(abs(a.cum - b.cum)) AS BIGINT) AS difference FROM (SELECT c, g.bin, coalesce((SELECT sum(h.n) FROM (SELECT (y % 2) * 2 + x % 2 AS c, val >> 10 AS bin, count(*) AS n FROM px GROUP BY ALL) h WHERE h.c = k.c AND h.bin <= g.bin), 0) AS cum FROM (SELECT unnest(range(0, 16)) AS bin) g, (SELECT unnest(range(0, 4)) AS c) k) a JOIN (SELECT g.bin, coalesce((SELECT sum(h.n) FROM (SELECT (y % 2) * 2 + x % 2 AS c, val >> 10 AS bin, count(*) AS n FROM px GROUP BY ALL) h WHERE h.c = 1 AND h.bin <= g.bin), 0) AS cum FROM (SELECT unnest(range(0, 16)) AS bin) g) b USING (bin) GROUP BY a.c"))
def a12(spark, sf):
    """Cumulative histograms of the four Bayer phases against that of phase 1."""
    phase = ((F.col("y") % 2) * 2 + F.col("x") % 2).alias("c")
    h = T.px(spark, sf).groupBy(phase, F.shiftright("val", 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(4).select(F.col("id").alias("c")).join(spark.range(16).select(F.col("id").alias("bin")))  # 64 rows
    cum = grid.join(h, ["c", "bin"], "left").select("c", "bin", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    one = cum.where("c = 1").select("bin", F.col("cum").alias("one"))
    return cum.join(one, "bin").groupBy("c").agg(F.sum(F.abs(F.col("cum") - F.col("one"))).alias("difference"))


@query("a13_a14_bright_dark_rows", with_px("SELECT frame, c, p, CASE WHEN p > avg(p) OVER (PARTITION BY frame) THEN 'bright' ELSE 'dark' END AS kind FROM (SELECT frame, y % 4 AS c, quantile_disc(val, 0.75) AS p FROM px GROUP BY ALL)"))
def a13(spark, sf):
    rows = T.px(spark, sf).groupBy("frame", (F.col("y") % 4).alias("c")).agg(A.percentile("val", 0.75).alias("p"))
    return rows.withColumn("kind", F.when(F.col("p") > F.avg("p").over(Window.partitionBy("frame")), "bright").otherwise("dark"))


@query("a15_weighted_least_squares", with_px(f"SELECT frame, {r6('(sw * swxy - swx * swy) / nullif(sw * swxx - swx * swx, 0)')} AS a, {r6('(swy - (sw * swxy - swx * swy) / nullif(sw * swxx - swx * swx, 0) * swx) / sw')} AS b FROM (SELECT frame, sum(w) AS sw, sum(w * x) AS swx, sum(w * v) AS swy, sum(w * x * v) AS swxy, sum(w * x * x) AS swxx FROM (SELECT frame, CAST(x AS DOUBLE) AS x, CAST(val AS DOUBLE) AS v, CAST(1 + y AS DOUBLE) AS w FROM px) GROUP BY frame)"))
def a15(spark, sf):
    d = T.px(spark, sf).select("frame", F.col("x").cast("double").alias("x"), F.col("val").cast("double").alias("y"), (F.col("y") + 1).cast("double").alias("w"))
    return A.weighted_line(d, "frame").select("frame", (F.round("a", 6) + 0.0).alias("a"), (F.round("b", 6) + 0.0).alias("b"))


_A16 = """pairs AS (SELECT label, p.val AS b, q.val AS d, count(*) AS n FROM px p JOIN embeddings ON vec_id = p.frame JOIN px q ON q.frame = p.frame AND q.x = p.x AND q.y = p.y + 2 WHERE p.y % 4 < 2 AND p.val < 15000 GROUP BY ALL),
cb AS (SELECT label, b, sum(n) OVER (PARTITION BY label ORDER BY b) AS cum, sum(n) OVER (PARTITION BY label) AS total FROM (SELECT label, b, sum(n) AS n FROM pairs GROUP BY ALL)),
cd AS (SELECT label, d, sum(n) OVER (PARTITION BY label ORDER BY d) AS cum, sum(n) OVER (PARTITION BY label) AS total FROM (SELECT label, d, sum(n) AS n FROM pairs GROUP BY ALL)),
lim AS (SELECT label, min(CASE WHEN cum >= total * 0.98 THEN b END) AS lo, min(CASE WHEN cum >= total * 0.999 THEN b END) AS hi, min(CASE WHEN cum * 2 >= total THEN b END) AS mb FROM cb GROUP BY label),
md AS (SELECT label, min(CASE WHEN cum * 2 >= total THEN d END) AS md FROM cd GROUP BY label),
pts AS (SELECT label, b, d, n, mb, md FROM pairs JOIN lim USING (label) JOIN md USING (label) WHERE b > lo AND b < hi),
sc AS (SELECT label, step, sum(CASE WHEN abs(d - md - (b - mb) * round(pow(2.0, -step / 100.0), 12)) < 50 THEN n ELSE 0 END) AS score FROM pts, (SELECT unnest(range(0, 601)) AS step) g GROUP BY ALL)
SELECT label, step / 100.0 AS ev, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, step) AS k FROM sc) WHERE k = 1"""


@query("a16_j12_slope_scan", f"WITH {PX}, {_A16}")
def a16(spark, sf):
    """For slopes from 0 to 6 in steps of 0.01 count the pairs of the brightest rows' percentile window that fit, keep the first best.

    Pairs are made within a frame's row and counted by value before anything is compared, so a
    clip's work is bounded by its distinct pairs in the window, whatever its number of frames.
    """
    f = T.frames(spark, sf, "label")
    w = F.col("w")
    pair = lambda v, i: F.struct(F.floor(i / w).alias("y"), v.alias("b"), F.get("data", i + w * 2).alias("d"))
    p = f.select("label", F.explode(F.transform("data", pair)).alias("p")).select("label", "p.*").where("y % 4 < 2 and b < 15000 and d is not null")
    return A.slope_scan(p.groupBy("label", "b", "d").agg(F.count(F.lit(1)).alias("n")), "label", residual=50)


#: Frames of a label side by side, 8 x 24 pixels, as rows of a wider frame: tile t, samples by place.
_A17 = """tall AS (SELECT label, list(a ORDER BY vec_id) AS fs FROM d JOIN embeddings ON vec_id = frame GROUP BY label),
tiles AS (SELECT unnest(range(0, len(fs) // 3)) AS t, fs FROM tall),
cells AS (SELECT q AS row, k, fs[3 * t + 1] AS f0, fs[3 * t + 2] AS f1, fs[3 * t + 3] AS f2, b FROM tiles, (SELECT unnest(range(0, 4)) AS q) r, (SELECT unnest(range(1, 8)) AS k) c, (SELECT unnest([0, 1]) AS b) bb),
two AS (SELECT k, row, CASE WHEN b = 0 THEN f0 ELSE f1 END AS l, CASE WHEN b = 0 THEN f1 ELSE f2 END AS n FROM cells),
ab AS (SELECT k, n[(2 * row + 1) * 8 + 1] - 2048 AS a, ((l[(2 * row + 1 - k % 2) * 8 + k + 1] - 2048) * k + (n[(2 * row + 1 - k % 2) * 8 + k + 1] - 2048) * (8 - k)) // 8 AS b FROM two),
bins AS (SELECT k AS c, least(greatest(CAST(floor(32768 + 32768 * round(log2(CAST(a AS DOUBLE) / b), 9)) AS BIGINT), 0), 65535) AS bin, CAST(trunc(log2(CAST(a AS DOUBLE))) AS BIGINT) AS w FROM ab WHERE least(a, b) >= 32 AND greatest(a, b) <= (15000 - 2048) / 1.1::DOUBLE),
cum AS (SELECT c, bin, sum(w) OVER (PARTITION BY c ORDER BY bin) AS cum, sum(w) OVER (PARTITION BY c) AS total FROM (SELECT c, bin, sum(w) AS w FROM bins GROUP BY ALL)),
med AS (SELECT c, min(bin) AS bin FROM cum WHERE cum * 2 >= total GROUP BY c)
SELECT c, bin, CAST(trunc(round(pow(2.0, (bin - 32768) / 32768.0::DOUBLE) * 65536, 6)) AS BIGINT) AS coef, abs(CAST(trunc(round(pow(2.0, (bin - 32768) / 32768.0::DOUBLE) * 65536, 6)) AS BIGINT) / 65536.0::DOUBLE - 1) > 0.002 AS needed FROM med"""


@query("a17_stripe_gain", f"WITH {DENSE}, {_A17}")
def a17(spark, sf):
    """Seven column gains by weighted medians of log ratios; three frames of a label side by side make one of 8 x 24 pixels."""
    f = T.frames(spark, sf, "label")
    numbered = f.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("frame")) - 1).withColumn("t", X.idiv(F.col("k"), 3))
    g = numbered.groupBy("label", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "data"))), lambda s: s["data"]).alias("fs")).where(F.size("fs") == 3)
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.flatten(F.transform("fs", lambda a: F.slice(a, y * 8 + 1, 8)))))
    return A.stripe_gains(g.select(F.lit(8).alias("h"), F.lit(24).alias("w"), wide.alias("data")), black=2048, white=15000)


#: Of a frame list a: its row means, gradient mask, noise by place, offsets (0 below the least count of samples) and their lower median.
_A18 = with_dense("""SELECT frame, (p - 1) // 8 AS y, (p - 1) % 8 AS x, greatest(0, least(32760, least(greatest(a[p] + offs[(p - 1) % 8 + 1], -32767), 32767) - list_sort(offs)[4])) AS val
FROM (SELECT frame, a, list_transform(range(0, 8), lambda x: CASE WHEN len(cols[x + 1]) < 4 THEN 0 ELSE -list_sort(cols[x + 1])[(len(cols[x + 1]) + 1) // 2] END) AS offs
  FROM (SELECT frame, a, list_transform(range(0, 8), lambda x: list_transform(
      list_filter(range(0, 8), lambda y: abs(a[y * 8 + greatest(x - 1, 0) + 1] - a[y * 8 + least(x + 1, 7) + 1]) <= 5000 AND a[y * 8 + x + 1] < 15000),
      lambda y: a[y * 8 + x + 1] - CAST(list_sum(a[y * 8 + 1 : y * 8 + 8]) AS BIGINT) // 8)) AS cols FROM d)), (SELECT unnest(range(1, 65)) AS p) r""")


@query("a18_column_noise", _A18)
def a18(spark, sf):
    """Column offsets from the noise at unmasked places, all within the frame's row (at least 4 of 8 samples here; 10 in a whole frame)."""
    return T.to_long(A.column_noise(T.frames(spark, sf), gradient=5000, white=15000, least=4))


@query("a19_highest_green_peak", with_rgb("SELECT max(bin) AS peak FROM (SELECT bin, n, lag(n, 1, 0) OVER (ORDER BY bin) AS before, lead(n, 1, 0) OVER (ORDER BY bin) AS after FROM (SELECT k.bin, count(g) AS n FROM (SELECT unnest(range(0, 256)) AS bin) k LEFT JOIN rgb ON (g >> 8) = k.bin GROUP BY ALL)) WHERE n > before AND n >= after AND n > 3"))
def a19(spark, sf):
    """Right-most local maximum of a 256-bin histogram; the windows run over its 256 rows only."""
    h = T.rgb(spark, sf).groupBy(F.shiftright("g", 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = spark.range(256).select(F.col("id").alias("bin")).join(h, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy("bin")
    peaks = full.withColumn("before", F.lag("n", 1, 0).over(w)).withColumn("after", F.lead("n", 1, 0).over(w)).where("n > before and n >= after and n > 3")
    return peaks.agg(F.max("bin").alias("peak"))


@query("a20_area_downscale", with_px("SELECT frame, y // 4 AS y, x // 4 AS x, CAST(sum(val) AS BIGINT) // 16 AS val FROM px GROUP BY ALL"))
def a20(spark, sf):
    g = T.px(spark, sf).groupBy("frame", X.idiv(F.col("y"), 4).alias("y"), X.idiv(F.col("x"), 4).alias("x"))
    return g.agg(X.idiv(F.sum("val"), 16).alias("val"))


@query("a23_neighbourhood_mean", with_rgb(f"SELECT frame, py, px, {', '.join(f'{r6(f'avg({c})')} AS {c}' for c in 'rgb')} FROM rgb, (VALUES (1, 2), (0, 0), (3, 3)) q(py, px) WHERE abs(y - py) <= 10 AND abs(x - px) <= 10 GROUP BY frame, py, px"))
def a23(spark, sf):
    """Mean of the 21 x 21 square around picked points, clipped at the frame's edges (which these small frames are)."""
    points = [(1, 2), (0, 0), (3, 3)]
    return A.neighbourhood_mean(T.rgb(spark, sf), points, radius=10)


def _gain24(c: int) -> str:
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    cases = " ".join(f"WHEN k < {d(hi[0])} THEN {d(lo[c])} * (({d(hi[0])} - k) / {d(hi[0] - lo[0])}) + {d(hi[c])} * (1.0 - ({d(hi[0])} - k) / {d(hi[0] - lo[0])})" for lo, hi in zip(KNOTS, KNOTS[1:]))
    return f"(CASE {cases} ELSE {d(KNOTS[-1][c])} END)"


_A24 = f"""grid AS (SELECT k, i, g1 + t / 19.0::DOUBLE AS a, g2 AS b, g3 + t / 11.0::DOUBLE AS c FROM (SELECT CAST(k AS DOUBLE) AS k, i, {_gain24(1)} AS g1, {_gain24(2)} AS g2, {_gain24(3)} AS g3, sign(i / 10.0::DOUBLE) * pow(abs(i / 10.0::DOUBLE / 10.0::DOUBLE), 1.75) * 10.0 AS t FROM (SELECT unnest(range(2300, 10001, 10)) AS k), (SELECT unnest(range(-100, 101)) AS i))),
gains AS (SELECT k, i, a / least(a, b, c) AS ga, b / least(a, b, c) AS gb, c / least(a, b, c) AS gc FROM grid),
curve AS (SELECT list(CAST(trunc(round(pow(v / 65535.0::DOUBLE, 1 / 2.2::DOUBLE) * 65535.0::DOUBLE, 6)) AS BIGINT) ORDER BY v) AS cv FROM (SELECT unnest(range(0, 65536)) AS v)),
mean AS (SELECT frame, CAST(sum(r) AS BIGINT) // count(*) AS r, CAST(sum(g) AS BIGINT) // count(*) AS g, CAST(sum(b) AS BIGINT) // count(*) AS b FROM rgb GROUP BY frame),
lit AS (SELECT frame, k, i, cv[CAST(least(trunc(round(ga * r, 6)), 65535) AS INT) + 1] AS x, cv[CAST(least(trunc(round(gb * g, 6)), 65535) AS INT) + 1] AS y, cv[CAST(least(trunc(round(gc * b, 6)), 65535) AS INT) + 1] AS z FROM mean, gains, curve),
best AS (SELECT frame, min(struct_pack(d := abs(x - y) + abs(y - z) + abs(x - z), k := k, i := i)) AS m FROM lit GROUP BY frame)
SELECT frame, CAST(m.k AS BIGINT) AS kelvin, m.i AS tint, m.d AS delta FROM best"""


@query("a24_white_balance_picker", f"WITH {RGB}, {_A24}")
def a24(spark, sf):
    """Arg-min over 771 temperatures and 201 tints, first win, per frame's mean colour (21 x 21 around a pixel is more than these frames have)."""
    mean = [X.idiv(F.sum(c), F.count(F.lit(1))).alias(c) for c in "rgb"]
    return whitebalance.pick(T.rgb(spark, sf).groupBy("frame").agg(*mean), KNOTS, 2.2)


@query("a25_exposure_alternation", with_px(f"SELECT frame, {r6('CAST(next AS DOUBLE) / total')} AS ratio, CAST(next AS DOUBLE) / total NOT BETWEEN 0.7 AND 1.3 AS alternates FROM (SELECT frame, total, lead(total) OVER (PARTITION BY frame // 2 ORDER BY frame) AS next FROM (SELECT frame, CAST(sum(val) AS BIGINT) AS total FROM px GROUP BY frame)) WHERE next IS NOT NULL"))
def a25(spark, sf):
    s = T.frames(spark, sf).select("frame", F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))
    n = s.withColumn("next", F.lead("total").over(Window.partitionBy(X.idiv(F.col("frame"), 2)).orderBy("frame"))).where("next is not null")
    ratio = F.col("next").cast("double") / F.col("total")
    return n.select("frame", F.round(ratio, 6).alias("ratio"), (~ratio.between(0.7, 1.3)).alias("alternates"))


@query("a26_audio_envelope", with_px("SELECT frame AS bucket, CAST(max(greatest(v, -v - 1)) AS BIGINT) AS peak, CAST(least(31, floor(round((100 * ln(CAST(greatest(1, max(greatest(v, -v - 1))) AS DOUBLE)) + max(greatest(v, -v - 1)) / 10.0) / 116, 6))) AS BIGINT) AS shown FROM (SELECT frame, val - 8192 AS v FROM px) GROUP BY frame"))
def a26(spark, sf):
    """Samples of a bucket fold to one peak, negatives mirrored; buckets are frames here, so rows stay where they are."""
    peak = F.array_max(F.transform("data", lambda s: F.greatest(s - 8192, 8191 - s)))
    p = T.frames(spark, sf).select(F.col("frame").alias("bucket"), peak.alias("peak"))
    shown = (100 * F.ln(F.greatest(F.lit(1), F.col("peak")).cast("double")) + F.col("peak") / 10.0) / 116
    return p.select("bucket", "peak", F.least(F.lit(31).cast("long"), F.floor(F.round(shown, 6))).alias("shown"))


@query("a28_frame_range", with_px("SELECT frame, min(val) AS low, max(val) AS high FROM px GROUP BY frame"))
def a28(spark, sf):
    """From the dense form: no grouping at all."""
    return T.frames(spark, sf).select("frame", F.array_min("data").alias("low"), F.array_max("data").alias("high"))


@query("a30_export_frames", with_index("SELECT clip, CAST(sum(hi - lo + 1) AS BIGINT) AS frames FROM (SELECT clip, kind, min(frame) AS lo, max(frame) AS hi FROM idx GROUP BY ALL) GROUP BY clip"))
def a30(spark, sf):
    cuts = T.index(spark, sf).groupBy("clip", "kind").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    return cuts.groupBy("clip").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("frames"))


@query("sk2_frame_average", with_px("SELECT y, x, (CAST(sum(val) AS BIGINT) + count(*) // 2) // count(*) AS val FROM px GROUP BY ALL"))
def sk2(spark, sf):
    return T.to_long(T.frames(spark, sf)).groupBy("y", "x").agg(X.idiv(F.sum("val") + X.idiv(F.count(F.lit(1)), 2), F.count(F.lit(1))).alias("val"))


@query("exposure_match_gain", with_px(f"SELECT frame, {r6('(md - mb * 0.25)')} AS offset, CAST(count(*) AS BIGINT) AS pairs FROM (SELECT frame, CAST(quantile_disc(CASE WHEN y % 4 < 2 THEN val END, 0.5) AS DOUBLE) AS mb, CAST(quantile_disc(CASE WHEN y % 4 >= 2 THEN val END, 0.5) AS DOUBLE) AS md FROM px GROUP BY frame) GROUP BY frame, md, mb"))
def exposure(spark, sf):
    g = T.px(spark, sf).groupBy("frame").agg(A.lower_median("if(y % 4 < 2, val, null)").alias("mb"), A.lower_median("if(y % 4 >= 2, val, null)").alias("md"))
    return g.select("frame", F.round(F.col("md") - F.col("mb") * 0.25, 6).cast("double").alias("offset"), F.lit(1).cast("long").alias("pairs"))


@query("a29_export_progress", with_index("SELECT clip, frame, done, total - done AS to_do, gone, total * gone // done - gone AS rest, printf('ETA: %02dh%02dm%02ds', (total * gone // done - gone) // 3600, (total * gone // done - gone) // 60 % 60, (total * gone // done - gone) % 60) AS eta FROM (SELECT clip, frame, count(*) OVER w AS done, count(*) OVER (PARTITION BY clip) AS total, CAST(sum(frame % 7 + 1) OVER w AS BIGINT) AS gone FROM idx WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING))"))
def a29(spark, sf):
    """Progress of an export queue: one window per clip."""
    return A.export_progress(T.index(spark, sf).select("clip", "frame", (F.col("frame") % 7 + 1).alias("s")), "clip", "frame", "s")
