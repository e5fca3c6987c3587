"""Stencils, demosaic and window operators over frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import exprs as X
from ..operators import kernels, layers, repair
from ..operators import stencil as S
from .common import DENSE, at, at_zero, clamp, trunc, with_dense, with_px, with_rgb
from .registry import query

PDQ = "SELECT frame, y, x, {} AS val FROM pd"


def _mean(cells):
    return f"(({' + '.join(cells)}) // {len(cells)})"


@query("w1_box_blur", f"WITH {DENSE}, h AS (SELECT frame, y, x, {_mean([at(0, k) for k in (-1, 0, 1)])} AS val FROM pd), hd AS (SELECT frame, list(val ORDER BY y, x) AS a FROM h GROUP BY frame) SELECT h.frame, h.y, h.x, {_mean([at(k, 0).replace('y +', 'h.y +').replace('x +', 'h.x +') for k in (-1, 0, 1)])} AS val FROM h JOIN hd USING (frame)")
def w1(spark, sf):
    return T.to_long(S.box_blur(T.frames(spark, sf), 1))


_cells = "list_sort([" + ", ".join(at(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + "])[5]"


@query("w2_median_filter", with_dense(PDQ.format(f"CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN {trunc(f'{_cells} * CAST(0.75 AS DOUBLE) + val * CAST(0.25 AS DOUBLE)')} ELSE val END")))
def w2(spark, sf):
    return T.to_long(S.median_filter(T.frames(spark, sf), 3, 0.75))


def _weighted(weights):
    return " + ".join(f"{at_zero(dy, dx)} * ({k})" for (dy, dx), k in weights.items())


_gh = _weighted({(dy, dx): dx * (2 - abs(dy)) for dy in (-1, 0, 1) for dx in (-1, 1)})
_gv = _weighted({(dy, dx): dy * (2 - abs(dx)) for dx in (-1, 0, 1) for dy in (-1, 1)})


@query("w3_sobel", with_dense(f"SELECT frame, y, x, {_gh} AS gx, {_gv} AS gy, CAST(floor(sqrt(CAST(({_gh}) * ({_gh}) + ({_gv}) * ({_gv}) AS DOUBLE))) AS BIGINT) AS magnitude FROM pd"))
def w3(spark, sf):
    f = T.frames(spark, sf)
    both = S.sobel(f.withColumn("raw", F.col("data")), "h").withColumnRenamed("data", "gx")
    both = S.sobel(both.withColumnRenamed("raw", "data"), "v")
    d = T.to_long(both.withColumn("data", F.arrays_zip(F.col("gx"), F.col("data").alias("gy"))))
    gx, gy = F.col("val.gx"), F.col("val.gy")
    return d.select("frame", "y", "x", gx.alias("gx"), gy.alias("gy"), F.floor(F.sqrt((gx * gx + gy * gy).cast("double"))).alias("magnitude"))


_s = 0.5**1.5 * 0.55
_sx, _sy = _s * (1 - 0.2), _s * (1 + 0.2)


@query("w4_sharpen", with_dense(PDQ.format(clamp(trunc(f"val * CAST({1 + 2 * _sx + 2 * _sy!r} AS DOUBLE)") + "".join(" - " + trunc(f"{at(*o)} * CAST({k!r} AS DOUBLE)") for o, k in (((-1, 0), _sy), ((1, 0), _sy), ((0, -1), _sx), ((0, 1), _sx)))))))
def w4(spark, sf):
    return T.to_long(S.sharpen(T.frames(spark, sf), 0.5, 0.2))


@query("w5_horizontal_gradient", with_px("SELECT frame, y, x, coalesce(lag(val, 2) OVER w - lead(val, 2) OVER w, 0) AS val FROM px WINDOW w AS (PARTITION BY frame, y ORDER BY x)"))
def w5(spark, sf):
    return T.to_long(S.horizontal_gradient(T.frames(spark, sf)))


def _bilinear(color: str) -> str:
    cross, corners = _mean([at(-1, 0), at(1, 0), at(0, -1), at(0, 1)]), _mean([at(-1, -1), at(-1, 1), at(1, -1), at(1, 1)])
    rows, cols = _mean([at(0, -1), at(0, 1)]), _mean([at(-1, 0), at(1, 0)])
    if color == "g":
        return f"CASE WHEN y % 2 = x % 2 THEN {cross} ELSE val END"
    a, b = (0, 1) if color == "r" else (1, 0)
    return f"CASE WHEN y % 2 = {a} AND x % 2 = {a} THEN val WHEN y % 2 = {a} THEN {rows} WHEN x % 2 = {b} THEN {corners} ELSE {cols} END"


@query("w10_bilinear_demosaic", with_dense(f"SELECT p.frame, p.y, p.x, q.r, q.g, q.b FROM px p JOIN (SELECT frame, y, x, {', '.join(f'{_bilinear(c)} AS {c}' for c in 'rgb')} FROM pd) q ON q.frame = p.frame AND q.y = least(greatest(p.y, 1), 6) AND q.x = least(greatest(p.x, 1), 6)"))
def w10(spark, sf):
    f = T.frames(spark, sf).withColumn("raw", F.col("data"))
    planes = f
    for c in "rgb":
        planes = S.bilinear_demosaic(planes.withColumn("data", F.col("raw")), c).withColumn(c, F.col("data"))
    return T.to_long(planes.withColumn("data", F.arrays_zip("r", "g", "b"))).select("frame", "y", "x", "val.*")


def _fir(name: str) -> str:
    total = " + ".join(f"{at(dy, dx)} * ({k})" for (dy, dx), k in S.CORRECTED[name].items())
    return f"greatest(0, least(16383, CAST(floor(({total}) / CAST(16 AS DOUBLE)) AS BIGINT)))"


_ee, _eo, _oe, _oo = (f"y % 2 = {a} AND x % 2 = {b}" for a in (0, 1) for b in (0, 1))


@query("w12_corrected_demosaic", with_dense(f"SELECT frame, y, x, CASE WHEN {_ee} THEN val WHEN {_eo} THEN {_fir('row')} WHEN {_oe} THEN {_fir('column')} ELSE {_fir('diagonal')} END AS r, CASE WHEN y % 2 = x % 2 THEN {_fir('cross')} ELSE val END AS g, CASE WHEN {_oo} THEN val WHEN {_oe} THEN {_fir('row')} WHEN {_eo} THEN {_fir('column')} ELSE {_fir('diagonal')} END AS b FROM pd"))
def w12(spark, sf):
    return T.to_long(S.corrected_demosaic(T.frames(spark, sf), 16383)).select("frame", "y", "x", "val.*")


@query("w11_nearest_demosaic", with_px("SELECT p.frame, p.y, p.x, q.r, q.g, q.b FROM px p JOIN (SELECT frame, y // 2 AS qy, x // 2 AS qx, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN val END) AS r, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN val END) AS g, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN val END) AS b FROM px GROUP BY ALL) q ON q.frame = p.frame AND q.qy = p.y // 2 AND q.qx = p.x // 2"))
def w11(spark, sf):
    f = T.frames(spark, sf)
    w = F.col("w")

    def quad(data, i):
        y, x = F.floor(i / w), i % w
        o = (y - y % 2) * w + x - x % 2
        return F.struct(F.get(data, o).alias("r"), F.get(data, o + 1).alias("g"), F.get(data, o + w + 1).alias("b"))

    return T.to_long(f.withColumn("data", S.once(F.col("data"), lambda data: F.transform(data, lambda _, i: quad(data, i))))).select("frame", "y", "x", "val.*")


_n8 = [at(dy, dx) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if (dy, dx) != (0, 0)]
_n8s = f"list_sort([{', '.join(_n8)}])"
_lg = lambda e: trunc(f"log2(CAST(greatest(1, {e} - 2048) AS DOUBLE)) * 65536.0")


@query("w8_f3_bad_pixels", with_dense(f"SELECT frame, y, x, val, CASE WHEN val < 2048 - 96 THEN 'cold' WHEN val > 2048 + 96 AND {_lg('val')} - {_lg(f'{_n8s}[7]')} > 4096 THEN 'hot' END AS kind FROM pd WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AND (val < 2048 - 96 OR (val > 2048 + 96 AND {_lg('val')} - {_lg(f'{_n8s}[7]')} > 4096))"))
def w8(spark, sf):
    """Cold: below the dark range. Hot: far above the second largest of eight same-colour neighbours (threshold 1/16 EV here)."""
    return repair.bad_pixels(T.frames(spark, sf), black=2048, threshold=4096)


_map = "((x * 7 + y * 3) % 11 = 0)"
_same = [at(-2, 0), at(2, 0), at(0, -2), at(0, 2)]


@query("w7_j2_repair_listed_pixels", with_dense(f"SELECT frame, y, x, CASE WHEN {_map} THEN {_mean(_same)} ELSE val END AS val, {_map} AS repaired FROM pd"))
def w7(spark, sf):
    """Pixels of a map get the mean of their four same-colour neighbours; the map is a broadcast semi-join on position."""
    cells = [(y, x) for y in range(8) for x in range(8) if (x * 7 + y * 3) % 11 == 0]
    pixel_map = spark.createDataFrame(cells, "y long, x long")
    return repair.repair_listed(T.frames(spark, sf), pixel_map)


@query("w7_median_repair", with_dense(f"SELECT frame, y, x, CASE WHEN {_map} THEN list_sort([{', '.join(_n8)}])[4] ELSE val END AS val FROM pd"))
def w7m(spark, sf):
    return T.to_long(repair.same_color_median(T.frames(spark, sf), lambda y, x: (x * 7 + y * 3) % 11 == 0))


@query("w22_temporal_mean", with_px("SELECT frame, clip, y, x, CAST(sum(val) OVER w AS BIGINT) // count(*) OVER w AS mean3, (val + coalesce(lag(val) OVER v, val)) // 2 AS blend FROM (SELECT px.*, label AS clip FROM px JOIN embeddings ON vec_id = frame) WINDOW w AS (PARTITION BY clip, y, x ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), v AS (PARTITION BY clip, y, x ORDER BY frame)"))
def w22(spark, sf):
    """Mean of three frames and blend of two of a clip.

    The window runs over dense frames, one row each, so a clip is sorted once and not once per
    pixel; neighbours meet element by element.
    """
    v = Window.partitionBy("clip").orderBy("frame")
    near = T.frames(spark, sf, "label").withColumnRenamed("label", "clip").select("frame", "clip", "h", "w", "data", F.lag("data", 1).over(v).alias("b"), F.lag("data", 2).over(v).alias("c"))
    three = F.zip_with("data", F.coalesce("b", "data"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    made = F.zip_with(
        three, F.coalesce("c", F.transform("data", lambda _: F.lit(0).cast("long"))),
        lambda p, c: F.struct(
            F.when(F.col("b").isNull(), p["a"]).when(F.col("c").isNull(), X.idiv(p["a"] + p["b"], 2)).otherwise(X.idiv(p["a"] + p["b"] + c, 3)).alias("mean3"),
            X.idiv(p["a"] + p["b"], 2).alias("blend"),
        ),
    )
    return T.to_long(near.withColumn("data", made), "clip").select("frame", "clip", "y", "x", "val.*")


_run = "list_max(list_filter(range(0, x + 1), lambda k: k = 0 OR abs(r[k + 1] - r[k]) > 900))", "list_min(list_filter(range(x + 1, 9), lambda k: k = 8 OR abs(r[k + 1] - r[k]) > 900))"


@query("w6_edge_aware_blur", with_dense(f"SELECT frame, y, x, s[(len(s) + 1) // 2] AS val FROM (SELECT frame, y, x, list_sort(r[first + 1 : last]) AS s FROM (SELECT frame, y, x, r, {_run[0]} AS first, {_run[1]} AS last FROM (SELECT frame, y, x, a[y * 8 + 1 : y * 8 + 8] AS r FROM pd)))"))
def w6(spark, sf):
    """Medians over runs that end at edges: the extent depends on the data, so one Arrow kernel per frame."""
    return T.to_long(kernels.edge_aware_blur(T.frames(spark, sf), threshold=900, reach=25))


@query("w9_chroma_smooth")
def w9(spark, sf):
    """All three sizes on frames of 16 x 16; one Arrow kernel per frame."""
    f = T.tiled(spark, sf)
    made = [T.to_long(kernels.chroma_smooth(f, black=2048, white=15000, size=size)).withColumn("size", F.lit(size)) for size in kernels.CHROMA]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("w14_recursive_bilateral")
def w14(spark, sf):
    """Three channels with one joint distance."""
    out = kernels.joint_bilateral(T.rgb_frames(spark, sf), sigma_space=0.0005, sigma_range=0.15, top=65535)
    return T.to_long(out.withColumn("data", F.arrays_zip("r", "g", "b"))).select("frame", "y", "x", "val.*")


@query("w16_edge_clamp")
def w16(spark, sf):
    """Red and blue within what green's edges allow."""
    out = kernels.guided_clamp(T.rgb_frames(spark, sf), threshold=6000)
    return T.to_long(out.withColumn("data", F.arrays_zip("r", "g", "b"))).select("frame", "y", "x", "val.*")


@query("w19_alias_map")
def w19(spark, sf):
    """Of frames of 16 x 16 against their blurred selves, where the light is low."""
    f = T.tiled(spark, sf)
    half = S.box_blur(f, 1).select("frame", F.col("data").alias("g"))
    return T.to_long(kernels.alias_map(f.withColumnRenamed("data", "r").join(half, "frame").withColumn("b", F.transform("r", lambda v: F.lit(2049).cast("long") + v % 16)), black=2048, noise=100))


def _weights(n: int, m: int) -> str:
    return ", ".join(f"({k}, {at}, CAST({float(v)!r} AS DOUBLE))" for k, row in enumerate(kernels.lanczos(n, m)) for at, v in enumerate(row))


@query("w23_resize", with_px(f"SELECT frame, CAST(wy.k AS BIGINT) AS y, CAST(wx.k AS BIGINT) AS x, CAST(least(greatest(floor(round(sum(wy.v * wx.v * val), 6) + 0.5), 0), 16383) AS BIGINT) AS val FROM px JOIN (VALUES {_weights(8, 5)}) wy(k, i, v) ON wy.i = px.y JOIN (VALUES {_weights(8, 6)}) wx(k, i, v) ON wx.i = px.x GROUP BY frame, wy.k, wx.k"))
def w23(spark, sf):
    return T.to_long(kernels.resize_fine(T.frames(spark, sf), 5, 6, top=16383))


@query("sk13_blend_export", with_dense("SELECT frame, 5 - y AS y, x, CAST(trunc(least(greatest(round(val / CAST(12000 AS DOUBLE) * (16384 - 2048) + 2048, 6), 0.0), 16384.0)) AS BIGINT) AS val FROM pd WHERE y < 6"))
def sk13(spark, sf):
    """Blended frames of 8 x 7, cut to whole cells, turned upside down and mapped to the sensor's range."""
    f = T.frames(spark, sf).select("frame", F.lit(7).alias("h"), "w", F.transform(F.slice("data", 1, 56), lambda v: v / F.lit(12000.0)).alias("data"))
    return T.to_long(layers.blend_export(f, black=2048, bits=14))


@query("a22_color_binning", with_px("SELECT frame, y // 4 AS y, x // 4 AS x, CAST((y % 2) * 2 + x % 2 AS BIGINT) AS plane, CAST(sum(val) AS BIGINT) // 4 AS binned, max(CASE WHEN y % 4 < 2 AND x % 4 < 2 THEN val END) AS skipped FROM px GROUP BY ALL"))
def a22(spark, sf):
    """Same-colour binning against line skipping."""
    y, x = F.col("y"), F.col("x")
    g = T.px(spark, sf).groupBy("frame", X.idiv(y, 4).alias("y"), X.idiv(x, 4).alias("x"), ((y % 2) * 2 + x % 2).alias("plane"))
    return g.agg(X.idiv(F.sum("val"), 4).alias("binned"), F.max(F.when((y % 4 < 2) & (x % 4 < 2), F.col("val"))).alias("skipped")).select("frame", "y", "x", "plane", "binned", "skipped")


@query("grade_pipeline", with_rgb("SELECT frame, y, x, " + ", ".join(clamp(f"{'((4 * r1 + 11 * g1 + b1) >> 4)'} + " + trunc(f"({c}1 - ((4 * r1 + 11 * g1 + b1) >> 4)) * CAST(1.2 AS DOUBLE)")) + f" AS {c}" for c in "rgb") + " FROM (SELECT frame, y, x, " + ", ".join(clamp(trunc(f"65535.0 * round(pow({c}0 / CAST(65535 AS DOUBLE), {1 / 2.2!r}), 6)")) + f" AS {c}1" for c in "rgb") + " FROM (SELECT frame, y, x, " + ", ".join(clamp(trunc(f"{c} * CAST({g!r} AS DOUBLE)")) + f" AS {c}0" for c, g in (("r", 1.9), ("g", 1.0), ("b", 1.4))) + " FROM rgb))"))
def grade(spark, sf):
    """The ordered stage builder: neutral settings add no step, the rest is one projection."""
    from ..operators import grade as G

    settings = G.Settings(gains=(1.9, 1.0, 1.4), gamma=2.2, saturation=1.2, vibrance=1.0, toning=0.0)
    return G.grade(T.rgb(spark, sf), settings)


@query("sc9_sk6_lossless_jpeg", with_px("SELECT frame, y, x, val FROM px"))
def sc9(spark, sf):
    """Every frame through the lossless codec and back."""
    from ..sources import lossless_jpeg as J

    return T.to_long(J.decode_frames(J.encode_frames(T.frames(spark, sf), 14, selection=6)))


@query("sc8_sk5_payload_round_trip", with_px("SELECT frame, y, x, val FROM px"))
def sc8(spark, sf):
    """Every frame packed into 14-bit payloads and unpacked again."""
    from ..sources import samples

    packed = samples.as_blocks(T.frames(spark, sf), 14)
    return T.to_long(samples.unpack_blocks(packed, 8, 8, 14))
