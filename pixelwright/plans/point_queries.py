"""Point operators (one value in, one value out) and per-sample filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import exprs as X
from ..functions import lang
from .common import RGB, clamp, r6, trunc, with_px, with_rgb
from .registry import query

def V():
    return F.col("val")


def R():
    return F.col("r")


def G():
    return F.col("g")


def B():
    return F.col("b")


def UNIT():
    return [c / F.lit(65535.0) for c in (R(), G(), B())]


PXQ = "SELECT frame, y, x, {} AS val FROM px"


def _px(spark, sf, value):
    return T.px(spark, sf).select("frame", "y", "x", value.alias("val"))


def _rgb(spark, sf, values, names=("r", "g", "b")):
    return T.rgb(spark, sf).select("frame", "y", "x", *[v.alias(n) for v, n in zip(values, names)])


def _rgbq(*values: str, names=("r", "g", "b")) -> str:
    return "SELECT frame, y, x, " + ", ".join(f"{v} AS {n}" for v, n in zip(values, names)) + " FROM rgb"


_unit = lambda c: f"({c} / CAST(65535 AS DOUBLE))"


_b, _w = 2048 << 2, int((15000 << 2) * 0.993)


@query("p1_levels", with_px(PXQ.format(clamp(trunc(f"(val * 4 - {_b}) * CAST(65535 AS DOUBLE) / CAST({_w - _b} AS DOUBLE)")))))
def p1(spark, sf):
    return _px(spark, sf, X.levels(V() * 4, 2048, 15000))


@query("p2_promote_demote", with_px("SELECT frame, y, x, ((val >> 2) << 2) AS promoted, ((val + 2) >> 2) AS demoted, ((val + 8) >> 4) AS demoted_10 FROM px"))
def p2(spark, sf):
    return T.px(spark, sf).select("frame", "y", "x", X.promote(F.shiftright("val", 2), 12).alias("promoted"), X.demote(V(), 12).alias("demoted"), X.demote(V(), 10).alias("demoted_10"))


@query("p3_restricted_range", with_px("SELECT frame, y, x, least(CAST(trunc((val - 2048) * CAST(9904 AS DOUBLE) / CAST(16383 AS DOUBLE) + CAST(2048.5 AS DOUBLE)) AS BIGINT), 16383) AS val, CAST(floor((val - lo) * CAST(16383 AS DOUBLE) / (hi - lo)) AS BIGINT) AS stretched FROM px JOIN (SELECT frame, min(val) AS lo, max(val) AS hi FROM px GROUP BY frame) USING (frame)"))
def p3(spark, sf):
    """By bit depth, and by each frame's own range (one row per frame, so no second pass over pixels)."""
    f = T.frames(spark, sf)
    ends = lambda data: F.struct(data.alias("v"), F.array_min(data).alias("lo"), F.array_max(data).alias("hi"))
    stretched = lambda s: F.transform(s["v"], lambda v: F.floor((v - s["lo"]) * F.lit(16383.0) / (s["hi"] - s["lo"])))
    own = X.bound(X.bound(F.col("data"), ends), stretched)
    both = f.withColumn("data", F.arrays_zip(F.col("data").alias("v"), own.alias("s")))
    d = T.to_long(both)
    return d.select("frame", "y", "x", X.restricted_range(F.col("val.v"), 2048, 14000, 0).alias("val"), F.col("val.s").alias("stretched"))


@query("p4_channel_gains", with_rgb(_rgbq(*[clamp(trunc(f"{c} * CAST({g!r} AS DOUBLE)")) for c, g in (("r", 1.9 * 2 ** -0.5), ("g", 2 ** -0.5), ("b", 1.4 * 2 ** -0.5))])))
def p4(spark, sf):
    e = 2.0**-0.5
    return _rgb(spark, sf, [X.clamp16(X.trunc(c * F.lit(g))) for c, g in zip((R(), G(), B()), (1.9 * e, e, 1.4 * e))])


KNOTS = ((2000.0, 1.0, 1.9, 5.2), (3200.0, 1.25, 1.0, 2.4), (5200.0, 2.0, 1.0, 1.6), (6500.0, 2.2, 1.0, 1.35), (10000.0, 2.6, 1.0, 1.1))


def _knot_sql(k: str, c: int) -> str:
    cases = " ".join(
        f"WHEN {k} < CAST({hi[0]!r} AS DOUBLE) THEN CAST({lo[c]!r} AS DOUBLE) * ((CAST({hi[0]!r} AS DOUBLE) - {k}) / CAST({hi[0] - lo[0]!r} AS DOUBLE)) + CAST({hi[c]!r} AS DOUBLE) * (1.0 - (CAST({hi[0]!r} AS DOUBLE) - {k}) / CAST({hi[0] - lo[0]!r} AS DOUBLE))"
        for lo, hi in zip(KNOTS, KNOTS[1:])
    )
    return f"(CASE {cases} ELSE CAST({KNOTS[-1][c]!r} AS DOUBLE) END)"


_K = "least(greatest(CAST(1500 + l_quantity * 200 AS DOUBLE), 2000.0), 10000.0)"
_line = "SELECT l_orderkey, l_linenumber"


@query("p5_kelvin_gains", f"{_line}, {', '.join(f'{r6(_knot_sql(_K, c))} AS {n}' for c, n in ((1, 'r'), (2, 'g'), (3, 'b')))} FROM lineitem")
def p5(spark, sf):
    gains = X.kelvin_gains((1500 + F.col("l_quantity") * 200).cast("double"), KNOTS)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[(F.round(g, 6) + 0.0).alias(n) for g, n in zip(gains, "rgb")])


_T = "(sign(CAST(l_quantity - 25 AS DOUBLE)) * pow(abs(l_quantity - 25) / 10.0, 1.75) * 10.0)"
_tr, _tg, _tb = f"(2.0::DOUBLE + {_T} / 19.0)", "1.0::DOUBLE", f"(1.6::DOUBLE + {_T} / 11.0)"
_tl = f"least({_tr}, {_tg}, {_tb})"


@query("p6_tint", f"{_line}, {r6(_T)} AS tint, " + ", ".join(f"{r6(f'{e} / {_tl}')} AS {n}" for e, n in ((_tr, "r"), (_tg, "g"), (_tb, "b"))) + " FROM lineitem")
def p6(spark, sf):
    t = X.tint_shape((F.col("l_quantity") - 25).cast("double"))
    out = X.tinted([F.lit(2.0), F.lit(1.0), F.lit(1.6)], t)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.round(t, 6) + 0.0).alias("tint"), *[(F.round(g, 6) + 0.0).alias(n) for g, n in zip(out, "rgb")])


#: A synthetic camera (XYZ to its colours) and the linear sRGB gamut; real cameras come from a camera table.
CAMERA = [0.8, 0.15, 0.05, 0.25, 0.7, 0.05, 0.02, 0.18, 0.8]
GAMUT = [3.2404542, -1.5371385, -0.4985314, -0.9692660, 1.8760108, 0.0415560, 0.0556434, -0.2040259, 1.0572252]
BALANCE, CHAIN = X.white_balance(4300.0, 2.5, KNOTS, CAMERA, GAMUT)


def _matrix_sql(m, c=("r", "g", "b")):
    return ["(" + " + ".join(f"{n} * CAST({float(k)!r} AS DOUBLE)" for k, n in zip(m[3 * i : 3 * i + 3], c) if k) + ")" for i in range(3)]


_balanced = [clamp(trunc(f"round({c} * CAST({g!r} AS DOUBLE), 6)")) for c, g in zip("rgb", BALANCE)]


@query("p7_p8_color_matrix", with_rgb("SELECT frame, y, x, " + ", ".join(f"{clamp(trunc(f'round({e}, 6)'))} AS {n}" for e, n in zip(_matrix_sql(CHAIN), "rgb")) + f" FROM (SELECT frame, y, x, {', '.join(f'{e} AS {n}' for e, n in zip(_balanced, 'rgb'))} FROM rgb) q"))
def p8(spark, sf):
    """White balance at 4300 K with a tint: gains, then camera to XYZ, adaptation in cone space and the gamut as one matrix made on the driver."""
    step = lambda c: X.clamp16(X.trunc(F.round(c, 6)))
    balanced = T.rgb(spark, sf).select("frame", "y", "x", *[step(F.col(c) * F.lit(g)).alias(c) for c, g in zip("rgb", BALANCE)])
    return balanced.select("frame", "y", "x", *[step(c).alias(n) for c, n in zip(X.matrix((R(), G(), B()), CHAIN), "rgb")])


def _gamut_sql(knee: float = 0.5):
    y = "((4 * r + 11 * g + b) / CAST(16 AS DOUBLE))"
    d = f"(({y} - least(r, g, b)) / {y})"
    o = f"(({d} - {knee}) / {1 - knee})"
    f = f"(CASE WHEN {y} <= 0 OR {d} = 0 THEN 1.0 WHEN {d} < {knee} THEN 1.0 ELSE ({knee} + {1 - knee} * {o} / ({o} + 1.0)) / {d} END)"
    return [r6(f"(({c} - {y}) * {f} + {y})") for c in "rgb"]


@query("p9_gamut_compression", with_rgb(_rgbq(*_gamut_sql())))
def p9(spark, sf):
    y = (R() * 4 + G() * 11 + B()) / F.lit(16.0)
    return _rgb(spark, sf, [F.round(c, 6) + 0.0 for c in X.gamut_compress(R(), G(), B(), y)])


COMPRESS = [0.85, 0.1, 0.05, 0.1, 0.8, 0.1, 0.1, 0.1, 0.8]


@query("p10_chroma_matrix_round_trip", with_rgb("SELECT frame, y, x, " + ", ".join(f"{a} AS {n}, {r6(b)} AS {n}_back" for a, b, n in zip([clamp(trunc(e)) for e in _matrix_sql(COMPRESS)], _matrix_sql(X.invert(COMPRESS), _matrix_sql(COMPRESS)), "rgb")) + " FROM rgb"))
def p10(spark, sf):
    packed = X.matrix((R(), G(), B()), COMPRESS)
    back = X.matrix(packed, X.invert(COMPRESS))
    return T.rgb(spark, sf).select("frame", "y", "x", *[c for p, b, n in zip(packed, back, "rgb") for c in (X.clamp16(X.trunc(p)).alias(n), (F.round(b, 6) + 0.0).alias(f"{n}_back"))])


_XU = "(val / CAST(16383 AS DOUBLE))"


@query("p11_transfer_expression", with_px(PXQ.format(clamp(trunc(f"65535.0 * ({lang.compile_sql('(x < 0.25) ? x * 2 : pow(x, 1/2.2) * (1 - 0.1 * sin(pi * x))', f'({_XU} * 2.0)')})")))))
def p11(spark, sf):
    u = V() / F.lit(16383.0) * 2.0
    return _px(spark, sf, X.clamp16(X.trunc(F.lit(65535.0) * lang.compile_column("(x < 0.25) ? x * 2 : pow(x, 1/2.2) * (1 - 0.1 * sin(pi * x))", u))))


@query("p12_tone_curves", with_px("SELECT frame, y, x, " + ", ".join(f"{r6(lang.compile_sql(t, _XU))} AS {n}" for n, t in lang.TONE_CURVES.items()) + " FROM px"))
def p12(spark, sf):
    u = V() / F.lit(16383.0)
    return T.px(spark, sf).select("frame", "y", "x", *[(F.round(lang.compile_column(t, u), 6) + 0.0).alias(n) for n, t in lang.TONE_CURVES.items()])


@query("p13_profiles", with_px("SELECT frame, y, x, " + ", ".join(f"{r6(lang.compile_sql(p[4], _XU))} AS {n}" for n, p in lang.PROFILES.items()) + " FROM px"))
def p13(spark, sf):
    u = V() / F.lit(16383.0)
    return T.px(spark, sf).select("frame", "y", "x", *[(F.round(lang.compile_column(p[4], u), 6) + 0.0).alias(n) for n, p in lang.PROFILES.items()])


def _bend(v: str, extent: float, factor: float) -> str:
    k = factor / (2 * extent)
    return f"(CASE WHEN {v} > 0 AND {v} < {extent} THEN pow({v}, 1.0 + ({extent} - {v}) * {k} * (1.0 - {v} / {extent})) ELSE {v} END)"


def _s_sql(v: str, dr: float, d: float, lr: float, li: float, lighten: float) -> str:
    e = _bend(v, dr, d) if dr else v
    e = f"(1.0 - {_bend(f'(1.0 - {e})', lr, li)})" if lr else f"(1.0 - (1.0 - {e}))"
    return f"pow({e}, {1 - lighten})" if lighten else e


@query("p14_s_curve", with_px(PXQ.format(r6(_s_sql(_XU, 0.7, 4.5, 0.5, 0.3, 0.2)))))
def p14(spark, sf):
    return _px(spark, sf, F.round(X.s_curve(V() / F.lit(16383.0), 0.7, 4.5, 0.5, 0.3, 0.2), 6) + 0.0)


_Y = "((4 * r + 11 * g + b) >> 4)"


def _contrast_sql(y: str, slider: float) -> str:
    v = f"pow({y} / CAST(65536 AS DOUBLE), 0.75)"
    n = _s_sql(v, 0.7, -slider * 0.5, 0.0, 0.0, 0.0)
    h = 2.0 ** (-1.5 * slider)
    q = f"(({n} - 0.2) / 0.8)"
    m = f"(CASE WHEN {n} > 0.2 THEN {n} * (1.0 - {q}) + {n} * {h!r} * {q} ELSE {n} END)"
    return f"(CASE WHEN {y} = 0 THEN 1.0 ELSE {v} / {m} END)"


@query("p15_contrast_factor", with_rgb(f"SELECT frame, y, x, {_Y} AS luma, {r6(_contrast_sql(_Y, 0.26))} AS factor, " + ", ".join(f"{clamp(trunc(f'{c} * round({_contrast_sql(_Y, 0.26)}, 6)'))} AS {c}" for c in "rgb") + " FROM rgb"))
def p15(spark, sf):
    y = X.luma(R(), G(), B())
    f = F.round(X.contrast_factor(y, 0.26), 6)
    return T.rgb(spark, sf).select("frame", "y", "x", y.alias("luma"), (f + 0.0).alias("factor"), *[X.clamp16(X.trunc(c * f)).alias(n) for c, n in zip((R(), G(), B()), "rgb")])


def _sat_sql(k: float):
    return [clamp(f"{_Y} + " + trunc(f"({c} - {_Y}) * CAST({k} AS DOUBLE)")) for c in "rgb"]


@query("p16_saturation", with_rgb(_rgbq(*_sat_sql(1.4))))
def p16(spark, sf):
    return _rgb(spark, sf, X.saturation((R(), G(), B()), 1.4))


_s = "(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) ELSE 0.0 END)"
_sw = f"least(1.0, 2.0 * {_s} / ({_s} * {_s} + 1.0))"


@query("p17_vibrance", with_rgb(_rgbq(*[clamp(trunc(f"{c} * {_sw} + {m} * (1.0 - {_sw})")) for c, m in zip("rgb", _sat_sql(1.6))])))
def p17(spark, sf):
    return _rgb(spark, sf, X.vibrance((R(), G(), B()), 1.6))


_mx, _mn = (f"{f}({', '.join(_unit(c) for c in 'rgb')})" for f in ("greatest", "least"))
_d = f"({_mx} - {_mn})"
_h = (
    f"(CASE WHEN {_d} = 0 THEN 0.0 WHEN {_mx} = {_unit('r')} THEN ((60.0 * ({_unit('g')} - {_unit('b')}) / {_d}) + 360.0) % 360.0"
    f" WHEN {_mx} = {_unit('g')} THEN 60.0 * ({_unit('b')} - {_unit('r')}) / {_d} + 120.0 ELSE 60.0 * ({_unit('r')} - {_unit('g')}) / {_d} + 240.0 END)"
)
_hs = f"(CASE WHEN {_mx} = 0 THEN 0.0 ELSE {_d} / {_mx} END)"
_hl = f"(({_mx} + {_mn}) / 2.0)"


@query("p18_hsv_hsl", with_rgb(f"SELECT frame, y, x, {r6(_h)} AS h, {r6(_hs)} AS s, {r6(_mx)} AS v, {r6(f'CASE WHEN {_d} = 0 THEN 0.0 ELSE {_d} / (1.0 - abs(2.0 * {_hl} - 1.0)) END')} AS sl, {r6(_hl)} AS l, r AS r_back, g AS g_back, b AS b_back FROM rgb"))
def p18(spark, sf):
    """To HSV and HSL, and from HSV back to the same components."""
    h, s, v = X.hsv(*UNIT())
    _, sl, li = X.hsl(*UNIT())
    back = X.hsv_to_rgb(h, s, v)
    return T.rgb(spark, sf).select("frame", "y", "x", *[(F.round(c, 6) + 0.0).alias(n) for c, n in ((h, "h"), (s, "s"), (v, "v"), (sl, "sl"), (li, "l"))], *[F.round(c * 65535.0).cast("long").alias(f"{n}_back") for c, n in zip(back, "rgb")])


#: Knots of the four hue curves and of the gradation curves of these queries.
HUE_LUMA, HUE_SAT = [(0, 0.1), (120, -0.2), (240, 0.3), (360, 0.1)], [(0, 0.0), (90, 0.25), (200, -0.25), (360, 0.0)]
HUE_HUE, LUMA_SAT = [(0, -0.1), (180, 0.4), (360, -0.1)], [(0, -0.3), (0.4, 0.1), (1, 0.2)]
GRADATION = [(0, 0), (0.25, 0.2), (0.7, 0.8), (1, 1)]
CHANNELS = [[(0, 0), (0.5, 0.55), (1, 1)], [(0, 0.02), (1, 0.98)], [(0, 0), (0.3, 0.25), (1, 0.95)]]


def _knots_sql(u: str, knots) -> str:
    d = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    steps = " ".join(f"WHEN {u} < {d(x1)} THEN {d(y0)} + ({u} - {d(x0)}) * {d((float(y1) - float(y0)) / (float(x1) - float(x0)))}" for (x0, y0), (x1, y1) in zip(knots, knots[1:]))
    return f"(CASE WHEN {u} < {d(knots[0][0])} THEN {d(knots[0][1])} {steps} ELSE {d(knots[-1][1])} END)"


_HUES = f"""hs AS (SELECT frame, y, x, {_h} AS h, {_hs} AS s, greatest(r, g, b) / CAST(65535 AS DOUBLE) AS v FROM rgb),
h1 AS (SELECT *, floor(round(h * 100, 6)) / CAST(100 AS DOUBLE) AS u FROM hs),
h2 AS (SELECT *, s * (1.0 + 2.0 * {_knots_sql('u', HUE_SAT)}) AS s1, v * (1.0 + 2.0 * {_knots_sql('u', HUE_LUMA)} * s) AS v1, (h + 60.0 * {_knots_sql('u', HUE_HUE)} + 360.0) % 360.0 AS hh FROM h1)
SELECT frame, y, x, {r6('hh')} AS h, {r6(f"s1 * (1.0 + 2.0 * {_knots_sql('(floor(round(v1 * 36000, 6)) / CAST(36000 AS DOUBLE))', LUMA_SAT)})")} AS s, {r6('v1')} AS v FROM h2"""


@query("p19_hue_curves", f"WITH {RGB}, {_HUES}")
def p19(spark, sf):
    """All four curves: hue against luma, saturation and hue, and luma against saturation."""
    out = T.rgb(spark, sf).select("frame", "y", "x", X.hue_curves(*X.hsv(*UNIT()), HUE_LUMA, HUE_SAT, HUE_HUE, LUMA_SAT).alias("o"))
    return out.select("frame", "y", "x", *[(F.round(F.col(f"o.{n}"), 6) + 0.0).alias(n) for n in "hsv"])


_step = lambda c, knots: clamp(trunc(f"round({_knots_sql(f'({c} / CAST(65535 AS DOUBLE))', knots)} * CAST(65535 AS DOUBLE), 6)"))


@query("p21_gradation_curves", f"WITH {RGB}, l AS (SELECT frame, y, x, {', '.join(f'{_step(c, GRADATION)} AS {c}' for c in 'rgb')} FROM rgb) SELECT frame, y, x, {', '.join(f'{_step(c, k)} AS {c}' for c, k in zip('rgb', CHANNELS))} FROM l")
def p21(spark, sf):
    """The common curve, then each channel's own, straight between knots: one projection."""
    return _rgb(spark, sf, X.gradation((R(), G(), B()), GRADATION, CHANNELS))


@query("p20_toning", with_rgb(_rgbq(*[clamp(trunc(f"{c} * CAST({(100 - 30 / 3) / 100!r} AS DOUBLE) + {c} * CAST({30 / 3 / 100 * t / 255!r} AS DOUBLE)")) for c, t in zip("rgb", (255, 180, 90))])))
def p20(spark, sf):
    return _rgb(spark, sf, X.toning((R(), G(), B()), 30, (255, 180, 90)))


def _ycc_sql(r="r", g="g", b="b"):
    t = lambda c, k: trunc(f"{c} * CAST({k} AS DOUBLE)")
    return [f"({t(r, 0.299)} + {t(g, 0.587)} + {t(b, 0.114)})", f"(32768 + {t(r, -0.168736)} + {t(g, -0.331264)} + ({b} >> 1))", f"(32768 + ({r} >> 1) + {t(g, -0.418688)} + {t(b, -0.081312)})"]


_cy, _cb, _cr = _ycc_sql()
_t = lambda c, k: trunc(f"({c} - 32768) * CAST({k} AS DOUBLE)")


@query("p23_ycbcr", with_rgb(f"SELECT frame, y, x, {_cy} AS luma, {_cb} AS cb, {_cr} AS cr, {clamp(f'{_cy} + {_t(_cr, 1.402)}')} AS r, {clamp(f'{_cy} + {_t(_cb, -0.344136)} + {_t(_cr, -0.714136)}')} AS g, {clamp(f'{_cy} + {_t(_cb, 1.772)}')} AS b FROM rgb"))
def p23(spark, sf):
    ycc = X.ycbcr(R(), G(), B())
    return _rgb(spark, sf, [*ycc, *X.ycbcr_to_rgb(*ycc)], ("luma", "cb", "cr", "r", "g", "b"))


NET = {"w1": [[0.9, -0.4, 0.2], [0.1, 0.8, -0.3], [-0.2, 0.3, 0.7], [0.5, 0.5, 0.1]], "b1": [0.05, -0.1, 0.02, -0.2], "w2": [[0.8, 0.1, -0.1, 0.4], [0.1, 0.9, 0.1, 0.2], [-0.1, 0.2, 0.8, 0.3]], "b2": [-0.4, -0.5, -0.4]}


def _net_sql():
    hid = [f"(1.0 / (1.0 + exp(-({' + '.join(f'{_unit(c)} * CAST({w} AS DOUBLE)' for c, w in zip('rgb', ws))} + CAST({b} AS DOUBLE)))))" for ws, b in zip(NET["w1"], NET["b1"])]
    out = [f"(1.0 / (1.0 + exp(-({' + '.join(f'{h} * CAST({w} AS DOUBLE)' for h, w in zip(hid, ws))} + CAST({b} AS DOUBLE)))))" for ws, b in zip(NET["w2"], NET["b2"])]
    return [r6(f"{_unit(c)} * 0.25 + {o} * 0.75") for c, o in zip("rgb", out)]


@query("p24_film_network", with_rgb(_rgbq(*_net_sql())))
def p24(spark, sf):
    """A dense net with user-supplied weights, unrolled into expressions, mixed with its input."""
    sig = lambda v: F.lit(1.0) / (F.exp(-v) + 1.0)
    dot = lambda xs, ws, b: sum((x * F.lit(w) for x, w in zip(xs, ws)), F.lit(0.0)) + F.lit(b)
    hidden = [sig(dot(UNIT(), w, b)) for w, b in zip(NET["w1"], NET["b1"])]
    out = [sig(dot(hidden, w, b)) for w, b in zip(NET["w2"], NET["b2"])]
    return _rgb(spark, sf, [F.round(c * 0.25 + o * 0.75, 6) + 0.0 for c, o in zip(UNIT(), out)])


@query("p25_grain")
def p25(spark, sf):
    """Deterministic grain by a hash of the place: no SQL twin, as the hash is Spark's; tested for range and repeatability."""
    noise = F.pmod(F.xxhash64("frame", "y", "x", F.lit(17)), F.lit(2001)) - 1000
    return _px(spark, sf, X.clamp16(V() + X.trunc(noise * F.lit(0.1))))


@query("p26_highlight_reconstruction", with_rgb("SELECT frame, y, x, r, CASE WHEN g >= 50000 THEN (r + b) // 2 ELSE g END AS g, b FROM rgb"))
def p26(spark, sf):
    return _rgb(spark, sf, [R(), F.when(G() >= 50000, X.idiv(R() + B(), 2)).otherwise(G()), B()])


_gc = "(4 * x + 2 * y)"
_gm = f"(CASE WHEN {_gc} <= 6 THEN 0 WHEN {_gc} >= 26 THEN 65535 ELSE {trunc(f'({_gc} - 6) * CAST(65535 AS DOUBLE) / CAST(20 AS DOUBLE)')} END)"


@query("p27_gradient_blend", with_px(f"SELECT frame, y, x, CAST({_gm} AS BIGINT) AS mask, {trunc(f'val + (val * 0.5 - val) * ({_gm} / CAST(65535 AS DOUBLE))')} AS val FROM px"))
def p27(spark, sf):
    m = X.gradient_mask(F.col("x"), F.col("y"), 1, 1, 5, 3).cast("long")
    return T.px(spark, sf).select("frame", "y", "x", m.alias("mask"), X.trunc(V() + (V() * 0.5 - V()) * (m / F.lit(65535.0))).alias("val"))


import math  # noqa: E402

_dg = math.hypot(4, 4)
_dd = "sqrt(pow(abs(x - 3.5), 2) + pow(abs(y - 3.5), 2))"
_vm = f"(CASE WHEN {_dd} > {_dg * 0.6!r} THEN 0.5 - 0.5 * cos({math.pi!r} * ({_dd} - {_dg * 0.6!r}) / {2 * (_dg - _dg * 0.6)!r}) ELSE 0.0 END)"


@query("p28_vignette", with_px(f"SELECT frame, y, x, {r6(_vm)} AS mask, {clamp(trunc(f'val * pow(1.0 + round({_vm}, 6) * -40.0 / 128.0, 4)'))} AS val FROM px"))
def p28(spark, sf):
    m = F.round(X.vignette_mask(F.col("x"), F.col("y"), 8, 8, 0.6), 6)
    return T.px(spark, sf).select("frame", "y", "x", (m + 0.0).alias("mask"), X.clamp16(X.trunc(V() * F.pow(1.0 + m * -40.0 / 128.0, F.lit(4.0)))).alias("val"))


_ev = trunc("log2(CAST(greatest(1, val - 2048) AS DOUBLE)) * 65536.0")


@query("p32_ev", with_px(f"SELECT frame, y, x, {_ev} AS ev, {trunc(f'2048.0 + pow(2.0, {_ev} / 65536.0)')} AS back FROM px"))
def p32(spark, sf):
    ev = X.raw_to_ev(V(), 2048)
    return T.px(spark, sf).select("frame", "y", "x", ev.alias("ev"), X.ev_to_raw(ev, 2048).alias("back"))


@query("p33_parity_gain", with_px("SELECT frame, y, x, g AS val, " + trunc("g / (CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 2.0 WHEN y % 2 = 1 AND x % 2 = 1 THEN 1.5 ELSE 1.0 END) + 0.5") + " AS undone FROM (SELECT *, " + clamp(trunc("val * (CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 2.0 WHEN y % 2 = 1 AND x % 2 = 1 THEN 1.5 ELSE 1.0 END)")) + " AS g FROM px)"))
def p33(spark, sf):
    gain = F.when((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0), 2.0).when((F.col("y") % 2 == 1) & (F.col("x") % 2 == 1), 1.5).otherwise(1.0)
    g = X.clamp16(X.trunc(V() * gain))
    return T.px(spark, sf).select("frame", "y", "x", g.alias("val"), X.trunc(g / gain + 0.5).alias("undone"))


_Kd = "(4000.0 + l_quantity * 100)"
_xd = f"(CASE WHEN {_Kd} <= 7000 THEN -4.6070e9 / pow({_Kd}, 3) + 2.9678e6 / pow({_Kd}, 2) + 0.09911e3 / {_Kd} + 0.244063 ELSE -2.0064e9 / pow({_Kd}, 3) + 1.9018e6 / pow({_Kd}, 2) + 0.24748e3 / {_Kd} + 0.237040 END)"


@query("p34_daylight_illuminant", f"{_line}, {r6(_xd)} AS x, {r6(f'-3.0 * {_xd} * {_xd} + 2.87 * {_xd} - 0.275')} AS y FROM lineitem")
def p34(spark, sf):
    """Chromaticity of CIE daylight of a colour temperature (fixed values of that standard)."""
    k = 4000.0 + F.col("l_quantity") * 100
    p = lambda n: F.pow(k, F.lit(float(n)))
    x = F.when(k <= 7000, -4.6070e9 / p(3) + 2.9678e6 / p(2) + 0.09911e3 / k + 0.244063).otherwise(-2.0064e9 / p(3) + 1.9018e6 / p(2) + 0.24748e3 / k + 0.237040)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(-3.0 * x * x + 2.87 * x - 0.275, 6).alias("y"))


@query("p35_p36_clip_metadata", f"{_line}, CASE WHEN l_linenumber % 4 = 0 THEN 0.0 ELSE CAST(l_quantity AS DOUBLE) / (l_linenumber % 4) END AS aspect, {r6('1e6 / (100 + l_partkey % 5000)')} AS shutter, {r6('360.0 * (100 + l_partkey % 5000) * 24 / 1e6')} AS angle, {r6('l_extendedprice / 1048576.0 * 8')} AS mbit FROM lineitem")
def p35(spark, sf):
    skip = F.col("l_linenumber") % 4
    us = 100 + F.col("l_partkey") % 5000
    return T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(skip == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("l_quantity").cast("double"), skip)).alias("aspect"),
        (F.round(1e6 / us, 6) + 0.0).alias("shutter"), (F.round(360.0 * us * 24 / 1e6, 6) + 0.0).alias("angle"), (F.round(F.col("l_extendedprice") / 1048576.0 * 8, 6) + 0.0).alias("mbit"),
    )


@query("p37_vector_scope_place", with_rgb("SELECT frame, y, x, " + trunc("128 + (-0.169 * (r >> 8) - 0.331 * (g >> 8) + 0.5 * (b >> 8))") + " AS u, " + trunc("128 + (0.5 * (r >> 8) - 0.419 * (g >> 8) - 0.081 * (b >> 8))") + " AS v FROM rgb"))
def p37(spark, sf):
    r8, g8, b8 = (F.shiftright(c, 8) for c in (R(), G(), B()))
    return _rgb(spark, sf, [X.trunc(F.lit(128) + (r8 * -0.169 - g8 * 0.331 + b8 * 0.5)), X.trunc(F.lit(128) + (r8 * 0.5 - g8 * 0.419 - b8 * 0.081))], ("u", "v"))


_toe = 0.0061
_slope, _at = 1 / (_toe * 9.72 * 0.6931471805599453), (math.log2(_toe) - 1) / 9.72 + 1
_lx = "least(greatest((val - 2048) / CAST(14335 AS DOUBLE), 0.0), 1.0)"
_le = f"floor(greatest(CASE WHEN {_lx} < {_toe} THEN {_at!r} + ({_lx} - {_toe}) * {_slope!r} ELSE (log2(greatest({_lx}, {_toe})) - 1.0) / 9.72 + 1.0 END, 0.0) * 16383.0 + 0.5)"


@query("sk3_log_companding", with_px(f"SELECT frame, y, x, CAST({_le} AS BIGINT) AS encoded, {r6(f'pow(2.0, ({_le} / 16383.0 - 1.0) * 9.72 + 1.0) * 14335.0 + 2048.0')} AS decoded FROM px"))
def sk3(spark, sf):
    e = X.log_encode(V(), 2048, 16383)
    return T.px(spark, sf).select("frame", "y", "x", e.cast("long").alias("encoded"), (F.round(X.log_decode(e, 2048, 16383), 6) + 0.0).alias("decoded"))


@query("sc8_sk5_pack_unpack", with_px("SELECT frame, y, x, (val & 1023) AS low_bits, ((val & 15) << 10) | (val >> 4) AS rotated, ((val & 255) << 8) | (val >> 8) AS swapped, val AS back FROM px"))
def sk5(spark, sf):
    """n-bit packing by shift and mask: rotate a 14-bit sample by 10 bits and back, swap the bytes."""
    rot = lambda v, k: F.shiftleft(v.bitwiseAND(F.lit((1 << (14 - k)) - 1)), k).bitwiseOR(F.shiftright(v, 14 - k))
    return T.px(spark, sf).select(
        "frame", "y", "x", V().bitwiseAND(F.lit(1023)).alias("low_bits"), rot(V(), 10).alias("rotated"),
        F.shiftleft(V().bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(V(), 8)).alias("swapped"), rot(rot(V(), 10), 4).alias("back"),
    )


@query("f1_cut_range", with_px("SELECT frame, y, x, val FROM px WHERE frame + 1 BETWEEN 11 AND 60"))
def f1(spark, sf):
    """Frames of a 1-based inclusive range; the filter reaches the scan, before pixels are made."""
    f = T.frames(spark, sf).where((F.col("frame") + 1).between(11, 60))
    return T.to_long(f)


@query("f2_zebra", with_rgb("SELECT frame, CAST(bit_or(CASE WHEN l >= 156 THEN 2 WHEN l <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS flag, CAST(sum(CASE WHEN l >= 156 THEN 1 ELSE 0 END) AS BIGINT) AS over, CAST(sum(CASE WHEN l <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS under FROM (SELECT frame, (greatest(r, g, b) + least(r, g, b)) // 512 AS l FROM rgb) GROUP BY frame"))
def f2(spark, sf):
    light = X.idiv(F.greatest(R(), G(), B()) + F.least(R(), G(), B()), 512)
    d = T.rgb(spark, sf).select("frame", light.alias("l"))
    return d.groupBy("frame").agg(
        F.bit_or(F.when(F.col("l") >= 156, 2).when(F.col("l") <= 100, 1).otherwise(0)).cast("long").alias("flag"),
        F.count_if(F.col("l") >= 156).alias("over"), F.count_if(F.col("l") <= 100).alias("under"),
    )


@query("f4_f5_f7_gates", with_px("SELECT frame, y, x, val FROM px WHERE val >= 32 AND val <= 14500 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6"))
def f5(spark, sf):
    return T.px(spark, sf).where(V().between(32, 14500) & F.col("y").between(1, 6) & F.col("x").between(1, 6))


@query("f6_a21_point_sampling", with_px("SELECT frame, y // 4 AS y, x // 4 AS x, val FROM px WHERE y % 4 = 0 AND x % 4 = 0"))
def f6(spark, sf):
    return T.px(spark, sf).where((F.col("y") % 4 == 0) & (F.col("x") % 4 == 0)).select("frame", X.idiv(F.col("y"), 4).alias("y"), X.idiv(F.col("x"), 4).alias("x"), "val")


@query("f8_f9_f10_session_filters", "SELECT p_partkey, p_name, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS rule FROM part WHERE p_size % 5 IN (1, 3) AND regexp_matches(lower(p_type), '(steel|brass|tin|copper|nickel|a)')")
def f8(spark, sf):
    p = T.table(spark, sf, "part").where((F.col("p_size") % 5).isin(1, 3) & F.lower("p_type").rlike("(steel|brass|tin|copper|nickel|a)"))
    return p.select("p_partkey", "p_name", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("rule"))


@query("p29_p30_geometry", "WITH e AS (SELECT vec_id AS frame, list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 8191.5) AS BIGINT)) AS a FROM embeddings) SELECT frame, (p - 1) // 8 AS y, (p - 1) % 8 AS x, a[65 - p] AS rotated, a[((p - 1) % 8) * 8 + (p - 1) // 8 + 1] AS transposed FROM e, (SELECT unnest(range(1, 65)) AS p) r")
def p29(spark, sf):
    """Both turns are made within a frame's row."""
    from ..operators import stencil as S

    f = T.frames(spark, sf)
    both = S.transpose(f.withColumn("keep", F.reverse("data")))
    return T.to_long(both.withColumn("data", F.arrays_zip(F.col("keep").alias("rotated"), F.col("data").alias("transposed")))).select("frame", "y", "x", "val.rotated", "val.transposed")


@query("p31_bayer_split", with_px("SELECT frame, y // 2 AS y, x // 2 AS x, CAST((y % 2) * 2 + x % 2 AS BIGINT) AS plane, val FROM px"))
def p31(spark, sf):
    y, x = F.col("y"), F.col("x")
    return T.px(spark, sf).select("frame", X.idiv(y, 2).alias("y"), X.idiv(x, 2).alias("x"), ((y % 2) * 2 + x % 2).alias("plane"), "val")


@query("sc13_cfa_shift", "WITH e AS (SELECT vec_id AS frame, list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 8191.5) AS BIGINT)) AS a FROM embeddings) SELECT frame, (p - 1) // 8 AS y, (p - 1) % 8 AS x, a[CASE WHEN p > 56 THEN p - 8 ELSE p + 8 END] AS val FROM e, (SELECT unnest(range(1, 65)) AS p) r")
def sc13(spark, sf):
    from ..operators import stencil as S

    return T.to_long(S.drop_first(T.frames(spark, sf), rows=1))
