"""Pixel repair in all its forms, pixel map states, dual-exposure merge."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import hdr, repair
from .common import DENSE, at, trunc, with_dense
from .registry import query

BLACK, WHITE = 2048, 15000

# -- repair ------------------------------------------------------------------------------------

_MAP = "((x * 7 + y * 3) % 5 < 3)"
_INNER = "y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4"
_ev = lambda e: f"CAST(trunc(log2(CAST(greatest(1, {e} - {BLACK}) AS DOUBLE)) * 65536.0) AS BIGINT)"
_raw = lambda e: trunc(f"{BLACK}.0 + round(pow(2.0, least(greatest({e}, 0), {repair.MOST_EV}) / 65536.0), 4)")


def _slopes_sql(arms, fallback) -> str:
    slopes = [f"abs({_ev(at(3 * dy, 3 * dx))} - {_ev(at(dy, dx))})" for dy, dx in arms]
    total = f"({' + '.join(slopes)})"
    terms = [f"(({_ev(at(2 * dy, 2 * dx))} * ((({total} - {d}) * 256) // ({total} * {len(arms) - 1}))) >> 8)" for (dy, dx), d in zip(arms, slopes)]
    return f"CASE WHEN {total} = 0 THEN {fallback} ELSE {_raw(' + '.join(terms))} END"


def _directional_sql() -> str:
    half = lambda e: f"(CASE WHEN ({e}) >= 0 THEN ({e}) // 2 ELSE -((-({e})) // 2) END)"
    side = lambda s, dy, dx: f"({at(2 * s * dy, 2 * s * dx)} + {half(f'{at(s * dy, s * dx)} - {at(3 * s * dy, 3 * s * dx)}')})"
    a, b, c, d = side(-1, 1, 0), side(1, 1, 0), side(-1, 0, 1), side(1, 0, 1)
    v, h = f"CAST(abs({a} - {b}) AS DOUBLE)", f"CAST(abs({c} - {d}) AS DOUBLE)"
    share = f"(CASE WHEN {v} + {h} = 0 THEN 0.5::DOUBLE ELSE {h} / nullif({v} + {h}, 0) END)"
    return f"least(greatest({trunc(f'round({share} * {half(f'{a} + {b}')} + (1.0 - {share}) * {half(f'{c} + {d}')}, 6)')}, 0), 65535)"


_WIDE = "list_sort(list_filter([" + ", ".join(f"CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN {at(dy, dx)} END" for dy, dx in repair.WIDE) + "], lambda v: v IS NOT NULL))"
_FORMS = {
    "around": _slopes_sql(repair.VERTICAL + repair.HORIZONTAL, at(0, 2)),
    "vertical": _slopes_sql(repair.VERTICAL, at(2, 0)),
    "horizontal": _slopes_sql(repair.HORIZONTAL, at(0, 2)),
    "directional": _directional_sql(),
    "median": f"{_WIDE}[len({_WIDE}) // 2 + 1]",
}


def _register(method: str) -> None:
    place = _MAP if method == "median" else f"{_MAP} AND {_INNER}"

    @query(f"w7_{method}_repair" if method != "median" else "w7_wide_median_repair", with_dense(f"SELECT frame, y, x, CASE WHEN {place} THEN {_FORMS[method]} ELSE val END AS val FROM pd"))
    def run(spark, sf):
        return T.to_long(repair.repair(T.frames(spark, sf), lambda y, x: (x * 7 + y * 3) % 5 < 3, method, BLACK))


for _method in _FORMS:
    _register(_method)


# -- pixel map states ----------------------------------------------------------------------------


@query("t5_pixel_map_states", """WITH clips AS (SELECT c_custkey AS clip, c_nationkey AS camera, c_custkey % 7 AS mode FROM customer),
maps AS (SELECT DISTINCT s_nationkey AS camera, s_suppkey % 7 AS mode FROM supplier), patterns AS (SELECT n_nationkey AS camera FROM nation WHERE n_regionkey <> 2)
SELECT clip, CASE WHEN m.camera IS NOT NULL OR p.camera IS NOT NULL THEN 2 ELSE 3 END AS state,
  CASE WHEN m.camera IS NOT NULL THEN '0>2' WHEN p.camera IS NOT NULL THEN '0>1>2' ELSE '0>1>3' END AS path
FROM clips LEFT JOIN maps m USING (camera, mode) LEFT JOIN patterns p USING (camera)""")
def t5(spark, sf):
    clips = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("clip"), F.col("c_nationkey").alias("camera"), (F.col("c_custkey") % 7).alias("mode"))
    maps = T.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("camera"), (F.col("s_suppkey") % 7).alias("mode"))
    patterns = T.table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("camera"), F.lit("A").alias("pattern"))
    return repair.map_states(clips, maps, patterns)


# -- dual exposure -------------------------------------------------------------------------------

CORR, RANGE, NOISE = 3.0, 11.0, 40.0
_OV = hdr.overlap(CORR, RANGE)
_START = math.log2(WHITE - BLACK) - _OV - CORR
_e = lambda e: f"(log2(CAST(greatest(1, {e} - {BLACK}) AS DOUBLE)))"
_r = lambda e: trunc(f"{BLACK}.0 + round(pow(2.0, {e}), 4)")


def _three(s: int) -> str:
    cells = [at(s, 1), at(s, -1), at(-2 * s, 0)]
    mean = _r("(" + " + ".join(map(_e, cells)) + ") / 3.0")
    return f"(CASE WHEN greatest({', '.join(cells)}) >= {WHITE} THEN greatest({mean}, {WHITE}) ELSE {mean} END)"


_two = f"(CASE WHEN greatest({at(-2, 0)}, {at(2, 0)}) >= {WHITE} THEN {WHITE} ELSE {_r(f'({_e(at(-2, 0))} + {_e(at(2, 0))}) / 2.0')} END)"
_other = f"(CASE WHEN (y + x) % 2 = 0 THEN {_two} WHEN y % 2 = 0 THEN {_three(-1)} ELSE {_three(1)} END)"
_IT = f"it AS (SELECT frame, y, x, CASE WHEN y % 4 < 2 THEN val ELSE {_other} END AS bright, CASE WHEN y % 4 < 2 THEN {_other} ELSE val END AS dark FROM pd)"
_cosine = lambda ev, start, over: f"round((1.0 - cos(3.141592653589793 * least(greatest({ev} - CAST({start!r} AS DOUBLE), 0.0::DOUBLE), CAST({over!r} AS DOUBLE)) / CAST({over!r} AS DOUBLE))) / 2.0, 9)"
_BW = 14000


@query("w17_dual_exposure_interpolation", f"WITH {DENSE}, {_IT} SELECT frame, y, x, bright, dark FROM it")
def w17(spark, sf):
    return T.to_long(hdr.interpolate_rows(T.frames(spark, sf), BLACK, WHITE)).select("frame", "y", "x", "val.bright", "val.dark")


_oat = lambda dy, dx: at(dy, dx, "o")
_spread = (
    f"(CASE WHEN y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4 THEN over + (({_oat(-1, 0)} + {_oat(0, -1)} + {_oat(0, 1)} + {_oat(1, 0)}) * 820) // 1024"
    f" + (({_oat(-1, -1)} + {_oat(-1, 1)} + {_oat(1, -1)} + {_oat(1, 1)}) * 657) // 1024 ELSE over END)"
)
_MERGE = f"""{_IT},
mx AS (SELECT *, {_cosine(_e('bright'), _START, _OV)} AS k, CASE WHEN bright >= {_BW} OR dark >= {WHITE} THEN 100 ELSE 0 END AS over FROM it),
hf AS (SELECT *, {_r(f"{_e('bright')} * (1.0 - k) + {_e('dark')} * k")} AS half FROM mx),
ol AS (SELECT frame, list(over ORDER BY y, x) AS o FROM hf GROUP BY frame),
sp AS (SELECT hf.*, {_spread} AS spread FROM hf JOIN ol USING (frame)),
bl AS (SELECT frame, y, x, half, CASE WHEN y % 4 < 2 THEN CASE WHEN bright < {_BW} THEN bright ELSE greatest(bright, dark) END ELSE dark END AS native,
  greatest(0.0::DOUBLE, least(greatest({_cosine(_e('bright'), hdr.FULL_START, hdr.FULL_OVER)}, least(spread / 200.0::DOUBLE, 1.0::DOUBLE)), ((bright + dark) // 2 - {BLACK}) / (4.0::DOUBLE * {NOISE}))) AS f FROM sp)
SELECT frame, y, x, round(f, 6) AS f, {_r(f"{_e('half')} * (1.0 - f) + {_e('native')} * f")} AS val FROM bl"""


@query("w20_w21_exposure_merge", f"WITH {DENSE}, {_MERGE}")
def w21(spark, sf):
    """The whole dual-exposure chain, all within a frame's row: interpolation, mix, spread clipping, final blend."""
    return hdr.merge(T.frames(spark, sf), BLACK, WHITE, _BW, CORR, RANGE, NOISE)
