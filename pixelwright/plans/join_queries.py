"""Joins, set-like operators and lookups."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import exprs as X
from ..operators import cube
from ..operators import joins as J
from .common import RGB, clamp, r6, trunc, with_dense, with_index, with_px, with_rgb
from .registry import query


@query("j1_dark_subtract", with_dense("SELECT frame, y, x, greatest(0, least(16383, val - (CAST(s[y * 8 + x + 1] AS BIGINT) + n // 2) // n + 8192)) AS val FROM (SELECT px.* FROM px) q, (SELECT list_transform(range(1, 65), lambda p: list_sum(list_transform(l, lambda a: a[p]))) AS s, len(l) AS n FROM (SELECT list(a) AS l FROM d WHERE frame IN (SELECT vec_id FROM embeddings WHERE label = 0))) k"))
def j1(spark, sf):
    """The dark frame is the half-up average of the frames of label 0."""
    average = X.idiv(F.sum("val") + X.idiv(F.count(F.lit(1)), 2), F.count(F.lit(1))).alias("val")
    dark = T.to_long(T.frames(spark, sf, "label").where("label = 0")).groupBy("y", "x").agg(average).withColumn("frame", F.lit(0).cast("long"))
    return T.to_long(J.dark_subtract(T.frames(spark, sf), T.to_dense(dark), 8192, 16383))


@query("j3_name_semi_join", "SELECT p_partkey, p_name FROM part p WHERE EXISTS (SELECT 1 FROM nation n WHERE contains(lower(p.p_brand), '#' || substr(lower(n.n_name), 8)))")
def j3(spark, sf):
    """contains() join, case-insensitive: a theta join against a dimension of fixed size."""
    n = F.broadcast(T.table(spark, sf, "nation").select(F.concat(F.lit("#"), F.substring(F.lower("n_name"), 8, 9)).alias("s")))
    p = T.table(spark, sf, "part")
    return p.join(n, F.lower("p_brand").contains(F.col("s")), "left_semi").select("p_partkey", "p_name")


@query("j4_name_anti_join", "SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE contains(lower(p.p_brand), '#' || substr(lower(n.n_name), 8)))")
def j4(spark, sf):
    n = F.broadcast(T.table(spark, sf, "nation").select(F.concat(F.lit("#"), F.substring(F.lower("n_name"), 8, 9)).alias("s")))
    p = T.table(spark, sf, "part")
    return p.join(n, F.lower("p_brand").contains(F.col("s")), "left_anti").select("p_partkey", "p_name")


@query("j5_first_match_lookup", "SELECT c_custkey, coalesce(m.first_order, -1) AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1) m ON o_custkey = c_custkey")
def j5(spark, sf):
    first = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    c = T.table(spark, sf, "customer")
    return c.join(first, c.c_custkey == first.o_custkey, "left").select("c_custkey", F.coalesce("first_order", F.lit(-1)).alias("first_order"))


@query("j6_dimension_lookup", "SELECT s_suppkey, coalesce(n_name, 'unknown') AS n_name, coalesce(r_name, 'unknown') AS r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 3 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey")
def j6(spark, sf):
    n, r = T.table(spark, sf, "nation").where("n_nationkey % 3 <> 0"), T.table(spark, sf, "region")
    s = T.table(spark, sf, "supplier")
    d = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
    return d.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("n_name"), F.coalesce("r_name", F.lit("unknown")).alias("r_name"))


@query("j7_sc12_lut_lookup", with_px("SELECT frame, y, x, CAST(floor(sqrt(CAST(val // 64 AS DOUBLE)) * 4096) AS BIGINT) AS val FROM px"))
def j7(spark, sf):
    """A 256-entry table, looked up by array index instead of a join."""
    lut = F.array(*[F.lit(int((k**0.5) * 4096)) for k in range(257)])
    return T.px(spark, sf).select("frame", "y", "x", F.get(lut, X.idiv(F.col("val"), 64).cast("int")).cast("long").alias("val"))


KNOTS = [(0.0, 0.0), (2000.0, 400.0), (6000.0, 5200.0), (9000.0, 11000.0), (12000.0, 14500.0), (16384.0, 16383.0)]
_knots = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in zip(KNOTS, KNOTS[1:])) + ") k(x0, y0, x1, y1)"


@query("j8_curve_range_join", with_px(f"SELECT frame, y, x, {r6('y0 + (y1 - y0) * ((val - x0) / (x1 - x0))')} AS lin, {r6('y0 + (y1 - y0) * ((1 - cos((val - x0) / (x1 - x0) * pi())) / 2)')} AS cosine FROM px JOIN {_knots} ON val >= x0 AND val < x1"))
def j8(spark, sf):
    steps = J.knot_intervals(spark.createDataFrame(KNOTS, "x double, y double"))
    d = J.interpolate(T.px(spark, sf), F.col("val").cast("double"), steps).withColumnRenamed("curve", "lin")
    d = J.interpolate(d, F.col("val").cast("double"), steps, "cosine").withColumnRenamed("curve", "cosine")
    return d.select("frame", "y", "x", (F.round("lin", 6) + 0.0).alias("lin"), (F.round("cosine", 6) + 0.0).alias("cosine"))


@query("j9_audio_sync_offset", with_index("SELECT v.clip, CAST(trunc((v.t - a.t) * CAST(48000 AS DOUBLE) * 4 / 1e6) AS BIGINT) // 4 * 4 AS off FROM (SELECT clip, min(t_us) AS t FROM idx WHERE kind = 'view' GROUP BY clip) v JOIN (SELECT clip, min(t_us) AS t FROM idx WHERE kind <> 'view' GROUP BY clip) a USING (clip)"))
def j9(spark, sf):
    """First time per stream, then the byte offset of a 48 kHz, 4-byte stream, whole samples only."""
    g = T.index(spark, sf).groupBy("clip").agg(F.min(F.when(F.col("kind") == "view", F.col("t_us"))).alias("v"), F.min(F.when(F.col("kind") != "view", F.col("t_us"))).alias("a"))
    off = X.idiv(X.trunc((F.col("v") - F.col("a")) * F.lit(48000.0) * 4 / 1e6), 4) * 4
    return g.where("v is not null and a is not null").select("clip", off.alias("off"))


@query("j9_as_of_join", with_index("SELECT frame, clip, (SELECT p.size FROM idx p WHERE p.clip = i.clip AND p.kind = 'purchase' AND p.ts <= i.ts ORDER BY p.ts DESC, p.frame DESC LIMIT 1) AS last_purchase FROM idx i WHERE kind = 'view'"))
def j9b(spark, sf):
    i = T.index(spark, sf).select("frame", "clip", "ts", "size", "kind")
    views, buys = i.where("kind = 'view'").select("frame", "clip", "ts"), i.where("kind = 'purchase'").select("frame", "clip", "ts", "size")
    return J.as_of(views, buys, "clip", "ts", "frame", "size", "last_purchase").select("frame", "clip", "last_purchase")


@query("j10_layer_frame_join", "SELECT c_custkey AS pos, n_nationkey AS frame FROM customer JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation) o ON n = least(c_custkey + 1, (SELECT count(*) FROM nation))")
def j10(spark, sf):
    """Positions joined to a short clip's frames (the 25 rows of a dimension); past its end the last frame repeats."""
    numbered = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("frame"), F.row_number().over(Window.orderBy("n_nationkey")).alias("n"))
    last = numbered.agg(F.max("n").alias("total"))
    pos = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos")).crossJoin(F.broadcast(last)).withColumn("n", F.least(F.col("pos") + 1, F.col("total")))
    return pos.join(F.broadcast(numbered), "n").select("pos", "frame")


@query("j11_neighbour_self_join", with_px("SELECT frame, y, x, val - (u + d) // 2 AS val FROM (SELECT *, lag(val, 2) OVER w AS u, lead(val, 2) OVER w AS d FROM px WINDOW w AS (PARTITION BY frame, x ORDER BY y)) WHERE u IS NOT NULL AND d IS NOT NULL"))
def j11(spark, sf):
    """Rows against those two above and below: lag and lead in place of a self-join."""
    w = Window.partitionBy("frame", "x").orderBy("y")
    d = T.px(spark, sf).withColumn("u", F.lag("val", 2).over(w)).withColumn("d", F.lead("val", 2).over(w)).where("u is not null and d is not null")
    return d.select("frame", "y", "x", (F.col("val") - X.idiv(F.col("u") + F.col("d"), 2)).alias("val"))


@query("e1_distinct_in_order", "SELECT l_shipdate, min(l_orderkey) AS pos FROM lineitem GROUP BY l_shipdate")
def e1(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_shipdate").agg(F.min("l_orderkey").alias("pos"))


@query("e2_e3_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def e2(spark, sf):
    known = T.table(spark, sf, "orders").select("o_custkey").distinct().withColumn("has_orders", F.lit(True))
    c = T.table(spark, sf, "customer")
    return c.join(known, c.c_custkey == known.o_custkey, "left").select("c_custkey", F.coalesce("has_orders", F.lit(False)).alias("has_orders"))


@query("e3_overwrite_list", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def e3(spark, sf):
    return T.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).intersect(T.table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("e4_e6_session_edit", "(SELECT c_custkey AS clip FROM customer UNION ALL SELECT s_suppkey + 10000000 FROM supplier) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def e4(spark, sf):
    """Append clips, delete the selected ones."""
    every = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("clip")).unionAll(T.table(spark, sf, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("clip")))
    gone = T.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("clip"))
    return every.distinct().join(gone, "clip", "left_anti")


@query("e5_plane_union", with_px("SELECT frame, 2 * (y // 2) + dy AS y, 2 * (x // 2) + dx AS x, val FROM (SELECT frame, y, x, val, y % 2 AS dy, x % 2 AS dx FROM px)"))
def e5(spark, sf):
    """Four quarter planes interleaved back to a frame."""
    y, x = F.col("y"), F.col("x")
    planes = T.px(spark, sf).select("frame", X.idiv(y, 2).alias("py"), X.idiv(x, 2).alias("pxx"), ((y % 2) * 2 + x % 2).alias("plane"), "val")
    out = None
    for k in range(4):
        part = planes.where(F.col("plane") == k).select("frame", (F.col("py") * 2 + k // 2).alias("y"), (F.col("pxx") * 2 + k % 2).alias("x"), "val")
        out = part if out is None else out.unionAll(part)
    return out


@query("e7_masked_paste", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN s.p_size ELSE p.p_size END AS size, CASE WHEN p_partkey % 3 = 0 THEN s.p_retailprice ELSE p.p_retailprice END AS price FROM part p, (SELECT p_size, p_retailprice FROM part ORDER BY p_partkey LIMIT 1) s")
def e7(spark, sf):
    """Fields of one preset pasted into the others where the mask says so."""
    p = T.table(spark, sf, "part")
    first = p.agg(F.min_by(F.struct("p_size", "p_retailprice"), "p_partkey").alias("s"))  # one row
    return p.crossJoin(F.broadcast(first)).select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("s.p_size")).otherwise(F.col("p_size")).alias("size"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("s.p_retailprice")).otherwise(F.col("p_retailprice")).alias("price"),
    )


_layers = "SELECT frame // 4 AS clip, y, x, frame % 4 AS layer, val / 16383.0 AS v, CASE WHEN frame % 4 = 0 THEN 1.0 ELSE least(least(x, 7 - x) / 3.0, 1.0) * least(least(y, 7 - y) / 3.0, 1.0) END AS alpha, frame % 4 = 2 AS difference FROM px"


@query("e8_layer_compositing", with_px(f", l AS ({_layers}), s AS (SELECT clip, y, x, max(CASE WHEN layer = 0 THEN v END) AS v0, max(CASE WHEN layer = 1 THEN v END) AS v1, max(CASE WHEN layer = 2 THEN v END) AS v2, max(CASE WHEN layer = 3 THEN v END) AS v3, max(CASE WHEN layer = 1 THEN alpha END) AS a FROM l GROUP BY ALL) SELECT clip, y, x, {r6('v3 * a + abs((v1 * a + v0 * (1 - a)) - v2) * (1 - a)')} AS v FROM s").replace(") , l AS", "), l AS"))
def e8(spark, sf):
    """Four layers with feathered edges over each other, one of them as a difference; null where a clip lacks one."""
    y, x = F.col("y"), F.col("x")
    feather = F.least(F.least(x, 7 - x) / 3.0, F.lit(1.0)) * F.least(F.least(y, 7 - y) / 3.0, F.lit(1.0))
    layer = F.col("frame") % 4
    d = T.px(spark, sf).select(X.idiv(F.col("frame"), 4).alias("clip"), "y", "x", layer.alias("layer"), (F.col("val") / 16383.0).alias("v"), F.when(layer == 0, 1.0).otherwise(feather).alias("alpha"), (layer == 2).alias("difference"))
    return J.composite(d, "clip", "y", "x", count=4).select("clip", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@query("e9_canvas_extent", "SELECT p_brand, min(p_size) AS x0, max(p_size + p_partkey % 50) AS x1, min(p_partkey % 40) AS y0, max(p_partkey % 40 + p_size) AS y1 FROM part GROUP BY p_brand")
def e9(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    return T.table(spark, sf, "part").groupBy("p_brand").agg(F.min(s).alias("x0"), F.max(s + k % 50).alias("x1"), F.min(k % 40).alias("y0"), F.max(k % 40 + s).alias("y1"))


def _lut(t: str, table: str) -> str:
    return table.replace("#", t)


_c = lambda c: f"({c} / CAST(65536 AS DOUBLE) * 3)"
_f = lambda e: f"({e} * {e} / 9.0 * 65535.0)"


@query("p22_cube_lut_1d", with_rgb("SELECT frame, y, x, " + ", ".join(f"{trunc(f'{c} * 0.5 + round({_f(f'floor({_c(c)})')} + ({_f(f'least(floor({_c(c)}) + 1, 3)')} - {_f(f'floor({_c(c)})')}) * ({_c(c)} - floor({_c(c)})), 6) * 0.5')} AS {c}" for c in "rgb") + " FROM rgb"))
def p22(spark, sf):
    """One-dimensional table of four entries (squares), linear between them, mixed half and half."""
    entries = F.array(*[F.lit(k * k / 9.0 * 65535.0) for k in range(4)])

    def look(c):
        t = c / F.lit(65536.0) * 3
        i = F.floor(t).cast("int")
        lo, hi = F.get(entries, i), F.get(entries, F.least(i + 1, F.lit(3)))
        return X.trunc(c * 0.5 + F.round(lo + (hi - lo) * (t - i), 6) * 0.5)

    return T.rgb(spark, sf).select("frame", "y", "x", *[look(F.col(c)).alias(c) for c in "rgb"])


#: A table of 17 a side whose outputs bend differently along each axis: whole numbers i, j, k of a place in, components out.
SIDE = 17
_TABLE = [((2 * i + 3 * j + i * j) / 336.0, (j * j + k) / 272.0, 1 - (i + 4 * k) / 80.0) for k in range(SIDE) for j in range(SIDE) for i in range(SIDE)]
_PLACES = {c: f"({c} * 16 / 65536.0::DOUBLE)" for c in "rgb"}
_LUT = "lu AS (SELECT frame, y, x, r, g, b, " + ", ".join(f"floor({e}) AS i{c}, least(floor({e}) + 1, 16) AS j{c}, {e} - floor({e}) AS f{c}" for c, e in _PLACES.items()) + " FROM rgb)"


def _corner(which: str, out: int) -> str:
    """The table's entry at a corner of the cell; which holds, for r, g and b, i (this side) or j (the next)."""
    i, j, k = (f"{w}{c}" for w, c in zip(which, "rgb"))
    return (f"((2 * {i} + 3 * {j} + {i} * {j}) / 336.0::DOUBLE)", f"(({j} * {j} + {k}) / 272.0::DOUBLE)", f"(1 - ({i} + 4 * {k}) / 80.0::DOUBLE)")[out]


def _path_sql(order: tuple[int, int, int], out: int) -> str:
    at, before = ["i"] * 3, _corner("iii", out)
    total = before
    for axis in order:
        at[axis] = "j"
        here = _corner("".join(at), out)
        total, before = f"{total} + f{'rgb'[axis]} * ({here} - {before})", here
    return f"({total})"


def _tetrahedral_sql(out: int) -> str:
    orders = [((0, 1, 2), "fr >= fg AND fg >= fb"), ((0, 2, 1), "fr >= fb AND fb >= fg"), ((1, 0, 2), "fg >= fr AND fr >= fb"), ((1, 2, 0), "fg >= fb AND fb >= fr"), ((2, 0, 1), "fb >= fr AND fr >= fg")]
    return "CASE " + " ".join(f"WHEN {when} THEN {_path_sql(order, out)}" for order, when in orders) + f" ELSE {_path_sql((2, 1, 0), out)} END"


def _trilinear_sql(out: int) -> str:
    corners = [("".join(w), " * ".join(f"f{c}" if v == "j" else f"(1 - f{c})" for v, c in zip(w, "rgb"))) for w in itertools.product("ij", repeat=3)]
    return "(" + " + ".join(f"{weight} * {_corner(w, out)}" for w, weight in corners) + ")"


def _mixed_sql(found: str, c: str, strength: float) -> str:
    return trunc(f"round({c} * CAST({1 - strength!r} AS DOUBLE) + {clamp(trunc(f'round({found} * 65535.0, 6)'))} * CAST({strength!r} AS DOUBLE), 6)")


def _cube_query(sql, strength: float) -> str:
    return f"WITH {RGB}, {_LUT} SELECT frame, y, x, {', '.join(f'{_mixed_sql(sql(k), c, strength)} AS {c}' for k, c in enumerate('rgb'))} FROM lu"


@query("p22_cube_lut_3d", _cube_query(_tetrahedral_sql, 0.75))
def p22c(spark, sf):
    """A three-dimensional table of 17 a side, tetrahedral, mixed by a strength; the table is shared once and looked up batch by batch."""
    return cube.apply(T.rgb(spark, sf), _TABLE, SIDE, strength=0.75)


@query("p22_cube_lut_trilinear", _cube_query(_trilinear_sql, 1.0))
def p22t(spark, sf):
    return cube.apply(T.rgb(spark, sf), _TABLE, SIDE, method="trilinear")


@query("sc16_pixel_map_edit", "SELECT y, x FROM (SELECT (p_partkey * 7) % 600 AS y, (p_partkey * 11) % 900 AS x FROM part) GROUP BY ALL HAVING (y, x) NOT IN (SELECT (s_suppkey * 7) % 600, (s_suppkey * 11) % 900 FROM supplier)")
def sc16(spark, sf):
    """Add pixels to a map, remove others."""
    p = T.table(spark, sf, "part")
    m = p.select(((F.col("p_partkey") * 7) % 600).alias("y"), ((F.col("p_partkey") * 11) % 900).alias("x")).distinct()
    gone = T.table(spark, sf, "supplier").select(((F.col("s_suppkey") * 7) % 600).alias("y"), ((F.col("s_suppkey") * 11) % 900).alias("x"))
    return m.join(gone, ["y", "x"], "left_anti")
