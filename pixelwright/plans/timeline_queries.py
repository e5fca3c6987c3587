"""Frame index, timecode, playback, scalar functions of metadata; batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import exprs as X
from ..functions import lang
from .common import r6, with_index, with_px
from .registry import query


@query("sc7_frame_rate", with_index(f"SELECT clip, greatest(1, CAST(round(1e6 * 3600 * (count(*) - 1) / nullif(max(t_us) - min(t_us), 0)) AS BIGINT)) AS rate, count(*) AS frames FROM idx GROUP BY clip HAVING count(*) > 1"))
def sc7(spark, sf):
    g = T.index(spark, sf).groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.min("t_us").alias("a"), F.max("t_us").alias("b")).where("frames > 1")
    rate = F.round(F.lit(1e6) * 3600 * (F.col("frames") - 1) / (F.col("b") - F.col("a"))).cast("long")
    return g.select("clip", F.greatest(F.lit(1).cast("long"), rate).alias("rate"), "frames")


@query("sc14_audio_sizes", with_index("SELECT clip, kind, CAST(sum(CAST(floor(size) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS blocks FROM idx GROUP BY ALL"))
def sc14(spark, sf):
    return T.index(spark, sf).groupBy("clip", "kind").agg(F.sum(F.floor("size")).alias("bytes"), F.count(F.lit(1)).alias("blocks"))


@query("sc5_index_first_last_wins", with_index("SELECT clip, arg_min(kind, frame) AS first_kind, arg_max(kind, frame) AS last_kind, min(frame) AS first_frame, max(frame) AS last_frame FROM idx GROUP BY clip"))
def sc5(spark, sf):
    """Header blocks of which the first or the last one counts."""
    return T.index(spark, sf).groupBy("clip").agg(
        F.min_by("kind", "frame").alias("first_kind"), F.max_by("kind", "frame").alias("last_kind"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")
    )


@query("o1_index_order", with_index("SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY t_us, frame) AS n FROM idx"))
def o1(spark, sf):
    """Position of a frame in its clip by time; ties in order of arrival."""
    w = Window.partitionBy("clip").orderBy("t_us", "frame")
    return T.index(spark, sf).select("clip", "frame", F.row_number().over(w).cast("long").alias("n"))


@query("o3_o4_first_frames", with_index("SELECT frame, clip, kind, size FROM idx ORDER BY size DESC, frame LIMIT 128"))
def o3(spark, sf):
    """A capped, sorted listing: the limit is the feature (top-k)."""
    return T.index(spark, sf).orderBy(F.desc("size"), "frame").limit(128).select("frame", "clip", "kind", "size")


@query("o5_sorted_rows", with_px("SELECT frame, y, list_sort(list(val)) [4] AS fourth FROM px GROUP BY ALL"))
def o5(spark, sf):
    return T.px(spark, sf).groupBy("frame", "y").agg(F.element_at(F.array_sort(F.collect_list("val")), 4).alias("fourth"))


@query("o6_longest_clip", with_index("SELECT kind, clip, n FROM (SELECT kind, clip, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, clip) AS k FROM (SELECT kind, clip, count(*) AS n FROM idx GROUP BY ALL)) WHERE k = 1"))
def o6(spark, sf):
    n = T.index(spark, sf).groupBy("kind", "clip").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("kind").agg(F.max(F.struct("n", (-F.col("clip")).alias("c"))).alias("m"))
    return best.select("kind", (-F.col("m.c")).alias("clip"), F.col("m.n").alias("n"))


@query("t1_drop_frame_playback", with_index("SELECT clip, slot, max(frame) AS frame, count(*) - 1 AS dropped FROM (SELECT clip, frame, CAST(floor(t_us / CAST(3600000000 AS DOUBLE)) AS BIGINT) AS slot FROM idx) GROUP BY ALL"))
def t1(spark, sf):
    """Of the frames that fall into one display slot the last is shown."""
    slot = F.floor(F.col("t_us") / F.lit(3.6e9))
    return T.index(spark, sf).groupBy("clip", slot.alias("slot")).agg(F.max("frame").alias("frame"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("t2_loop_in_cut", with_index("SELECT frame, 10 + (frame * 3) % 41 AS shown, least(10 + frame * 3, 50) AS held FROM idx"))
def t2(spark, sf):
    f = F.col("frame") * 3
    return T.index(spark, sf).select("frame", (f % 41 + 10).alias("shown"), F.least(f + 10, F.lit(50)).alias("held"))


@query("t4_first_frame_state", with_px("SELECT frame, y, x, val - first_value(val) OVER (PARTITION BY label, y, x ORDER BY frame) AS val FROM px JOIN embeddings ON vec_id = frame"))
def t4(spark, sf):
    """Coefficients of a clip's first frame, used for all its frames. The first frame is an aggregate per clip."""
    f = T.frames(spark, sf, "label")
    first = f.groupBy("label").agg(F.min_by("data", "frame").alias("first"))
    both = f.join(first, "label").withColumn("data", F.zip_with("data", "first", lambda a, b: a - b))
    return T.to_long(both)


@query("t7_tumbling_windows", with_index("SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS start_us, kind, count(*) AS n, round(sum(size), 4) AS total FROM idx GROUP BY ALL"))
def t7(spark, sf):
    e = T.index(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("size"), 4).alias("total"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "kind", "n", "total")


@query("t7_session_windows", with_index("SELECT clip, min(t_us) AS start_us, max(t_us) + 21600000000 AS end_us, count(*) AS n FROM (SELECT clip, t_us, sum(fresh) OVER (PARTITION BY clip ORDER BY t_us, frame ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT clip, t_us, frame, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY clip ORDER BY t_us, frame) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM idx)) GROUP BY clip, s"))
def t7s(spark, sf):
    e = T.index(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("clip", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("clip", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


@query("t7_sliding_windows", with_index("SELECT (t_us // 3600000000 - k) * 3600000000 AS start_us, count(*) AS n FROM idx, (SELECT unnest(range(0, 3)) AS k) GROUP BY ALL"))
def t7l(spark, sf):
    e = T.index(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


# 2.10: scalar functions -------------------------------------------------------------------

_LINE = "SELECT l_orderkey, l_linenumber"
_U = "(l_quantity / 60.0)"
_MATH = {
    "trig": "sin(x) + cos(x) + tan(x) + asin(x) + acos(x) + atan(x) + atan2(x, 2)",
    "hyper": "sinh(x) + cosh(x) + tanh(x) + exp(x) + sqrt(x) + abs(x - 1)",
    "logs": "ln(x + 1) + log(x + 1) + log10(x + 2) + pow(x, 3) + pi * e",
    "whole": "ceil(x * 7) + floor(x * 9) + fac(5) + ncr(6, 2) + npr(5, 2) + (x * 10) % 3",
    "branch": "(x <= 0.5) ? x : 1 - x",
    "signs": "-x^2 + 2^3^2 - -x",
}


@query("fn_expression_language", f"{_LINE}, " + ", ".join(f"{r6(lang.compile_sql(t, _U))} AS {n}" for n, t in _MATH.items()) + " FROM lineitem")
def fn_lang(spark, sf):
    u = F.col("l_quantity") / 60.0
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[(F.round(lang.compile_column(t, u), 6) + 0.0).alias(n) for n, t in _MATH.items()])


@query("fn_interpolation", f"{_LINE}, {r6(f'10 + (20 - 10) * {_U}')} AS lin, {r6(f'(10 + 10 * {_U}) + ((30 + 25 * {_U}) - (10 + 10 * {_U})) * l_discount')} AS bilinear FROM lineitem")
def fn_interp(spark, sf):
    u, v = F.col("l_quantity") / 60.0, F.col("l_discount")
    low, high = X.lerp(F.lit(10), F.lit(20), u), X.lerp(F.lit(30), F.lit(55), u)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.round(low, 6) + 0.0).alias("lin"), (F.round(X.lerp(low, high, v), 6) + 0.0).alias("bilinear"))


@query("fn_matrix_inverse", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r6(v)} AS {n}" for v, n in (("l_quantity", "a"), ("l_discount", "b"), ("l_tax", "c"))) + " FROM lineitem")
def fn_matrix(spark, sf):
    """A matrix and its inverse give the input back."""
    m = [2.0, 0.5, 0.1, 0.3, 1.5, 0.2, 0.1, 0.4, 1.1]
    cols = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]
    back = X.matrix(X.matrix(cols, m), X.invert(m))
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(back, "abc")])


@query("fn_strings", "SELECT c_custkey, lower(c_name) AS low, split_part(c_name, '#', 1) AS stem, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, replace(c_name, 'Customer', 'clip') AS renamed, contains(lower(c_name), '12') AS has12, starts_with(c_name, 'C') AS c, ends_with(c_name, '7') AS seven, regexp_replace(c_name, '[0-9]+$', '') AS cut FROM customer")
def fn_strings(spark, sf):
    n = F.col("c_name")
    return T.table(spark, sf, "customer").select(
        "c_custkey", F.lower(n).alias("low"), F.substring_index(n, "#", 1).alias("stem"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.replace(n, F.lit("Customer"), F.lit("clip")).alias("renamed"), F.contains(F.lower(n), F.lit("12")).alias("has12"), F.startswith(n, F.lit("C")).alias("c"),
        F.endswith(n, F.lit("7")).alias("seven"), F.regexp_replace(n, "[0-9]+$", "").alias("cut"),
    )


@query("fn_curve_text", "SELECT p_partkey, CAST(len(string_split(t, '?')) AS INT) AS curves, CAST(len(string_split(string_split(t, '?')[1], ';')) AS INT) // 2 AS points, CAST(string_split(string_split(t, '?')[1], ';')[4] AS DOUBLE) AS y2 FROM (SELECT p_partkey, '0;0;0.5;' || CAST(p_size AS VARCHAR) || ';1;1?0;0;1;1?' AS t FROM part)")
def fn_curve(spark, sf):
    t = F.concat(F.lit("0;0;0.5;"), F.col("p_size").cast("string"), F.lit(";1;1?0;0;1;1?"))
    first = F.split(F.get(F.split(t, "\\?"), F.lit(0)), ";")
    return T.table(spark, sf, "part").select("p_partkey", F.size(F.split(t, "\\?")).alias("curves"), X.idiv(F.size(first), 2).cast("int").alias("points"), F.get(first, F.lit(3)).cast("double").alias("y2"))


@query("fn_hex_hash_bits", "SELECT p_partkey, lower(to_hex(p_partkey + 2147483648)) AS camera, sha1('blob ' || CAST(length(p_name) AS VARCHAR) || chr(58) || p_name) AS digest, p_partkey & 7 AS low3, (p_partkey << 3) | 5 AS packed, p_partkey // 16 * 16 AS aligned, (p_partkey + 15) // 16 * 16 AS aligned_up FROM part")
def fn_hex(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_name")
    return T.table(spark, sf, "part").select(
        "p_partkey", F.lower(F.hex(k + 2147483648)).alias("camera"), F.sha1(F.concat(F.lit("blob "), F.char_length(n).cast("string"), F.lit(":"), n)).alias("digest"),
        k.bitwiseAND(F.lit(7)).alias("low3"), F.shiftleft(k, 3).bitwiseOR(F.lit(5)).alias("packed"), (X.idiv(k, 16) * 16).alias("aligned"), (X.idiv(k + 15, 16) * 16).alias("aligned_up"),
    )


@query("fn_timecode", with_index("SELECT frame, printf('%02d:%02d:%02d:%02d', (frame // 24 // 3600) % 24, (frame // 24 // 60) % 60, (frame // 24) % 60, frame % 24) AS tc, ((frame % 60) // 10) * 16 + (frame % 60) % 10 AS bcd, strftime(ts + to_seconds(clip), '%Y:%m:%d %H:%M:%S') AS clock FROM idx"))
def fn_timecode(spark, sf):
    f = F.col("frame")
    clock = F.date_format(F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("clip")), "yyyy:MM:dd HH:mm:ss")
    return T.index(spark, sf).select("frame", X.timecode(f, F.lit(23.976)).alias("tc"), X.bcd(f % 60).alias("bcd"), clock.alias("clock"))


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, length(props) AS size, json_valid(props) AS valid FROM events")
def fn_json(spark, sf):
    e = T.table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.char_length("props").cast("long").alias("size"), F.try_parse_json("props").isNotNull().alias("valid"))
