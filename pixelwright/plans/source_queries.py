"""Source and sink formats: files are made from the tables, then read by the format's own reader."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from .. import scratch
from .. import tables as T
from ..functions import exprs as X
from ..functions import lang
from ..sources import container, samples, stills, text_formats, trailer_container
from ..streaming import playback
from .common import r6, with_dense, with_index, with_px, with_rgb
from .registry import query

# -- tagged blocks -------------------------------------------------------------------------------

_TAG = "CASE frame % 3 WHEN 0 THEN 'VIDF' WHEN 1 THEN 'AUDF' ELSE 'RTCI' END"


def _blocks(spark, sf):
    """One block per index event: its tag, time and kind as payload."""
    return T.index(spark, sf).select("clip", "frame", "t_us", F.expr(_TAG).alias("tag"), container.block_bytes(F.expr(_TAG), F.col("t_us"), F.encode("kind", "utf-8")).alias("block"))


def _mlv(clip="clip", ext=".MLV"):
    return F.concat(F.col(clip).cast("string"), F.lit(ext))


_SIZED = f"sized AS (SELECT clip, frame, t_us, {_TAG} AS type, 16 + strlen(kind) AS size FROM idx)"


@query("sc1_container_blocks", with_index(f", {_SIZED} SELECT CAST(clip AS VARCHAR) AS clip, CAST(sum(size) OVER (PARTITION BY clip ORDER BY frame) - size AS BIGINT) AS \"offset\", type, size, t_us AS ts FROM sized"))
def sc1(spark, sf):
    """Walk the blocks of one file per clip."""
    files = container.chunk_files(_blocks(spark, sf).withColumn("path", _mlv()), "path", "frame")
    return container.parse_files(files, payload=False).select("clip", "offset", "type", "size", "ts")


@query("sc2_spanned_clips", with_index(", f AS (SELECT CAST(clip AS VARCHAR) AS clip, CAST(frame % 3 AS INT) AS chunk FROM idx WHERE NOT (clip % 2 = 0 AND frame % 3 = 1)), c AS (SELECT clip, chunk, count(*) AS blocks FROM f GROUP BY ALL) SELECT * FROM c WHERE chunk = 0 OR (chunk = 1 AND EXISTS (SELECT 1 FROM c d WHERE d.clip = c.clip AND d.chunk = 0)) OR (chunk = 2 AND EXISTS (SELECT 1 FROM c d WHERE d.clip = c.clip AND d.chunk = 0) AND EXISTS (SELECT 1 FROM c d WHERE d.clip = c.clip AND d.chunk = 1))"))
def sc2(spark, sf):
    """Three files per clip; where the second is missing, the third isn't read."""
    rows = _blocks(spark, sf).withColumn("chunk", (F.col("frame") % 3).cast("int")).where("not (clip % 2 = 0 and chunk = 1)")
    name = F.concat(F.col("clip").cast("string"), F.element_at(F.array(F.lit(".MLV"), F.lit(".M00"), F.lit(".M01")), F.col("chunk") + 1))
    found = container.parse_files(container.chunk_files(rows.withColumn("path", name), "path", "frame"), payload=False)
    return container.contiguous_chunks(found).groupBy("clip", "chunk").agg(F.count(F.lit(1)).alias("blocks"))


@query("sc3_resync", with_index(f", {_SIZED} SELECT CAST(clip AS VARCHAR) AS clip, CAST(sum(size + CASE WHEN frame % 5 = 0 THEN 7 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame) - size AS BIGINT) AS \"offset\", type, t_us AS ts FROM sized"))
def sc3(spark, sf):
    """Seven bytes of garbage before each fifth block: the reader finds the next known tag."""
    rows = _blocks(spark, sf).withColumn("block", F.when(F.col("frame") % 5 == 0, F.concat(F.encode(F.lit("garbage"), "utf-8"), F.col("block"))).otherwise(F.col("block")))
    files = container.chunk_files(rows.withColumn("path", _mlv()), "path", "frame")
    return container.parse_files(files, payload=False).select("clip", "offset", "type", "ts")


@query("sc4_preview_open", with_index(f", {_SIZED} SELECT CAST(clip AS VARCHAR) AS clip, type, t_us AS ts FROM (SELECT *, coalesce(sum(CASE WHEN type = 'VIDF' THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized) WHERE before = 0"))
def sc4(spark, sf):
    """Only up to a clip's first video frame."""
    files = container.chunk_files(_blocks(spark, sf).withColumn("path", _mlv()), "path", "frame")
    return container.parse_files(files, max_frames=1, payload=False).select("clip", "type", "ts")


@query("sk1_container_export", with_index(f", {_SIZED} SELECT CAST(clip AS VARCHAR) || '.MLV' AS path, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS blocks, string_agg(type, '' ORDER BY t_us, frame) AS tags FROM sized GROUP BY clip"))
def sk1(spark, sf):
    """One container per clip, its blocks in order of time; read back to list the tags."""
    files = container.chunk_files(_blocks(spark, sf).withColumn("path", _mlv()), "path", "t_us", "frame").withColumn("bytes", F.octet_length("content").cast("long"))
    back = container.parse_files(files, payload=False).groupBy("clip").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "type"))), lambda s: s["type"]), "").alias("tags"), F.count(F.lit(1)).alias("blocks"))
    return files.join(back, files["path"] == F.concat(back["clip"], F.lit(".MLV"))).select("path", "bytes", "blocks", "tags")


@query("sc6_trailer_container", with_index("SELECT CAST(clip AS VARCHAR) AS clip, row_number() OVER (PARTITION BY clip ORDER BY t_us, frame) - 1 AS number, t_us AS ts, CAST(frame % 800 AS INT) AS iso, CAST(frame % 3 + 1 AS BIGINT) AS bytes FROM idx"))
def sc6(spark, sf):
    """A container with a trailing index per clip, written in order of arrival, listed in order of time."""

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["frame"])
        frames = [(r["t_us"] * 1000, json.dumps({"iso": r["frame"] % 800}), bytes(r["frame"] % 3 + 1)) for r in rows]
        return pa.table({"path": [str(rows[0]["clip"])], "content": pa.array([trailer_container.build("{}", frames)], pa.binary())})

    files = T.index(spark, sf).select("clip", "frame", "t_us").groupBy("clip").applyInArrow(build, "path string, content binary")
    return trailer_container.frames(trailer_container.parse_files(files)).select("clip", "number", "ts", "iso", F.octet_length("payload").cast("long").alias("bytes"))


# -- text formats --------------------------------------------------------------------------------


@query("sc15_pixel_map", "SELECT CAST(p_partkey % 1872 AS INT) AS x, CAST(p_partkey * 7 % 1059 AS INT) AS y, '80000301' AS camera, 1872 AS width, 1059 AS height FROM part")
def sc15(spark, sf):
    """A pixel map written as text and read again; camera and size come from its name."""
    path = f"{scratch.folder(spark, 'maps')}/80000301_1872x1059.fpm"
    text_formats.write_pixel_map(T.table(spark, sf, "part").select((F.col("p_partkey") % 1872).alias("x"), (F.col("p_partkey") * 7 % 1059).alias("y")), path)
    return text_formats.pixel_map(spark, path)


def _cube(spark, n: int = 5) -> str:
    """A three-dimensional table file of n entries a side: the colour's complement, red fastest."""
    lines = ['TITLE "complement"', "# made here", f"LUT_3D_SIZE {n}", "DOMAIN_MIN 0 0 0", "DOMAIN_MAX 1 1 1"]
    lines += [f"{1 - r / (n - 1)!r} {1 - g / (n - 1)!r} {1 - b / (n - 1)!r}" for b in range(n) for g in range(n) for r in range(n)]
    path = scratch.folder(spark, "cube")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


@query("sc17_cube_lut", "SELECT CAST(b * 25 + g * 5 + r AS INT) AS place, 1 - r / 4.0::DOUBLE AS r, 1 - g / 4.0::DOUBLE AS g, 1 - b / 4.0::DOUBLE AS b FROM (SELECT unnest(range(0, 5)) AS r), (SELECT unnest(range(0, 5)) AS g), (SELECT unnest(range(0, 5)) AS b)")
def sc17(spark, sf):
    lut = text_formats.cube_lut(spark, _cube(spark))
    return spark.createDataFrame([(k, *e) for k, e in enumerate(lut["entries"])], "place int, r double, g double, b double")


@query("sc18_sk11_presets_xml", "SELECT 4 AS version, CAST(p_size AS INT) AS exposure, CAST(p_size * 2 AS INT) AS contrast, 75 AS pivot, 6000 AS temperature, p_name AS \"gradationCurve\" FROM part")
def sc18(spark, sf):
    """Presets written as XML and read again; a setting without a tag gets its default."""
    path = scratch.folder(spark, "presets")
    p = T.table(spark, sf, "part").select(F.lit(4).alias("version"), F.col("p_size").cast("int").alias("exposure"), (F.col("p_size") * 2).cast("int").alias("contrast"), F.col("p_name").alias("gradationCurve"))
    text_formats.write_presets(p, path)
    return text_formats.presets(spark, path).select("version", "exposure", "contrast", "pivot", "temperature", "gradationCurve")


@query("sc18_session_xml", "SELECT '/clips/' || s_suppkey || '.MLV' AS file, s_suppkey || '.MLV' AS relative, CAST(s_nationkey % 4 AS INT) AS mark FROM supplier")
def sc18s(spark, sf):
    """A session of clips, written and read as XML attributes."""
    path = scratch.folder(spark, "session")
    key = F.col("s_suppkey").cast("string")
    rows = T.table(spark, sf, "supplier").select(F.concat(F.lit("/clips/"), key, F.lit(".MLV")).alias("_file"), F.concat(key, F.lit(".MLV")).alias("_relative"), (F.col("s_nationkey") % 4).cast("int").alias("_mark"))
    rows.write.format("xml").option("rootTag", "session").option("rowTag", "clip").save(path)
    return text_formats.session(spark, path)


@query("sc19_edit_list", "SELECT n_name AS name, CAST(min(n_nationkey) AS INT) AS pos FROM nation GROUP BY n_name")
def sc19(spark, sf):
    """Clip names of an edit list, each with its first place; every name occurs twice under different tags."""
    path = scratch.folder(spark, "edits")
    tag = F.when(F.col("n_nationkey") % 2 == 0, "clip").otherwise("asset-clip")
    items = T.table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("<"), tag, F.lit(' id="1" name="'), "n_name", F.lit('.[0-9].MLV"/>')).alias("one"), F.concat(F.lit('<clipitem name="'), "n_name", F.lit('.mov"/>')).alias("two"))
    whole = items.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "one", "two"))).alias("l"))
    whole.select(F.concat(F.lit("<fcpxml>\n"), F.array_join(F.transform("l", lambda s: s["one"]), "\n"), F.lit("\n"), F.array_join(F.transform("l", lambda s: s["two"]), "\n"), F.lit("\n</fcpxml>")).alias("value")).write.text(path)
    return text_formats.edit_list(spark, path)


@query("sc20_properties", "SELECT 'supplier.' || s_suppkey AS key, s_name || ' = ' || s_nationkey AS value FROM supplier")
def sc20(spark, sf):
    path = scratch.folder(spark, "properties")
    s = T.table(spark, sf, "supplier")
    line = F.concat(F.lit("supplier."), F.col("s_suppkey").cast("string"), F.lit(" = "), "s_name", F.lit(" = "), F.col("s_nationkey").cast("string"))
    s.select(line.alias("value")).unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return text_formats.properties(spark, path)


@query("sc21_map_listing", "SELECT s_name AS name, CAST(strlen(s_name) AS BIGINT) AS size, s_suppkey % 3 = 0 AS stale FROM supplier")
def sc21(spark, sf):
    """A remote listing's digests against the files' own."""
    s = T.table(spark, sf, "supplier")
    sha = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length("s_name").cast("string")), "utf-8"), F.unhex(F.lit("00")), F.encode("s_name", "utf-8")))
    listed = F.when(F.col("s_suppkey") % 3 == 0, F.lit("0" * 40)).otherwise(sha)
    listing = F.concat(F.lit('[{"name": "'), "s_name", F.lit('", "size": '), F.length("s_name").cast("string"), F.lit(', "sha": "'), listed, F.lit('"}]'))
    d = s.select(F.encode("s_name", "utf-8").alias("content"), F.explode(text_formats.map_listing(listing)).alias("f"))
    return d.select("f.name", "f.size", text_formats.stale(F.col("content"), F.col("f.sha")).alias("stale"))


@query("sc22_discovery", "SELECT DISTINCT CAST(n_regionkey AS INT) AS region FROM nation")
def sc22(spark, sf):
    """Files found at any depth by the pattern of their names."""
    root = scratch.folder(spark, "tree")
    T.table(spark, sf, "nation").select("n_name", F.col("n_regionkey").cast("int").alias("region")).repartition("region").write.partitionBy("region").text(f"{root}/a/b")
    found = text_formats.discover(spark, root, "part-*.txt")
    return found.where("size > 0").select(F.regexp_extract("path", r"region=(\d+)/", 1).cast("int").alias("region")).distinct()


@query("sc23_dark_frame_fits", with_px("SELECT CAST(4 AS BIGINT) AS frame, 8 AS h, 8 AS w, CAST(64 AS INT) AS n"))
def sc23(spark, sf):
    """Of three dark frames only the one of the clip's size is taken."""
    f = T.frames(spark, sf).where("frame = 4")
    darks = f.unionByName(f.withColumn("h", F.lit(16)).withColumn("frame", F.lit(5).cast("long"))).unionByName(f.withColumn("w", F.lit(4)).withColumn("frame", F.lit(6).cast("long")))
    return text_formats.load_dark_frame(darks, T.frames(spark, sf)).select("frame", "h", "w", F.size("data").alias("n"))


@query("sk9_wav_export", "SELECT doc_id, CAST(strlen(t) AS BIGINT) AS pcm_bytes, md5(substr(t, 9, 88)) AS cut, CAST(44 + strlen(t) AS BIGINT) AS wav_bytes FROM (SELECT doc_id, repeat(CAST(doc_id AS VARCHAR) || 'abcd', 40) AS t FROM documents)")
def sk9(spark, sf):
    """Audio cut to frames 3 to 24 at 24 frames a second (24 samples a second here), and the whole as WAV."""
    d = T.table(spark, sf, "documents").select("doc_id", F.encode(F.repeat(F.concat(F.col("doc_id").cast("string"), F.lit("abcd")), F.lit(40)), "utf-8").alias("pcm"))

    def wavs(batches):
        for batch in batches:
            sizes = [len(text_formats.wav(v.as_py(), 24, 2, 16)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "pcm", "wav_bytes"])

    d = d.mapInArrow(wavs, "doc_id long, pcm binary, wav_bytes long")
    return d.select("doc_id", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.md5(text_formats.wav_cut(F.col("pcm"), 24.0, 3, 24, rate=24)).alias("cut"), "wav_bytes")


@query("sk10_session_table", "SELECT c_name AS \"Name\", CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE c_mktsegment END AS \"Camera\", CAST(c_custkey AS VARCHAR) AS \"Frames\" FROM customer")
def sk10(spark, sf):
    """The clip table as tab-separated text, read back as text."""
    path = scratch.folder(spark, "table")
    clips = T.table(spark, sf, "customer").select(F.col("c_name").alias("Name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("Camera"), F.col("c_custkey").alias("Frames"))
    text_formats.write_session_table(clips, path)
    return spark.read.option("sep", "\t").option("header", "true").schema("Name string, Camera string, Frames string").csv(path)


# -- user functions, tables and streams ----------------------------------------------------------


def _bind() -> None:
    if "halve" not in lang.FUNCTIONS:
        lang.register("halve", 1, lambda a: a / 2.0, "({0} / CAST(2 AS DOUBLE))", lambda a: a / 2.0)
        lang.register("mean", 2, lambda a, b: (a + b) / 2.0, "(({0} + {1}) / CAST(2 AS DOUBLE))", lambda a, b: (a + b) / 2.0)


_bind()
_USER = "mean(halve(x), x * x) + pi"


@query("u2_user_functions", with_px(f"SELECT frame, y, x, {r6(lang.compile_sql(_USER, '(val / CAST(16383 AS DOUBLE))'))} AS v FROM px"))
def u2(spark, sf):
    """Functions of the caller's own within a transfer text."""
    return T.px(spark, sf).select("frame", "y", "x", (F.round(lang.compile_column(_USER, F.col("val") / F.lit(16383.0)), 6) + 0.0).alias("v"))


@query("u5_table_function", "SELECT p_partkey, CAST(k AS INT) AS point, CAST(p_size * k AS DOUBLE) AS x, CAST(p_size + k AS DOUBLE) AS y FROM part, (SELECT unnest(range(0, 3)) AS k) r")
def u5(spark, sf):
    """A table function that gives the points of a curve text, one row each."""
    size = F.col("p_size")
    text = F.concat_ws(";", *[v.cast("string") for k in range(3) for v in (size * k, size + k)])
    points = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(k.alias("point"), F.get(F.split("t", ";"), k * 2).cast("double").alias("x"), F.get(F.split("t", ";"), k * 2 + 1).cast("double").alias("y"))))
    return T.table(spark, sf, "part").select("p_partkey", text.alias("t")).select("p_partkey", points.alias("p")).select("p_partkey", F.col("p.point").cast("int").alias("point"), "p.x", "p.y")


def _arriving(spark, sf):
    """The events as a stream of four files."""
    path = scratch.folder(spark, "arriving")
    T.table(spark, sf, "events").repartition(4, "event_id").write.parquet(path)
    return playback.events(spark, path)


def _streamed(spark, stream, name: str, mode: str, every: str | None = None):
    """All that is there now through a stream into a memory table, and that table."""
    run = playback.start(stream, name, mode, scratch.folder(spark, "stream"), every)
    try:
        if every:
            run.processAllAvailable()
        else:
            run.awaitTermination()
    finally:
        run.stop()
    return spark.table(name)


@query("t6_running_average", "SELECT event_type, count(*) AS n, (CAST(sum(floor(value)) AS BIGINT) + count(*) // 2) // count(*) AS mean FROM events GROUP BY event_type")
def t6(spark, sf):
    """An accumulator that a stream carries from one batch to the next."""
    return _streamed(spark, playback.running_average(_arriving(spark, sf)), "t6_running_average", "complete")


@query("t3_timed_pull", "SELECT event_type, count(*) AS n, (CAST(sum(floor(value)) AS BIGINT) + count(*) // 2) // count(*) AS mean FROM events GROUP BY event_type")
def t3(spark, sf):
    """The same, pulled by a timer of 40 ms until nothing is left."""
    return _streamed(spark, playback.running_average(_arriving(spark, sf)), "t3_timed_pull", "complete", every="40 milliseconds")


_PINV = [(0.8, 0.1, 0.05), (0.2, 0.9, 0.1), (0.05, 0.2, 1.1), (0.3, 0.3, 0.4)]


def _least_squares(k: int) -> str:
    """Solution k of the normal equations by Cramer's rule."""
    m = [[sum(r[i] * r[j] for r in _PINV) for j in range(3)] for i in range(3)]
    v = [f"({' + '.join(f'l_{c} * CAST({r[i]!r} AS DOUBLE)' for c, r in zip(('quantity', 'discount', 'tax', 'extendedprice'), _PINV))})" for i in range(3)]
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * minor(0, j) for j in range(3))
    return f"round({' + '.join(f'{v[i]} * CAST({minor(i, k) / det!r} AS DOUBLE)' for i in range(3))}, 4) + 0.0"


@query("fn_pseudo_inverse", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{_least_squares(k)} AS {c}' for k, c in enumerate('rgb'))} FROM lineitem")
def pinv(spark, sf):
    """Least squares by the pseudo-inverse of a 4 x 3 matrix, composed on the driver."""
    inverse = X.pseudo_inverse(_PINV)
    v = [F.col(f"l_{c}") for c in ("quantity", "discount", "tax", "extendedprice")]
    out = [sum((x * row[k] for x, row in zip(v[1:], inverse[1:])), v[0] * inverse[0][k]) for k in range(3)]
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[(F.round(o, 4) + 0.0).alias(c) for o, c in zip(out, "rgb")])


# -- single frames as files ------------------------------------------------------------------------

_STILL = stills.Still(matrix=(0.8, -0.1, 0.05, -0.2, 1.1, 0.1, 0.0, 0.2, 0.7), neutral=(0.5, 1.0, 0.625), fps=23.976)
_BACK = "frame long, h int, w int, data array<bigint>, bits long, black long, white long, timecode string, compression long"


def _dng_back(files):
    def run(batches):
        for batch in batches:
            rows = []
            for frame, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                image, tags = stills.read_dng(content.as_py())
                rows.append((frame, *image.shape, image.reshape(-1).tolist(), *(tags[t][0] for t in ("BitsPerSample", "BlackLevel", "WhiteLevel")), bytes(tags["TimeCodes"]).hex(), tags["Compression"][0]))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, types)], names=[f.split()[0] for f in _BACK.split(", ")])

    return files.mapInArrow(run, _BACK)


@query("sk4_dng_sequence", with_px("SELECT frame, y, x, val, CAST(14 AS BIGINT) AS bits, CAST(2048 AS BIGINT) AS black, CAST(15000 AS BIGINT) AS white, printf('%02d%02d%02d%02d', frame % 24, frame // 24 % 60, frame // 1440 % 60, frame // 86400 % 24) || '00000000' AS timecode, CAST(c AS BIGINT) AS compression FROM px, (VALUES (1), (7)) v(c)"))
def sk4(spark, sf):
    """Every frame as a DNG of packed samples and as one of lossless JPEG, and what a reader finds in them."""
    f = T.frames(spark, sf)
    both = stills.dng_files(f, _STILL).unionByName(stills.dng_files(f, _STILL, compressed=True))
    return T.to_long(_dng_back(both), "bits", "black", "white", "timecode", "compression")


@query("sk12_single_frame_png", with_rgb("SELECT frame, y, x, r, g, b FROM rgb"))
def sk12(spark, sf):
    """Every colour frame as a 16-bit PNG, and the image that a reader finds in it."""

    def run(batches):
        for batch in batches:
            images = [stills.read_png(c.as_py())[0] for c in batch.column(1)]
            planes = [pa.array([i[:, :, k].reshape(-1).tolist() for i in images], pa.list_(pa.int64())) for k in range(3)]
            sizes = [pa.array([i.shape[k] for i in images], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, *planes], names=["frame", "h", "w", "r", "g", "b"])

    back = stills.png_files(T.rgb_frames(spark, sf)).mapInArrow(run, "frame long, h int, w int, r array<bigint>, g array<bigint>, b array<bigint>")
    return T.to_long(back.withColumn("data", F.arrays_zip("r", "g", "b"))).select("frame", "y", "x", "val.*")


_BITS = "list_aggregate(list_transform(a, lambda v: lpad(bin(v), 14, '0')), 'string_agg', '')"


@query("sk5_packed_bytes", with_dense(f"SELECT frame, list_aggregate(list_transform(range(0, 112), lambda k: printf('%02X', list_sum(list_transform(range(0, 8), lambda j: CASE substr(s, CAST((k // 2) * 16 + (1 - k % 2) * 8 + j + 1 AS BIGINT), 1) WHEN '1' THEN CAST(pow(2, 7 - j) AS INT) ELSE 0 END)))), 'string_agg', '') AS packed FROM (SELECT frame, {_BITS} AS s FROM d)"))
def sk5(spark, sf):
    """The payload's very bytes: 14-bit samples one after the other, in 16-bit words of which the low byte comes first."""
    video = samples.as_blocks(T.frames(spark, sf), 14)
    return video.select(F.col("ts").cast("long").alias("frame"), F.expr("right(hex(payload), 224)").alias("packed"))
