import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from pixelwright.sources import container as C
from pixelwright.sources import text_formats as X


def frame(ts, data, number=0):
    return C.block("VIDF", ts, struct.pack("<IHHHHI", number, 0, 0, 0, 0, 0) + data)


@pytest.fixture
def clip(tmp_path):
    rtci = struct.pack("<10H8s", 5, 30, 14, 9, 2, 121, 0, 0, 0, 0, b"UTC")
    first = C.block("RTCI", 1, rtci) + C.block("EXPO", 2, b"old") + frame(3000, b"c") + C.block("AUDF", 50, struct.pack("<II", 0, 0) + b"ABCD") + frame(1000, b"a")
    second = b"garbage!" * 3 + frame(2000, b"b") + C.block("EXPO", 5, b"new") + C.block("AUDF", 20, struct.pack("<II", 1, 0) + b"1234")
    (tmp_path / "x.MLV").write_bytes(first)
    (tmp_path / "x.M00").write_bytes(second)
    (tmp_path / "x.M02").write_bytes(frame(9, b"z"))  # after a gap
    return tmp_path


def test_blocks_and_index(spark, clip):
    found = C.contiguous_chunks(C.blocks(spark, str(clip)))
    index = C.frame_index(found).where("frame_type = 1").orderBy("frame_number").collect()
    assert [r["frame_time"] for r in index] == [1000, 2000, 3000]
    assert {r["type"]: bytes(r["payload"]) for r in C.headers(found).collect()}["EXPO"] == b"new"
    assert str(C.clock(found).first()["recorded"]) == "2021-03-09 14:30:05"
    assert bytes(C.audio(found).first()["pcm"]) == b"1234ABCD"
    assert C.blocks(spark, str(clip), max_frames=1).where("type = 'VIDF'").count() == 3  # one a file


def test_data_source_agrees(spark, clip):
    spark.dataSource.register(C.TaggedBlocks)
    a = spark.read.format("tagged_blocks").option("path", str(clip)).load()
    b = C.blocks(spark, str(clip))
    key = ["chunk", "offset", "type", "size", "ts", "payload"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))
    lean = spark.read.format("tagged_blocks").option("path", str(clip)).option("payload", "false").load()
    assert lean.where("payload is not null").count() == 0 and lean.count() == a.count()


def test_write_container(spark, clip, tmp_path):
    spark.dataSource.register(C.TaggedBlocks)
    out = str(tmp_path / "out")
    chosen = C.blocks(spark, str(clip)).where("type in ('VIDF', 'EXPO')").coalesce(1)
    chosen.write.format("tagged_blocks").option("path", out).mode("append").save()
    back = C.blocks(spark, out)
    assert sorted(r[0] for r in back.select("ts").collect()) == sorted(r[0] for r in chosen.select("ts").collect())


def test_index_cache(spark, clip, tmp_path):
    index = C.frame_index(C.blocks(spark, str(clip)))
    path = str(tmp_path / "index")
    assert C.load_index(spark, path) is None
    C.save_index(index, path)
    assert C.load_index(spark, path).count() == index.count()
    index.withColumn("version", F.lit(99)).write.mode("overwrite").parquet(path)
    assert C.load_index(spark, path) is None


def test_pixel_map(spark, tmp_path):
    f = tmp_path / "80000301_1872x1059.fpm"
    f.write_text("#FPM 80000301\n7 \t 1\n15 \t 1\n\n23 2\n")
    got = X.pixel_map(spark, str(f)).orderBy("x").collect()
    assert [tuple(r) for r in got] == [(7, 1, "80000301", 1872, 1059), (15, 1, "80000301", 1872, 1059), (23, 2, "80000301", 1872, 1059)]
    X.write_pixel_map(X.pixel_map(spark, str(f)), str(tmp_path / "again_1x1.fpm"))
    assert spark.read.text(str(tmp_path / "again_1x1.fpm")).count() == 3


def cube(tmp_path, text):
    f = tmp_path / "t.cube"
    f.write_text(text)
    return str(f)


def test_cube(spark, tmp_path):
    good = X.cube_lut(spark, cube(tmp_path, 'TITLE "a b"\n# note\nLUT_1D_SIZE 2\nDOMAIN_MIN 0 0 0\nDOMAIN_MAX 2 2 2\n0 0 0\n1 1 1\n'))
    assert good["title"] == "a b" and good["size"] == 2 and good["domain"][1] == [2.0] * 3 and good["entries"][1] == (1.0, 1.0, 1.0)
    for text, code in (("0 0 0", "no_size"), ("LUT_3D_SIZE 1\n0 0 0", "bad_size"), ("LUT_1D_SIZE 2\n0 0 0", "wrong_count"), ("LUT_1D_SIZE 2\nfoo", "bad_line"), ("LUT_1D_SIZE 2\nDOMAIN_MAX 0 0 0\n0 0 0\n1 1 1", "bad_domain")):
        with pytest.raises(X.CubeError) as e:
            X.cube_lut(spark, cube(tmp_path, text))
        assert e.value.code == code


def test_presets(spark, tmp_path):
    f = tmp_path / "p.xml"
    f.write_text('<?xml version="1.0"?><receipts><receipt version="4"><exposure>100</exposure><tint>3</tint><unknown>1</unknown><transferFunction>pow(x, 1/2.2)</transferFunction></receipt></receipts>')
    r = X.presets(spark, str(f)).first()
    assert (r["version"], r["exposure"], r["tint"], r["temperature"], r["transferFunction"]) == (4, 100, 3, 6000, "pow(x, 1/2.2)")
    X.write_presets(X.presets(spark, str(f)), str(tmp_path / "out"))
    assert X.presets(spark, str(tmp_path / "out")).first()["exposure"] == 100


def test_session_and_edit_list(spark, tmp_path):
    f = tmp_path / "s.xml"
    f.write_text('<session><clip file="/a/x.MLV" relative="x.MLV" mark="2"><exposure>1</exposure></clip><clip file="/a/y.MLV" relative="y.MLV"><exposure>1</exposure></clip></session>')
    assert sorted(map(tuple, X.session(spark, str(f)).collect())) == [("/a/x.MLV", "x.MLV", 2), ("/a/y.MLV", "y.MLV", 0)]
    e = tmp_path / "e.xml"
    e.write_text('<r><asset-clip name="M01.[0-9].dng"/><clip name="M02.mov"/><clipitem id="1" name="M01.mov"/></r>')
    assert [r["name"] for r in X.edit_list(spark, str(e)).orderBy("pos").collect()] == ["M01", "M02"]


def test_small_formats(spark, tmp_path):
    f = tmp_path / "props.txt"
    f.write_text("a = 1\nb=x = y\nnothing\n")
    assert sorted(map(tuple, X.properties(spark, str(f)).collect())) == [("a", "1"), ("b", "x = y")]
    m = spark.createDataFrame([('{"iso": 200, "asShotNeutral": [0.5, 1, 0.6]}',), ("junk",)], "j string").select(X.camera_metadata(F.col("j")).alias("m")).collect()
    assert m[0]["m"]["iso"] == 200 and m[0]["m"]["asShotNeutral"][2] == 0.6 and m[0]["m"]["width"] is None
    listing = spark.createDataFrame([('[{"name": "a.fpm", "size": 3, "sha": "ff"}]',)], "j string").select(X.map_listing(F.col("j")).alias("l")).first()["l"]
    assert listing[0]["name"] == "a.fpm" and listing[0]["sha"] == "ff"
    content = b"hello"
    listed = hashlib.sha1(b"blob 5\0hello").hexdigest()
    d = spark.createDataFrame([(bytearray(content), listed), (bytearray(b"other"), listed)], "c binary, s string")
    assert [r[0] for r in d.select(X.stale(F.col("c"), F.col("s"))).collect()] == [False, True]
    assert X.discover(spark, str(tmp_path), "props*").count() == 1
    assert X.wav(b"\0" * 8, 48000, 2, 16)[:4] == b"RIFF"
    pcm = spark.createDataFrame([(bytearray(range(200)),)], "p binary")
    cut = pcm.select(X.wav_cut(F.col("p"), 24, 2, 3, rate=240).alias("c")).first()["c"]
    assert bytes(cut) == bytes(range(40, 120))
    t = spark.createDataFrame([("a", None), ("b", "c")], "Name string, Lens string")
    X.write_session_table(t, str(tmp_path / "table"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "table"))
    assert sorted(map(tuple, back.collect())) == [("a", "-"), ("b", "c")]


def test_dark_frame_must_fit(spark):
    clip = spark.createDataFrame([(1, 4, 4, [0] * 16)], "frame long, h int, w int, data array<bigint>")
    dark = spark.createDataFrame([(0, 4, 4, [1] * 16), (0, 2, 8, [1] * 16)], "frame long, h int, w int, data array<bigint>")
    assert X.load_dark_frame(dark, clip).count() == 1


def test_trailer_container(spark, tmp_path):
    from pixelwright.sources import trailer_container as M

    meta = '{"iso": %d, "width": 4, "height": 2, "asShotNeutral": [0.5, 1.0, 0.6]}'
    frames = [(k * 41_666_667, meta % (100 + k), bytes([k]) * 8) for k in (2, 0, 1, 3)]
    camera = '{"whiteLevel": 1023, "colorMatrix1": [2,0,0,0,2,0,0,0,2], "extraData": {"audioChannels": 2, "audioSampleRate": 48000}}'
    (tmp_path / "a.mcraw").write_bytes(M.build(camera, frames, [(5000, b"xyz"), (9000, b"uvw")]))
    (tmp_path / "bad.mcraw").write_bytes(b"MOTION \x03" + b"junk" * 20)
    (tmp_path / "short.mcraw").write_bytes(b"MO")
    rows = M.read(spark, str(tmp_path))
    got = M.frames(rows).orderBy("number").collect()
    assert [(r["ts"], r["iso"], bytes(r["payload"])[0]) for r in got] == [(k * 41_666_667 // 1000, 100 + k, k) for k in range(4)]
    assert [(r["ts"], bytes(r["payload"])) for r in rows.where("kind = 'audio'").orderBy("number").collect()] == [(5, b"xyz"), (9, b"uvw")]
    c = M.cameras(rows).first()
    assert c["colorMatrix2"][0] == 2.0 and c["extraData"]["audioSampleRate"] == 48000
    assert M.frame_rate(rows).first()["rate"] == 24
    assert rows.where("kind = 'error'").count() == 2


def test_packed_bits():
    import numpy as np

    from pixelwright.sources import samples as S

    rng = np.random.default_rng(1)
    for bits in (10, 12, 14, 16):
        v = rng.integers(0, 1 << bits, 37)
        assert (S.unpack(S.pack(v, bits), bits, 37) == v).all()
        assert S.pack(v, bits, big_endian=True) == np.frombuffer(S.pack(v, bits), "<u2").astype(">u2").tobytes()
    assert S.pack(np.array([1]), 14) == struct.pack("<H", 1 << 2)  # the first sample sits in a word's high bits


def test_frames_and_export(spark, tmp_path):
    import numpy as np

    from pixelwright.sources import samples as S

    rng = np.random.default_rng(2)
    shots = [rng.integers(0, 1 << 12, 24) for _ in range(4)]
    body = C.block("RAWI", 1, S.raw_block(4, 6, 12, 100, 4000)) + C.block("EXPO", 2, b"e") + C.block("NULL", 3, b"")
    body += b"".join(frame(1000 * (k + 1), S.pack(s, 12), k) for k, s in enumerate(shots))
    body += b"".join(C.block("AUDF", 1000 * k + 500, struct.pack("<II", 0, 0) + bytes([k])) for k in range(5))
    (tmp_path / "y.MLV").write_bytes(body)
    found = C.blocks(spark, str(tmp_path))
    info = S.raw_info(found).first()
    assert (info["height"], info["width"], info["bits"], info["black"], info["white"]) == (4, 6, 12, 100, 4000)
    dense = S.frames(found)
    got = {r["frame"]: r["data"] for r in dense.collect()}
    assert all(got[k] == shots[k].tolist() for k in range(4))
    assert sorted((r["type"], r["ts"]) for r in S.cut(found, 2, 3).collect()) == [("AUDF", 2500), ("EXPO", 2), ("RAWI", 1), ("VIDF", 2000), ("VIDF", 3000)]
    mean = S.averaged(dense).first()
    assert mean["data"] == [(int(sum(s[i] for s in shots)) + 2) // 4 for i in range(24)]
    again = S.as_blocks(S.averaged(dense), 12).first()
    assert S.unpack(bytes(again["payload"])[S.VIDEO_LEAD.size :], 12, 24).tolist() == mean["data"]
    for curve in ([2 * k for k in range(4096)], [2 * k for k in range(5000)]):
        assert S.linearise(dense, curve).where("frame = 0").first()["data"] == [2 * v for v in shots[0].tolist()]
    assert max(S.linearise(dense, [0, 7]).first()["data"]) == 7
