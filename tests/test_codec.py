"""Round trips and rejections of the binary formats."""

import numpy as np
import pytest

from rasterloom.codec import CodecError, Reader, container, exif, image, lossless, lossy, metablock, ppm, rans, streams
from rasterloom.codec.container import Animation, Header, Tile
from rasterloom.operators import codec as C
from rasterloom.plans.codec import jpeg_with, tiff
from rasterloom.sources import container as SC


def gradient(w, h):
    x, y = np.arange(w)[None, :], np.arange(h)[:, None]
    return np.stack([255 * x // max(w - 1, 1) + 0 * y, 255 * y // max(h - 1, 1) + 0 * x, 255 * (x + y) // max(w + h - 2, 1)], 2).astype(np.uint8)


def code(f, *args, **kw):
    with pytest.raises(CodecError) as e:
        f(*args, **kw)
    return e.value.code


@pytest.mark.parametrize(("symbols", "n"), [(8, 1000), (256, 5000), (2049, 2000), (1, 10)])
def test_rans(symbols, n):
    rng = np.random.default_rng(42)
    v = np.minimum(rng.geometric(0.02, n) - 1, symbols - 1).tolist()
    t = rans.Table.of_counts(np.bincount(v, minlength=symbols).tolist())
    data = rans.encode(v, t)
    assert rans.decode(data, n, t, strict=True) == v
    if len(data) > 8:
        assert code(rans.decode, data[: len(data) // 2], n, t) == "RansError"
    assert code(rans.decode, b"\0\0\0\0", 1, t) == "RansError"
    f = rans.normalize([1, 1, 1, 1000, 500, 200, 50, 10])
    assert sum(f) == 4096 and min(f) >= 1


@pytest.mark.parametrize("shape", [(1, 1), (7, 9), (65, 33), (16, 16)])
def test_lossless(shape):
    rng = np.random.default_rng(1)
    for im in (rng.integers(0, 256, (*shape, 4)).astype(np.uint8), gradient(shape[1], shape[0]), np.full((*shape, 3), 7, np.uint8)):
        assert (image.decode(image.encode(im, image.Config(lossless=True))) == im).all()
    noise = rng.integers(0, 256, (*shape, 4)).astype(np.uint8)
    for mode in range(13):
        assert (lossless.decode_tile(lossless.encode_tile(noise, mode), shape[1], shape[0]) == noise).all()


def test_lossless_rejects():
    rng = np.random.default_rng(2)
    data = bytearray(lossless.encode_tile(rng.integers(0, 256, (20, 20, 4)).astype(np.uint8)))
    data[2 + 512 + 4 : 2 + 512 + 8] = bytes(4)
    assert code(lossless.decode_tile, bytes(data), 20, 20) == "RansError"
    assert code(lossless.expand, [(1, 3)], 3) == "DecodeFailed"
    assert code(lossless.expand, [1, (1, 300)], 10) == "DecodeFailed"
    big = b"\x01\x0b" + (300).to_bytes(2, "little") + bytes(1200)
    assert code(lossless.decode_tile, big, 4, 4) == "DecodeFailed"


def test_lossy():
    g = gradient(96, 96)
    for q, least in ((75, 40), (90, 42)):
        for how in ("444", "420"):
            data = image.encode(g, image.Config(quality=q, subsampling=how))
            assert image.psnr(g, image.decode(data)) > least
            assert image.info(data) == {"width": 96, "height": 96, "bit_depth": 8, "lossless": False, "has_alpha": False, "frame_count": 1}
    solid = np.tile(np.array([128, 64, 192, 255], np.uint8), (64, 64, 1))
    assert image.psnr(solid, image.decode(image.encode(solid, image.Config(quality=90, tile_size_log2=6)))) > 25
    rng = np.random.default_rng(5)
    for shape in ((1, 1), (7, 9), (70, 33)):
        im = rng.integers(0, 256, (*shape, 4)).astype(np.uint8)
        out = image.decode(image.encode(im, image.Config(quality=100, tile_size_log2=6)))
        assert out.shape == im.shape and image.psnr(im, out) > 35


def test_every_syntax():
    planes = image.to_planes(gradient(40, 24), 1, 255)
    alpha = np.arange(40 * 24).reshape(24, 40) % 256
    first = None
    for flags in [0, 2, *range(1, 256, 23), 255]:
        data, _ = lossy.encode_tile(*planes, alpha, 75, 75, 81, 8, flags)
        out = lossy.decode_tile(data, 0, 0, 1024, 40, 24, 8, None, True, True)
        first = first or out
        assert all((out[k] == first[k]).all() for k in out), flags


def test_lossy_rejects():
    planes = image.to_planes(gradient(24, 24), 1, 255)
    data, _ = lossy.encode_tile(*planes, None, 85, 85, 90, 8, 0)
    decode = lambda b, alpha=False: lossy.decode_tile(bytes(b), 0, 0, 1024, 24, 24, 8, None, alpha, False)
    assert code(decode, data, True) == "DecodeFailed"
    modes = 256 + 8 + 4
    for at, value, want in ((modes, b"\x09", "PredictionError"), (256, b"\x09", "DecodeFailed"), (256 + 8, b"zz", "DecodeFailed"), (modes + 2 + 5 + 2 + 5, b"\x00\xc0", "DecodeFailed")):
        bad = bytearray(data)
        bad[at : at + len(value)] = value
        assert code(decode, bad) == want, at
    assert code(decode, data + b"x") == "InvalidChunkSize" and code(decode, data[:-3]) in ("TruncatedInput", "RansError", "DecodeFailed")
    whole, _ = lossy.encode_tile(*planes, None, 85, 85, 90, 8, 255)
    rng = np.random.default_rng(0)
    for _ in range(60):  # whatever is wrong, it is said and not guessed at
        bad = bytearray(whole)
        bad[rng.integers(256, len(bad))] ^= 1 << rng.integers(8)
        try:
            decode(bad)
        except CodecError:
            pass


def test_streams():
    rng = np.random.default_rng(7)
    for spans in (rng.integers(0, 65, 100), np.full(9, 5), np.repeat([3, 0, 64], 50)):
        for adaptive in (False, True):
            assert (streams.read_spans(Reader(streams.write_spans(spans, adaptive)), len(spans), adaptive) == spans).all()
    assert code(streams.read_spans, Reader(b"\x00\xc0"), 3, True) == "DecodeFailed"
    assert len(streams.write_spans(np.full(90, 5), True)) == 2 and len(streams.write_spans(np.repeat([3, 0], 90), True)) == 8
    assert code(streams.unpack_bits, b"\xff", 7, 1) == "DecodeFailed"
    assert code(streams.read_table, Reader(b"\x07"), 10) == "RansError" and code(streams.read_table, Reader(b"\x05"), 10) == "RansError"


def test_container():
    h = Header(3840, 2160, 10, 9, 16, 9, 24, 9, 1000, 400)
    a = Animation(2, 7, [(100, 0, 1, 1, 2, 100, 100, 1000 * i) for i in range(3)])
    data = container.write(h, [Tile(1, 2, 1, b"abc")], b"m" * 5, b"icc", b"prov", a)
    chunks = container.read_chunks(data)
    assert [c[0] for c in chunks] == ["FHDR", "META", "ICCP", "PROV", "ANIM", "TILE", "FEND"] and len(h.pack()) == 19 and len(a.pack()) == 58
    assert Header.parse(chunks[0][2]) == h and Animation.parse(chunks[4][2]) == a and Tile.parse(chunks[5][2]) == Tile(1, 2, 1, b"abc")
    assert container.write_chunks(chunks) == data
    assert code(container.read_chunks, data[:-9]) == "InvalidChunkType" and code(container.read_chunks, data[:20]) == "TruncatedInput"
    late = [chunks[0], chunks[5], chunks[1], chunks[6]]
    assert code(container.read_chunks, container.write_chunks(late)) == "InvalidChunkType"
    assert container.read_chunks(container.write_chunks([chunks[0], ("WHAT", 1, b"?"), chunks[6]]))
    assert code(Animation.parse, (1 << 31).to_bytes(4, "little") + bytes(6)) == "TruncatedInput"
    assert code(image.decode, container.write(Header(128, 128, flags=0, tile_size_log2=6), [Tile(0, 0, 1, b"")])) == "DecodeFailed"


def test_metadata_block():
    e = metablock.Entry
    entries = [e(2, 1, 7, 48.856614), e(5, 1, 9, ("en", "Ä title")), e(1, 6, 8, (50, 1)), e(7, 1, 13, [e(7, 1, 10, "x")]), e(10, 1, 12, (2, [1, 2, 3])), e(10, 2, 200, opaque=b"zz"), e(3, 1, 14, -5)]
    assert metablock.parse(metablock.pack(entries)) == entries
    bad = bytearray(metablock.pack([e(2, 1, 7, 1.0), e(9, 1, 1, 5)]))
    bad[3 + 3] = 8 + 90  # an unknown type: its bytes are kept, and the next entry is where it was
    got = metablock.parse(bytes(bad))
    assert got[0].opaque is not None and got[1].value == 5
    for junk in (b"", b"\xff" * 5):
        assert code(metablock.parse, junk) in ("MetaError", "TruncatedInput")
    deep = e(7, 1, 13, [])
    for _ in range(30):
        deep = e(7, 1, 13, [deep])
    assert metablock.parse(metablock.pack([deep]))


def test_exif():
    for block in (tiff(7), tiff(7, False)):
        for data in (block, b"Exif\0\0" + block, jpeg_with(block)):
            got = {(x.ns, x.tag): x.value for x in exif.entries(exif.find(data))}
            assert got == {(1, 1): "Maker 7", (1, 10): 107, (2, 1): -7.0, (2, 2): 7.0, (2, 3): 7.0}
    assert exif.find(b"nothing") is None and exif.find(b"\xff\xd8\xff") is None


def test_ppm():
    a = gradient(5, 3)
    a[0, 0] = 32  # white space as the first sample
    assert (ppm.parse(ppm.write(a)) == a).all() and (ppm.parse(b"P6 #c\n5\t3\n255\n" + a.tobytes()) == a).all()
    assert code(ppm.parse, b"P5 1 1 255\n0") == "InvalidHeader" and code(ppm.parse, ppm.write(a) + b"x") == "InvalidChunkSize"


def test_operators(spark, tmp_path):
    g = gradient(20, 12)
    rows = [(i, y, x, *map(int, g[y, x])) for i in (1, 2) for y in range(12) for x in range(20)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    files = C.encode(px, image.Config(lossless=True))
    out = C.decode(files).select("image_id", "y", "x", "r", "g", "b")
    assert sorted(map(tuple, out.collect())) == sorted(rows)
    lossy_files = C.encode(px, image.Config(quality=80)).select("image_id", "content").cache()
    part = C.decode(lossy_files, (3, 4, 5, 6)).collect()
    assert {(r["y"], r["x"]) for r in part} == {(y, x) for y in range(4, 10) for x in range(3, 8)}
    bad = spark.createDataFrame([(1, bytearray(b"no"))], "image_id long, content binary")
    assert C.decode(bad).first()["_error_code"] == "InvalidMagic" and C.info(bad).first()["_error_code"] == "InvalidMagic"
    from pyspark.sql import functions as F

    chunks = SC.parsed(lossy_files.withColumn("path", F.concat(F.lit("i"), F.col("image_id").cast("string"))), "chunks")
    SC.write(chunks.drop("_error_code"), f"file://{tmp_path}/out")
    (tmp_path / "out" / "bad.wk").write_bytes(b"no")
    SC.register(spark)
    read = lambda table: spark.read.format("rasterchunks").option("table", table).load(f"{tmp_path}/out")
    assert read("tiles").where("_error_code is null").count() == 2 and read("frames").where("_error_code = 'InvalidMagic'").count() == 1
    assert {r["type"] for r in read("chunks").where("type = 'TILE'").collect()} == {"TILE"}
    assert read("meta").where("ns = 9 and tag = 5").count() == 2


def test_stream(spark, tmp_path):
    from rasterloom.streaming import complete_images

    folder = tmp_path / "tiles"
    schema = "image_id string, tile_x int, tile_y int, expected int"
    spark.createDataFrame([("a", 0, 0, 2), ("b", 0, 0, 1)], schema).coalesce(1).write.parquet(str(folder))

    def run():  # one batch; the state is kept for the next run
        stream = spark.readStream.schema(schema).parquet(str(folder))
        q = complete_images(stream).writeStream.format("parquet").option("path", str(tmp_path / "done")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(once=True).start()
        assert q.awaitTermination(90)

    run()
    spark.createDataFrame([("a", 0, 0, 2), ("a", 1, 0, 2)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "done")).collect()} == {("b", 1, True), ("a", 2, True)}


def test_small_planes_are_fast():
    """Ranks of few values are held and sized by what occurs, not by the 2,049 symbols; this took twenty times as long."""
    import time

    from rasterloom.codec.lossy import _spans
    from rasterloom.plans.codec import _coeffs

    rng = np.random.default_rng(3)
    groups = [rng.integers(0, 100, 64) for _ in range(20)]
    began = time.process_time()
    for v in groups:
        planes = [_coeffs(v), -_coeffs(v[::-1])]
        spans = _spans(planes)
        for f in (0, 20):
            syntax = streams.with_flags(f)
            streams.write_planes(planes, spans, int(spans.max(initial=0)), syntax)
    assert time.process_time() - began < 1.5


def test_plans_know_their_size():
    """Of the syntaxes that are tried only one is written, so what a plan says must be what it writes; and what it
    remembers of one syntax must not change another."""
    from rasterloom.codec.lossy import _spans

    rng = np.random.default_rng(4)
    for blocks, width in ((1, 1), (4, 3), (16, 40), (90, 900)):
        planes = [np.round(rng.laplace(0, width, (blocks, 64)) * np.linspace(1, 0, 64)).astype(np.int64).clip(-1024, 1024) for _ in range(2)]
        spans = _spans(planes)
        extent, memo = int(spans.max(initial=0)), {}
        for f in (0, 2, 4, 20, 22, 52, 64, 116, 246, 254):
            s = streams.with_flags(f)
            plan = streams.plan_planes(planes, spans, extent, s, memo)
            data = plan.bytes(s)
            assert len(data) == plan.size and data == streams.write_planes(planes, spans, extent, s)
            assert all((a == b).all() for a, b in zip(streams.read_planes(Reader(data), 2, spans, extent, s), planes, strict=True))


def test_codec_work_is_dealt_out(spark):
    """Few bytes of pixels cost much, so their steps aren't joined into a few tasks, nor is a file made twice."""
    import __spark_entry__ as entry
    from rasterloom.operators import codec

    px = spark.range(512).selectExpr("id div 256 AS image_id", "cast(id % 256 div 16 AS int) AS y", "cast(id % 16 AS int) AS x", "cast(id % 251 AS int) AS r", "cast(id % 13 AS int) AS g", "cast(id % 17 AS int) AS b")
    for df in (codec.encode(px), codec.encode(px, image.Config(lossless=True)), codec.decode(codec.encode(px))):
        assert df.rdd.getNumPartitions() >= 16
    for name, most in (("blk11_lossy_encode", 0), ("blk12_lossy_decode", 2)):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsInPandas") == most, name


def test_text_of_singles():
    """A number keeps what tells it from others, also past six digits."""
    text = lambda v: metablock.text_of(metablock.Entry(2, 3, 6, v))[0]
    assert [text(float(np.float32(v))) for v in (0.5083, 12.5, 0, 1e6, 3.25e-7)] == ["0.5083", "12.5", "0", "1e+06", "3.25e-07"]
    for i in (999_999, 1_000_001, 5_999_999, 16_777_217, 34_353_808, 35_999_999):
        assert text(float(i)) == str(i)
    assert text(float(np.float32(0.1234567))) == "0.1234567" and text(1e300) == "1e+300" and text(float("nan")) == "nan"
    assert metablock.text_of(next(e for e in exif.entries(__import__("rasterloom.plans.codec", fromlist=["x"]).tiff(1_234_567)) if e.type_id == 6))[0] == "1234567"
