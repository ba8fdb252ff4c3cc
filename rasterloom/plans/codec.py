"""Queries over the binary formats: what goes in must come out, so SQL can tell the result without knowing the bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import CodecError, lossless, metablock, ppm, rans
from ..codec import streams as ST
from ..codec.container import Animation, Header, Tile, read_chunks, rewrite_meta, write, write_chunks
from ..codec.image import Config
from ..derive import PX, pixels, table
from ..operators import codec as C
from ..operators import metrics as M
from ..operators.order import spread, written
from ..sources import container as SC
from ..sources import files as SF
from . import query

_PIX = f"WITH {PX} SELECT image_id, y, x, r, g, b FROM px"


def _places(out: DataFrame, px: DataFrame) -> DataFrame:
    """Of decoded pixels those that went in: a file is a whole rectangle, and pads an image whose last row is partial."""
    return out.join(px.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")


def _files(spark, d, config: Config = Config(lossless=True)) -> DataFrame:
    return C.encode(pixels(spark, d), config)


#: Whole rectangles, a partial image filled up with black.
_FILLED = f"""{PX}, pl AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM px GROUP BY 1),
q AS (SELECT pl.image_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, coalesce(px.r, 0) AS r, coalesce(px.g, 0) AS g, coalesce(px.b, 0) AS b FROM pl CROSS JOIN range(0, 16) a(yy) CROSS JOIN range(0, 16) b(xx) LEFT JOIN px ON px.image_id = pl.image_id AND px.y = yy AND px.x = xx WHERE yy <= my AND xx <= mx)"""


@query("blk14_lossless_encode", f"""WITH {_FILLED}, c AS (SELECT image_id, printf('%02X%02X%02XFF', r, g, b) AS colour, min(y * 16 + x) AS first FROM q GROUP BY ALL)
    SELECT image_id, count(*) AS colours, printf('010B%02X%02X', count(*) % 256, count(*) // 256) || string_agg(colour, '' ORDER BY first) AS head FROM c GROUP BY image_id""")
def lossless_encode(spark, d):
    """Images of few colours: the payload begins with its kind, its predictor, and the colours by first place."""
    px = pixels(spark, d)
    n = C.lossless_tiles(px)
    count = F.conv(F.concat(F.hex(F.substring("payload", 4, 1)), F.hex(F.substring("payload", 3, 1))), 16, 10).cast("bigint")
    return n.select("image_id", count.alias("colours"), F.hex(F.substring("payload", F.lit(1), (4 + 4 * count).cast("int"))).alias("head"))


@query("blk15_lossless_roundtrip", _PIX)
def lossless_roundtrip(spark, d):
    return _places(C.decode(_files(spark, d)), pixels(spark, d)).select("image_id", "y", "x", "r", "g", "b")


def _smooth(spark, d) -> DataFrame:
    """An image of soft gradients for each image of events, whole ones only in their ids."""
    p = pixels(spark, d).select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15))))
    shift = (F.col("image_id") % 40).cast("int")
    return p.select("image_id", "y", "x", (60 + 4 * F.col("x") + shift).cast("int").alias("r"), (50 + 3 * F.col("y") + 2 * F.col("x") + shift).cast("int").alias("g"), (90 + 4 * F.col("y") - shift).cast("int").alias("b"))


@query("blk11_lossy_encode", f"WITH {PX} SELECT DISTINCT image_id, TRUE AS more_bytes, TRUE AS psnr, TRUE AS ssim, TRUE AS no_worse FROM px")
def lossy_encode(spark, d):
    """Gradients at a low and a high quality: the higher takes more bytes, and both come back as near as is asked of them.
    (Qualities next to each other don't differ enough on images of this size.)"""
    px, low, high = _smooth(spark, d), 50, 95
    # each quality's files are made once, for their pixels and for their sizes
    files = {q: written(C.encode(px, Config(quality=q, subsampling="444")), "lossy") for q in (low, high)}
    got = {q: M.overall(M.channels(M.samples(M.paired(px, C.decode(spread(f, "image_id")).select("image_id", "y", "x", "r", "g", "b"))))).select("image_id", F.col("psnr").alias(f"p{q}"), F.col("ssim").alias(f"s{q}")) for q, f in files.items()}
    size = {q: f.select("image_id", F.octet_length("content").alias(f"n{q}")) for q, f in files.items()}
    t = got[low].join(got[high], "image_id").join(size[low], "image_id").join(size[high], "image_id")
    c = lambda k, q: F.col(f"{k}{q}")
    return t.select("image_id", (c("n", high) > c("n", low)).alias("more_bytes"), ((c("p", low) > 36) & (c("p", high) > 42)).alias("psnr"), ((c("s", low) > 0.95) & (c("s", high) > 0.98)).alias("ssim"), ((c("p", high) >= c("p", low)) & (c("s", high) >= c("s", low))).alias("no_worse"))


@query("blk12_lossy_decode", f"WITH {PX} SELECT image_id, count(*) AS n, TRUE AS psnr, TRUE AS ssim FROM px GROUP BY image_id")
def lossy_decode(spark, d):
    """Noise at the best quality, against what was encoded."""
    px = pixels(spark, d)
    pair = M.paired(px, C.decode(C.encode(px, Config(quality=100, subsampling="444"))).select("image_id", "y", "x", "r", "g", "b"))
    return M.overall(M.channels(M.samples(pair)), places="n").select("image_id", "n", (F.col("psnr") > 33).alias("psnr"), (F.col("ssim") > 0.97).alias("ssim"))


@query("blk13_image_assembly", f"WITH {PX} SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, count(*) AS n FROM px GROUP BY image_id")
def image_assembly(spark, d):
    px = pixels(spark, d)
    out = _places(C.decode(C.encode(px, Config(quality=60, subsampling="420"))), px)
    return out.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("n"))


@query("src9_info", f"WITH {PX} SELECT image_id, CAST(max(x) + 1 AS BIGINT) AS width, CAST(max(y) + 1 AS BIGINT) AS height, CAST(8 AS INTEGER) AS bit_depth, TRUE AS lossless, FALSE AS has_alpha, CAST(1 AS INTEGER) AS frame_count FROM px GROUP BY image_id")
def info(spark, d):
    return C.info(_files(spark, d)).drop("_error_code")


def _chunks(spark, d, name: str) -> DataFrame:
    return SC.parsed(_files(spark, d, Config(quality=75)).withColumn("path", F.col("image_id").cast("string")), name)


@query("src7_container_chunks", f"WITH {PX} SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS seq, unnest(['FHDR', 'META', 'TILE', 'FEND']) AS type, CAST(unnest([0, 3, 4, 0]) AS INTEGER) AS flags FROM (SELECT DISTINCT image_id FROM px)")
def container_chunks(spark, d):
    return _chunks(spark, d, "chunks").select("image_id", "seq", "type", "flags")


@query("src8_header", f"WITH {PX} SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(max(x) + 1 AS BIGINT) AS width, CAST(max(y) + 1 AS BIGINT) AS height, CAST(10 AS INTEGER) AS tile_size_log2, CAST(1 AS INTEGER) AS n_tiles FROM px GROUP BY image_id")
def header(spark, d):
    return _chunks(spark, d, "frames").select("image_id", "width", "height", "tile_size_log2", "n_tiles")


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """A row for each row, by a function of its values."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([f(*r) for r in pdf.itertuples(index=False)], columns=names)

    return df.mapInPandas(run, schema)


def _le(v: str, n: int) -> str:
    """SQL of a whole number as n bytes, the lowest first, in hex."""
    return "printf('" + "%02X" * n + "', " + ", ".join(f"CAST(({v} // {256**i}) % 256 AS INTEGER)" for i in range(n)) + ")"


_U, _V = "(event_id % 65536)", "((event_id + 1) % 65536)"


def _frames(n: int) -> str:
    each = [f"'64000001' || {_le(_U, 2)} || {_le(_U, 2)} || '64006400' || {_le(str(1000 * k), 4)}" for k in range(n)]
    return f"WHEN {n} THEN " + (" || ".join(each) or "''")


_FRAMES = f"CASE event_id % 4 {' '.join(map(_frames, range(4)))} END"


@query("snk2_serializers", f"""SELECT event_id, {_le('(640 + event_id)', 4)} || {_le('(480 + event_id)', 4)} || ['08', '0A', '0C'][1 + event_id % 3] || '0910' || {_le('9', 1)} || {_le('(event_id % 256)', 2)} || {_le('(6 + event_id % 5)', 1)} || {_le(_U, 2)} || {_le(_V, 2)} AS header,
    {_le('(event_id % 4)', 4)} || {_le('(event_id % 3)', 2)} || {_le('event_id', 4)} || {_FRAMES} AS animation,
    {_le(_U, 2)} || {_le(_V, 2)} || '01' || {_le('(event_id % 9)', 4)} || repeat({_le('(event_id % 256)', 1)}, event_id % 9) AS tile, TRUE AS same FROM events""")
def serializers(spark, d):
    def one(i: int):
        u, v = i % (1 << 16), (i + 1) % (1 << 16)  # of fields with 16 bits
        h = Header(640 + i, 480 + i, (8, 10, 12)[i % 3], 9, 16, 9, i % 256, 6 + i % 5, u, v)
        a = Animation(i % 3, i, [(100, 0, 1, u, u, 100, 100, 1000 * k) for k in range(i % 4)])
        t = Tile(u, v, 1, bytes([i % 256]) * (i % 9))
        same = Header.parse(h.pack()) == h and Animation.parse(a.pack()) == a and Tile.parse(t.pack()) == t
        return i, *[x.pack().hex().upper() for x in (h, a, t)], same

    return _map(table(spark, d, "events").select("event_id"), one, "event_id bigint, header string, animation string, tile string, same boolean")


_FAULTS = ["InvalidMagic", "InvalidVersion", "InvalidHeader", "InvalidChunkType", "InvalidChunkSize", "TruncatedInput", "InvalidBitDepth", "InvalidChunkType"]


def _fault(i: int) -> bytes:
    h = Header(16, 16)
    good = write(h, [Tile(0, 0, 1, b"abc")])
    kind = i % 8
    if kind == 0:
        return b"NO" + good
    if kind == 1:
        return good[:5] + b"\x09\x00" + good[7:]
    if kind == 2:
        return write_chunks([("TILE", 4, Tile(0, 0, 1, b"").pack())])
    if kind == 3:
        return write_chunks([("FHDR", 0, h.pack())])
    if kind == 4:
        return write_chunks([("FHDR", 0, h.pack()), ("TILE", 4, Tile(0, 0, 1, b"abc").pack() + b"x"), ("FEND", 0, b"")])
    if kind == 5:
        return good[:-4]
    if kind == 6:
        return write(Header(16, 16, 9), [])
    return write_chunks([("FHDR", 0, h.pack()), ("WHAT", 0, b""), ("FEND", 0, b"")])


_FAULT_SQL = f"SELECT event_id, ([{', '.join(repr(f) for f in _FAULTS)}])[1 + event_id % 8] AS error FROM events"


@query("flt5_container_validity", _FAULT_SQL)
def container_validity(spark, d):
    def one(i: int):
        try:
            read_chunks(_fault(i))
        except CodecError as e:
            return i, e.code
        return i, None

    return _map(table(spark, d, "events").select("event_id"), one, "event_id bigint, error string")


@query("prj26_error_taxonomy", f"WITH f AS ({_FAULT_SQL}) SELECT error, count(*) AS files, min(event_id) AS first FROM f GROUP BY error")
def error_taxonomy(spark, d):
    """The codes that a table of files gives, each with how many: bad files are rows, not failures."""

    def one(i: int):
        return str(i), _fault(i)

    files = _map(table(spark, d, "events").select("event_id"), one, "path string, content binary")
    bad = SC.parsed(files, "frames").where("_error_code IS NOT NULL")
    return bad.groupBy(F.col("_error_code").alias("error")).agg(F.count("*").alias("files"), F.min(F.col("image_id").cast("bigint")).alias("first"))


@query("flt8_geometry_validity", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'outside' WHEN event_id % 5 = 3 THEN 'blocks' ELSE CASE WHEN event_id % 5 = 1 THEN '420' ELSE '444' END END AS fit FROM events")
def geometry_validity(spark, d):
    from ..codec.lossy import geometry

    def one(i: int):
        k = i % 5
        try:
            return i, geometry(9 if k == 4 else 1, 0, 64, 100, 70, (5, 8, 3, 4) if k == 1 else (5, 8, 4, 9) if k == 3 else (5, 8, 5, 8))[2]
        except CodecError as e:
            return i, "outside" if "outside" in str(e) else "blocks"

    return _map(table(spark, d, "events").select("event_id"), one, "event_id bigint, fit string")


# --- streams: each group of 64 events is a row of symbols ------------------------------------------------------------------

_GROUPS = "SELECT event_id // 64 AS s, count(*) AS n, TRUE AS same FROM events GROUP BY 1"


def _groups(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 64).cast("bigint").alias("s"), "event_id", (F.col("user_id") % 100).cast("int").alias("v"))
    g = spread(e, "s").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("event_id", "v"))).alias("p"))
    return g.select("s", F.transform("p", lambda x: x["v"]).alias("v"))


def _roundtrip(name: str, there, back) -> None:
    @query(name, _GROUPS)
    def run(spark, d):
        return _map(_groups(spark, d), lambda s, v: (s, len(v), list(back(there(list(v)), len(v))) == list(v)), "s bigint, n bigint, same boolean")


def _reader(data: bytes):
    from ..codec import Reader

    return Reader(data)


def _ends(r, value):
    if r.left:
        raise CodecError("DecodeFailed", "bytes are left")
    return value


def _rans(v: list[int]) -> bytes:
    t = rans.Table.of_counts([v.count(i) for i in range(100)])
    return struct.pack("<100H", *t.freq) + rans.encode(v, t)


def _unrans(data: bytes, n: int) -> list[int]:
    return rans.decode(data[200:], n, rans.Table(struct.unpack("<100H", data[:200])), strict=True)


def _spans(v: list[int], adaptive: bool) -> bytes:
    import numpy as np

    return ST.write_spans(np.array([x % 65 for x in v]), adaptive)


_roundtrip("ent2_rans_roundtrip", _rans, _unrans)
_roundtrip("ent17_back_references", lambda v: lossless.references(bytes(x % 4 for x in v) + bytes(v)), lambda t, n: lossless.expand(t, 2 * n)[n:])


@query("ent3_rans_decode", "SELECT event_id // 64 AS s, count(*) AS n, 'RansError' AS cut, 'RansError' AS longer, 'RansError' AS state FROM events GROUP BY 1")
def rans_decode(spark, d):
    """Streams that end early, go on too long, or begin with no state, must be refused."""

    def one(s, v):
        data = _rans(list(v))

        def code(bad: bytes) -> str | None:
            try:
                _unrans(bad, len(v))
            except CodecError as e:
                return e.code
            return None

        return s, len(v), code(data[:203]), code(data + b"\0"), code(data[:200] + b"\0\0\0\0" + data[204:])

    return _map(_groups(spark, d), one, "s bigint, n bigint, cut string, longer string, state string")


@query("ent10_table_roundtrip", _GROUPS)
def table_roundtrip(spark, d):
    def one(s, v):
        a = rans.Table.of_counts([list(v).count(i) for i in range(100)]).freq
        b = rans.Table.of_counts([list(v[:50]).count(i) for i in range(100)]).freq
        same = all(ST.read_table(_reader(ST.write_table(t, p)), 100, p) == t for t, p in ((a, None), (b, a), (a, a)))
        return s, len(v), same

    return _map(_groups(spark, d), one, "s bigint, n bigint, same boolean")


@query("ent11_bank_roundtrip", _GROUPS)
def bank_roundtrip(spark, d):
    def one(s, v):
        some = [rans.Table.of_counts([list(v[k::7]).count(i) for i in range(100)]).freq if len(v) > k else [1] * 0 or rans.normalize([1] * 100) for k in range(1 + s % 6)]
        banks = [some[int(x) % len(some)] for x in v]
        return s, len(v), ST.read_bank(_reader(ST.write_bank(banks)), len(banks), 100) == banks

    return _map(_groups(spark, d), one, "s bigint, n bigint, same boolean")


@query("ent13_span_roundtrip", _GROUPS)
def span_roundtrip(spark, d):
    import numpy as np

    def one(s, v):
        same = True
        for spans in (np.array([x % 65 for x in v]), np.sort([x % 65 for x in v]), np.full(len(v), 7)):
            for adaptive in (False, True):
                r = _reader(ST.write_spans(spans, adaptive))
                same &= (ST.read_spans(r, len(v), adaptive) == spans).all() and not r.left
        return s, len(v), bool(same)

    return _map(_groups(spark, d), one, "s bigint, n bigint, same boolean")


def _coeffs(v, n: int = 8):
    import numpy as np

    q = np.resize(np.array(v) - 50, (n, 64)) // 20
    q[:, 40:] = 0
    q[: n // 2, 10:] = 0
    return q


def _payload(name: str, planes: int, flags: list[int]) -> None:
    @query(name, _GROUPS)
    def run(spark, d):
        from ..codec.lossy import _spans as spans_of

        def one(s, v):
            ps = [_coeffs(v), -_coeffs(v[::-1])][:planes]
            spans = spans_of(ps)
            same, memo = True, {}
            for f in flags:
                syntax = ST.with_flags(f)
                extent = int(spans.max(initial=0))
                r = _reader(ST.plan_planes(ps, spans, extent, syntax, memo).bytes(syntax))
                got = ST.read_planes(r, planes, spans, extent, syntax)
                same &= all((a == b).all() for a, b in zip(got, ps, strict=True)) and not r.left
            return s, len(v), bool(same)

        return _map(_groups(spark, d), one, "s bigint, n bigint, same boolean")


_payload("ent5_plane_payload", 1, [0, 2, 4])
_payload("ent6_shared_chroma_payload", 2, [0, 2, 4, 20])
_payload("ent7_payload_decode", 2, [6, 22, 52])
_payload("ent8_context_streams", 1, [32, 64, 132, 246])


@query("ent18_syntax_selection", f"WITH {PX} SELECT image_id, TRUE AS smaller, TRUE AS same FROM px GROUP BY image_id")
def syntax_selection(spark, d):
    """The syntax that is chosen takes fewer bytes than the plain one, and says the same coefficients."""
    import numpy as np

    from ..codec import image, lossy

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = C._array(pdf, False)
        planes = image.to_planes(a, 1, 255)
        made = [lossy.encode_tile(*planes, None, 75, 75, 81, 8, *f)[0] for f in ((0,), ())]
        h, w = a.shape[:2]
        plain, best = (lossy.decode_tile(m, 0, 0, 64, w, h, 8, "444", False, False) for m in made)
        return pd.DataFrame({"image_id": [key[0]], "smaller": [len(made[1]) < len(made[0])], "same": [all(np.array_equal(plain[k], best[k]) for k in plain)]})

    return spread(pixels(spark, d), "image_id").groupBy("image_id").applyInPandas(run, "image_id bigint, smaller boolean, same boolean")


# --- files and metadata ----------------------------------------------------------------------------------------------------


@query("src4_ppm_read", _PIX)
def ppm_roundtrip(spark, d):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = C._array(pdf, False)
        return pd.DataFrame({"path": [str(key[0])], "content": [ppm.write(a).replace(b"\n", b"\n# made for a test\n", 1)]})

    files = spread(pixels(spark, d), "image_id").groupBy("image_id").applyInPandas(pack, "path string, content binary")
    images = SF.read_ppm(SF.write_ppm(SF.read_ppm(files)).withColumnRenamed("image_id", "path"))

    def samples(batches):
        import numpy as np

        for pdf in batches:
            for r in pdf.itertuples():
                a = SF.to_array(r)
                y, x = np.divmod(np.arange(a.shape[0] * a.shape[1]), a.shape[1])
                f = a.reshape(-1, 3)
                yield pd.DataFrame({"image_id": int(r.image_id), "y": y, "x": x, "r": f[:, 0], "g": f[:, 1], "b": f[:, 2]})

    return _places(images.mapInPandas(samples, "image_id bigint, y int, x int, r int, g int, b int"), pixels(spark, d))


_EXIF = "SELECT CAST(event_id AS VARCHAR) AS image_id, unnest([1, 1, 2, 2, 2]) AS ns, unnest([1, 10, 1, 2, 3]) AS tag, unnest(['Maker ' || event_id, CAST(100 + event_id AS VARCHAR), CAST(-(event_id % 80) AS VARCHAR), CAST(event_id % 170 AS VARCHAR), CAST(event_id AS VARCHAR)]) AS value FROM events"


def tiff(i: int, little: bool = True) -> bytes:
    """A block with maker, sensitivity, and a position of whole degrees, south and east."""
    e = "<" if little else ">"
    entry = lambda tag, kind, n, value: struct.pack(e + "HHI", tag, kind, n) + value
    long = lambda v: struct.pack(e + "I", v)
    maker = f"Maker {i}".encode() + b"\0"
    root, sub, gps, data = 8, 8 + 2 + 36 + 4, 8 + 42 + 18, 8 + 42 + 18 + 2 + 72 + 4
    rat = lambda *xs: b"".join(struct.pack(e + "II", x, 1) for x in xs)
    tail = rat(i % 80, 0, 0) + rat(i % 170, 0, 0) + rat(i) + maker
    out = (b"II" if little else b"MM") + struct.pack(e + "HI", 42, root)
    out += struct.pack(e + "H", 3) + entry(0x10F, 2, len(maker), long(data + 56)) + entry(0x8769, 4, 1, long(sub)) + entry(0x8825, 4, 1, long(gps)) + long(0)
    out += struct.pack(e + "H", 1) + (entry(0x8827, 3, 1, struct.pack(e + "HH", 100 + i, 0)) if 100 + i < 1 << 16 else entry(0x8827, 4, 1, long(100 + i))) + long(0)
    out += struct.pack(e + "H", 6) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, long(data)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, long(data + 24)) + entry(5, 1, 1, b"\0\0\0\0") + entry(6, 5, 1, long(data + 48)) + long(0)
    return out + tail


def jpeg_with(block: bytes) -> bytes:
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def _exif(spark, d) -> DataFrame:
    def one(i: int):
        block = tiff(i, i % 2 == 0)
        return str(i), (block, b"Exif\0\0" + block, jpeg_with(block))[i % 3]

    files = _map(table(spark, d, "events").select("event_id"), one, "path string, content binary")
    e = SF.read_exif(files)
    number = F.when(F.col("type_id").isin(6, 7), F.round(F.col("value").cast("double")).cast("bigint").cast("string")).otherwise(F.col("value"))
    return e.select("image_id", "ns", "tag", F.when(F.col("type_id").isin(6, 7), number).otherwise(F.col("value")).alias("value"))


@query("src10_exif_blob", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '49492A0008000000' ELSE '4D4D002A00000008' END AS head, CAST(209 + length(CAST(event_id AS VARCHAR)) AS INTEGER) AS length, CAST(NULL AS VARCHAR) AS none FROM events")
def exif_blob(spark, d):
    """The block in a bare file, behind its own head, and in a JPEG, by turns; a JPEG without one has none."""
    from ..codec import exif

    def one(i: int):
        block = tiff(i, i % 2 == 0)
        found = exif.find((block, b"Exif\0\0" + block, jpeg_with(block))[i % 3])
        none = exif.find(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xd9")
        return i, found[:8].hex().upper(), len(found), none.hex() if none else None

    return _map(table(spark, d, "events").select("event_id"), one, "event_id bigint, head string, length int, none string")


@query("src11_exif_read", _EXIF)
def exif_read(spark, d):
    return _exif(spark, d)


def _entries(i: int) -> list[metablock.Entry]:
    e = metablock.Entry
    return [
        e(2, 1, 7, i / 4), e(5, 1, 9, ("en", f"Title {i}")), e(4, 4, 10, f"L-{i}"), e(9, 1, 1, i % 6), e(1, 10, 3, 100 + i), e(1, 6, 8, (i, 3)), e(3, 1, 14, i * 1_000_000),
        e(7, 1, 13, [e(7, 1, 10, f"face {i}"), e(7, 5, 7, 0.5)]), e(10, 7, 12, (2, [i % 9, 2, 3])), e(10, 8, 15, bytes(range(16))), e(10, 9, 99, opaque=b"??"),
    ]


_VALUES = ["CASE WHEN event_id % 4 = 0 THEN event_id // 4 || '.0' ELSE CAST(event_id / 4.0::DOUBLE AS VARCHAR) END", "'Title ' || event_id", "'L-' || event_id", "CAST(event_id % 6 AS VARCHAR)", "CAST(100 + event_id AS VARCHAR)", "event_id || '/3'", "CAST(event_id * 1000000 AS VARCHAR)", """'[{"tag": 1, "type": 10, "value": "face ' || event_id || '"}, {"tag": 5, "type": 7, "value": "0.5"}]'""", "'[' || event_id % 9 || ', 2, 3]'", "'00010203-0405-0607-0809-0a0b0c0d0e0f'", "NULL"]


@query("met1_parse_block", f"SELECT event_id, CAST(unnest(range(0, 11)) AS INTEGER) AS ord, CAST(unnest([2, 5, 4, 9, 1, 1, 3, 7, 10, 10, 10]) AS INTEGER) AS ns, CAST(unnest([1, 1, 4, 1, 10, 6, 1, 1, 7, 8, 9]) AS INTEGER) AS tag, unnest([{', '.join(_VALUES)}]) AS value FROM events")
def parse_block(spark, d):
    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["event_id"]:
                out += [(i, n, e.ns, e.tag, metablock.text_of(e)[0]) for n, e in enumerate(metablock.parse(metablock.pack(_entries(int(i)))))]
            yield pd.DataFrame(out, columns=["event_id", "ord", "ns", "tag", "value"])

    return table(spark, d, "events").select("event_id").mapInPandas(run, "event_id bigint, ord int, ns int, tag int, value string")


def _text_entry(ns: int, tag: int, kind: int, text: str, before: str = "") -> str:
    """SQL of an entry whose body is a text, behind so many bytes in hex."""
    return f"'{ns:02X}{tag:02X}00{kind:02X}' || {_le(f'(length({text}) + {len(before) // 2})', 4)} || '{before}' || hex({text})"


_FACE = "'face ' || event_id"
_BLOCK = " || ".join([
    "'010A00'", _text_entry(5, 1, 9, "('Title ' || event_id)", "02656E"), _text_entry(4, 4, 10, "('L-' || event_id)"), f"'0901000101000000' || {_le('(event_id % 6)', 1)}", f"'010A000304000000' || {_le('(100 + event_id)', 4)}",
    f"'0106000808000000' || {_le('event_id', 4)} || '03000000'", f"'0301000E08000000' || {_le('(event_id * 1000000)', 8)}", f"'0701000D' || {_le(f'(26 + length({_FACE}))', 4)} || '0200' || {_text_entry(7, 1, 10, f'({_FACE})')} || '0705000708000000000000000000E03F'",
    f"'0A07000C09000000030002' || {_le('(event_id % 9)', 2)} || '02000300'", "'0A08000F10000000000102030405060708090A0B0C0D0E0F'", "'0A090063020000003F3F'",
])


@query("met2_serialize_block", f"SELECT event_id, {_BLOCK} AS bytes FROM events")
def serialize_block(spark, d):
    """The bytes of a block with entries of ten types."""
    return _map(table(spark, d, "events").select("event_id"), lambda i: (i, metablock.pack(_entries(i)[1:]).hex().upper()), "event_id bigint, bytes string")


_META_CHUNK = "'4D45544103' || " + _le("length('meta ' || event_id)", 4) + " || hex('meta ' || event_id)"
_BARE = "'574B494D470100' || '464844520013000000' || '0800000008000000' || '08010D01' || '{0}' || '0A00000000' || {1} || '54494C45040A000000' || '000000000101000000' || '78' || '46454E440000000000'"


@query("snk11_metadata_rewrite", f"SELECT event_id, {_BARE.format('2000', _META_CHUNK)} AS with_meta, {_BARE.format('0000', chr(39) * 2)} AS without FROM events")
def metadata_rewrite(spark, d):
    """The bytes of a file that gets metadata, and of that file when it is taken away again."""

    def one(i: int):
        f = rewrite_meta(write(Header(8, 8), [Tile(0, 0, 1, b"x")], b"old"), f"meta {i}".encode())
        return i, f.hex().upper(), rewrite_meta(f, b"").hex().upper()

    return _map(table(spark, d, "events").select("event_id"), one, "event_id bigint, with_meta string, without string")


@query("snk12_api_buffers", f"WITH {PX} SELECT image_id, count(*) AS n, CAST(0 AS BIGINT) AS errors FROM px GROUP BY image_id")
def api_buffers(spark, d):
    out = C.decode(_files(spark, d))
    out = _places(out, pixels(spark, d)).unionByName(out.where("_error_code IS NOT NULL"))
    return out.groupBy("image_id").agg(F.count("y").alias("n"), F.count("_error_code").alias("errors"))
