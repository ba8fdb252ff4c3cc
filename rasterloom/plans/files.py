"""Queries over files that are written to the shared folder and read back, and over bytes and contexts."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import Reader, ppm
from ..codec import streams as ST
from ..codec.image import Config
from ..derive import PX, coarse, pixels, table
from ..functions import binary as N
from ..functions import surface
from ..functions import text as T
from ..operators import blocks as B
from ..operators import codec as C
from ..operators import metrics as M
from ..operators import report as R
from ..operators import statistics as S
from ..operators.order import spread
from ..session import shared_folder
from ..sources import container as SC
from ..sources import files as SF
from . import query
from .codec import _FILLED, _coeffs, _groups, _le, _map
from .pixels import _MEANS_SQL, _ROWS, _rows
from .statistics import _NORM, _hist

#: All images as whole rectangles, a partial one filled up with black; then an image's samples as hex, and as a PPM file.
_FULL = f"""{_FILLED},
im AS (SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x) AS hex FROM q GROUP BY image_id),
pp AS (SELECT image_id, width, height, hex, hex('P6' || chr(10) || width || ' ' || height || chr(10) || '255' || chr(10)) || hex AS file FROM im)"""
_NAME = "CASE WHEN image_id % 2 = 0 THEN 'Img' ELSE 'img' END || image_id"


def _images(spark, d) -> DataFrame:
    """image_id, width, height, has_alpha, pixels, one row for each image."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = C._array(pdf, False)
        return pd.DataFrame({"image_id": [str(key[0])], "width": [a.shape[1]], "height": [a.shape[0]], "has_alpha": [False], "pixels": [a.tobytes()]})

    return spread(pixels(spark, d), "image_id").groupBy("image_id").applyInPandas(pack, "image_id string, width int, height int, has_alpha boolean, pixels binary")


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _id(path: str = "path"):
    return F.regexp_extract(path, r"(\d+)\.[^./]*$", 1).cast("bigint")


def _written(spark, d, ending: str = "ppm", in_folders: bool = False) -> str:
    """A folder of the images as files, and of one file for each that is none."""
    i = F.col("image_id").cast("bigint")
    name = F.concat(F.when(i % 2 == 0, "Img").otherwise("img"), "image_id")
    place = F.concat(F.lit("a"), (i % 3).cast("string"), F.lit("/"), name) if in_folders else name
    made = SF.write_ppm(_images(spark, d), png=ending.lower() == "png").select(F.concat(place, F.lit(f".{ending}")).alias("path"), "content")
    other = F.struct(F.regexp_replace("path", r"\.[^.]*$", ".txt").alias("path"), F.lit(b"no image").alias("content"))
    to = _folder(spark, ending)
    SF.write_files(made.select(F.inline(F.array(F.struct("path", "content"), other))), to)  # each image is made once
    return to


@query("src1_file_bytes", f"WITH {_FULL} SELECT image_id, CAST(length(file) // 2 AS BIGINT) AS length, sha256(unhex(file)) AS digest FROM pp")
def file_bytes(spark, d):
    return SF.scan(spark, _written(spark, d), (".ppm",)).select(_id().alias("image_id"), "length", F.sha2("content", 256).alias("digest"))


@query("snk3_ppm_write", f"WITH {_FULL} SELECT image_id, CAST(length(file) // 2 AS BIGINT) AS length, file AS content FROM pp")
def ppm_write(spark, d):
    out = SF.write_ppm(_images(spark, d))
    return out.select(F.col("image_id").cast("bigint").alias("image_id"), F.octet_length("content").cast("bigint").alias("length"), F.hex("content").alias("content"))


@query("src2_recursive_scan", f"WITH {PX} SELECT DISTINCT image_id, 'a' || image_id % 3 AS folder, 'ppm' AS declared_format, 'ppm' AS detected_format FROM px")
def recursive_scan(spark, d):
    found = SF.scan(spark, _written(spark, d, "PPM", in_folders=True), (".ppm",))
    return found.select(_id().alias("image_id"), F.regexp_extract("path", r"/([^/]*)/[^/]*$", 1).alias("folder"), "declared_format", "detected_format")


@query("src3_collect_files", f"WITH {PX}, f AS (SELECT DISTINCT image_id, 'a' || image_id % 3 || '/' || {_NAME} || '.PPM' AS path FROM px) SELECT path, row_number() OVER (ORDER BY lower(path), path) - 1 AS n FROM f")
def collect_files(spark, d):
    """The folder itself has no file, so those below it are taken."""
    found = SF.collect(spark, _written(spark, d, "PPM", in_folders=True), T.is_source_image)
    return found.select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("path"), "n")


def _spread(images: DataFrame) -> DataFrame:
    """The images' samples as rows."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = SF.to_array(r)
                y, x = np.divmod(np.arange(a.shape[0] * a.shape[1]), a.shape[1])
                f = a.reshape(-1, a.shape[2])
                yield pd.DataFrame({"image_id": r.image_id, "y": y, "x": x, "r": f[:, 0], "g": f[:, 1], "b": f[:, 2]})

    return images.select("image_id", "width", "height", "has_alpha", "pixels").mapInPandas(run, "image_id string, y int, x int, r int, g int, b int")


@query("src5_image_reader", f"WITH {_FULL} SELECT image_id, y, x, r, g, b FROM q")
def image_reader(spark, d):
    return _spread(SF.read_image(spark, _written(spark, d, "png"))).withColumn("image_id", _id("image_id"))


@query("snk4_png_write", f"WITH {_FULL} SELECT image_id, '89504E470D0A1A0A0000000D49484452' || printf('%08X%08X', width, height) || '0802000000' AS head, '0000000049454E44AE426082' AS foot FROM im")
def png_write(spark, d):
    out = SF.write_ppm(_images(spark, d), png=True)
    whole = F.hex("content")
    return out.select(F.col("image_id").cast("bigint").alias("image_id"), F.substring(whole, 1, 58).alias("head"), F.substring(whole, F.length(whole) - 23, F.lit(24)).alias("foot"))


@query("src15_image_loader", f"WITH {_FULL} SELECT image_id, ['wk', 'ppm', 'png'][1 + image_id % 3] AS ending, width, height, sha256(unhex(hex)) AS digest FROM im")
def image_loader(spark, d):
    """A third of the images each as a lossless container, a PPM and a PNG file, in one folder."""
    images, to = _images(spark, d), _folder(spark, "mixed")
    of = lambda k: images.where(F.col("image_id").cast("bigint") % 3 == k)
    named = lambda df, ending: df.select(F.concat("image_id", F.lit(f".{ending}")).alias("path"), "content")
    lossless = C.encode(B_full(spark, d).where("image_id % 3 = 0"), Config(lossless=True)).withColumn("image_id", F.col("image_id").cast("string"))
    SF.write_files(named(lossless, "wk").union(named(SF.write_ppm(of(1)), "ppm")).union(named(SF.write_ppm(of(2), png=True), "png")), to)
    out = SF.load_images(spark, to)
    return out.select(_id("image_id").alias("image_id"), F.regexp_extract("image_id", r"\.([^.]*)$", 1).alias("ending"), "width", "height", F.sha2("pixels", 256).alias("digest"))


def B_full(spark, d) -> DataFrame:
    """The pixels of whole rectangles."""
    return B.completed(pixels(spark, d), "r", "g", "b")


_TILED = f"{PX}, tl AS (SELECT image_id, x // 8 AS tile_x, y // 8 AS tile_y, string_agg(printf('%02X', g), '' ORDER BY y, x) AS payload FROM px GROUP BY ALL)"


def _tiled(spark, d) -> DataFrame:
    """Whole files of raw tiles, as chunks: the union of headers, metadata, tiles and ends."""
    px = pixels(spark, d)
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    fixed = {"bit_depth": 8, "primaries": 1, "transfer": 13, "matrix": 1, "flags": 48, "tile_size_log2": 6, "max_cll": 0, "max_fall": 0}
    headers = size.select("image_id", "width", "height", *[F.lit(v).alias(k) for k, v in fixed.items()])
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "g")))
    tiles = px.groupBy("image_id", F.floor(F.col("x") / 8).cast("int").alias("tile_x"), F.floor(F.col("y") / 8).cast("int").alias("tile_y")).agg(F.unhex(F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(c["g"]), 2, "0")), "")).alias("payload"))
    meta = size.select("image_id", F.unhex(F.lit("0000")).alias("payload"))
    return C.chunk_list(headers, tiles.withColumn("layer_flags", F.lit(1)), meta)


_FILE = f"""{_TILED}, sz AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY 1),
le AS (SELECT image_id, printf('%02X000000%02X000000', w, h) || '08010D01300006' || '00000000' AS head FROM sz),
tx AS (SELECT image_id, string_agg('54494C4504' || printf('%02X000000', 9 + length(payload) // 2) || printf('%02X00%02X0001%02X000000', tile_x, tile_y, length(payload) // 2) || payload, '' ORDER BY tile_y, tile_x) AS tiles FROM tl GROUP BY 1),
fl AS (SELECT image_id, '574B494D470100' || '464844520013000000' || head || '4D4554410302000000' || '0000' || tiles || '46454E440000000000' AS file FROM le JOIN tx USING (image_id))"""


@query("set1_chunk_union", f"WITH {_FILE} SELECT CAST(image_id AS VARCHAR) AS image_id, file FROM fl")
def chunk_union(spark, d):
    """The bytes of files whose chunks are a union of rows of four kinds."""
    return SC.built(_tiled(spark, d)).select("image_id", F.hex("content").alias("file"))


@query("snk1_container_write", f"WITH {_FILE} SELECT image_id, CAST(length(file) // 2 AS BIGINT) AS length, sha256(unhex(file)) AS digest FROM fl")
def container_write(spark, d):
    """Written by the data source, a file for each image, whose ids differ only by what an ending would cut off."""
    to = _folder(spark, "containers")
    SC.write(_tiled(spark, d).withColumn("image_id", F.concat(F.lit("a/img."), "image_id")), to)
    files = spark.read.format("binaryFile").load(to)
    return files.select(F.regexp_extract("path", r"%2E(\d+)\.wk$", 1).cast("bigint").alias("image_id"), "length", F.sha2("content", 256).alias("digest"))


@query("src7_data_source", f"WITH {_TILED} SELECT image_id, tile_x, tile_y, CAST(1 AS INTEGER) AS layer_flags, payload FROM tl WHERE tile_x = 1 UNION ALL SELECT image_id, tile_x, tile_y, CAST(1 AS INTEGER), payload FROM tl WHERE tile_x = 0")
def data_source(spark, d):
    """Tiles read by the data source, whose reader takes the filter, and by Spark's own files."""
    to = _folder(spark, "containers")
    SC.write(_tiled(spark, d), to)
    near = spark.read.format("rasterchunks").option("table", "tiles").load(to).where("tile_x = 1")
    far = SC.read(spark, to, "tiles").where("tile_x = 0")
    return near.unionByName(far).select(_id("image_id").alias("image_id"), "tile_x", "tile_y", "layer_flags", F.hex("payload").alias("payload"))


@query("str11_lower_extension", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN '' ELSE ['.jpg', '.png', '.wk'][1 + page_id % 4] END AS extension FROM pages")
def lower_extension(spark, d):
    i = F.col("page_id")
    path = F.concat(F.lit("A.b/page"), i.cast("string"), F.when(i % 4 == 0, ".JPG").when(i % 4 == 1, ".png").when(i % 4 == 2, ".x.Wk").otherwise(""))
    return table(spark, d, "pages").select("page_id", T.lower_extension(path).alias("extension"))


@query("prj16_little_endian", f"SELECT event_id, {_le('event_id', 4)} || {_le('(user_id % 65536)', 2)} || {_le('(18446744073709551616::HUGEINT - 1 - event_id)', 8)} || {_le('(user_id % 256)', 1)} AS bytes, event_id AS u32, user_id % 65536 AS u16, -1 - event_id AS i64, -1 - event_id AS i32, user_id % 256 AS u8, CAST(NULL AS BIGINT) AS beyond FROM events")
def little_endian(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    e = table(spark, d, "events").select("event_id", F.concat(N.le_bytes(i, 4), N.le_bytes(u, 2), N.le_bytes(-1 - i, 8), N.le_bytes(u, 1)).alias("b"))
    b = F.col("b")
    return e.select("event_id", F.hex("b").alias("bytes"), N.le_number(b, 0, 4).alias("u32"), N.le_number(b, 4, 2).alias("u16"), N.le_number(b, 6, 8).alias("i64"), N.le_number(b, 6, 4, signed=True).alias("i32"), N.le_number(b, 14, 1).alias("u8"), N.le_number(b, 14, 2).alias("beyond"))


@query(
    "ent4_context_helpers",
    f"""WITH {PX}, n AS (SELECT image_id, y, x, lag(g) OVER c AS a, lag(g) OVER r AS l FROM px WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)), o AS (SELECT *, lag(l) OVER (PARTITION BY image_id, x ORDER BY y) AS k FROM n)
    SELECT image_id, y, x, xor(xor(coalesce(a * 2654435761 % 4294967296, 0), coalesce(l * 2246822519 % 4294967296, 0)), coalesce(k * 3266489917 % 4294967296, 0)) AS hash, CAST((image_id % 3) * 64 + y * 4 AS BIGINT) AS context FROM o""",
)
def context_helpers(spark, d):
    from pyspark.sql import Window

    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    p = pixels(spark, d).withColumns({"a": F.lag("g").over(column), "l": F.lag("g").over(row)}).withColumn("k", F.lag("l").over(column))
    return p.select("image_id", "y", "x", N.sample_hash(F.col("a"), F.col("l"), F.col("k")).alias("hash"), N.rank_context(F.col("y") * 4, F.col("image_id") % 3).cast("bigint").alias("context"))


@query("ent9_table_clustering", "SELECT event_id // 64 AS s, count(*) AS n, TRUE AS smaller, TRUE AS same FROM events GROUP BY 1")
def table_clustering(spark, d):
    """Three ranks of alike distributions, the values of a stream's first places turned by its number: the bank with
    shared tables must be smaller than the one without, and read back alike."""
    from dataclasses import replace

    one, two = [2] * 4 + [1] * 4 + [0] * 4 + [-1] * 4, [2] * 3 + [1] * 4 + [0] * 4 + [-1] * 5

    def run(s, v):
        q = np.zeros((16, 64), np.int64)
        q[:, 0], q[:, 1], q[:, 2] = [(i + s) % 5 - 2 for i in range(16)], np.roll(one, s), np.roll(two, s)
        syntax, spans = ST.Syntax(bank=True), np.full(16, 3)
        plain = ST.write_planes([q], spans, 3, replace(syntax, cluster=False))
        data = ST.write_planes([q], spans, 3, syntax)
        r = Reader(data)
        (got,) = ST.read_planes(r, 1, spans, 3, syntax)
        return s, len(v), len(data) < len(plain), bool((got == q).all() and not r.left)

    return _map(_groups(spark, d), run, "s bigint, n bigint, smaller boolean, same boolean")


@query("ent12_legacy_table", f"WITH {_NORM}, b AS (SELECT k, min(symbol) AS lo, max(symbol) AS hi FROM nf GROUP BY k), c AS (SELECT k, lo, hi, unnest(range(lo, hi + 1)) AS symbol FROM b) SELECT k, any_value({_le('lo', 2)} || {_le('hi', 2)}) || string_agg({_le('coalesce(freq, 0)', 2)}, '' ORDER BY symbol) AS bytes, TRUE AS same FROM c LEFT JOIN nf USING (k, symbol) GROUP BY k")
def legacy_table(spark, d):
    """Tables of the oldest layout, which holds every frequency between the first and the last symbol."""
    f = S.normalized(_hist(spark, d)).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "freq"))).alias("freqs"))

    def run(k, freqs):
        dense = [0] * ST.SIGNED
        for symbol, freq in dict(freqs).items():
            dense[symbol] = freq
        data = ST._legacy(dense)
        return k, data.hex().upper(), ST._read_legacy(Reader(data), ST.SIGNED) == dense

    return _map(f, run, "k int, bytes string, same boolean")


@query("ent12_legacy_payload", "SELECT event_id // 64 AS s, count(*) AS n, TRUE AS same FROM events GROUP BY 1")
def legacy_payload(spark, d):
    """Planes of tiles without adaptive tables, with signs apart and not."""

    def run(s, v):
        q, same = _coeffs(v), True
        spans = np.where(q.any(axis=1), 64 - np.argmax(q[:, ::-1] != 0, axis=1), 0)
        for split in (False, True):
            syntax = ST.Syntax(adaptive_tables=False, split_signs=split)
            r = Reader(ST.write_planes([q], spans, 64, syntax))
            (got,) = ST.read_planes(r, 1, spans, 64, syntax)
            same &= bool((got == q).all()) and not r.left
        return s, len(v), same

    return _map(_groups(spark, d), run, "s bigint, n bigint, same boolean")


# --- reports -----------------------------------------------------------------------------------------------------------


def _reported(spark, d) -> DataFrame:
    px = pixels(spark, d)
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), (3 * F.count("*")).alias("reference_bytes"))
    extra = {"reference_path": F.concat(F.lit("in/"), F.col("image_id").cast("string")), "candidate_path": F.concat(F.lit('out/"'), F.col("image_id").cast("string")), "bit_depth": F.lit(8), "candidate_bytes": F.col("reference_bytes") - F.col("image_id") % 7}
    return M.compare(px, coarse(px)).join(size, "image_id").withColumns(extra)


@query("snk8_metric_json")
def metric_json(spark, d):
    return _reported(spark, d).select("image_id", R.report_text().alias("text"), R.report_json().alias("json"))


_E = "CASE WHEN {0} < 1e-10 THEN 100.0::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / {0}) END"


def _fixed_sql(x: str, places: int) -> str:
    """Halves to even."""
    return f"printf('%.{places}f', round_even({x} * 1e{places}, 0) / 1e{places})"


@query(
    "snk8_metric_report",
    f"""WITH {PX}, e AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, count(*) AS n, {', '.join(f"CAST(sum(abs({c} - ({c} // 8) * 8)) AS DOUBLE) / count(*) AS a{c}, CAST(sum(({c} - ({c} // 8) * 8) * ({c} - ({c} // 8) * 8)) AS DOUBLE) / count(*) AS s{c}" for c in "rgb")} FROM px GROUP BY image_id)
    SELECT image_id, 'Reference:      in/' || image_id || chr(10) || 'Candidate:      out/"' || image_id || chr(10) || 'Dimensions:     ' || w || 'x' || h || chr(10) || 'Bit depth:      8' || chr(10) || 'Channels:       RGB' || chr(10) || 'Reference bytes: ' || 3 * n || chr(10) || 'Candidate bytes: ' || (3 * n - image_id % 7) || chr(10)
    || 'Size ratio:     ' || {_fixed_sql('((3 * n - image_id % 7) / CAST(3 * n AS DOUBLE))', 4)} || 'x' || chr(10) AS head, {', '.join(f"{_fixed_sql(f'a{c}', 4)} AS mae_{c}, {_fixed_sql(f's{c}', 4)} AS mse_{c}" for c in "rgb")} FROM e""",
)
def metric_report(spark, d):
    """The report's head, and the errors of its channel lines."""
    text = _reported(spark, d).select("image_id", R.report_text().alias("t"))
    errors = {f"{k}_{c}": F.regexp_extract("t", rf"\n{c.upper()}: .*?{k.upper()}=([0-9.]+)", 1) for c in "rgb" for k in ("mae", "mse")}
    return text.select("image_id", F.concat(F.substring_index("t", "\n", 8), F.lit("\n")).alias("head"), *[v.alias(k) for k, v in errors.items()])


def _json_sql(alias: str, name: str) -> str:
    from ..operators.rollup import MEANS

    means = " || ".join(f"""',"avg_{k}":' || CAST(CAST({alias}.avg_{k} AS DECIMAL(20, {p})) AS VARCHAR)""" for k, p in MEANS.items())
    return f"""'{{"name":"' || {name} || '","count":' || {alias}.count || ',"total_bytes":' || {alias}.total_bytes || {means} || '}}'"""


@query(
    "snk9_rollup_json",
    f"""WITH {_ROWS}, c AS (SELECT scene_group, lighting_bucket, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS total_bytes, {_MEANS_SQL} FROM rw GROUP BY CUBE (scene_group, lighting_bucket)),
    j AS (SELECT *, {_json_sql('c', "concat_ws('|', scene_group, lighting_bucket)")} AS named, {_json_sql('c', 'lighting_bucket')} AS light, {_json_sql('c', "'overall'")} AS whole FROM c),
    p AS (SELECT *, '{{"scene_group":"' || scene_group || '","lighting_bucket":"' || lighting_bucket || '","summary":' || named || '}}' AS pair FROM j WHERE scene_group IS NOT NULL AND lighting_bucket IS NOT NULL),
    top AS (SELECT 'rollup/rollup_q75_yuv444.json' AS path, '{{"profile":"q75_yuv444","input_dir":"photos","total_images":' || (SELECT count FROM j WHERE scene_group IS NULL AND lighting_bucket IS NULL) || ',"overall":' || (SELECT whole FROM j WHERE scene_group IS NULL AND lighting_bucket IS NULL)
      || ',"by_scene_group":[' || (SELECT string_agg(named, ',' ORDER BY scene_group) FROM j WHERE scene_group IS NOT NULL AND lighting_bucket IS NULL) || '],"by_lighting_bucket":[' || (SELECT string_agg(named, ',' ORDER BY lighting_bucket) FROM j WHERE scene_group IS NULL AND lighting_bucket IS NOT NULL)
      || '],"by_scene_and_lighting":[' || (SELECT string_agg(pair, ',' ORDER BY scene_group || '|' || lighting_bucket) FROM p) || ']}}' AS content),
    sc AS (SELECT s.scene_group || '/rollup/rollup_q75_yuv444.json' AS path, '{{"profile":"q75_yuv444","input_dir":"photos","total_images":' || any_value(s.count) || ',"overall":' || any_value(s.named) || ',"by_scene_group":[' || any_value(s.named) || '],"by_lighting_bucket":[' || string_agg(p.light, ',' ORDER BY p.lighting_bucket) || '],"by_scene_and_lighting":[' || string_agg(p.pair, ',' ORDER BY p.lighting_bucket) || ']}}' AS content
      FROM j s JOIN p USING (scene_group) WHERE s.lighting_bucket IS NULL GROUP BY s.scene_group)
    SELECT path, chr(65279) || content AS content FROM top UNION ALL SELECT path, chr(65279) || content FROM sc""",
)
def rollup_json(spark, d):
    """The files as they lie in the folder."""
    to = _folder(spark, "rollups")
    SF.write_files(R.rollup_files(_rows(spark, d), "q75_yuv444", "photos"), to)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(to)
    path = F.regexp_extract(F.replace("path", F.lit("%23"), F.lit("#")), rf"{to.rpartition('/')[2]}/(.*)$", 1)
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))


@query("snk9_summary_json", f"WITH {_ROWS} SELECT scene_group, k AS id, lighting_bucket, bytes, 'q75_yuv444' AS profile FROM rw")
def summary_json(spark, d):
    to = _folder(spark, "summary")
    R.write_summary(_rows(spark, d), to, "q75_yuv444")
    back = spark.read.schema("scene_group string, relative_path string, lighting_bucket string, bytes bigint, profile string").json(to)
    return back.select("scene_group", F.col("relative_path").cast("bigint").alias("id"), "lighting_bucket", "bytes", "profile")


# --- the SQL surface -----------------------------------------------------------------------------------------------------

_BUCKET = "CASE WHEN value >= 300 OR value / 600.0::DOUBLE <= 0.33 THEN 'dark' WHEN value / 600.0::DOUBLE >= 0.62 THEN 'bright' ELSE 'balanced' END"


@query("sql_scalars", f"SELECT event_id, round(CASE WHEN value <= 1e-12 THEN 100.0::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / value) END, 9) AS db, {_BUCKET} AS bucket, CASE WHEN event_id % 2 = 0 THEN 'png' ELSE 'unknown' END AS format, 'jpeg' AS declared FROM events")
def sql_scalars(spark, d):
    surface.register(spark)
    return spark.sql(
        """SELECT event_id, round(psnr(value), 9) AS db, lighting_bucket(value / 600, if(value >= 300, 0.5D, 0D), 0D) AS bucket,
        sniff_format(if(event_id % 2 = 0, X'89504E470D0A1A0A00', X'00')) AS format, declared_format(concat('a/', event_id, '.JPG')) AS declared FROM {events}""",
        events=table(spark, d, "events"),
    )


@query("sql_table_functions", "SELECT event_id, unnest(['FHDR', 'META', 'TILE', 'FEND']) AS type, CAST(unnest([19, 4 + length(CAST(event_id AS VARCHAR)), 10, 0]) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS error FROM events UNION ALL SELECT -1 - event_id, NULL, NULL, 'InvalidMagic' FROM events")
def sql_table_functions(spark, d):
    """Files, and what are none, through the table function."""
    from ..codec.container import Header, Tile, write

    surface.register(spark)
    events = spread(table(spark, d, "events").select("event_id"), "event_id")
    files = _map(events, lambda i: (i, write(Header(8, 8), [Tile(0, 0, 1, b"x")], b"abcd" + str(i).encode())), "event_id bigint, content binary")
    none = events.select((-1 - F.col("event_id")).alias("event_id"), F.lit(b"NO").alias("content"))
    files = files.unionByName(none)  # from the table, so that no file is made a second time for its id
    return spark.sql("SELECT f.event_id, c.type, c.size, c.error FROM {files} f, LATERAL parse_container(f.content) c", files=files)
