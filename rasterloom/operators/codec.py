"""Images to containers and back, by tile. pixels: image_id, y, x, r, g, b (and a), 8 bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..codec import CodecError, image, lossless, lossy
from ..codec.container import TYPES, Header, Tile, read_chunks, write
from ..codec.metablock import Entry, pack
from ..functions.binary import le_bytes
from ..schemas import FLAGS
from .order import spread

ROWS = 1 << 15  # of a batch of pixels
PIXELS = "image_id bigint, y int, x int, r int, g int, b int, a int"


def _array(pdf: pd.DataFrame, alpha: bool) -> np.ndarray:
    names = ["r", "g", "b", "a"] if alpha else ["r", "g", "b"]
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, len(names)), np.uint8)
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[names].to_numpy()
    return out


def encode(px: DataFrame, config: image.Config = image.Config()) -> DataFrame:
    """image_id, content, score: a file for each image. Lossy tiles are coded apart from each other, one task row each,
    and an image's tiles meet again as bytes; a lossless image is one tile."""
    alpha = "a" in px.columns
    if config.lossless:

        def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"image_id": [key[0]], "content": [image.encode(_array(pdf, alpha), config)], "score": [100.0]})

        return spread(px, "image_id").groupBy("image_id").applyInPandas(whole, "image_id bigint, content binary, score double")
    size = 1 << image.size_log2(config)
    half = 2 if config.subsampling == "420" else 1
    tiles = px.withColumns({"tx": F.floor(F.col("x") / size).cast("int"), "ty": F.floor(F.col("y") / size).cast("int")})

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, tx, ty = key
        a = _array(pdf.assign(x=pdf["x"] - tx * size, y=pdf["y"] - ty * size), alpha)
        planes = image.to_planes(a, config.matrix, 255)
        if half == 2:
            planes[1:] = [image.halve(p) for p in planes[1:]]
        quality = image.tile_qualities(image.tile_statistics(*planes, 255), config.quality, half == 2)
        data, score = lossy.encode_tile(*planes, a[:, :, 3].astype(np.int64) if alpha else None, config.quality, *quality)
        return pd.DataFrame({"image_id": [key[0]], "tile_x": [tx], "tile_y": [ty], "w": [tx * size + a.shape[1]], "h": [ty * size + a.shape[0]], "payload": [data], "score": [score]})

    coded = spread(tiles, "image_id", "tx", "ty").groupBy("image_id", "tx", "ty").applyInPandas(one, "image_id bigint, tile_x int, tile_y int, w int, h int, payload binary, score double")
    return assemble_files(coded, config, alpha)


def assemble_files(coded: DataFrame, config: image.Config, alpha: bool) -> DataFrame:
    """Coded tiles -> files; the mean of the tiles' scores goes into the metadata."""

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tile_y", "tile_x"])
        score = float(pdf["score"].mean())
        flags = FLAGS["tiled"] | FLAGS["full_range"] | FLAGS["has_meta"] | (FLAGS["alpha"] if alpha else 0)
        header = Header(int(pdf["w"].max()), int(pdf["h"].max()), matrix=config.matrix, flags=flags, tile_size_log2=image.size_log2(config))
        tiles = [Tile(int(r.tile_x), int(r.tile_y), lossy.layer_flags(alpha), bytes(r.payload)) for r in pdf.itertuples()]
        return pd.DataFrame({"image_id": [key[0]], "content": [write(header, tiles, pack([Entry(9, 5, 6, score)]))], "score": [score]})

    return spread(coded, "image_id").groupBy("image_id").applyInPandas(join, "image_id bigint, content binary, score double")


def chunk_list(headers: DataFrame, tiles: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """headers(image_id, width, ..., max_fall), tiles(image_id, tile_x, tile_y, layer_flags, payload) and meta(image_id,
    payload) -> chunks of whole files: the header, metadata, the tiles row by row, the end."""
    cell = lambda c, n: le_bytes(F.col(c), n)
    sizes = {"width": 4, "height": 4, "bit_depth": 1, "primaries": 1, "transfer": 1, "matrix": 1, "flags": 2, "tile_size_log2": 1, "max_cll": 2, "max_fall": 2}
    none = F.unhex(F.lit(""))
    row = lambda df, kind, order, payload: df.select("image_id", F.lit(kind).alias("type"), F.lit(TYPES[kind]).alias("flags"), order.alias("_at"), payload.alias("payload"))
    at = lambda k, y=F.lit(0), x=F.lit(0): F.struct(F.lit(k).alias("k"), y.alias("y"), x.alias("x"))
    tile = F.concat(cell("tile_x", 2), cell("tile_y", 2), cell("layer_flags", 1), le_bytes(F.octet_length("payload"), 4), F.col("payload"))
    parts = [row(headers, "FHDR", at(0), F.concat(*[cell(c, n) for c, n in sizes.items()])), row(tiles, "TILE", at(2, F.col("tile_y"), F.col("tile_x")), tile), row(headers, "FEND", at(3), none)]
    parts += [row(meta, "META", at(1), F.col("payload"))] if meta is not None else []
    out = reduce(DataFrame.unionByName, parts)
    seq = F.row_number().over(Window.partitionBy("image_id").orderBy("_at")) - 1
    return out.select(F.col("image_id").cast("string").alias("image_id"), seq.alias("seq"), "type", "flags", F.octet_length("payload").cast("bigint").alias("size"), "payload")


def decode(files: DataFrame, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """files(image_id, content) -> pixels, a null where there is no alpha, and _error_code (a row without pixels) for a
    file that can't be decoded. region: x, y, width, height; tiles outside of it aren't decoded."""

    ids = files.schema["image_id"].dataType.simpleString()
    id_type = pa.string() if ids == "string" else pa.int64()
    names = ["image_id", "y", "x", "r", "g", "b", "a", "_error_code"]

    def table(image_id, n: int, cells: list, code: str | None) -> pa.RecordBatch:
        """cells: arrays of y, x, r, g, b, a, or None where all are null."""
        cols = [pa.nulls(n, pa.int32()) if c is None else pa.array(c, pa.int32()) for c in cells]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(image_id, id_type), n), *cols, pa.repeat(pa.scalar(code, pa.string()), n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for image_id, data in zip(b.column(0), b.column(1), strict=True):
                try:
                    a, x0, y0 = _decoded(data.as_py(), region)
                    h, w, n = a.shape
                    y, x = np.divmod(np.arange(h * w, dtype=np.int32), max(w, 1))
                    flat = a.reshape(-1, n).astype(np.int32)
                    held.append(table(image_id.as_py(), h * w, [y + y0, x + x0, *(np.ascontiguousarray(flat[:, i]) if i < n else None for i in range(4))], None))
                except CodecError as e:
                    held.append(table(image_id.as_py(), 1, [None] * 6, e.code))
                rows += held[-1].num_rows
                if rows >= ROWS:  # small images meet in a batch, large ones have their own
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches(ROWS)
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(ROWS)

    return files.select("image_id", "content").mapInArrow(run, f"{PIXELS.replace('bigint', ids, 1)}, _error_code string")


def _decoded(data: bytes, region: tuple[int, int, int, int] | None) -> tuple[np.ndarray, int, int]:
    if region is None:
        return image.decode(data), 0, 0
    x, y, w, h = region
    chunks = read_chunks(data)
    header = Header.parse(chunks[0][2])
    if header.flags & FLAGS["lossless"]:
        return image.decode(data)[y : y + h, x : x + w], x, y
    size, alpha = 1 << header.tile_size_log2, bool(header.flags & FLAGS["alpha"])
    tiles = [Tile.parse(p) for k, _, p in chunks if k == "TILE"]
    near = [t for t in tiles if t.x * size < x + w and (t.x + 1) * size > x and t.y * size < y + h and (t.y + 1) * size > y]
    if not near:
        return np.zeros((0, 0, 3), np.int64), x, y
    how = lossy.sampling(near[0].payload, near[0].x, near[0].y, size, header.width, header.height)
    got = [(t.x, t.y, lossy.decode_tile(t.payload, t.x, t.y, size, header.width, header.height, header.bit_depth, how, alpha, bool(t.layer_flags & 4))) for t in near]
    return image.assemble(header, got, how)[y : y + h, x : x + w], x, y


def info(files: DataFrame) -> DataFrame:
    """image_id, width, height, bit_depth, lossless, has_alpha, frame_count, _error_code; nothing is decoded."""
    names = ["width", "height", "bit_depth", "lossless", "has_alpha", "frame_count"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for image_id, data in zip(pdf["image_id"], pdf["content"], strict=True):
                try:
                    got = image.info(bytes(data))
                    out.append((image_id, *[got[n] for n in names], None))
                except CodecError as e:
                    out.append((image_id, *[None] * len(names), e.code))
            yield pd.DataFrame(out, columns=["image_id", *names, "_error_code"], dtype=object)

    return files.select("image_id", "content").mapInPandas(run, "image_id bigint, width bigint, height bigint, bit_depth int, lossless boolean, has_alpha boolean, frame_count int, _error_code string")


def lossless_tiles(px: DataFrame) -> DataFrame:
    """image_id, payload of the lossless tile."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = _array(pdf, False)
        rgba = np.concatenate([a, np.full((*a.shape[:2], 1), 255, np.uint8)], axis=2)
        return pd.DataFrame({"image_id": [key[0]], "payload": [lossless.encode_tile(rgba)]})

    return spread(px, "image_id").groupBy("image_id").applyInPandas(run, "image_id bigint, payload binary")
