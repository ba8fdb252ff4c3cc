"""The container as a table, in two ways.

read(spark, path, table): by Spark's own binary files, so any store that Spark reads will do.

spark.read.format("rasterchunks").option("table", ...).load(path): a data source with filter pushdown. Its readers and
writers run outside of the JVM, so they go by pyarrow's file systems: local paths, file://, hdfs://, s3://, gs://; all
machines must see the path. Files are listed once, by the driver. Filters on type, tile_x, tile_y, ns and tag are
applied before payloads are copied; the frames table decodes no tile.

Tables: chunks, tiles, frames, meta. mode PERMISSIVE (the default) gives a row with an error code for a bad file,
FAILFAST fails. A file that is written is named by the whole image_id, escaped, so no two images share one; rows come
by image, and each image is written, whole or not at all, when its rows end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

from ..codec import CodecError
from ..codec.container import TYPES, Animation, Header, Tile, read_chunks, write_chunks
from ..codec.metablock import parse, text_of
from ..schemas import CHUNKS, FRAMES, META, SUFFIX, TILES

META_LANG = META.replace("value STRING", "value STRING, lang STRING")
TABLES = {"chunks": CHUNKS, "tiles": TILES, "frames": FRAMES, "meta": META_LANG}


def rows(table: str, image_id: str, data: bytes, wanted: dict | None = None) -> Iterator[tuple]:
    """A file's rows of a table, without the error column. wanted: values that columns must have."""
    wanted = wanted or {}
    chunks = read_chunks(data)
    if table == "chunks":
        for seq, (kind, flags, payload) in enumerate(chunks):
            if wanted.get("type", kind) == kind:
                yield image_id, seq, kind, flags, len(payload), payload
    elif table == "tiles":
        for kind, _, payload in chunks:
            if kind == "TILE":
                t = Tile.parse(payload)
                if wanted.get("tile_x", t.x) == t.x and wanted.get("tile_y", t.y) == t.y:
                    yield image_id, t.x, t.y, t.layer_flags, t.payload
    elif table == "frames":
        header = Header.parse(chunks[0][2])
        frames = next((len(Animation.parse(p).frames) for k, _, p in chunks if k == "ANIM"), 1)
        yield (image_id, header.width, header.height, header.bit_depth, header.primaries, header.transfer, header.matrix, header.flags, header.tile_size_log2, header.max_cll, header.max_fall, frames, sum(k == "TILE" for k, _, _ in chunks))
    else:
        block = next((p for k, _, p in reversed(chunks) if k == "META"), None)  # the last one holds
        try:
            entries = parse(block) if block is not None else []
        except CodecError:
            entries = []  # metadata that can't be read doesn't spoil the image
        for n, e in enumerate(entries):
            if wanted.get("ns", e.ns) == e.ns and wanted.get("tag", e.tag) == e.tag:
                text, lang = text_of(e)
                yield image_id, n, e.ns, e.tag, e.type_id, text, lang, e.opaque


def parsed(files: DataFrame, table: str = "chunks", permissive: bool = True, id_col: str = "path", content: str = "content") -> DataFrame:
    """files(path, content) -> a table, with _error_code: null, or why a file gave no rows. Any store's bytes will do."""
    names = [c.split()[0] for c in TABLES[table].split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for image_id, data in zip(pdf["id"], pdf["data"], strict=True):
                try:
                    out += [(*r, None) for r in list(rows(table, str(image_id), bytes(data)))]
                except CodecError as e:
                    if not permissive:
                        raise
                    out.append((str(image_id), *[None] * (len(names) - 1), e.code))
            yield pd.DataFrame(out, columns=[*names, "_error_code"], dtype=object)

    return files.select(F.col(id_col).cast("string").alias("id"), F.col(content).alias("data")).mapInPandas(run, f"{TABLES[table]}, _error_code STRING")


def built(chunks: DataFrame) -> DataFrame:
    """chunks -> image_id, content: each image's file, its chunks in order of seq, sizes and flags as given."""
    order = F.array_sort(F.collect_list(F.struct("seq", "type", "flags", "payload")))
    files = chunks.groupBy("image_id").agg(order.alias("chunks"))

    @F.pandas_udf("binary")
    def join(parts: pd.Series) -> pd.Series:
        return parts.map(lambda cs: write_chunks([(c["type"], c["flags"], bytes(c["payload"])) for c in cs]))

    return files.select("image_id", join("chunks").alias("content"))


def read(spark: SparkSession, path: str, table: str = "chunks", permissive: bool = True) -> DataFrame:
    """A table of all files below a path, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{SUFFIX}").load(path)
    return parsed(files, table, permissive)


def store(path: str):
    """A path's file system, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_name(image_id: str) -> str:
    """The escaped id; one too long for a file's name is cut and told apart by its hash."""
    name = quote(image_id, safe="").replace(".", "%2E")
    return name if len(name) <= 180 else f"{name[:100]}-{hashlib.sha256(image_id.encode()).hexdigest()}"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.path = options.get("table", "chunks"), options["path"]
        self.fast, self.most = options.get("mode", "PERMISSIVE").upper() == "FAILFAST", int(options.get("bytesperpartition", str(64 << 20)))
        self.wanted: dict = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("type", "tile_x", "tile_y", "ns", "tag"):
                self.wanted[f.attribute[0]] = f.value
            yield f  # rows of bad files keep their nulls, so Spark filters as well

    def partitions(self) -> list[Files]:
        """Files by about so many bytes together."""
        from pyarrow import fs

        files, top = store(self.path)
        info = files.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        out, size = [[]], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(f".{SUFFIX}")), key=lambda f: f.path):
            if out[-1] and size + f.size > self.most:
                out, size = [*out, []], 0
            out[-1].append(f.path)
            size += f.size
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        width = len(TABLES[self.table].split(", "))
        files, _ = store(self.path)
        for path in partition.paths:
            try:
                with files.open_input_stream(path) as f:
                    data = f.read()
                yield from [(*r, None) for r in rows(self.table, path, data, self.wanted)]
            except CodecError as e:
                if self.fast:
                    raise
                yield (path, *[None] * (width - 1), e.code)


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ChunkWriter(DataSourceArrowWriter):
    """One file for each image of a task; rows come by image and seq (see write()), so one image is held at a time."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, top = store(self.path)
        files.create_dir(top, recursive=True)
        out, image_id, held = [], None, []

        def end() -> None:
            if not held:
                return
            to = f"{top.rstrip('/')}/{file_name(image_id)}.{SUFFIX}"
            with files.open_output_stream(f"{to}.part") as f:
                f.write(write_chunks([c[1:] for c in sorted(held, key=lambda c: c[0])]))
            files.move(f"{to}.part", to)
            out.append(to)

        for b in batches:
            for r in b.to_pylist():
                if r["image_id"] != image_id:
                    end()
                    image_id, held = r["image_id"], []
                held.append((r["seq"], r["type"], r["flags"], r["payload"]))
        end()
        return Written(out)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterchunks"

    def schema(self) -> str:
        return f"{TABLES[self.options.get('table', 'chunks')]}, _error_code STRING"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses a reader that takes filters
    spark.dataSource.register(ChunkSource)


def write(chunks: DataFrame, path: str) -> None:
    """A file for each image."""
    register(chunks.sparkSession)
    chunks.select("image_id", "seq", "type", "flags", "size", "payload").repartition("image_id").sortWithinPartitions("image_id", "seq").write.format("rasterchunks").mode("append").save(path)


def flags_of(kind: str) -> int:
    return TYPES[kind]
