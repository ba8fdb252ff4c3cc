"""Files as rows: scans, images, EXIF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec import CodecError, exif, ppm
from ..codec.metablock import text_of
from ..functions.text import declared_format, loader_of, lower_extension, sniff_format
from ..operators.order import numbered
from ..schemas import IMAGES
from .container import store

ENTRIES = "image_id string, ord int, ns int, tag int, type_id int, value string, lang string"


def scan(spark: SparkSession, root: str, endings: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """path, length, content, declared_format, detected_format of the files below root, by lower-case endings. The
    content is only read by what asks for it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    if endings:
        df = df.where(lower_extension(F.col("path")).isin(*endings))
    return df.select("path", "length", "content", declared_format(F.col("path")).alias("declared_format"), sniff_format(F.col("content")).alias("detected_format"))


def collect(spark: SparkSession, root: str, wanted: Callable[[Column], Column], recursive: bool = False) -> DataFrame:
    """path, content, n (from 0, in order of lower-case paths) of the files of a folder for whose path `wanted` holds; of
    all folders below it if the folder itself has none."""
    files = lambda deep: spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(root).select("path", "content")
    if not recursive and not spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(root)):
        return spark.createDataFrame([], "path string, content binary, n bigint")
    deep = recursive or not files(False).where(wanted(F.col("path"))).limit(1).count()
    found = files(deep).where(wanted(F.col("path")))
    order = numbered(found.select("path", F.lower("path").alias("lower")), ["lower", "path"]).select("path", "n")
    return found.join(order, "path")


def write_files(files: DataFrame, folder: str) -> int:
    """files(path, content): a file for each row, below a folder that all machines see; how many were written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store_, top = store(folder)
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                to = f"{top.rstrip('/')}/{path}"
                store_.create_dir(to.rpartition("/")[0], recursive=True)
                with store_.open_output_stream(f"{to}.part") as f:
                    f.write(bytes(data))
                store_.move(f"{to}.part", to)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def load_images(spark: SparkSession, root: str) -> DataFrame:
    """image_id (the path), width, height, bit_depth, has_alpha, pixels, _error_code of all images below a folder: the
    containers decoded, PPM parsed, JPEG and PNG by Spark's reader."""
    files = scan(spark, root).withColumn("loader", loader_of(F.col("path")))
    none = F.lit(None).cast("string").alias("_error_code")
    return (
        read_container(files.where("loader = 'container'"))
        .unionByName(read_ppm(files.where("loader = 'ppm'")))
        .unionByName(read_image(spark, root).where(loader_of(F.col("image_id")) == "image").select("*", none))
    )


def read_container(files: DataFrame) -> DataFrame:
    """files(path, content) -> images, with _error_code for what can't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from ..codec import image

        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    a = image.decode(bytes(data))
                    out.append((path, a.shape[1], a.shape[0], 8, a.shape[2] == 4, np.ascontiguousarray(a, dtype=np.uint8).tobytes(), None))
                except CodecError as e:
                    out.append((path, None, None, None, None, None, e.code))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "bit_depth", "has_alpha", "pixels", "_error_code"], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"{IMAGES}, _error_code STRING")


def read_ppm(files: DataFrame) -> DataFrame:
    """files(path, content) -> images, with _error_code for what is no binary PPM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    a = ppm.parse(bytes(data))
                    out.append((path, a.shape[1], a.shape[0], 8, False, a.tobytes(), None))
                except CodecError as e:
                    out.append((path, None, None, None, None, None, e.code))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "bit_depth", "has_alpha", "pixels", "_error_code"], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"{IMAGES}, _error_code STRING")


def write_ppm(images: DataFrame, png: bool = False) -> DataFrame:
    """images -> image_id, content of a file; alpha only goes with PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = to_array(r)
                out.append((r.image_id, ppm.write_png(a) if png else ppm.write(a)))
            yield pd.DataFrame(out, columns=["image_id", "content"])

    return images.select("image_id", "width", "height", "has_alpha", "pixels").mapInPandas(run, "image_id string, content binary")


def to_array(r):
    import numpy as np

    return np.frombuffer(bytes(r.pixels), np.uint8).reshape(int(r.height), int(r.width), 4 if r.has_alpha else 3)


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """JPEG and PNG by Spark's own reader, whose bytes are blue first."""
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path).select("image.*")

    @F.pandas_udf("binary")
    def red_first(data: pd.Series, n: pd.Series) -> pd.Series:
        import numpy as np

        def turn(d: bytes, k: int) -> bytes:
            a = np.frombuffer(d, np.uint8).reshape(-1, k)
            return a[:, [2, 1, 0, *range(3, k)]].tobytes() if k >= 3 else d

        return pd.Series([turn(d, k) for d, k in zip(data, n, strict=True)])

    return df.select(F.col("origin").alias("image_id"), "width", "height", F.lit(8).alias("bit_depth"), (F.col("nChannels") == 4).alias("has_alpha"), red_first("data", "nChannels").alias("pixels"))


def read_exif(files: DataFrame) -> DataFrame:
    """files(path, content) -> metadata entries; files without EXIF give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    block = exif.find(bytes(data))
                    found = exif.entries(block) if block else []
                except CodecError:
                    found = []
                out += [(path, n, e.ns, e.tag, e.type_id, *text_of(e)) for n, e in enumerate(found)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRIES.split(", ")])

    return files.select("path", "content").mapInPandas(run, ENTRIES)
