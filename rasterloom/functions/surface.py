"""The engine's functions under names for SQL: register(spark), then spark.sql("SELECT psnr(mse, 255D) ...").

Scalar functions are SQL functions whose bodies are the same column expressions as in Python, so Catalyst folds them into
the plan; what parses bytes is a table function: SELECT * FROM files, LATERAL parse_container(content)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..codec import CodecError, exif
from ..codec.metablock import parse, text_of
from . import colour, quality, text

#: name: parameters, what it returns, and the expression of them.
SCALARS: dict[str, tuple[str, str, object]] = {
    "psnr": ("mse DOUBLE", "DOUBLE", lambda mse: quality.psnr(mse)),
    "tile_score": ("mse DOUBLE", "DOUBLE", lambda mse: quality.tile_score(mse)),
    "lighting_bucket": ("mean_luma DOUBLE, dark_fraction DOUBLE, bright_fraction DOUBLE", "STRING", quality.lighting_bucket),
    "pq_eotf": ("v DOUBLE", "DOUBLE", colour.pq_eotf),
    "pq_oetf": ("y DOUBLE", "DOUBLE", colour.pq_oetf),
    "sniff_format": ("content BINARY", "STRING", text.sniff_format),
    "declared_format": ("path STRING", "STRING", text.declared_format),
    "scene_group": ("relative STRING", "STRING", text.scene_group),
    "match_text": ("name STRING", "STRING", text.match_text),
}


def _sql(spark: SparkSession, parameters: str, c: Column) -> str:
    """A column's expression of the parameters, as SQL: the analyzer knows how to write what it has resolved."""
    plan = spark.createDataFrame([], parameters.replace(" ", ": ").replace(",: ", ", ").lower()).select(c.alias("x"))._jdf.queryExecution().analyzed()
    return plan.projectList().head().child().sql()


@udtf(returnType="seq int, type string, flags int, size bigint, payload binary, error string")
class ParseContainer:
    """The chunks of a file, or one row with an error code."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        from ..sources.container import rows

        try:
            yield from [(*r[1:], None) for r in list(rows("chunks", "", bytes(content)))]
        except CodecError as e:
            yield None, None, None, None, None, e.code


@udtf(returnType="ord int, ns int, tag int, type_id int, value string, lang string")
class ParseMeta:
    """The entries of a metadata block; none if it is no block."""

    def eval(self, block: bytes) -> Iterator[tuple]:
        try:
            found = parse(bytes(block))
        except CodecError:
            found = []
        yield from [(n, e.ns, e.tag, e.type_id, *text_of(e)) for n, e in enumerate(found)]


@udtf(returnType="ord int, ns int, tag int, type_id int, value string, lang string")
class Exif:
    """The entries of a file's EXIF block; none if it has none."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            block = exif.find(bytes(content))
            found = exif.entries(block) if block else []
        except CodecError:
            found = []
        yield from [(n, e.ns, e.tag, e.type_id, *text_of(e)) for n, e in enumerate(found)]


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session's SQL."""
    for name, (parameters, returns, expression) in SCALARS.items():
        body = _sql(spark, parameters, expression(*[F.col(p.split()[0]) for p in parameters.split(", ")]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    for name, kind in (("parse_container", ParseContainer), ("parse_meta", ParseMeta), ("exif", Exif)):
        spark.udtf.register(name, kind)
