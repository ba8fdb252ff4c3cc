"""Rasters that are derived from the test tables, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 16 x 16 from events; the last may be partial."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    place = F.pmod("event_id", F.lit(256))
    return e.select(
        F.floor(F.col("event_id") / 256).cast("bigint").alias("image_id"), F.floor(place / 16).cast("int").alias("y"), (place % 16).cast("int").alias("x"),
        ((place % 16) * 16 + F.col("user_id") % 16).cast("int").alias("r"), ((F.col("user_id") * 37) % 256).cast("int").alias("g"), (F.floor("value").cast("bigint") % 256).cast("int").alias("b"),
    )


def coarse(px: DataFrame) -> DataFrame:
    """A candidate for comparison: samples cut to multiples of 8."""
    return px.select("image_id", "y", "x", *[(F.floor(F.col(c) / 8) * 8).cast("int").alias(c) for c in ("r", "g", "b")])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 blocks of samples 0..255 from embeddings: block_id, v (row-major)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("block_id"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 127.5).cast("int")).alias("v"))


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of samples from lineitem: image_id, n (place in the image), r, g, b; for benches."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_quantity").cast("int") * 5).alias("g"), (F.floor("l_extendedprice").cast("bigint") % 256).cast("int").alias("b"))


PX = """px AS (SELECT CAST(event_id // 256 AS BIGINT) AS image_id, CAST((event_id % 256) // 16 AS INTEGER) AS y, CAST(event_id % 16 AS INTEGER) AS x,
  CAST((event_id % 16) * 16 + user_id % 16 AS INTEGER) AS r, CAST((user_id * 37) % 256 AS INTEGER) AS g, CAST(CAST(floor(value) AS BIGINT) % 256 AS INTEGER) AS b FROM events)"""
CAND = "cd AS (SELECT image_id, y, x, (r // 8) * 8 AS r, (g // 8) * 8 AS g, (b // 8) * 8 AS b FROM px)"
PAIR = "j AS (SELECT px.image_id, px.y, px.x, px.r, px.g, px.b, cd.r AS r2, cd.g AS g2, cd.b AS b2 FROM px JOIN cd USING (image_id, y, x))"
LONG = "l AS (SELECT image_id, y, x, 'R' AS channel, r AS a, r2 AS c FROM j UNION ALL SELECT image_id, y, x, 'G', g, g2 FROM j UNION ALL SELECT image_id, y, x, 'B', b, b2 FROM j)"
BLK = "bl AS (SELECT vec_id AS block_id, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE) AS INTEGER)) AS v FROM embeddings)"
CELL = f"{BLK}, cell AS (SELECT block_id, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, unnest(v) AS s FROM bl)"


def clamp_sql(x: str, top: str = "255.0") -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), {top}::DOUBLE)"


#: Unrounded Y, Cb, Cr of r, g, b, as the metrics take them.
def ycc_sql(r: str = "r", g: str = "g", b: str = "b") -> tuple[str, str, str]:
    r, g, b = (f"(CAST({x} AS DOUBLE) / 255.0::DOUBLE)" for x in (r, g, b))
    line = lambda w: f"({w[0]}::DOUBLE * {r} + {w[1]}::DOUBLE * {g} + {w[2]}::DOUBLE * {b}) * 255.0::DOUBLE"
    from .schemas import YCBCR

    y, cb, cr = (line(w) for w in YCBCR[1])
    return clamp_sql(y), clamp_sql(f"{cb} + 127.5::DOUBLE"), clamp_sql(f"{cr} + 127.5::DOUBLE")
