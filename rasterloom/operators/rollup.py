"""Corpus rollups and per-image colour summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import luma_77

#: Averaged columns, with the places they are rounded to.
MEANS = {"psnr": 4, "ssim": 6, "chroma_psnr": 4, "weighted_chroma_mae": 4, "source_mean_luma": 4}


def exact_mean(name: str, places: int) -> Column:
    """The mean of a column, rounded half to even. A double is cut into two whole numbers, of 2^-40 and of 2^-80, whose
    sums are exact in any order and need no group in memory; one rounding makes the sum a double again."""
    scaled = F.col(name) * float(1 << 40)
    high = F.floor(scaled)
    low = ((scaled - high) * float(1 << 40)).cast("bigint")
    whole = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    mean = (whole(high) + whole(low) / float(1 << 40)) / float(1 << 40) / F.count(name)
    return F.rint(mean * float(10**places)) / float(10**places)


def rollup(rows: DataFrame, places: dict[str, int] = MEANS) -> DataFrame:
    """Of quality rows: all, by scene_group, by lighting_bucket, and by both."""
    g = rows.cube("scene_group", "lighting_bucket")
    return g.agg(F.count("*").alias("count"), F.sum("bytes").alias("total_bytes"), *[exact_mean(n, p).alias(f"avg_{n}") for n, p in places.items()])


def with_keys(rolled: DataFrame) -> DataFrame:
    """key: overall, or the group's names with a bar between."""
    return rolled.withColumn("key", F.when(F.col("scene_group").isNull() & F.col("lighting_bucket").isNull(), "overall").otherwise(F.concat_ws("|", "scene_group", "lighting_bucket")))


def colour_ratios(px: DataFrame) -> DataFrame:
    """image_id, g_r, g_b, r_b: how far red and blue go with green, and blue with red, in 32nds."""
    wide = lambda a, b: F.sum(F.col(a).cast("bigint") * F.col(b))
    s = px.groupBy("image_id").agg(wide("g", "r").alias("gr"), wide("g", "b").alias("gb"), wide("r", "b").alias("rb"), wide("g", "g").alias("gg"), wide("r", "r").alias("rr"))
    part = lambda a, b: F.least(F.greatest((F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)) * 32).cast("int"), F.lit(-128)), F.lit(127))
    return s.select("image_id", part("gr", "gg").alias("g_r"), part("gb", "gg").alias("g_b"), part("rb", "rr").alias("r_b"))


def luma_histogram(px: DataFrame) -> DataFrame:
    """luma 0..255, n, and the largest n."""
    h = px.groupBy(luma_77(F.col("r"), F.col("g"), F.col("b")).alias("luma")).agg(F.count("*").alias("n"))
    peak = h.agg(F.max("n").alias("peak"))
    all_ = px.sparkSession.range(256).select(F.col("id").cast("int").alias("luma"))
    return all_.join(h, "luma", "left").select("luma", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")).crossJoin(F.broadcast(peak))  # one row
