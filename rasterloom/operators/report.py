"""Reports: an image's metrics as text and JSON, and a corpus's rows and rollups as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_escape
from .rollup import MEANS, rollup

CHANNEL = ("mae", "mse", "psnr", "ssim")
ARTIFACTS = ("chroma_mae", "chroma_mse", "chroma_psnr", "weighted_luma_mae", "weighted_chroma_mae", "max_abs_error")
STATISTICS = ("mean_luma", "luma_stddev", "mean_chroma", "dark_fraction", "bright_fraction")
BOM = "﻿"


def fixed(c: Column, places: int) -> Column:
    """A number with so many places, halves to even, and never in powers of ten."""
    return F.bround(c.cast("decimal(38,18)"), places).cast(f"decimal(38,{places})").cast("string")


def size_ratio(reference: Column, candidate: Column) -> Column:
    return F.when(reference > 0, candidate / F.nullif(reference, F.lit(0))).otherwise(0.0)


def report_text(reference: str = "reference_path", candidate: str = "candidate_path") -> Column:
    """The lines of a report, with 4 places, of a row of metrics.compare with both paths, width, height, bit_depth,
    reference_bytes and candidate_bytes."""
    n = lambda c: fixed(c if isinstance(c, Column) else F.col(c), 4)
    line = lambda label, *parts: F.concat(F.lit(label), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    four = lambda m, name: line(f"{name}:", *[x for k in CHANNEL for x in (f" {k.upper()}=", n(F.col(m)[name][k]))])
    stats = lambda label, c: line(label, *[x for k, f in zip(("LUMA", "STD", "CHROMA", "DARK", "BRIGHT"), STATISTICS, strict=True) for x in (f" {k}=", n(F.col(c)[f]))])
    ratio = F.when(F.col("reference_bytes") > 0, line("Size ratio:     ", n(size_ratio(F.col("reference_bytes"), F.col("candidate_bytes"))), "x")).otherwise("")
    alpha = F.col("compared_channels") > 3
    return F.concat(
        line("Reference:      ", F.col(reference)), line("Candidate:      ", F.col(candidate)), line("Dimensions:     ", F.col("width").cast("string"), "x", F.col("height").cast("string")),
        line("Bit depth:      ", F.col("bit_depth").cast("string")), line("Channels:       ", F.when(alpha, "RGBA").otherwise("RGB")),
        line("Reference bytes: ", F.col("reference_bytes").cast("string")), line("Candidate bytes: ", F.col("candidate_bytes").cast("string")), ratio,
        line("MAE:            ", n("mae")), line("MSE:            ", n("mse")), line("PSNR:           ", n("psnr"), " dB"), line("SSIM:           ", n("ssim")),
        *[four("channels", c) for c in "RGB"], F.when(alpha, four("channels", "A")).otherwise(""), line("YCbCr:"), *[four("ycbcr", c) for c in ("Y", "Cb", "Cr")],
        line("Chroma MAE:     ", n("chroma_mae")), line("Chroma PSNR:    ", n("chroma_psnr"), " dB"), line("Weighted Luma:  ", n("weighted_luma_mae")), line("Weighted Chroma: ", n("weighted_chroma_mae")), line("Max Abs Error:  ", n("max_abs_error")),
        stats("Ref Stats:      ", "reference_stats"), stats("Cand Stats:     ", "candidate_stats"),
    )


def report_json(reference: str = "reference_path", candidate: str = "candidate_path") -> Column:
    """The same report as a JSON object, with 6 places."""
    n = lambda c: fixed(c, 6)
    quoted = lambda c: F.concat(F.lit('"'), json_escape(F.col(c)), F.lit('"'))
    object_ = lambda *items: F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in items]), ","), F.lit("}"))
    whole = lambda c: F.col(c).cast("string")
    group = lambda c, names: object_(*[(k, n(F.col(c)[k])) for k in names])
    four = lambda m, names: object_(*[(k, object_(*[(x, n(F.col(m)[k][x])) for x in CHANNEL])) for k in names])
    alpha = F.col("compared_channels") > 3
    return object_(
        ("reference_path", quoted(reference)), ("candidate_path", quoted(candidate)), ("width", whole("width")), ("height", whole("height")), ("bit_depth", whole("bit_depth")), ("compared_channels", whole("compared_channels")),
        ("compared_alpha", alpha.cast("string")), ("reference_bytes", whole("reference_bytes")), ("candidate_bytes", whole("candidate_bytes")), ("size_ratio", n(size_ratio(F.col("reference_bytes"), F.col("candidate_bytes")))),
        *[(k, n(F.col(k))) for k in CHANNEL], ("channels", F.when(alpha, four("channels", "RGBA")).otherwise(four("channels", "RGB"))), ("ycbcr", four("ycbcr", ("Y", "Cb", "Cr"))),
        ("artifacts", object_(*[(k, n(F.col(k))) for k in ARTIFACTS])), ("reference_stats", group("reference_stats", STATISTICS)), ("candidate_stats", group("candidate_stats", STATISTICS)),
    )


def _summary(name: Column) -> Column:
    """A rollup's row as a JSON object; means as decimals of their own places."""
    means = [F.col(f"avg_{k}").cast(f"decimal(20,{p})").alias(f"avg_{k}") for k, p in MEANS.items()]
    return F.struct(name.alias("name"), "count", "total_bytes", *means)


def rollup_files(rows: DataFrame, profile: str, input_dir: str) -> DataFrame:
    """path, content: the rollup of all rows, and one of each scene group, as JSON documents. A rollup has a row for each
    group, however many images there are."""
    r = rollup(rows)
    scene, light = F.col("scene_group"), F.col("lighting_bucket")
    kind = F.when(scene.isNull() & light.isNull(), "overall").when(light.isNull(), "scene").when(scene.isNull(), "light").otherwise("both")
    r = r.withColumn("kind", kind).withColumn("name", F.when(scene.isNull() & light.isNull(), "overall").otherwise(F.concat_ws("|", scene, light)))
    r = r.withColumn("s", _summary(F.col("name")))
    rows_of = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "s"))))
    pairs = F.sort_array(F.collect_list(F.when(F.col("kind") == "both", F.struct("name", F.struct(scene.alias("scene_group"), light.alias("lighting_bucket"), F.col("s").alias("summary")).alias("s")))))
    bare = lambda c: F.transform(c, lambda x: x["s"])

    def document(overall: Column, scenes: Column, lights: Column, both: Column) -> Column:
        total = overall["count"]
        return F.to_json(F.struct(F.lit(profile).alias("profile"), F.lit(input_dir).alias("input_dir"), total.alias("total_images"), overall.alias("overall"), scenes.alias("by_scene_group"), lights.alias("by_lighting_bucket"), both.alias("by_scene_and_lighting")))

    first = lambda k: F.first(F.when(F.col("kind") == k, F.col("s")), ignorenulls=True)
    all_ = r.agg(first("overall").alias("o"), rows_of("scene").alias("sc"), rows_of("light").alias("li"), pairs.alias("bo")).select(
        F.lit(f"rollup/rollup_{profile}.json").alias("path"), document(F.col("o"), bare(F.col("sc")), bare(F.col("li")), bare(F.col("bo"))).alias("content"))
    # within a scene its buckets are named by themselves
    lights_of = F.sort_array(F.collect_list(F.when(F.col("kind") == "both", F.struct(light.alias("name"), F.col("s").withField("name", light).alias("s")))))
    each = r.where(scene.isNotNull()).groupBy("scene_group").agg(first("scene").alias("o"), lights_of.alias("li"), pairs.alias("bo")).select(
        F.concat(scene, F.lit(f"/rollup/rollup_{profile}.json")).alias("path"), document(F.col("o"), F.array(F.col("o")), bare(F.col("li")), bare(F.col("bo"))).alias("content"))
    return all_.unionByName(each).withColumn("content", F.encode(F.concat(F.lit(BOM), "content"), "UTF-8"))


def write_summary(rows: DataFrame, folder: str, profile: str) -> None:
    """The rows themselves as JSON lines, in a folder for each scene group; written by all tasks, whatever a group's size."""
    rows.withColumn("profile", F.lit(profile)).write.mode("overwrite").partitionBy("scene_group").json(folder)
