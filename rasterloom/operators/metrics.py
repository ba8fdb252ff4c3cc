"""How far a candidate image is from its reference, per image.

pixels: image_id, y, x, r, g, b (and a). The two sides are joined on the place once; everything else is aggregation
over that, so the family shares one shuffle. Sums of samples are whole numbers, so they don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import clamp, ycbcr_exact
from ..functions.quality import psnr, ssim

PLACE = ["image_id", "y", "x"]


def paired(reference: DataFrame, candidate: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Both sides of each place: the reference's channels, the candidate's with a 2 behind the name."""
    return reference.join(candidate.select(*PLACE, *[F.col(c).alias(f"{c}2") for c in channels]), PLACE)


def mismatches(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """image_id, reason: images that can't be compared, for want of one side or for different sizes."""
    size = lambda df, n: df.groupBy("image_id").agg((F.max("x") + 1).alias(f"w{n}"), (F.max("y") + 1).alias(f"h{n}"))
    both = size(reference, 1).join(size(candidate, 2), "image_id", "full")
    reason = F.when(F.col("w2").isNull() | F.col("w1").isNull(), "missing").when((F.col("w1") != F.col("w2")) | (F.col("h1") != F.col("h2")), "dimensions")
    return both.select("image_id", reason.alias("reason")).where("reason IS NOT NULL")


def samples(pair: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """A row for each place and channel: channel, a (reference), c (candidate)."""
    cells = F.array(*[F.struct(F.lit(c.upper()).alias("channel"), F.col(c).alias("a"), F.col(f"{c}2").alias("c")) for c in channels])
    return pair.select(*PLACE, F.explode(cells).alias("s")).select(*PLACE, "s.*")


def _windows(s: DataFrame, by: list[str]) -> DataFrame:
    wide = lambda c: c.cast("bigint")
    a, c = wide(F.col("a")), wide(F.col("c"))
    return s.groupBy(*by, F.floor(F.col("y") / 8).cast("int").alias("wy"), F.floor(F.col("x") / 8).cast("int").alias("wx")).agg(
        F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(c).alias("sc"), F.sum(a * a).alias("saa"), F.sum(c * c).alias("scc"), F.sum(a * c).alias("sac"),
        F.sum(F.abs(a - c)).alias("abs"), F.sum((a - c) * (a - c)).alias("sq"),
    )


def window_ssim(s: DataFrame, top: float = 255.0) -> DataFrame:
    """image_id, channel, wy, wx, ssim of each 8 x 8 window; windows at the edges may be smaller."""
    w = _windows(s, ["image_id", "channel"])
    return w.select("image_id", "channel", "wy", "wx", ssim(*[F.col(c) for c in ("n", "sa", "sc", "saa", "scc", "sac")], top=top).alias("ssim"))


def channels(s: DataFrame, top: float = 255.0) -> DataFrame:
    """image_id, channel, n, mae, mse, psnr, ssim. One pass: the windows' sums are the image's as well."""
    w = _windows(s, ["image_id", "channel"])
    q = ssim(*[F.col(c) for c in ("n", "sa", "sc", "saa", "scc", "sac")], top=top)
    out = w.groupBy("image_id", "channel").agg(F.sum("n").alias("n"), (F.sum("abs") / F.sum("n")).alias("mae"), (F.sum("sq") / F.sum("n")).alias("mse"), F.avg(q).alias("ssim"))
    return out.select("image_id", "channel", "n", "mae", "mse", psnr(F.col("mse"), top).alias("psnr"), "ssim")


def overall(per_channel: DataFrame, top: float = 255.0, places: str | None = None) -> DataFrame:
    """Pooled over the channels of an image. places: the name under which the number of places is given as well."""
    out = per_channel.groupBy("image_id").agg(F.avg("mae").alias("mae"), F.avg("mse").alias("mse"), F.avg("ssim").alias("ssim"), F.max("n").alias("n"))
    return out.select("image_id", "mae", "mse", psnr(F.col("mse"), top).alias("psnr"), "ssim", *([F.col("n").alias(places)] if places else []))


def planes(pair: DataFrame, top: float = 255.0) -> DataFrame:
    """pair with yy, cb, cr of the reference and yy2, cb2, cr2 of the candidate."""
    out = pair.withColumns(dict(zip(("yy", "cb", "cr"), ycbcr_exact(*map(F.col, ("r", "g", "b")), top), strict=True)))
    return out.withColumns(dict(zip(("yy2", "cb2", "cr2"), ycbcr_exact(*map(F.col, ("r2", "g2", "b2")), top), strict=True)))


def statistics(px: DataFrame, top: float = 255.0) -> DataFrame:
    """image_id, mean_luma, luma_stddev, mean_chroma, dark_fraction, bright_fraction."""
    yy, cb, cr = ycbcr_exact(*map(F.col, ("r", "g", "b")), top)
    luma = yy / top
    chroma = clamp(F.hypot(cb - top / 2, cr - top / 2) / F.lit(top * 0.5**0.5), 0, 1)
    p = px.select("image_id", luma.alias("luma"), chroma.alias("chroma"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    variance = F.greatest(F.lit(0.0), F.avg(F.col("luma") * F.col("luma")) - F.avg("luma") * F.avg("luma"))
    return p.groupBy("image_id").agg(F.avg("luma").alias("mean_luma"), F.sqrt(variance).alias("luma_stddev"), F.avg("chroma").alias("mean_chroma"), share(F.col("luma") <= 0.25).alias("dark_fraction"), share(F.col("luma") >= 0.75).alias("bright_fraction"))


def neighbours(px: DataFrame, value: str, step: int = 1, within: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """px with left, right, up, down: value at the places beside, null where there is none. Two sorts, no join."""
    row = Window.partitionBy(*within, "y").orderBy("x")
    column = Window.partitionBy(*within, "x").orderBy("y")

    def beside(w, place: str, n: int) -> Column:
        f = F.lead if n > 0 else F.lag
        return F.when(f(place, abs(n)).over(w) == F.col(place) + n, f(value, abs(n)).over(w))

    return px.withColumns({"left": beside(row, "x", -step), "right": beside(row, "x", step)}).withColumns({"up": beside(column, "y", -step), "down": beside(column, "y", step)})


def edge_strength(value: str = "yy") -> Column:
    """The largest step to one of the four places beside."""
    return F.greatest(F.lit(0.0), *[F.coalesce(F.abs(F.col(value) - F.col(n)), F.lit(0.0)) for n in ("left", "right", "up", "down")])


def artifacts(pair: DataFrame, top: float = 255.0, channels_: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """image_id, weighted_luma_mae, weighted_chroma_mae (by the reference's edges and colour), chroma_mae, chroma_mse,
    chroma_psnr (of the mean of both chroma planes' errors), max_abs_error (of the samples)."""
    p = neighbours(planes(pair, top), "yy")
    edge = 1 + 3 * clamp(edge_strength("yy") / top, 0, 1)
    radius = F.hypot(F.col("cb") - top / 2, F.col("cr") - top / 2) / top
    p = p.withColumn("we", edge).withColumn("wc", F.col("we") * (1 + 1.75 * clamp(radius, 0, 1)))
    d_y, d_cb, d_cr = (F.abs(F.col(c) - F.col(f"{c}2")) for c in ("yy", "cb", "cr"))
    chroma = 0.5 * (d_cb + d_cr)
    out = p.groupBy("image_id").agg(
        (F.sum(d_y * F.col("we")) / F.sum("we")).alias("weighted_luma_mae"), (F.sum(chroma * F.col("wc")) / F.sum("wc")).alias("weighted_chroma_mae"),
        F.avg(chroma).alias("chroma_mae"), F.avg(0.5 * (d_cb * d_cb + d_cr * d_cr)).alias("chroma_mse"),
        F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"{c}2")) for c in channels_])).cast("double").alias("max_abs_error"),
    )
    return out.withColumn("chroma_psnr", psnr(F.col("chroma_mse"), top))


def plane_metrics(pair: DataFrame, top: float = 255.0) -> DataFrame:
    """image_id, channel (Y, Cb, Cr), mae, mse, psnr, ssim."""
    p = planes(pair, top)
    cells = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).alias("a"), F.col(f"{c}2").alias("c")) for n, c in (("Y", "yy"), ("Cb", "cb"), ("Cr", "cr"))])
    s = p.select(*PLACE, F.explode(cells).alias("s")).select(*PLACE, "s.*")
    a, c = F.col("a"), F.col("c")
    w = s.groupBy("image_id", "channel", F.floor(F.col("y") / 8).alias("wy"), F.floor(F.col("x") / 8).alias("wx")).agg(
        F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(c).alias("sc"), F.sum(a * a).alias("saa"), F.sum(c * c).alias("scc"), F.sum(a * c).alias("sac"), F.sum(F.abs(a - c)).alias("abs"), F.sum((a - c) * (a - c)).alias("sq")
    )
    q = ssim(*[F.col(c) for c in ("n", "sa", "sc", "saa", "scc", "sac")], top=top)
    out = w.groupBy("image_id", "channel").agg((F.sum("abs") / F.sum("n")).alias("mae"), (F.sum("sq") / F.sum("n")).alias("mse"), F.avg(q).alias("ssim"))
    return out.select("image_id", "channel", "mae", "mse", psnr(F.col("mse"), top).alias("psnr"), "ssim")


def _sums(a: Column, c: Column, name: str) -> list[Column]:
    """A window's sums of a channel, under names of their own."""
    return [F.sum(x).alias(f"{name}_{k}") for k, x in (("sa", a), ("sc", c), ("saa", a * a), ("scc", c * c), ("sac", a * c), ("abs", F.abs(a - c)), ("sq", (a - c) * (a - c)))]


def _of_image(name: str, top: float) -> Column:
    """A channel's figures from the sums of its windows."""
    window = ssim(F.col("n"), *[F.col(f"{name}_{k}") for k in ("sa", "sc", "saa", "scc", "sac")], top=top)
    mse = F.sum(f"{name}_sq") / F.sum("n")
    return F.struct((F.sum(f"{name}_abs") / F.sum("n")).alias("mae"), mse.alias("mse"), psnr(mse, top).alias("psnr"), F.avg(window).alias("ssim"))


def compare(reference: DataFrame, candidate: DataFrame, top: float = 255.0) -> DataFrame:
    """All metrics of an image in one row; images that can't be compared, as some place has one side only, are missing
    (see mismatches). The sides meet once, and one group-by over windows holds the sums of all channels, planes,
    artifacts and statistics."""
    names = tuple(c for c in ("r", "g", "b", "a") if c in reference.columns and c in candidate.columns)
    wide = lambda c: F.col(c).cast("bigint")
    sides = [df.select(*PLACE, *[F.col(c).alias(f"{c}{n}") for c in names]) for df, n in ((reference, ""), (candidate, "2"))]
    whole = F.col(names[0]).isNotNull() & F.col(f"{names[0]}2").isNotNull()
    p = neighbours(planes(sides[0].join(sides[1], PLACE, "full"), top), "yy").withColumn("whole", whole)
    edge = 1 + 3 * clamp(edge_strength("yy") / top, 0, 1)
    radius = F.hypot(F.col("cb") - top / 2, F.col("cr") - top / 2) / top
    p = p.withColumn("we", edge).withColumn("wc", F.col("we") * (1 + 1.75 * clamp(radius, 0, 1)))
    d_y, d_cb, d_cr = (F.abs(F.col(c) - F.col(f"{c}2")) for c in ("yy", "cb", "cr"))
    p = p.withColumns({"chroma": 0.5 * (d_cb + d_cr), "chroma_sq": 0.5 * (d_cb * d_cb + d_cr * d_cr), "d_y": d_y})
    for n in ("", "2"):
        far = clamp(F.hypot(F.col(f"cb{n}") - top / 2, F.col(f"cr{n}") - top / 2) / F.lit(top * 0.5**0.5), 0, 1)
        p = p.withColumns({f"luma{n}": F.col(f"yy{n}") / top, f"far{n}": far})
    stats = [x for n in ("", "2") for x in (F.sum(f"luma{n}").alias(f"l{n}"), F.sum(F.col(f"luma{n}") * F.col(f"luma{n}")).alias(f"ll{n}"), F.sum(f"far{n}").alias(f"f{n}"), F.count_if(F.col(f"luma{n}") <= 0.25).alias(f"dark{n}"), F.count_if(F.col(f"luma{n}") >= 0.75).alias(f"bright{n}"))]
    weighted = [F.sum(F.col("d_y") * F.col("we")).alias("dw"), F.sum("we").alias("we"), F.sum(F.col("chroma") * F.col("wc")).alias("cw"), F.sum("wc").alias("wc"), F.sum("chroma").alias("chroma"), F.sum("chroma_sq").alias("chroma_sq")]
    most = F.max(F.greatest(*[F.abs(wide(c) - wide(f"{c}2")) for c in names])).alias("most")
    channels_ = [x for c in names for x in _sums(wide(c), wide(f"{c}2"), c)] + [x for c in ("yy", "cb", "cr") for x in _sums(F.col(c), F.col(f"{c}2"), c)]
    w = p.groupBy("image_id", F.floor(F.col("y") / 8).alias("wy"), F.floor(F.col("x") / 8).alias("wx")).agg(F.count("*").alias("n"), F.min("whole").alias("whole"), most, *channels_, *weighted, *stats)
    per = lambda c: F.sum(c) / F.sum("n")

    def statistics_of(n: str) -> Column:
        luma = per(f"l{n}")
        variance = F.greatest(F.lit(0.0), per(f"ll{n}") - luma * luma)
        return F.struct(luma.alias("mean_luma"), F.sqrt(variance).alias("luma_stddev"), per(f"f{n}").alias("mean_chroma"), per(f"dark{n}").alias("dark_fraction"), per(f"bright{n}").alias("bright_fraction"))

    map_of = lambda labels: F.create_map(*[x for label, c in labels for x in (F.lit(label), _of_image(c, top))])
    out = w.groupBy("image_id").agg(
        F.min("whole").alias("whole"), map_of([(c.upper(), c) for c in names]).alias("channels"), map_of([("Y", "yy"), ("Cb", "cb"), ("Cr", "cr")]).alias("ycbcr"),
        (F.sum("dw") / F.sum("we")).alias("weighted_luma_mae"), (F.sum("cw") / F.sum("wc")).alias("weighted_chroma_mae"), per("chroma").alias("chroma_mae"), per("chroma_sq").alias("chroma_mse"),
        F.max("most").cast("double").alias("max_abs_error"), statistics_of("").alias("reference_stats"), statistics_of("2").alias("candidate_stats"),
    ).where("whole").drop("whole")
    mean = lambda k: sum((F.col("channels")[c.upper()][k] for c in names[1:]), F.col("channels")[names[0].upper()][k]) / len(names)
    out = out.withColumns({"mae": mean("mae"), "mse": mean("mse"), "ssim": mean("ssim"), "chroma_psnr": psnr(F.col("chroma_mse"), top), "compared_channels": F.lit(len(names))})
    order = ["image_id", "mae", "mse", "psnr", "ssim", "channels", "ycbcr", "weighted_luma_mae", "weighted_chroma_mae", "chroma_mae", "chroma_mse", "max_abs_error", "chroma_psnr", "reference_stats", "candidate_stats", "compared_channels"]
    return out.withColumn("psnr", psnr(F.col("mse"), top)).select(*order)
