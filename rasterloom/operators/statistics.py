"""Statistics that drive coding choices: tiles, symbols, frequency tables, runs and bit packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import clamp
from .blocks import with_tiles

SCALE = 4096  # what frequencies add up to


# --- tiles ------------------------------------------------------------------------------------------------------------


def tile_complexity(planes: DataFrame, tile_size: int, top: int = 255) -> DataFrame:
    """planes(image_id, y, x, yy, cb, cr), chroma at full size -> ten statistics of each tile. Steps are taken to the
    places on the right and below, within the tile."""
    p = with_tiles(planes, tile_size)
    row = Window.partitionBy("image_id", "tile_y", "tile_x", "y").orderBy("x")
    column = Window.partitionBy("image_id", "tile_y", "tile_x", "x").orderBy("y")
    for name, w in (("r", row), ("d", column)):
        p = p.withColumns({f"{c}_{name}": F.lead(c).over(w) for c in ("yy", "cb", "cr")})
    # whole numbers are added and divided once, so that no result depends on the order of addition
    far = lambda c, n: F.abs(F.col(c) - F.col(f"{c}_{n}"))
    mid = (top + 1) // 2
    p = p.withColumn("dev", F.abs(F.col("cb") - mid) + F.abs(F.col("cr") - mid))
    for n in "rd":
        p = p.withColumns({f"l_{n}": far("yy", n), f"c_{n}": far("cb", n) + far("cr", n)})
    luma, dev = F.col("yy") / float(top), F.col("dev") / (2.0 * top)
    edge = lambda k, scale: F.greatest(F.coalesce(f"{k}_r", F.lit(0)), F.coalesce(f"{k}_d", F.lit(0))) / (scale * top)
    share = lambda c: F.count_if(c) / F.count("*")
    mean = lambda k, scale: F.coalesce((F.coalesce(F.sum(f"{k}_r"), F.lit(0)) + F.coalesce(F.sum(f"{k}_d"), F.lit(0))) / F.nullif((F.count(f"{k}_r") + F.count(f"{k}_d")) * scale * top, F.lit(0.0)), F.lit(0.0))
    return p.groupBy("image_id", "tile_y", "tile_x").agg(
        (F.sum("dev") / (F.count("*") * 2.0 * top)).alias("mean_chroma_deviation"), (F.max("dev") / (2.0 * top)).alias("max_chroma_deviation"), mean("c", 2.0).alias("mean_chroma_gradient"), mean("l", 1.0).alias("mean_luma_gradient"), (F.sum("yy") / (F.count("*") * float(top))).alias("mean_luma"),
        share(luma >= 0.72).alias("bright_fraction"), share(luma <= 0.18).alias("dark_fraction"), share(dev > 0.18).alias("saturated_fraction"),
        share((dev > 0.14) & (edge("l", 1.0) > 0.08) & (edge("c", 2.0) > 0.04)).alias("strong_color_edge_fraction"), share((luma >= 0.62) & (edge("l", 1.0) > 0.08)).alias("highlight_edge_fraction"),
    )


# Weights of the scores, ladders (a score above -> what quality gains), and pairs of conditions.
DETAIL = ({"mean_chroma_deviation": 0.85, "max_chroma_deviation": 0.22, "mean_chroma_gradient": 1.2, "mean_luma_gradient": 0.55, "highlight_edge_fraction": 0.4}, 1.5, [(0.78, 2.5), (0.60, 1.5), (0.42, 0.75)])
PROTECTION = ({"mean_chroma_deviation": 0.7, "max_chroma_deviation": 0.6, "mean_chroma_gradient": 1.0, "mean_luma_gradient": 0.4, "saturated_fraction": 0.9, "strong_color_edge_fraction": 1.1, "bright_fraction": 0.55, "highlight_edge_fraction": 1.2}, 2.0, [(1.05, 8.0), (0.82, 6.0), (0.60, 4.0), (0.42, 2.5), (0.30, 1.0)])
HIGHLIGHT = ({"mean_luma": 0.4, "bright_fraction": 0.95, "mean_luma_gradient": 1.25, "highlight_edge_fraction": 1.1, "strong_color_edge_fraction": 0.75}, 1.8, [(1.15, 4.0), (0.88, 3.0), (0.68, 2.0), (0.50, 1.0)])
CHROMA_RULES = [
    ("max_chroma_deviation > 0.32 AND mean_luma_gradient > 0.09", 4.0), ("saturated_fraction > 0.12 AND mean_chroma_gradient > 0.06", 3.0), ("strong_color_edge_fraction > 0.05", 3.0),
    ("bright_fraction > 0.30 AND mean_chroma_deviation > 0.18", 4.5), ("dark_fraction > 0.22 AND mean_chroma_deviation > 0.05 AND mean_chroma_gradient > 0.02 AND mean_luma_gradient > 0.04", 2.5),
    ("mean_chroma_deviation < 0.16 AND mean_chroma_gradient > 0.03 AND mean_luma_gradient > 0.05", 1.75), ("highlight_edge_fraction > 0.05 AND mean_chroma_gradient > 0.04", 3.5),
]
LUMA_RULES = [("bright_fraction > 0.34 AND mean_luma_gradient > 0.06", 3.5), ("highlight_edge_fraction > 0.08", 2.5), ("strong_color_edge_fraction > 0.06 AND mean_luma_gradient > 0.05", 2.0)]
#: What chroma gains at once, by quality: 4:4:4 from 90, 85, 75, below; 4:2:0 always. The most each may gain: below 85, from 85.
CHROMA_BASE, CHROMA_BASE_420 = [(90, 3.0), (85, 5.0), (75, 6.0), (0, 8.0)], 4.0
MOST = {"luma": (3.0, 2.5), "444": (8.5, 7.0), "420": (10.0, 8.0)}


def _ladder(weights: dict[str, float], most: float, rungs: list[tuple[float, float]]) -> Column:
    score = clamp(reduce(lambda a, b: a + b, [F.col(n) * w for n, w in weights.items()]), 0, most)
    out = F
    for least, gain in rungs:
        out = out.when(score > least, gain)
    return out.otherwise(0.0)


def adaptive_quality(stats: DataFrame, quality: float, subsampled: bool = False) -> DataFrame:
    """stats with luma_quality and chroma_quality."""
    rules = lambda rs: [F.when(F.expr(c), g).otherwise(0.0) for c, g in rs]
    luma = F.greatest(_ladder(*HIGHLIGHT), *rules(LUMA_RULES)) * (1.10 if subsampled else 1.0)
    chroma = F.greatest(_ladder(*DETAIL), _ladder(*PROTECTION), *rules(CHROMA_RULES)) * (1.15 if subsampled else 1.0)
    base = min(100.0, quality + (CHROMA_BASE_420 if subsampled else next(g for q, g in CHROMA_BASE if quality >= q)))
    high = int(quality >= 85)
    top = lambda k: F.lit(float(quality + MOST[k][high]))
    return stats.withColumns({"luma_quality": F.least(clamp(quality + luma, 1, 100), top("luma")), "chroma_quality": F.least(clamp(base + chroma, 1, 100), top("420" if subsampled else "444"))})


# --- symbols and tables -----------------------------------------------------------------------------------------------


def cell_entropy(px: DataFrame, value: str = "g", cell: int = 16, sets: int = 12) -> DataFrame:
    """image_id, cy, cx, entropy (bits a sample), context: of sets, by the image's largest entropy."""
    key = ["image_id", F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx")]
    h = px.groupBy(*key, value).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("image_id", "cy", "cx")))
    e = h.groupBy("image_id", "cy", "cx").agg(F.sum(-(F.col("n") / F.col("all")) * F.log2(F.col("n") / F.col("all"))).alias("entropy"))
    most = F.max("entropy").over(Window.partitionBy("image_id"))
    return e.withColumn("context", F.when(most > 1e-12, F.floor(F.round(F.col("entropy") / F.when(most > 1e-12, most) * (sets - 1), 9) + 0.5)).otherwise(0).cast("int"))


def palette(px: DataFrame, most: int = 256) -> DataFrame:
    """image_id, colour, index (by first place): of images with no more than `most` colours."""
    colour = F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")
    c = px.groupBy("image_id", colour.alias("colour")).agg(F.min(F.struct("y", "x")).alias("first"))
    by = Window.partitionBy("image_id")
    c = c.withColumn("n", F.count("*").over(by)).where(F.col("n") <= most)
    return c.select("image_id", "colour", (F.row_number().over(by.orderBy("first")) - 1).alias("index"))


def indexed(px: DataFrame, colours: DataFrame) -> DataFrame:
    """px as indices into their image's palette."""
    colour = F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")
    return px.select("image_id", "y", "x", colour.alias("colour")).join(colours, ["image_id", "colour"]).select("image_id", "y", "x", "index")


def long_coefficients(blocks: DataFrame, value: str = "q") -> DataFrame:
    """block_id, k, q."""
    return blocks.select("block_id", F.posexplode(value).alias("k", "q"))


def histogram(coeffs: DataFrame, symbol: Column, by: tuple[str, ...] = ("k",)) -> DataFrame:
    return coeffs.groupBy(*by, symbol.alias("symbol")).agg(F.count("*").alias("n"))


def cumulative(freqs: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """freqs with cum, the sum of the frequencies of smaller symbols."""
    w = Window.partitionBy(*by).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return freqs.withColumn("cum", F.coalesce(F.sum("freq").over(w), F.lit(0).cast("bigint")))


def normalized(counts: DataFrame, by: tuple[str, ...] = ("k",), scale: int = SCALE) -> DataFrame:
    """counts(by, symbol, n) -> freq, adding up to scale, each 1 at least. Floors first; what is missing goes, one
    each, to the largest remainders, and what is too much is taken, one at a time, where there is most above the exact
    share, ties to the lower symbol. Taking is a loop over one table at a time, in an array."""
    w = Window.partitionBy(*by)
    c = counts.withColumn("all", F.sum("n").over(w)).withColumn("exact", F.col("n") * float(scale) / F.col("all"))
    c = c.withColumn("freq", F.greatest(F.lit(1), F.floor("exact")).cast("bigint")).withColumn("miss", F.lit(scale) - F.sum("freq").over(w))
    rank = F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("freq")), "symbol"))
    c = c.withColumn("freq", F.col("freq") + F.when((F.col("miss") > 0) & (rank <= F.col("miss")), 1).otherwise(0))
    # the tables with too much: each unit goes to the largest excess, in order; all candidate units are ranked at once
    over = c.where("miss < 0 AND freq > 1")
    units = over.withColumn("u", F.explode(F.expr("sequence(0, cast(least(freq - 2, -miss - 1) AS int))")))
    taken = units.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.col("freq") - F.col("u") - F.col("exact")), "symbol"))).where("r <= -miss")
    taken = taken.groupBy(*by, "symbol").agg(F.count("*").alias("less"))
    return c.join(taken, [*by, "symbol"], "left").select(*by, "symbol", "n", (F.col("freq") - F.coalesce("less", F.lit(0))).alias("freq"))


def slots(freqs: DataFrame, probes: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """probes(by, slot) -> the symbol whose range of cumulative frequencies holds the slot. A table's ranges are laid out
    slot by slot, no more than what its frequencies add up to, so that a probe meets one row."""
    table = cumulative(freqs, by).select(*by, "symbol", "freq", "cum").where("freq > 0")
    laid = table.withColumn("slot", F.explode(F.sequence(F.col("cum"), F.col("cum") + F.col("freq") - 1)))
    return probes.withColumn("slot", F.col("slot").cast("bigint")).join(laid, [*by, "slot"])


def unsupported(counts: DataFrame, freqs: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """Counted symbols that a table has no frequency for."""
    return counts.where("n > 0").join(freqs.where("freq > 0"), [*by, "symbol"], "left_anti")


def table_distances(freqs: DataFrame, key: str = "k") -> DataFrame:
    """Each pair of tables (k1 < k2) with the sum of the differences of their frequencies. A corpus has one table for
    each of 64 ranks, so pairs are bounded."""
    f = freqs.select(F.col(key).alias("k"), "symbol", "freq")
    all_ = f.select("k").distinct()
    pairs = all_.select(F.col("k").alias("k1")).join(all_.select(F.col("k").alias("k2")), F.col("k1") < F.col("k2"))
    one = pairs.join(f, F.col("k1") == F.col("k")).select("k1", "k2", "symbol", F.col("freq").alias("d"))
    two = pairs.join(f, F.col("k2") == F.col("k")).select("k1", "k2", "symbol", (-F.col("freq")).alias("d"))
    return one.union(two).groupBy("k1", "k2", "symbol").agg(F.sum("d").alias("d")).groupBy("k1", "k2").agg(F.sum(F.abs("d")).alias("distance"))


def nearest_tables(distances: DataFrame, n: int = 8) -> DataFrame:
    """For each table the n nearest others, by distance and number; equal tables don't count."""
    both = distances.select("k1", "k2", "distance").union(distances.select("k2", "k1", "distance")).where("distance > 0")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("k1").orderBy("distance", "k2"))).where(F.col("rank") <= n)


#: Table encodings in the order they are tried: name and payload bytes.
ENCODINGS = ("single", "dense16", "sparse16", "dense8", "sparse8", "reuse", "delta8")


def table_sizes(freqs: DataFrame, key: str = "k") -> DataFrame:
    """For each table (in order of key): bytes that each encoding takes (null where it can't be used), and the
    choice: reuse, then single, then the smallest, ties to the first in order."""
    f = freqs.where("freq > 0").select(F.col(key).alias("k"), "symbol", "freq")
    shape = f.groupBy("k").agg(F.count("*").alias("n"), (F.max("symbol") - F.min("symbol") + 1).alias("w"), F.max("freq").alias("most"))
    order = shape.select("k", F.lag("k").over(Window.orderBy("k")).alias("before"))  # at most 64 tables
    here = order.join(f, "k").select("k", "symbol", F.col("freq").alias("d"))
    there = order.where("before IS NOT NULL").select(F.col("k").alias("k2"), "before").join(f, F.col("before") == F.col("k")).select(F.col("k2").alias("k"), "symbol", (-F.col("freq")).alias("d"))
    delta = here.union(there).groupBy("k", "symbol").agg(F.sum("d").alias("d")).where("d <> 0")
    delta = delta.groupBy("k").agg(F.count("*").alias("changed"), F.min("d").alias("low"), F.max("d").alias("high"))
    t = shape.join(order, "k").join(delta, "k", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    had = F.col("before").isNotNull()
    size = {
        "dense16": 4 + 2 * F.col("w"), "sparse16": 2 + 4 * F.col("n"), "dense8": F.when(F.col("most") <= 255, 4 + F.col("w")), "sparse8": F.when(F.col("most") <= 255, 2 + 3 * F.col("n")),
        "delta8": F.when(had & (F.col("changed") > 0) & (F.col("low") >= -128) & (F.col("high") <= 127), 2 + 3 * F.col("changed")),
    }
    names = ["dense16", "sparse16", "dense8", "sparse8", "delta8"]
    best = F.array_min(F.filter(F.array(*[F.struct(size[n].cast("bigint").alias("bytes"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)]), lambda x: x["bytes"].isNotNull()))
    reuse, single = had & (F.col("changed") == 0), F.col("n") == 1
    choice = F.when(reuse, "reuse").when(single, "single").otherwise(best["name"])
    return t.select("k", "n", "w", *[size[n].cast("bigint").alias(n) for n in names], choice.alias("choice"), F.when(reuse, 0).when(single, 2).otherwise(best["bytes"]).cast("bigint").alias("bytes"))


def bank_sizes(sizes: Column, distinct: Column, inline: Column, tables: Column) -> Column:
    """struct(bytes, mode): the smallest way to write `tables` tables, `distinct` of them different, of sizes bytes
    together, or `inline` bytes if each is written; a later mode must be smaller."""
    width = lambda bits: F.ceil(bits * tables / 8)
    ways = [("inline", F.lit(True), 1 + inline), ("single", distinct == 1, 1 + sizes), ("index1", distinct <= 2, 2 + sizes + width(1)), ("index2", distinct <= 4, 2 + sizes + width(2)), ("index4", distinct <= 16, 2 + sizes + width(4)), ("index8", distinct <= 255, 2 + sizes + tables)]
    return F.array_min(F.filter(F.array(*[F.struct(F.when(ok, b).cast("bigint").alias("bytes"), F.lit(i).alias("i"), F.lit(n).alias("mode")) for i, (n, ok, b) in enumerate(ways)]), lambda x: x["bytes"].isNotNull()))


# --- runs and bits ----------------------------------------------------------------------------------------------------


def runs(rows: DataFrame, by: str, order: str, value: str, longest: int = 65535) -> DataFrame:
    """by, run (from 0), value, length: runs of equal values in order, none longer than `longest`."""
    w = Window.partitionBy(by).orderBy(order)
    r = rows.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    r = r.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy(by, "_run").orderBy(order)) - 1) / longest))
    out = r.groupBy(by, "_run", "_part", F.col(value).alias("value")).agg(F.count("*").alias("length"))
    return out.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("_run", "_part")) - 1).alias("run"), "value", "length")


def unrun(rows: DataFrame, by: str) -> DataFrame:
    """runs undone: by, n (from 0), value."""
    r = rows.select(by, "run", "value", F.explode(F.expr("sequence(1, cast(length AS int))")).alias("i"))
    return r.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("run", "i")) - 1).alias("n"), "value")


def packed_bits(rows: DataFrame, by: str, place: str, value: str, width: int = 1) -> DataFrame:
    """by, byte, bits: numbers of `width` bits, the first in the lowest bits of its byte."""
    each = 8 // width
    shifted = F.col(value).cast("int") * F.pow(F.lit(2), (F.col(place) % each) * width).cast("int")
    return rows.groupBy(by, F.floor(F.col(place) / each).cast("int").alias("byte")).agg(F.sum(shifted).cast("int").alias("bits"))


def unpacked_bits(rows: DataFrame, by: str, width: int = 1) -> DataFrame:
    each = 8 // width
    out = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    return out.select(by, (F.col("byte") * each + F.col("i")).alias("place"), (F.floor(F.col("bits") / F.pow(F.lit(2), F.col("i") * width)).cast("int") % (1 << width)).alias("value"))


def span_stream_bytes(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, legacy, adaptive, mode: bytes of a stream of spans of 7 bits, raw, as one value, or as runs."""
    s = rows.groupBy(by).agg(F.count("*").alias("m"), (F.min(value) == F.max(value)).alias("same"))
    n = runs(rows, by, order, value).groupBy(by).agg(F.count("*").alias("runs"))
    raw = (2 + F.ceil(7 * F.col("m") / 8)).cast("bigint")
    rle = 2 + 3 * F.col("runs")
    t = s.join(n, by)
    return t.select(by, raw.alias("legacy"), F.when(F.col("same"), 2).when(rle < raw, rle).otherwise(raw).cast("bigint").alias("adaptive"), F.when(F.col("same"), "single").when(rle < raw, "runs").otherwise("raw").alias("mode"))


def all_same(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg((F.min(value) == F.max(value)).alias("same"), F.min(F.col(value) != 0).alias("all_set"), F.max(F.col(value) != 0).alias("any_set"))


