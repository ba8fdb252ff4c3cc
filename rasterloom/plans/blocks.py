"""Block transform, prediction and resampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import BLK, CELL, PX, blocks, pixels
from ..functions import quality as Q
from ..operators import blocks as B
from ..schemas import ZIGZAG
from . import query


def _long(df: DataFrame, column: str, name: str, places: int | None = None) -> DataFrame:
    out = df.select("block_id", F.posexplode(column).alias("pos", name))
    return out if places is None else out.withColumn(name, F.round(name, places))


def _list(xs: list) -> str:
    return "[" + ", ".join(str(x) for x in xs) + "]"


@query("blk1_tile_split", f"WITH {PX} SELECT image_id, x // 10 AS tile_x, y // 10 AS tile_y, max(x) % 10 + 1 AS width, max(y) % 10 + 1 AS height FROM px GROUP BY ALL")
def tile_split(spark, d):
    return B.tile_grid(pixels(spark, d), 10)


@query("blk2_block_split", f"WITH {PX}, g AS (SELECT DISTINCT image_id, y // 8 AS \"by\", x // 8 AS bx FROM px) SELECT g.image_id, \"by\", bx, CAST(p AS INTEGER) AS pos, coalesce(px.g, 0) AS v FROM g CROSS JOIN range(0, 64) t(p) LEFT JOIN px ON px.image_id = g.image_id AND px.y = \"by\" * 8 + p // 8 AND px.x = bx * 8 + p % 8")
def block_split(spark, d):
    b = B.split_blocks(pixels(spark, d), "g")
    return b.select("image_id", "by", "bx", F.posexplode("v").alias("pos", "v"))


@query("jn3_tile_overlay", f"WITH {PX} SELECT image_id, y, x, g FROM px")
def tile_overlay(spark, d):
    """Blocks are padded; what takes part in the overlay is the image's own places, partial or not."""
    px = pixels(spark, d)
    return B.join_blocks(B.split_blocks(px, "g"), "g").join(px.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")


_BASIS = "bs AS (SELECT CAST(u AS INTEGER) AS u, CAST(n AS INTEGER) AS n, CASE WHEN u = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5::DOUBLE END * cos(pi() * (2 * n + 1) * u / 16) AS w FROM range(0, 8) a(u), range(0, 8) b(n))"
_DCT = f"{CELL}, {_BASIS}, f AS (SELECT block_id, a.u * 8 + b.u AS pos, sum(s * a.w * b.w) AS f FROM cell JOIN bs a ON a.n = pos // 8 JOIN bs b ON b.n = pos % 8 GROUP BY ALL)"


@query("blk3_dct", f"WITH {_DCT} SELECT block_id, pos, round(f, 4) + 0.0 AS f FROM f")
def dct(spark, d):
    return _long(blocks(spark, d).select("block_id", B.dct(F.col("v")).alias("f")), "f", "f", 4).withColumn("f", F.col("f") + 0.0)


@query("blk4_idct", f"WITH {_DCT} SELECT block_id, pos, round(CAST(s AS DOUBLE), 4) AS s FROM cell")
def idct(spark, d):
    f = blocks(spark, d).select("block_id", B.idct(B.dct(F.col("v"))).alias("s"))
    return _long(f, "s", "s", 4)


@query("blk5_dct_samples", f"WITH {CELL} SELECT block_id, pos, s FROM cell")
def dct_samples(spark, d):
    return _long(blocks(spark, d).select("block_id", B.dct_to_samples(B.dct(F.col("v"))).alias("s")), "s", "s")


@query("prj17_zigzag", f"WITH {BLK}, z AS (SELECT block_id, list_transform({_list(ZIGZAG)}, lambda k: v[k + 1]) AS z, v FROM bl) SELECT block_id, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, unnest(z) AS z, unnest(v) AS back FROM z")
def zigzag(spark, d):
    z = blocks(spark, d).select("block_id", B.zigzag(F.col("v")).alias("z"))
    both = z.select("block_id", F.arrays_zip("z", B.unzigzag(F.col("z")).alias("back")).alias("p"))
    return both.select("block_id", F.posexplode("p").alias("pos", "p")).select("block_id", "pos", F.col("p.z").alias("z"), F.col("p.back").alias("back"))


def _quant_sql(quality: float, chroma: bool) -> str:
    s, z = Q.steps(quality, chroma), Q.dead_zones(quality, chroma)
    return f"""WITH {CELL}, k AS (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS k, unnest({_list(ZIGZAG)}) AS pos, unnest({_list(s)}) AS step, unnest([{', '.join(f'{x!r}::DOUBLE' for x in z)}]) AS zone),
    c AS (SELECT block_id, k, step, zone, (s - 128) * 1.37::DOUBLE AS v FROM cell JOIN k USING (pos)),
    q AS (SELECT *, CAST(least(greatest(CASE WHEN abs(v) < step * zone THEN 0 ELSE sign(v) * floor(abs(v) / step + 0.5::DOUBLE) END, -1024), 1024) AS INTEGER) AS q FROM c)"""


def _quantized(spark, d, quality: float, chroma: bool) -> DataFrame:
    f = F.transform("v", lambda x: (x - 128) * 1.37)
    return blocks(spark, d).select("block_id", B.quantized(f, Q.steps(quality, chroma), Q.dead_zones(quality, chroma)).alias("q"))


for _q, _chroma, _name in ((75.0, False, "prj18_quantize"), (90.0, True, "prj18_quantize_chroma"), (30.0, False, "prj18_quantize_low")):

    @query(_name, f"{_quant_sql(_q, _chroma)} SELECT block_id, k, q FROM q")
    def quantize(spark, d, q=_q, chroma=_chroma):
        return _quantized(spark, d, q, chroma).select("block_id", F.posexplode("q").alias("k", "q"))


@query("prj19_dequantize", f"{_quant_sql(75.0, False)} SELECT block_id, pos, CAST(q * step AS DOUBLE) AS f FROM q JOIN k USING (k, step, zone)")
def dequantize(spark, d):
    return _long(_quantized(spark, d, 75.0, False).select("block_id", B.dequantized(F.col("q"), Q.steps(75.0)).alias("f")), "f", "f")


@query("agg11_span", f"{_quant_sql(75.0, False)} SELECT block_id, CAST(coalesce(max(CASE WHEN q <> 0 THEN k + 1 END), 0) AS INTEGER) AS span FROM q GROUP BY block_id")
def span(spark, d):
    return _quantized(spark, d, 75.0, False).select("block_id", B.span(F.col("q")).alias("span"))


@query("agg12_plane_extent", f"{_quant_sql(75.0, False)}, s AS (SELECT block_id, CAST(coalesce(max(CASE WHEN q <> 0 THEN k + 1 END), 0) AS INTEGER) AS span FROM q GROUP BY block_id) SELECT block_id // 64 AS plane, max(span) AS extent FROM s GROUP BY 1")
def plane_extent(spark, d):
    s = _quantized(spark, d, 75.0, False).select(F.floor(F.col("block_id") / 64).alias("plane"), B.span(F.col("q")).alias("span"))
    return s.groupBy("plane").agg(F.max("span").alias("extent"))


@query("flt3_active_coefficients", f"{_quant_sql(75.0, False)}, s AS (SELECT block_id, coalesce(max(CASE WHEN q <> 0 THEN k + 1 END), 0) AS span FROM q GROUP BY block_id) SELECT block_id, k, q FROM q JOIN s USING (block_id) WHERE span > k")
def active_coefficients(spark, d):
    b = _quantized(spark, d, 75.0, False).withColumn("span", B.span(F.col("q")))
    return b.select("block_id", "span", F.posexplode("q").alias("k", "q")).where("span > k").drop("span")


@query("flt4_nonzero_coefficients", f"{_quant_sql(75.0, False)} SELECT block_id, k, q FROM q WHERE q <> 0")
def nonzero_coefficients(spark, d):
    return _quantized(spark, d, 75.0, False).select("block_id", F.posexplode("q").alias("k", "q")).where("q <> 0")


@query("agg13_ssd_bits", f"WITH {CELL}, r AS (SELECT block_id, s - 128 AS r FROM cell) SELECT block_id, CAST(sum(r * r) AS BIGINT) AS ssd, round(5 + sum(CASE WHEN r <> 0 THEN log2(abs(r) + 1.0::DOUBLE) + 1 ELSE 0 END), 4) AS bits FROM r GROUP BY block_id")
def ssd_bits(spark, d):
    r = F.transform("v", lambda x: x - 128)
    return blocks(spark, d).select("block_id", B.ssd(F.col("v"), F.array_repeat(F.lit(128), 64)).alias("ssd"), F.round(B.bit_estimate(r), 4).alias("bits"))


# --- prediction: the neighbours are the first samples of a block ------------------------------------------------------

_EDGES = f"{BLK}, e AS (SELECT block_id, v[1:8] AS a, v[9:16] AS l, v[17] AS tl FROM bl), p AS (SELECT e.*, CAST(pos AS INTEGER) AS pos, CAST(pos // 8 AS INTEGER) AS r, CAST(pos % 8 AS INTEGER) AS c FROM e, range(0, 64) t(pos))"
_D117 = "CASE WHEN {c} - {r} // 2 < 0 THEN {s}[least({r} + 2 * ({r} // 2 - {c} - 1), 7) + 1] WHEN {r} % 2 = 1 THEN ({m}[greatest({c} - {r} // 2 - 1, 0) + 1] + {m}[{c} - {r} // 2 + 1] + 1) // 2 ELSE {m}[{c} - {r} // 2 + 1] END"
_D207 = "CASE WHEN {r} + {c} // 2 >= 8 THEN {m}[8] WHEN {c} % 2 = 1 THEN ({m}[{r} + {c} // 2 + 1] + {m}[least({r} + {c} // 2 + 1, 7) + 1] + 1) // 2 ELSE {m}[{r} + {c} // 2 + 1] END"
_MODE_SQL = {
    "DC": "(list_sum(a) + list_sum(l) + 8) // 16", "V": "a[c + 1]", "H": "l[r + 1]", "TM": "least(greatest(l[r + 1] + a[c + 1] - tl, 0), 255)", "DC_LEFT": "(list_sum(l) + 4) // 8", "DC_TOP": "(list_sum(a) + 4) // 8",
    "DC_128": "128", "D45": "a[least(c + r + 1, 7) + 1]", "D135": "CASE WHEN c > r THEN a[c - r] WHEN c = r THEN tl ELSE l[r - c] END",
    "D117": _D117.format(r="r", c="c", m="a", s="l"), "D153": _D117.format(r="c", c="r", m="l", s="a"), "D207": _D207.format(r="r", c="c", m="l"), "D63": _D207.format(r="c", c="r", m="a"),
}


def _edges(spark, d) -> DataFrame:
    v = F.col("v")
    return blocks(spark, d).select("block_id", F.slice(v, 1, 8).alias("above"), F.slice(v, 9, 8).alias("left"), F.get(v, F.lit(16)).alias("corner"))


@query("blk6_predict", f"WITH {_EDGES} " + " UNION ALL ".join(f"SELECT block_id, '{m}' AS mode, pos, CAST({sql} AS INTEGER) AS p FROM p" for m, sql in _MODE_SQL.items()))
def predict(spark, d):
    e = _edges(spark, d)
    each = F.array(*[F.struct(F.lit(m).alias("mode"), B.predict(m, F.col("above"), F.col("left"), F.col("corner")).alias("p")) for m in B.MODES])
    return e.select("block_id", F.explode(each).alias("m")).select("block_id", "m.mode", F.posexplode("m.p").alias("pos", "p"))


@query(
    "blk7_neighbour_mode",
    f"""WITH {BLK}, e AS (SELECT block_id, v[1:8] AS a, v[9:16] AS l, v[17] AS tl FROM bl),
    m AS (SELECT block_id, abs((list_sum(a) + 4) // 8 - (list_sum(l) + 4) // 8) AS apart, abs(a[1] - tl) + abs(l[1] - tl) AS bend, list_sum(list_transform(range(2, 9), lambda i: abs(a[i] - a[i - 1]))) AS va, list_sum(list_transform(range(2, 9), lambda i: abs(l[i] - l[i - 1]))) AS vl FROM e)
    SELECT block_id, CASE WHEN apart <= 6 AND bend <= 12 AND va <= 20 AND vl <= 20 THEN 'TM' WHEN va + 2 * apart < vl THEN 'V' WHEN vl + 2 * apart < va THEN 'H' WHEN apart <= 12 AND bend <= 20 THEN 'TM' ELSE 'DC' END AS mode FROM m""",
)
def neighbour_mode(spark, d):
    return _edges(spark, d).select("block_id", B.neighbour_mode(F.col("above"), F.col("left"), F.col("corner")).alias("mode"))


@query(
    "top1_best_mode",
    f"""WITH {_EDGES}, o AS (SELECT block_id, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, unnest(v) AS s FROM bl),
    m AS ({' UNION ALL '.join(f"SELECT block_id, {i} AS mode, pos, {_MODE_SQL[m]} AS p FROM p" for i, m in enumerate(B.MODES))}),
    c AS (SELECT block_id, mode, round(CAST(sum((s - p) * (s - p)) AS DOUBLE) + 3.5::DOUBLE * (5 + sum(CASE WHEN s <> p THEN log2(abs(s - p) + 1.0::DOUBLE) + 1 ELSE 0 END)), 3) AS cost FROM m JOIN o USING (block_id, pos) GROUP BY ALL)
    SELECT block_id, CAST(arg_min(mode, cost * 100 + mode / 1000.0::DOUBLE) AS INTEGER) AS mode, min(cost) AS cost FROM c GROUP BY block_id""",
)
def best_mode(spark, d):
    b = blocks(spark, d).join(_edges(spark, d), "block_id")
    return B.best_mode(b, 3.5).select("block_id", "mode", F.round("cost", 3).alias("cost"))


# --- resampling -------------------------------------------------------------------------------------------------------


#: All images as whole rectangles, a partial one filled up with 0.
_WHOLE = f"""{PX}, pl AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM px GROUP BY 1),
q AS (SELECT pl.image_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, coalesce(px.g, 0) AS v FROM pl CROSS JOIN range(0, 16) a(yy) CROSS JOIN range(0, 16) b(xx) LEFT JOIN px ON px.image_id = pl.image_id AND px.y = yy AND px.x = xx WHERE yy <= my AND xx <= mx)"""


def _green(spark, d) -> DataFrame:
    return pixels(spark, d).select("image_id", "y", "x", F.col("g").alias("v"))


def _whole(spark, d) -> DataFrame:
    return B.completed(_green(spark, d))


@query("blk8_subsample", f"WITH {_WHOLE}, o AS (SELECT * FROM q UNION ALL SELECT -1 - image_id, y, x, v FROM q WHERE y < 15 AND x < 15), s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM o GROUP BY 1), p AS (SELECT o.*, CASE WHEN x = w - 1 AND w % 2 = 1 THEN 2 ELSE 1 END * CASE WHEN y = h - 1 AND h % 2 = 1 THEN 2 ELSE 1 END AS n FROM o JOIN s USING (image_id)) SELECT image_id, y // 2 AS y, x // 2 AS x, CAST((sum(v * n) + 2) // 4 AS INTEGER) AS v FROM p GROUP BY ALL")
def subsample(spark, d):
    """Whole images, and each without its last row and column, under a negative id, for odd sizes."""
    px = _whole(spark, d)
    odd = px.where("y < 15 AND x < 15").withColumn("image_id", -1 - F.col("image_id"))
    return B.halve(px.unionByName(odd))


def _bilinear_sql(w2: str, h2: str) -> str:
    src = lambda at, n, n2: f"least(greatest(({at} + 0.5::DOUBLE) * {n} / {n2} - 0.5::DOUBLE, 0), {n} - 1)"
    return f"""t AS (SELECT image_id, w, h, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, {src('xx', 'w', w2)} AS sx, {src('yy', 'h', h2)} AS sy FROM s, range(0, 64) a(yy), range(0, 64) b(xx) WHERE yy < {h2} AND xx < {w2}),
    u AS (SELECT *, CAST(floor(sx) AS INTEGER) AS x0, CAST(floor(sy) AS INTEGER) AS y0 FROM t), k AS (SELECT *, sx - x0 AS tx, sy - y0 AS ty, least(x0 + 1, w - 1) AS x1, least(y0 + 1, h - 1) AS y1 FROM u)
    SELECT k.image_id, k.y, k.x, CAST(round(round(a.v * (1 - tx) * (1 - ty) + b.v * tx * (1 - ty) + c.v * (1 - tx) * ty + e.v * tx * ty, 9)) AS INTEGER) AS v FROM k
    JOIN q a ON a.image_id = k.image_id AND a.y = y0 AND a.x = x0 JOIN q b ON b.image_id = k.image_id AND b.y = y0 AND b.x = x1 JOIN q c ON c.image_id = k.image_id AND c.y = y1 AND c.x = x0 JOIN q e ON e.image_id = k.image_id AND e.y = y1 AND e.x = x1"""


_HALF = f"{_WHOLE}, s AS (SELECT image_id, CAST(max(x) + 1 AS DOUBLE) AS w, CAST(max(y) + 1 AS DOUBLE) AS h FROM q GROUP BY 1)"


@query("blk9_upsample", f"WITH {_HALF}, {_bilinear_sql('32', '32')}")
def upsample(spark, d):
    return B.double(_green(spark, d), (32, 32))


@query("blk10_resize_bilinear", f"WITH {_HALF}, {_bilinear_sql('11', '7')}")
def resize_bilinear(spark, d):
    return B.resample(_green(spark, d), (11, 7), ["v"])


@query("blk10_resize_nearest", f"WITH {_HALF}, t AS (SELECT image_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, CAST(round(least(greatest((xx + 0.5::DOUBLE) * w / 40 - 0.5::DOUBLE, 0), w - 1)) AS INTEGER) AS fx, CAST(round(least(greatest((yy + 0.5::DOUBLE) * h / 24 - 0.5::DOUBLE, 0), h - 1)) AS INTEGER) AS fy FROM s, range(0, 24) a(yy), range(0, 40) b(xx)) SELECT t.image_id, t.y, t.x, q.v FROM t JOIN q ON q.image_id = t.image_id AND q.y = fy AND q.x = fx")
def resize_nearest(spark, d):
    return B.resample(_green(spark, d), (40, 24), ["v"], smooth=False)


# --- lossless prediction ----------------------------------------------------------------------------------------------

_LN = """n AS (SELECT image_id, y, x, g AS v, coalesce(lag(g) OVER r, 0) AS l, lag(g) OVER r AS lt, lead(g) OVER r AS rt, coalesce(lag(g) OVER c, 0) AS t FROM px WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
o AS (SELECT image_id, y, x, v, l, t, coalesce(lag(lt) OVER c, 0) AS tl, coalesce(lag(rt) OVER c, t) AS tr FROM n WINDOW c AS (PARTITION BY image_id, x ORDER BY y))"""
_SELECT = "CASE WHEN abs(t - tl) <= abs(l - tl) AND abs(t - tl) <= abs(l + t - 2 * tl) THEN l WHEN abs(l - tl) <= abs(l + t - 2 * tl) THEN t ELSE tl END"
_PREDICTORS = {
    "NONE": "0", "L": "l", "T": "t", "TR": "tr", "TL": "tl", "AVG_LT": "(l + t + 1) // 2", "AVG_LTR": "(l + t + tr + 1) // 3", "AVG_LTL": "(l + tl + 1) // 2", "AVG_TTR": "(t + tr + 1) // 2", "AVG_TTL": "(t + tl + 1) // 2",
    "AVG_LTRTL": "(l + t + tr + tl + 2) // 4", "SELECT": _SELECT, "CLAMP_ADD": "least(greatest(l + t - tl, 0), 255)",
}


@query("blk16_predictors", f"WITH {PX}, {_LN} SELECT image_id, y, x, {', '.join(f'CAST({sql} AS INTEGER) AS {n.lower()}' for n, sql in _PREDICTORS.items())} FROM o")
def predictors(spark, d):
    p = B.with_neighbours(pixels(spark, d), "g")
    near = [F.col(c) for c in ("l", "t", "tr", "tl")]
    return p.select("image_id", "y", "x", *[B.predicted(n, *near).cast("int").alias(n.lower()) for n in B.PREDICTORS])


@query("win5_lossless_residual", f"WITH {PX}, {_LN} SELECT image_id, y, x, CAST((v - ({_SELECT}) + 256) % 256 AS INTEGER) AS residual FROM o")
def lossless_residual(spark, d):
    return B.residuals(pixels(spark, d), "g").select("image_id", "y", "x", "residual")
