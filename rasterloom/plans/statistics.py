"""Statistics, table and bit-packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import BLK, PX, blocks, pixels, table, ycc_sql
from ..functions.colour import rgb_to_ycbcr
from ..operators import statistics as S
from ..operators.order import numbered
from . import query

_Y, _CB, _CR = (f"CAST(round({e}) AS INTEGER)" for e in ycc_sql())


def _planes(spark, d) -> DataFrame:
    out = rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, d).select("image_id", "y", "x", *[c.alias(n) for c, n in zip(out, ("yy", "cb", "cr"), strict=True)])


_M = "255.0::DOUBLE"
_TILES = f"""pl AS (SELECT image_id, y // 8 AS tile_y, x // 8 AS tile_x, y, x, {_Y} AS yy, {_CB} AS cb, {_CR} AS cr FROM px),
nx AS (SELECT *, abs(yy - lead(yy) OVER r) AS lr, abs(yy - lead(yy) OVER c) AS ld, abs(cb - lead(cb) OVER r) + abs(cr - lead(cr) OVER r) AS cr_, abs(cb - lead(cb) OVER c) + abs(cr - lead(cr) OVER c) AS cd,
  abs(cb - 128) + abs(cr - 128) AS dv FROM pl WINDOW r AS (PARTITION BY image_id, tile_y, tile_x, y ORDER BY x), c AS (PARTITION BY image_id, tile_y, tile_x, x ORDER BY y)),
el AS (SELECT *, dv / 510.0::DOUBLE AS dev, yy / {_M} AS luma, greatest(coalesce(lr, 0), coalesce(ld, 0)) / {_M} AS le, greatest(coalesce(cr_, 0), coalesce(cd, 0)) / 510.0::DOUBLE AS ce FROM nx),
tl AS (SELECT image_id, tile_y, tile_x, CAST(sum(dv) AS DOUBLE) / (count(*) * 510.0::DOUBLE) AS mean_chroma_deviation, max(dv) / 510.0::DOUBLE AS max_chroma_deviation,
  coalesce(CAST(coalesce(sum(cr_), 0) + coalesce(sum(cd), 0) AS DOUBLE) / nullif((count(cr_) + count(cd)) * 510.0::DOUBLE, 0), 0) AS mean_chroma_gradient,
  coalesce(CAST(coalesce(sum(lr), 0) + coalesce(sum(ld), 0) AS DOUBLE) / nullif((count(lr) + count(ld)) * {_M}, 0), 0) AS mean_luma_gradient, CAST(sum(yy) AS DOUBLE) / (count(*) * {_M}) AS mean_luma,
  {', '.join(f"CAST(count(*) FILTER ({c}) AS DOUBLE) / count(*) AS {n}" for c, n in (("luma >= 0.72", "bright_fraction"), ("luma <= 0.18", "dark_fraction"), ("dev > 0.18", "saturated_fraction"), ("dev > 0.14 AND le > 0.08 AND ce > 0.04", "strong_color_edge_fraction"), ("luma >= 0.62 AND le > 0.08", "highlight_edge_fraction")))}
  FROM el GROUP BY ALL)"""


@query("agg6_tile_complexity", f"WITH {PX}, {_TILES} SELECT * FROM tl")
def tile_complexity(spark, d):
    return S.tile_complexity(_planes(spark, d), 8)


def _ladder_sql(weights: dict, most: float, rungs: list) -> str:
    score = f"least(greatest({' + '.join(f'{n} * {w}::DOUBLE' for n, w in weights.items())}, 0), {most})"
    return "CASE " + " ".join(f"WHEN {score} > {a} THEN {b}" for a, b in rungs) + " ELSE 0.0 END"


def _rules_sql(rules: list) -> str:
    return ", ".join(f"CASE WHEN {c} THEN {g} ELSE 0.0 END" for c, g in rules)


@query(
    "prj25_adaptive_quality",
    f"""WITH {PX}, {_TILES}, rt AS (SELECT * FROM tl)
    SELECT image_id, tile_y, tile_x, round(CAST(least(least(greatest(75 + greatest({_ladder_sql(*S.HIGHLIGHT)}, {_rules_sql(S.LUMA_RULES)}), 1), 100), 78.0) AS DOUBLE), 3) AS luma_quality,
    round(CAST(least(least(greatest(81 + greatest({_ladder_sql(*S.DETAIL)}, {_ladder_sql(*S.PROTECTION)}, {_rules_sql(S.CHROMA_RULES)}), 1), 100), 83.5) AS DOUBLE), 3) AS chroma_quality FROM rt""",
)
def adaptive_quality(spark, d):
    return S.adaptive_quality(S.tile_complexity(_planes(spark, d), 8), 75.0).select("image_id", "tile_y", "tile_x", F.round("luma_quality", 3).alias("luma_quality"), F.round("chroma_quality", 3).alias("chroma_quality"))


@query("agg17_average_tile_score", f"WITH {PX}, t AS (SELECT image_id, y // 8 AS ty, x // 8 AS tx, CAST(sum((g - (g // 8) * 8) * (g - (g // 8) * 8)) AS DOUBLE) / count(*) AS mse FROM px GROUP BY ALL) SELECT image_id, round(avg(CASE WHEN mse < 1e-10 THEN 100.0::DOUBLE ELSE least(greatest((10 * log10(65025.0::DOUBLE / mse) - 20) * 2.5::DOUBLE, 0), 100) END), 5) AS score FROM t GROUP BY 1")
def average_tile_score(spark, d):
    from ..functions.quality import tile_score

    e = F.col("g") - F.floor(F.col("g") / 8) * 8
    t = pixels(spark, d).groupBy("image_id", F.floor(F.col("y") / 8), F.floor(F.col("x") / 8)).agg((F.sum(e * e) / F.count("*")).alias("mse"))
    return t.groupBy("image_id").agg(F.round(F.avg(tile_score(F.col("mse"))), 5).alias("score"))


# --- symbols: the embeddings' blocks, as coefficients around 0 ---------------------------------------------------------

_Q = f"{BLK}, cf AS (SELECT block_id, CAST(unnest(range(0, 64)) AS INTEGER) AS k, CAST(trunc((unnest(v) - 128) / 6.0::DOUBLE) AS INTEGER) AS q FROM bl)"
_H = f"{_Q}, h AS (SELECT k, CAST(least(greatest(q + 1024, 0), 2048) AS INTEGER) AS symbol, count(*) AS n FROM cf GROUP BY ALL)"


def _coeffs(spark, d) -> DataFrame:
    b = blocks(spark, d).select("block_id", F.transform("v", lambda x: ((x - 128) / 6.0).cast("int")).alias("q"))
    return S.long_coefficients(b)


def _hist(spark, d) -> DataFrame:
    from ..functions.quality import signed_symbol

    return S.histogram(_coeffs(spark, d), signed_symbol(F.col("q")))


@query("agg7_symbol_histogram", f"WITH {_H} SELECT * FROM h")
def symbol_histogram(spark, d):
    return _hist(spark, d)


_NORM = f"""{_H}, ex AS (SELECT *, n * 4096.0::DOUBLE / sum(n) OVER (PARTITION BY k) AS exact FROM h), fl AS (SELECT *, greatest(1, CAST(floor(exact) AS BIGINT)) AS f0 FROM ex),
ms AS (SELECT *, 4096 - sum(f0) OVER (PARTITION BY k) AS miss, row_number() OVER (PARTITION BY k ORDER BY exact - f0 DESC, symbol) AS rk FROM fl),
up AS (SELECT k, symbol, n, exact, miss, f0 + CASE WHEN miss > 0 AND rk <= miss THEN 1 ELSE 0 END AS f1 FROM ms),
un AS (SELECT k, symbol, u, row_number() OVER (PARTITION BY k ORDER BY f1 - u - exact DESC, symbol) AS r, miss FROM up, range(0, 4096) t(u) WHERE miss < 0 AND f1 > 1 AND u <= least(f1 - 2, -miss - 1)),
tk AS (SELECT k, symbol, count(*) AS less FROM un WHERE r <= -miss GROUP BY ALL),
nf AS (SELECT k, symbol, n, CAST(f1 - coalesce(less, 0) AS BIGINT) AS freq FROM up LEFT JOIN tk USING (k, symbol))"""


@query("agg19_normalized_frequencies", f"WITH {_NORM} SELECT * FROM nf")
def normalized_frequencies(spark, d):
    return S.normalized(_hist(spark, d))


@query("win2_cumulative_frequency", f"WITH {_NORM} SELECT k, symbol, n, freq, CAST(coalesce(sum(freq) OVER (PARTITION BY k ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM nf")
def cumulative_frequency(spark, d):
    return S.cumulative(S.normalized(_hist(spark, d)))


@query("jn6_slot_lookup", f"WITH {_NORM}, c AS (SELECT k, symbol, freq, CAST(coalesce(sum(freq) OVER (PARTITION BY k ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM nf), p AS (SELECT CAST(event_id % 64 AS INTEGER) AS k, (user_id * 131) % 4096 AS slot, event_id FROM events) SELECT event_id, k, slot, symbol, freq, cum FROM p JOIN c USING (k) WHERE slot >= cum AND slot < cum + freq")
def slot_lookup(spark, d):
    p = table(spark, d, "events").select((F.col("event_id") % 64).cast("int").alias("k"), ((F.col("user_id") * 131) % 4096).alias("slot"), "event_id")
    return S.slots(S.normalized(_hist(spark, d)), p).select("event_id", "k", "slot", "symbol", "freq", "cum")


@query("ent1_rans_table", f"WITH {_NORM} SELECT k, CAST(sum(freq) AS BIGINT) AS total, min(freq) AS least, count(*) AS symbols FROM nf GROUP BY k")
def rans_table(spark, d):
    return S.normalized(_hist(spark, d)).groupBy("k").agg(F.sum("freq").alias("total"), F.min("freq").alias("least"), F.count("*").alias("symbols"))


@query("flt9_table_support", f"WITH {_H}, b AS (SELECT DISTINCT k, symbol FROM h WHERE symbol % 3 <> 0) SELECT h.k, h.symbol, h.n FROM h ANTI JOIN b USING (k, symbol)")
def table_support(spark, d):
    h = _hist(spark, d)
    return S.unsupported(h, h.where("symbol % 3 <> 0").withColumn("freq", F.col("n")))


_DIST = f"{_NORM}, ks AS (SELECT DISTINCT k FROM nf), sy AS (SELECT a.k AS k1, b.k AS k2, f.symbol, f.freq AS d FROM ks a JOIN ks b ON a.k < b.k JOIN nf f ON f.k = a.k UNION ALL SELECT a.k, b.k, f.symbol, -f.freq FROM ks a JOIN ks b ON a.k < b.k JOIN nf f ON f.k = b.k), ds AS (SELECT k1, k2, CAST(sum(abs(d)) AS BIGINT) AS distance FROM (SELECT k1, k2, symbol, sum(d) AS d FROM sy GROUP BY ALL) GROUP BY ALL)"


@query("agg20_table_distance", f"WITH {_DIST} SELECT * FROM ds")
def table_distance(spark, d):
    return S.table_distances(S.normalized(_hist(spark, d)))


@query("top3_nearest_tables", f"WITH {_DIST}, b AS (SELECT k1, k2, distance FROM ds UNION ALL SELECT k2, k1, distance FROM ds), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k1 ORDER BY distance, k2) AS INTEGER) AS rank FROM b WHERE distance > 0) SELECT * FROM r WHERE rank <= 8")
def nearest_tables(spark, d):
    return S.nearest_tables(S.table_distances(S.normalized(_hist(spark, d))))


_SIZES = f"""{_NORM}, sh AS (SELECT k, count(*) AS n, max(symbol) - min(symbol) + 1 AS w, max(freq) AS most FROM nf GROUP BY k), od AS (SELECT k, lag(k) OVER (ORDER BY k) AS pv FROM sh),
df AS (SELECT k, count(*) AS ch, min(d) AS lo, max(d) AS hi FROM (SELECT k, symbol, sum(d) AS d FROM (SELECT od.k, symbol, freq AS d FROM od JOIN nf USING (k) UNION ALL SELECT od.k, symbol, -freq FROM od JOIN nf ON nf.k = od.pv) GROUP BY ALL) WHERE d <> 0 GROUP BY k),
sz AS (SELECT k, n, w, 4 + 2 * w AS dense16, 2 + 4 * n AS sparse16, CASE WHEN most <= 255 THEN 4 + w END AS dense8, CASE WHEN most <= 255 THEN 2 + 3 * n END AS sparse8, CASE WHEN pv IS NOT NULL AND coalesce(ch, 0) > 0 AND lo >= -128 AND hi <= 127 THEN 2 + 3 * ch END AS delta8, pv IS NOT NULL AND coalesce(ch, 0) = 0 AS reuse FROM sh JOIN od USING (k) LEFT JOIN df USING (k))"""


@query(
    "top2_table_encoding",
    f"""WITH {_SIZES}, b AS (SELECT *, least(dense16, sparse16, coalesce(dense8, 1000000), coalesce(sparse8, 1000000), coalesce(delta8, 1000000)) AS best FROM sz)
    SELECT k, n, CAST(w AS INTEGER) AS w, CAST(dense16 AS BIGINT) AS dense16, CAST(sparse16 AS BIGINT) AS sparse16, CAST(dense8 AS BIGINT) AS dense8, CAST(sparse8 AS BIGINT) AS sparse8, CAST(delta8 AS BIGINT) AS delta8,
    CASE WHEN reuse THEN 'reuse' WHEN n = 1 THEN 'single' WHEN dense16 = best THEN 'dense16' WHEN sparse16 = best THEN 'sparse16' WHEN dense8 = best THEN 'dense8' WHEN sparse8 = best THEN 'sparse8' ELSE 'delta8' END AS choice,
    CAST(CASE WHEN reuse THEN 0 WHEN n = 1 THEN 2 ELSE best END AS BIGINT) AS bytes FROM b""",
)
def table_encoding(spark, d):
    return S.table_sizes(S.normalized(_hist(spark, d)))


@query("ent10_table_bytes", f"WITH {_SIZES} SELECT CAST(sum(1 + CASE WHEN reuse THEN 0 WHEN n = 1 THEN 2 ELSE least(dense16, sparse16, coalesce(dense8, 1000000), coalesce(sparse8, 1000000), coalesce(delta8, 1000000)) END) AS BIGINT) AS bytes, count(*) AS tables FROM sz")
def table_bytes(spark, d):
    return S.table_sizes(S.normalized(_hist(spark, d))).agg(F.sum(F.col("bytes") + 1).alias("bytes"), F.count("*").alias("tables"))


@query(
    "ent11_bank_modes",
    """WITH t AS (SELECT s_suppkey AS bank, 1 + s_suppkey % 40 AS tables, 1 + (s_suppkey * 7) % (1 + s_suppkey % 40) AS distinct_, 20 + s_suppkey % 50 AS size FROM supplier),
    u AS (SELECT bank, tables, least(distinct_, tables) AS m, size FROM t), s AS (SELECT bank, tables, m, m * size AS sizes, tables * size AS inline FROM u),
    w AS (SELECT bank, unnest([1 + inline, CASE WHEN m = 1 THEN 1 + sizes END, CASE WHEN m <= 2 THEN 2 + sizes + (tables + 7) // 8 END, CASE WHEN m <= 4 THEN 2 + sizes + (2 * tables + 7) // 8 END, CASE WHEN m <= 16 THEN 2 + sizes + (4 * tables + 7) // 8 END, CASE WHEN m <= 255 THEN 2 + sizes + tables END]) AS bytes, unnest(['inline', 'single', 'index1', 'index2', 'index4', 'index8']) AS mode, unnest([0, 1, 2, 3, 4, 5]) AS i FROM s)
    SELECT bank, CAST(min(bytes) AS BIGINT) AS bytes, arg_min(mode, bytes * 10 + i) AS mode FROM w WHERE bytes IS NOT NULL GROUP BY bank""",
)
def bank_modes(spark, d):
    n = F.col("s_suppkey")
    t = table(spark, d, "supplier").select(n.alias("bank"), (1 + n % 40).alias("tables"), (1 + (n * 7) % (1 + n % 40)).alias("m"), (20 + n % 50).alias("size"))
    best = S.bank_sizes(F.col("m") * F.col("size"), F.col("m"), F.col("tables") * F.col("size"), F.col("tables"))
    return t.select("bank", best.alias("b")).select("bank", "b.bytes", "b.mode")


@query("agg8_cell_entropy", f"WITH {PX}, h AS (SELECT image_id, y // 4 AS cy, x // 4 AS cx, g, count(*) AS n FROM px GROUP BY ALL), p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY image_id, cy, cx) AS DOUBLE) AS p FROM h), e AS (SELECT image_id, cy, cx, sum(-p * log2(p)) AS entropy FROM p GROUP BY ALL), m AS (SELECT *, max(entropy) OVER (PARTITION BY image_id) AS most FROM e) SELECT image_id, cy, cx, round(entropy, 6) + 0.0 AS entropy, CAST(CASE WHEN most > 1e-12 THEN floor(round(entropy / most * 11, 9) + 0.5) ELSE 0 END AS INTEGER) AS context FROM m")
def cell_entropy(spark, d):
    return S.cell_entropy(pixels(spark, d), "g", 4).select("image_id", "cy", "cx", (F.round("entropy", 6) + 0.0).alias("entropy"), "context")


_PAL = "cs AS (SELECT image_id, (r << 16) + ((g // 64) * 64 << 8) + 7 AS colour, min(y * 16 + x) AS first FROM px2 GROUP BY ALL), pa AS (SELECT image_id, colour, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first) - 1 AS INTEGER) AS index, count(*) OVER (PARTITION BY image_id) AS n FROM cs)"
_PX2 = f"{PX}, px2 AS (SELECT image_id, y, x, r // 16 AS r, g FROM px)"


def _few(spark, d) -> DataFrame:
    return pixels(spark, d).select("image_id", "y", "x", F.floor(F.col("r") / 16).cast("int").alias("r"), (F.floor(F.col("g") / 64) * 64).cast("int").alias("g"), F.lit(7).alias("b"))


@query("agg9_palette", f"WITH {_PX2}, {_PAL} SELECT image_id, colour, index FROM pa WHERE n <= 256")
def palette(spark, d):
    return S.palette(_few(spark, d))


@query("jn4_palette_join", f"WITH {_PX2}, {_PAL} SELECT px2.image_id, y, x, index FROM px2 JOIN pa ON pa.image_id = px2.image_id AND pa.colour = (r << 16) + ((g // 64) * 64 << 8) + 7 WHERE n <= 256")
def palette_join(spark, d):
    px = _few(spark, d)
    return S.indexed(px, S.palette(px))


@query("win7_first_seen", f"WITH {PX}, f AS (SELECT image_id, g, min(y * 16 + x) AS first FROM px GROUP BY ALL) SELECT image_id, g, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY first) - 1 AS INTEGER) AS index FROM f")
def first_seen(spark, d):
    from pyspark.sql import Window

    f = pixels(spark, d).groupBy("image_id", "g").agg(F.min(F.col("y") * 16 + F.col("x")).alias("first"))
    return f.select("image_id", "g", (F.dense_rank().over(Window.partitionBy("image_id").orderBy("first")) - 1).alias("index"))


# --- runs and bits: the low bits of events ------------------------------------------------------------------------------

_EV = "ev AS (SELECT CAST(event_id // 256 AS BIGINT) AS s, CAST(event_id % 256 AS INTEGER) AS p, CAST(user_id % 3 AS INTEGER) AS v FROM events)"
_RUN = f"{_EV}, nw AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY s ORDER BY p) IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS nw FROM ev), rn AS (SELECT *, sum(nw) OVER (PARTITION BY s ORDER BY p) AS run FROM nw), rr AS (SELECT s, run - 1 AS run, v AS value, count(*) AS length FROM rn GROUP BY ALL)"


def _events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / 256).cast("bigint").alias("s"), (F.col("event_id") % 256).cast("int").alias("p"), (F.col("user_id") % 3).cast("int").alias("v"))


@query("win3_run_lengths", f"WITH {_RUN} SELECT s, CAST(run AS INTEGER) AS run, value, length FROM rr")
def run_lengths(spark, d):
    return S.runs(_events(spark, d), "s", "p", "v")


@query("win4_run_decode", f"WITH {_EV} SELECT s, p AS n, v AS value FROM ev")
def run_decode(spark, d):
    return S.unrun(S.runs(_events(spark, d), "s", "p", "v"), "s")


@query("win6_table_delta", f"WITH {_NORM}, ks AS (SELECT k, lag(k) OVER (ORDER BY k) AS pv FROM (SELECT DISTINCT k FROM nf)), dd AS (SELECT ks.k, symbol, freq AS d FROM ks JOIN nf USING (k) WHERE pv IS NOT NULL UNION ALL SELECT ks.k, symbol, -freq FROM ks JOIN nf ON nf.k = pv) SELECT k, symbol, CAST(sum(d) AS BIGINT) AS delta FROM dd GROUP BY ALL HAVING sum(d) <> 0")
def table_delta(spark, d):
    f = S.normalized(_hist(spark, d)).select("k", "symbol", "freq")
    both = f.where("k > 0").withColumnRenamed("freq", "d").union(f.where("k < 63").select((F.col("k") + 1).alias("k"), "symbol", (-F.col("freq")).alias("d")))
    return both.groupBy("k", "symbol").agg(F.sum("d").alias("delta")).where("delta <> 0")


@query("ent13_span_stream", f"WITH {_RUN}, c AS (SELECT s, count(*) AS m, min(v) = max(v) AS same FROM ev GROUP BY s), n AS (SELECT s, count(*) AS runs FROM rr GROUP BY s) SELECT s, CAST(2 + (7 * m + 7) // 8 AS BIGINT) AS legacy, CAST(CASE WHEN same THEN 2 WHEN 2 + 3 * runs < 2 + (7 * m + 7) // 8 THEN 2 + 3 * runs ELSE 2 + (7 * m + 7) // 8 END AS BIGINT) AS adaptive, CASE WHEN same THEN 'single' WHEN 2 + 3 * runs < 2 + (7 * m + 7) // 8 THEN 'runs' ELSE 'raw' END AS mode FROM c JOIN n USING (s)")
def span_stream(spark, d):
    return S.span_stream_bytes(_events(spark, d), "s", "p", "v")


for _w, _name in ((1, "ent14_presence_bits"), (2, "ent15_sign_modes"), (4, "ent16_mode_nibbles")):

    @query(_name, f"WITH {_EV} SELECT s, p // {8 // _w} AS byte, CAST(sum((v % {1 << _w}) << ((p % {8 // _w}) * {_w})) AS INTEGER) AS bits FROM ev GROUP BY ALL")
    def packing(spark, d, w=_w):
        e = _events(spark, d).withColumn("v", F.col("v") % (1 << w))
        return S.packed_bits(e, "s", "p", "v", w)


@query("ent19_unpack_indices", f"WITH {_EV} SELECT s, p AS place, v AS value FROM ev")
def unpack_indices(spark, d):
    e = _events(spark, d)
    n = e.groupBy("s").agg(F.max("p").alias("last"))  # a stream's length goes with it, as its last byte may be partial
    return S.unpacked_bits(S.packed_bits(e, "s", "p", "v", 2), "s", 2).join(n, "s").where("place <= last").drop("last")


@query("agg18_all_same", f"WITH {_EV}, b AS (SELECT s * 64 + p // 4 AS g, v FROM ev) SELECT g, min(v) = max(v) AS same, bool_and(v <> 0) AS all_set, bool_or(v <> 0) AS any_set FROM b GROUP BY g")
def all_same(spark, d):
    e = _events(spark, d).select((F.col("s") * 64 + F.floor(F.col("p") / 4)).alias("g"), "v")
    return S.all_same(e, "g", "v")


@query("srt2_block_order", f"WITH {BLK} SELECT block_id, CAST(row_number() OVER (ORDER BY block_id // 8, block_id % 8) - 1 AS INTEGER) AS n FROM bl")
def block_order(spark, d):
    b = blocks(spark, d).select("block_id", F.floor(F.col("block_id") / 8).alias("row"), (F.col("block_id") % 8).alias("column"))
    return numbered(b, ["row", "column", "block_id"]).select("block_id", F.col("n").cast("int"))


@query("jn10_plane_pairing", f"WITH {_Q}, s AS (SELECT block_id, CAST(coalesce(max(CASE WHEN q <> 0 THEN k + 1 END), 0) AS INTEGER) AS span FROM cf GROUP BY 1) SELECT a.block_id // 2 AS pair, greatest(a.span, b.span) AS span FROM s a JOIN s b ON b.block_id = a.block_id + 1 WHERE a.block_id % 2 = 0")
def plane_pairing(spark, d):
    c = _coeffs(spark, d).groupBy("block_id").agg(F.coalesce(F.max(F.when(F.col("q") != 0, F.col("k") + 1)), F.lit(0)).alias("span"))
    cb = c.where("block_id % 2 = 0").select(F.floor(F.col("block_id") / 2).alias("pair"), F.col("span").alias("s1"))
    cr = c.where("block_id % 2 = 1").select(F.floor(F.col("block_id") / 2).alias("pair"), F.col("span").alias("s2"))
    return cb.join(cr, "pair").select("pair", F.greatest("s1", "s2").alias("span"))


@query("jn5_step_lookup", f"WITH {_Q}, st AS (SELECT CAST(k AS INTEGER) AS k, CAST(k % 7 + 1 AS INTEGER) AS step FROM range(0, 64) t(k)) SELECT block_id, k, q * step AS f FROM cf JOIN st USING (k)")
def step_lookup(spark, d):
    st = spark.range(64).select(F.col("id").cast("int").alias("k"), (F.col("id") % 7 + 1).cast("int").alias("step"))
    return _coeffs(spark, d).join(F.broadcast(st), "k").select("block_id", "k", (F.col("q") * F.col("step")).alias("f"))  # 64 rows
