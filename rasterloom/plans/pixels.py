"""Colour, metrics and rollup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import CAND, LONG, PAIR, PX, clamp_sql, coarse, pixels, table, ycc_sql
from ..functions import colour as C
from ..functions import quality as Q
from ..operators import metrics as M
from ..operators import rollup as R
from ..schemas import RGB, YCBCR
from . import query



def _c(*names: str):
    return [F.col(n) for n in names]


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _pair(spark, d) -> DataFrame:
    px = pixels(spark, d)
    return M.paired(px, coarse(px))


def _matrix_sql(matrix: int, full: bool, top: float = 255.0) -> list[str]:
    y_off, y_span, c_off, c_span = C._ranges(8, full)
    out = []
    for w, off, span in zip(YCBCR[matrix], (y_off, c_off, c_off), (y_span, c_span, c_span), strict=True):
        mix = " + ".join(f"{x}::DOUBLE * (CAST({c} AS DOUBLE) / 255.0::DOUBLE)" for x, c in zip(w, "rgb", strict=True))
        out.append(f"CAST(round({clamp_sql(f'({mix}) * {span!r}::DOUBLE + {off!r}::DOUBLE')}) AS INTEGER)")
    return out


def _to_ycc(matrix: int, full: bool, name: str) -> None:
    y, cb, cr = _matrix_sql(matrix, full)

    @query(name, f"WITH {PX} SELECT image_id, y, x, {y} AS yy, {cb} AS cb, {cr} AS cr FROM px")
    def run(spark, d):
        out = C.rgb_to_ycbcr(*_c("r", "g", "b"), matrix=matrix, full_range=full)
        return pixels(spark, d).select("image_id", "y", "x", *[c.alias(n) for c, n in zip(out, ("yy", "cb", "cr"), strict=True)])

    r_cr, g_cb, g_cr, b_cb = RGB[matrix]
    y_off, y_span, c_off, c_span = C._ranges(8, full)
    parts = f"(yy - {y_off!r}::DOUBLE) / {y_span!r}::DOUBLE AS a, (cb - {c_off!r}::DOUBLE) / {c_span!r}::DOUBLE AS p, (cr - {c_off!r}::DOUBLE) / {c_span!r}::DOUBLE AS q"
    cell = lambda e: f"CAST(floor({clamp_sql(e, '1.0')} * 255.0::DOUBLE + 0.5::DOUBLE) AS INTEGER)"
    back = f"{cell(f'a + {r_cr}::DOUBLE * q')} AS r, {cell(f'a + {g_cb}::DOUBLE * p + {g_cr}::DOUBLE * q')} AS g, {cell(f'a + {b_cb}::DOUBLE * p')} AS b"

    @query(name.replace("prj1", "prj2").replace("rgb_to_ycbcr", "ycbcr_to_rgb"), f"WITH {PX}, t AS (SELECT image_id, y, x, {y} AS yy, {cb} AS cb, {cr} AS cr FROM px), u AS (SELECT image_id, y, x, {parts} FROM t) SELECT image_id, y, x, {back} FROM u")
    def run_back(spark, d):
        t = C.rgb_to_ycbcr(*_c("r", "g", "b"), matrix=matrix, full_range=full)
        p = pixels(spark, d).select("image_id", "y", "x", *[c.alias(n) for c, n in zip(t, ("yy", "cb", "cr"), strict=True)])
        out = C.ycbcr_to_rgb(*_c("yy", "cb", "cr"), matrix=matrix, full_range=full)
        return p.select("image_id", "y", "x", *[c.alias(n) for c, n in zip(out, "rgb", strict=True)])


for _m, _full, _n in ((1, True, "prj1_rgb_to_ycbcr"), (5, True, "prj1_rgb_to_ycbcr_601"), (9, True, "prj1_rgb_to_ycbcr_2020"), (1, False, "prj1_rgb_to_ycbcr_limited")):
    _to_ycc(_m, _full, _n)

_Y, _CB, _CR = ycc_sql()


@query("prj3_ycbcr_double", f"WITH {PX} SELECT image_id, y, x, round({_Y}, 6) AS yy, round({_CB}, 6) AS cb, round({_CR}, 6) AS cr FROM px")
def ycbcr_double(spark, d):
    out = C.ycbcr_exact(*_c("r", "g", "b"))
    return pixels(spark, d).select("image_id", "y", "x", *[F.round(c, 6).alias(n) for c, n in zip(out, ("yy", "cb", "cr"), strict=True)])


_V = "events_v AS (SELECT event_id, least(greatest(value / 600.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS v FROM events)"


def _values(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", C.clamp(F.col("value") / 600.0, 0, 1).alias("v"))


@query(
    "prj4_pq",
    f"""WITH {_V}, p AS (SELECT *, pow(v, 1.0::DOUBLE / 78.84375::DOUBLE) AS e, pow(v, 0.1593017578125::DOUBLE) AS o FROM events_v)
    SELECT event_id, round(CASE WHEN v <= 0 OR 18.8515625::DOUBLE - 18.6875::DOUBLE * e <= 0 THEN 0.0::DOUBLE
      ELSE 10000.0::DOUBLE * pow(greatest(e - 0.8359375::DOUBLE, 0.0::DOUBLE) / (18.8515625::DOUBLE - 18.6875::DOUBLE * e), 1.0::DOUBLE / 0.1593017578125::DOUBLE) END, 6) AS eotf,
      round(CASE WHEN v <= 0 THEN 0.0::DOUBLE ELSE pow((0.8359375::DOUBLE + 18.8515625::DOUBLE * o) / (1.0::DOUBLE + 18.6875::DOUBLE * o), 78.84375::DOUBLE) END, 6) AS oetf FROM p""",
)
def pq(spark, d):
    return _values(spark, d).select("event_id", F.round(C.pq_eotf(F.col("v")), 6).alias("eotf"), F.round(C.pq_oetf(F.col("v") * 10000.0), 6).alias("oetf"))


@query(
    "prj5_hlg",
    f"""WITH {_V} SELECT event_id,
      round(CASE WHEN v <= 0 THEN 0.0::DOUBLE WHEN v <= 1.0::DOUBLE / 12 THEN sqrt(3 * v) ELSE 0.17883277::DOUBLE * ln(12 * v - 0.28466892::DOUBLE) + 0.55991073::DOUBLE END, 6) AS oetf,
      round(CASE WHEN v <= 0 THEN 0.0::DOUBLE WHEN v <= 0.5 THEN v * v / 3 ELSE (exp((v - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END, 6) AS inv_oetf,
      round(pow(v, 1.2::DOUBLE), 6) AS ootf FROM events_v""",
)
def hlg(spark, d):
    v = F.col("v")
    return _values(spark, d).select("event_id", F.round(C.hlg_oetf(v), 6).alias("oetf"), F.round(C.hlg_inverse_oetf(v), 6).alias("inv_oetf"), F.round(C.hlg_ootf(v), 6).alias("ootf"))


_BT = {"o": "CASE WHEN v < 0.018 THEN 4.5::DOUBLE * v ELSE 1.099::DOUBLE * pow(v, 0.45::DOUBLE) - 0.099::DOUBLE END", "e": "CASE WHEN v < 0.081 THEN v / 4.5::DOUBLE ELSE pow((v + 0.099::DOUBLE) / 1.099::DOUBLE, 1.0::DOUBLE / 0.45::DOUBLE) END"}
_SR = {"o": "CASE WHEN v <= 0.0031308 THEN 12.92::DOUBLE * v ELSE 1.055::DOUBLE * pow(v, 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END", "e": "CASE WHEN v <= 0.04045 THEN v / 12.92::DOUBLE ELSE pow((v + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"}


@query("prj6_bt709", f"WITH {_V} SELECT event_id, round({_BT['o']}, 6) AS oetf, round({_BT['e']}, 6) AS eotf FROM events_v")
def bt709(spark, d):
    return _values(spark, d).select("event_id", F.round(C.bt709_oetf(F.col("v")), 6).alias("oetf"), F.round(C.bt709_eotf(F.col("v")), 6).alias("eotf"))


@query("prj7_srgb", f"WITH {_V} SELECT event_id, round({_SR['o']}, 6) AS oetf, round({_SR['e']}, 6) AS eotf FROM events_v")
def srgb(spark, d):
    return _values(spark, d).select("event_id", F.round(C.srgb_oetf(F.col("v")), 6).alias("oetf"), F.round(C.srgb_eotf(F.col("v")), 6).alias("eotf"))


@query(
    "prj8_transfer_dispatch",
    f"""WITH {_V}, t AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 13 ELSE 2 END AS transfer FROM events_v)
    SELECT event_id, CAST(transfer AS INTEGER) AS transfer, round(CASE WHEN transfer = 1 THEN {_BT['e']} ELSE {_SR['e']} END, 6) AS linear, round(CASE WHEN transfer = 1 THEN {_BT['o']} ELSE {_SR['o']} END, 6) AS coded FROM t""",
)
def transfer_dispatch(spark, d):
    t = _values(spark, d).withColumn("transfer", F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 13).otherwise(2))
    return t.select("event_id", "transfer", F.round(C.to_linear(F.col("v"), F.col("transfer")), 6).alias("linear"), F.round(C.from_linear(F.col("v"), F.col("transfer")), 6).alias("coded"))


@query("prj9_subtract_green", f"WITH {PX}, s AS (SELECT image_id, y, x, (r - g + 256) % 256 AS r, g, (b - g + 256) % 256 AS b FROM px) SELECT *, (r + g) % 256 AS r0, (b + g) % 256 AS b0 FROM s")
def subtract_green(spark, d):
    r, g, b = C.subtract_green(*_c("r", "g", "b"))
    s = pixels(spark, d).select("image_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))
    r0, _, b0 = C.add_green(*_c("r", "g", "b"))
    return s.withColumns({"r0": r0, "b0": b0})


_RATIOS = """f AS (SELECT image_id, CAST(least(greatest(trunc(coalesce(sum(CAST(g AS BIGINT) * r) / CAST(nullif(sum(CAST(g AS BIGINT) * g), 0) AS DOUBLE), 0) * 32), -128), 127) AS INTEGER) AS g_r,
  CAST(least(greatest(trunc(coalesce(sum(CAST(g AS BIGINT) * b) / CAST(nullif(sum(CAST(g AS BIGINT) * g), 0) AS DOUBLE), 0) * 32), -128), 127) AS INTEGER) AS g_b,
  CAST(least(greatest(trunc(coalesce(sum(CAST(r AS BIGINT) * b) / CAST(nullif(sum(CAST(r AS BIGINT) * r), 0) AS DOUBLE), 0) * 32), -128), 127) AS INTEGER) AS r_b FROM px GROUP BY image_id)"""


@query("agg10_colour_ratios", f"WITH {PX}, {_RATIOS} SELECT * FROM f")
def colour_ratios(spark, d):
    return R.colour_ratios(pixels(spark, d))


@query("prj10_decorrelate", f"WITH {PX}, {_RATIOS}, s AS (SELECT image_id, y, x, (r - ((g * g_r) >> 5)) & 255 AS r, g, (b - ((g * g_b) >> 5) - ((r * r_b) >> 5)) & 255 AS b, r AS r0, b AS b0 FROM px JOIN f USING (image_id)) SELECT * FROM s")
def decorrelate(spark, d):
    px = pixels(spark, d)
    p = px.join(R.colour_ratios(px), "image_id")
    r, g, b = C.decorrelate(*_c("r", "g", "b", "g_r", "g_b", "r_b"))
    p = p.select("image_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"), "g_r", "g_b", "r_b")
    r0, _, b0 = C.recorrelate(*_c("r", "g", "b", "g_r", "g_b", "r_b"))
    return p.select("image_id", "y", "x", "r", "g", "b", r0.alias("r0"), b0.alias("b0"))


@query("prj11_expand_rgba", f"WITH {PX} SELECT *, CAST(255 AS INTEGER) AS a FROM px")
def expand_rgba(spark, d):
    return pixels(spark, d).withColumn("a", F.lit(255))


@query("prj12_scale_to_8bit", "SELECT event_id, CAST((((user_id * 37) % 1024) * 255 + 511) // 1023 AS INTEGER) AS s FROM events")
def scale_to_8bit(spark, d):
    return table(spark, d, "events").select("event_id", C.scale_to_8bit((F.col("user_id") * 37) % 1024, 1023).alias("s"))


@query("prj13_pack_argb", f"WITH {PX} SELECT image_id, y, x, (255::BIGINT << 24) | (r::BIGINT << 16) | (g::BIGINT << 8) | b::BIGINT AS argb, CAST(255 AS INTEGER) AS a, r, g, b FROM px")
def pack_argb(spark, d):
    p = pixels(spark, d).select("image_id", "y", "x", C.pack_argb(F.lit(255), *_c("r", "g", "b")).alias("argb"))
    return p.select("*", *[c.alias(n) for c, n in zip(C.unpack_argb(F.col("argb")), "argb", strict=True)])


@query("prj14_luma_integer", f"WITH {PX} SELECT image_id, y, x, (77 * r + 150 * g + 29 * b) >> 8 AS luma FROM px")
def luma_integer(spark, d):
    return pixels(spark, d).select("image_id", "y", "x", C.luma_77(*_c("r", "g", "b")).alias("luma"))


@query("agg16_luma_histogram", f"WITH {PX}, h AS (SELECT (77 * r + 150 * g + 29 * b) >> 8 AS luma, count(*) AS n FROM px GROUP BY 1) SELECT CAST(i AS INTEGER) AS luma, coalesce(n, 0) AS n, max(n) OVER () AS peak FROM range(0, 256) t(i) LEFT JOIN h ON h.luma = i")
def luma_histogram(spark, d):
    return R.luma_histogram(pixels(spark, d))


@query("prj15_sample_bytes", "SELECT event_id, CAST(event_id % 65536 AS INTEGER) AS sample FROM events")
def sample_bytes(spark, d):
    n = F.col("event_id") % 65536
    data = F.unhex(F.concat(*[F.lpad(F.hex(x), 2, "0") for x in (n % 256, F.floor(n / 256))]))
    return table(spark, d, "events").select("event_id", C.le16(data, F.lit(0)).alias("sample"))


@query("prj20_quality_lambda", "SELECT event_id, CAST(trunc(100 - least(greatest(value / 6, 0.0::DOUBLE), 100.0::DOUBLE)) AS INTEGER) AS qp, round(0.85::DOUBLE * pow(2.0::DOUBLE, (trunc(100 - least(greatest(value / 6, 0.0::DOUBLE), 100.0::DOUBLE)) - 12) / 3.0::DOUBLE), 4) AS lambda FROM events")
def quality_lambda(spark, d):
    qp = Q.qp_of(F.col("value") / 6)
    return table(spark, d, "events").select("event_id", qp.alias("qp"), F.round(Q.lambda_of(qp), 4).alias("lambda"))


@query("prj21_psnr", "SELECT event_id, round(CASE WHEN value <= 1e-12 THEN 100.0::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / value) END, 6) AS psnr FROM events")
def psnr(spark, d):
    return table(spark, d, "events").select("event_id", F.round(Q.psnr(F.col("value")), 6).alias("psnr"))


@query("prj22_tile_score", "SELECT event_id, round(CASE WHEN value < 1e-10 THEN 100.0::DOUBLE ELSE least(greatest((10 * log10(65025.0::DOUBLE / value) - 20) * 2.5, 0.0::DOUBLE), 100.0::DOUBLE) END, 6) AS score FROM events")
def tile_score(spark, d):
    return table(spark, d, "events").select("event_id", F.round(Q.tile_score(F.col("value")), 6).alias("score"))


@query("prj24_coefficient_symbols", "SELECT event_id, CAST(least(greatest(CAST((user_id * 37) % 4096 AS INTEGER) - 2048 + 1024, 0), 2048) AS INTEGER) AS signed, CAST(least(abs(CAST((user_id * 37) % 4096 AS INTEGER) - 2048), 1024) AS INTEGER) AS magnitude FROM events")
def coefficient_symbols(spark, d):
    q = ((F.col("user_id") * 37) % 4096).cast("int") - 2048
    return table(spark, d, "events").select("event_id", Q.signed_symbol(q).alias("signed"), Q.magnitude_symbol(q).alias("magnitude"))


_CHANNELS = """w AS (SELECT image_id, channel, y // 8 AS wy, x // 8 AS wx, CAST(count(*) AS DOUBLE) AS n, CAST(sum(a) AS DOUBLE) AS sa, CAST(sum(c) AS DOUBLE) AS sc, CAST(sum(a * a) AS DOUBLE) AS saa, CAST(sum(c * c) AS DOUBLE) AS scc, CAST(sum(a * c) AS DOUBLE) AS sac, CAST(sum(abs(a - c)) AS DOUBLE) AS ab, CAST(sum((a - c) * (a - c)) AS DOUBLE) AS sq FROM l GROUP BY ALL),
m AS (SELECT *, sa / n AS mx, sc / n AS my, greatest(0, saa / n - (sa / n) * (sa / n)) AS vx, greatest(0, scc / n - (sc / n) * (sc / n)) AS vy, sac / n - (sa / n) * (sc / n) AS cov FROM w),
q AS (SELECT *, (mx * mx + my * my + 6.5025::DOUBLE) * (vx + vy + 58.5225::DOUBLE) AS under, (2 * mx * my + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE) AS over_ FROM m),
s AS (SELECT *, CASE WHEN under > 0 THEN over_ / under ELSE 1.0::DOUBLE END AS ssim FROM q),
per AS (SELECT image_id, channel, CAST(sum(n) AS BIGINT) AS n, sum(ab) / sum(n) AS mae, sum(sq) / sum(n) AS mse, avg(ssim) AS ssim FROM s GROUP BY ALL)"""
_DB = "CASE WHEN mse <= 1e-12 THEN 100.0::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / mse) END"


@query("jn1_positional_join", f"WITH {PX}, {CAND}, {PAIR} SELECT * FROM j")
def positional_join(spark, d):
    return _pair(spark, d)


@query("agg1_channel_errors", f"WITH {PX}, {CAND}, {PAIR}, {LONG}, {_CHANNELS} SELECT image_id, channel, n, round(mae, 6) AS mae, round(mse, 6) AS mse, round({_DB}, 6) AS psnr, round(ssim, 6) AS ssim FROM per")
def channel_errors(spark, d):
    return _round(M.channels(M.samples(_pair(spark, d))), "mae", "mse", "psnr", "ssim")


@query("agg2_overall", f"WITH {PX}, {CAND}, {PAIR}, {LONG}, {_CHANNELS}, o AS (SELECT image_id, avg(mae) AS mae, avg(mse) AS mse, avg(ssim) AS ssim FROM per GROUP BY ALL) SELECT image_id, round(mae, 6) AS mae, round(mse, 6) AS mse, round({_DB}, 6) AS psnr, round(ssim, 6) AS ssim FROM o")
def overall(spark, d):
    return _round(M.overall(M.channels(M.samples(_pair(spark, d)))), "mae", "mse", "psnr", "ssim")


@query("agg3_window_ssim", f"WITH {PX}, {CAND}, {PAIR}, {LONG}, {_CHANNELS} SELECT image_id, channel, CAST(wy AS INTEGER) AS wy, CAST(wx AS INTEGER) AS wx, round(ssim, 6) AS ssim FROM s")
def window_ssim(spark, d):
    return _round(M.window_ssim(M.samples(_pair(spark, d))), "ssim")


_STATS = f"""u AS (SELECT image_id, ({_Y}) / 255.0::DOUBLE AS luma, least(greatest(sqrt(({_CB} - 127.5::DOUBLE) * ({_CB} - 127.5::DOUBLE) + ({_CR} - 127.5::DOUBLE) * ({_CR} - 127.5::DOUBLE)) / (255.0::DOUBLE * sqrt(0.5::DOUBLE)), 0), 1) AS chroma FROM px),
st AS (SELECT image_id, avg(luma) AS mean_luma, sqrt(greatest(0, avg(luma * luma) - avg(luma) * avg(luma))) AS luma_stddev, avg(chroma) AS mean_chroma, avg(CASE WHEN luma <= 0.25 THEN 1.0::DOUBLE ELSE 0 END) AS dark_fraction, avg(CASE WHEN luma >= 0.75 THEN 1.0::DOUBLE ELSE 0 END) AS bright_fraction FROM u GROUP BY image_id)"""
_STAT_NAMES = ("mean_luma", "luma_stddev", "mean_chroma", "dark_fraction", "bright_fraction")


@query("agg4_image_statistics", f"WITH {PX}, {_STATS} SELECT image_id, {', '.join(f'round({n}, 6) AS {n}' for n in _STAT_NAMES)} FROM st")
def image_statistics(spark, d):
    return _round(M.statistics(pixels(spark, d)), *_STAT_NAMES)


@query("prj23_lighting_bucket", f"WITH {PX}, {_STATS} SELECT image_id, CASE WHEN dark_fraction >= 0.40 OR mean_luma <= 0.33 THEN 'dark' WHEN bright_fraction >= 0.35 OR mean_luma >= 0.62 THEN 'bright' ELSE 'balanced' END AS bucket FROM st")
def lighting_bucket(spark, d):
    return M.statistics(pixels(spark, d)).select("image_id", Q.lighting_bucket(*_c("mean_luma", "dark_fraction", "bright_fraction")).alias("bucket"))


_NB = """nb AS (SELECT *, lag(yy) OVER r AS le, lead(yy) OVER r AS ri, lag(yy) OVER c AS up, lead(yy) OVER c AS dn FROM yp WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
ed AS (SELECT *, greatest(0.0::DOUBLE, coalesce(abs(yy - le), 0), coalesce(abs(yy - ri), 0), coalesce(abs(yy - up), 0), coalesce(abs(yy - dn), 0)) AS edge FROM nb)"""


@query("jn2_edge_strength", f"WITH {PX}, yp AS (SELECT image_id, y, x, {_Y} AS yy FROM px), {_NB} SELECT image_id, y, x, round(edge, 6) AS edge FROM ed")
def edge_strength(spark, d):
    p = pixels(spark, d).withColumn("yy", C.ycbcr_exact(*_c("r", "g", "b"))[0])
    return M.neighbours(p, "yy").select("image_id", "y", "x", F.round(M.edge_strength("yy"), 6).alias("edge"))


@query("win1_neighbours", f"WITH {PX} SELECT image_id, y, x, lag(g) OVER r AS le, lead(g) OVER r AS ri, lag(g) OVER c AS up, lead(g) OVER c AS down FROM px WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)")
def neighbours(spark, d):
    return M.neighbours(pixels(spark, d), "g").select("image_id", "y", "x", F.col("left").alias("le"), F.col("right").alias("ri"), "up", "down")


_Y2, _CB2, _CR2 = ycc_sql("r2", "g2", "b2")
_ART_NAMES = ("weighted_luma_mae", "weighted_chroma_mae", "chroma_mae", "chroma_mse", "max_abs_error", "chroma_psnr")
_HALF = "127.5::DOUBLE"


@query(
    "agg5_artifacts",
    f"""WITH {PX}, {CAND}, {PAIR}, yp AS (SELECT *, {_Y} AS yy, {_CB} AS cb, {_CR} AS cr, {_Y2} AS y2, {_CB2} AS cb2, {_CR2} AS cr2 FROM j), {_NB},
    wt AS (SELECT *, 1 + 3 * least(greatest(edge / 255.0::DOUBLE, 0), 1) AS we, sqrt((cb - {_HALF}) * (cb - {_HALF}) + (cr - {_HALF}) * (cr - {_HALF})) / 255.0::DOUBLE AS rad FROM ed),
    a AS (SELECT image_id, sum(abs(yy - y2) * we) / sum(we) AS weighted_luma_mae,
      sum(0.5 * (abs(cb - cb2) + abs(cr - cr2)) * we * (1 + 1.75 * least(greatest(rad, 0), 1))) / sum(we * (1 + 1.75 * least(greatest(rad, 0), 1))) AS weighted_chroma_mae,
      avg(0.5 * (abs(cb - cb2) + abs(cr - cr2))) AS chroma_mae, avg(0.5 * ((cb - cb2) * (cb - cb2) + (cr - cr2) * (cr - cr2))) AS chroma_mse,
      CAST(max(greatest(abs(r - r2), abs(g - g2), abs(b - b2))) AS DOUBLE) AS max_abs_error FROM wt GROUP BY image_id), f AS (SELECT *, chroma_mse AS mse FROM a)
    SELECT image_id, round(weighted_luma_mae, 5) AS weighted_luma_mae, round(weighted_chroma_mae, 5) AS weighted_chroma_mae, round(chroma_mae, 5) AS chroma_mae, round(chroma_mse, 5) AS chroma_mse, max_abs_error, round({_DB}, 5) AS chroma_psnr FROM f""",
)
def artifacts(spark, d):
    return _round(M.artifacts(_pair(spark, d)), *_ART_NAMES, places=5)


@query("flt6_compare_preconditions", f"WITH {PX}, cut AS (SELECT * FROM px WHERE image_id % 3 <> 0 AND (image_id % 3 <> 1 OR x < 12)), s AS (SELECT image_id, max(x) AS w, max(y) AS h FROM px GROUP BY 1), t AS (SELECT image_id, max(x) AS w2, max(y) AS h2 FROM cut GROUP BY 1), j AS (SELECT image_id, CASE WHEN w2 IS NULL THEN 'missing' WHEN w <> w2 OR h <> h2 THEN 'dimensions' END AS reason FROM s LEFT JOIN t USING (image_id)) SELECT * FROM j WHERE reason IS NOT NULL")
def compare_preconditions(spark, d):
    px = pixels(spark, d)
    return M.mismatches(px, px.where("image_id % 3 <> 0 AND (image_id % 3 <> 1 OR x < 12)"))


def flagship(spark, d) -> DataFrame:
    """Every metric of every image, in one row."""
    px = pixels(spark, d)
    return M.compare(px, coarse(px))


query("compare_images")(flagship)


# --- corpus rollups ---------------------------------------------------------------------------------------------------

_ROWS = """rw AS (SELECT lower(p_brand) AS scene_group, CASE WHEN p_size < 15 THEN 'dark' WHEN p_size > 35 THEN 'bright' ELSE 'balanced' END AS lighting_bucket, p_partkey AS k,
  CAST(p_size * 100 AS BIGINT) AS bytes, round(p_retailprice / 50, 4) AS psnr, round(p_size / 51.0::DOUBLE, 6) AS ssim, round(p_retailprice / 45, 4) AS chroma_psnr, round(p_size / 70.0::DOUBLE, 4) AS weighted_chroma_mae, round(p_size / 60.0::DOUBLE, 4) AS source_mean_luma FROM part)"""
def _mean_sql(name: str, places: int) -> str:
    scaled = f"({name} * {float(1 << 40)}::DOUBLE)"
    high, low = (f"CAST(sum(CAST({x} AS BIGINT)) AS DOUBLE)" for x in (f"floor({scaled})", f"trunc(({scaled} - floor({scaled})) * {float(1 << 40)}::DOUBLE)"))
    return f"round_even(({high} + {low} / {float(1 << 40)}::DOUBLE) / {float(1 << 40)}::DOUBLE / count({name}) * 1e{places}, 0) / 1e{places} AS avg_{name}"


_MEANS_SQL = ", ".join(_mean_sql(n, p) for n, p in R.MEANS.items())


def _rows(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select(
        F.lower("p_brand").alias("scene_group"), F.when(size < 15, "dark").when(size > 35, "bright").otherwise("balanced").alias("lighting_bucket"), F.col("p_partkey").cast("string").alias("relative_path"),
        (size * 100).cast("bigint").alias("bytes"), F.round(F.col("p_retailprice") / 50, 4).alias("psnr"), F.round(size / 51.0, 6).alias("ssim"), F.round(F.col("p_retailprice") / 45, 4).alias("chroma_psnr"), F.round(size / 70.0, 4).alias("weighted_chroma_mae"), F.round(size / 60.0, 4).alias("source_mean_luma"),
    )


@query(
    "agg15_grouping_sets",
    f"WITH {_ROWS} SELECT scene_group, lighting_bucket, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS total_bytes, {_MEANS_SQL} FROM rw GROUP BY CUBE (scene_group, lighting_bucket)",
)
def grouping_sets(spark, d):
    return R.rollup(_rows(spark, d))


@query("agg14_rollup", f"WITH {_ROWS} SELECT scene_group, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS total_bytes, {_MEANS_SQL} FROM rw GROUP BY scene_group")
def rollup_by_scene(spark, d):
    return R.rollup(_rows(spark, d)).where("scene_group IS NOT NULL AND lighting_bucket IS NULL").drop("lighting_bucket")


@query("set2_distinct_scenes", f"WITH {_ROWS} SELECT DISTINCT scene_group FROM rw")
def distinct_scenes(spark, d):
    return _rows(spark, d).select("scene_group").distinct()
