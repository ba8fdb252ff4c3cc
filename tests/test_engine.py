"""Metrics, rollups, transforms and metadata on analytic fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import colour, quality, text
from rasterloom.operators import blocks, match, meta, metrics, rollup, statistics

# Published quality rows (path, scene, lighting, bytes, psnr, ssim, chroma psnr, weighted chroma error,
# mean luma, dark and bright share) of two qualities, and their published rollups.
SOURCES = {
    "ember-7f3a": ("people", "balanced", 0.5083, 0.2317, 0.2255), "mira-5b8d": ("people", "balanced", 0.4083, 0.3967, 0.0521), "solis-2c9e": ("people", "bright", 0.4732, 0.3986, 0.3647),
    "horizon-4e2a": ("scenery", "bright", 0.6811, 0.0228, 0.4458), "meadow-6d3b": ("scenery", "balanced", 0.5891, 0.0365, 0.15), "noctis-8c1f": ("scenery", "balanced", 0.3968, 0.3696, 0.1217),
}
RESULTS = {
    75: {"ember-7f3a": (23215, 36.4255, 0.978607, 47.6044, 0.7825), "mira-5b8d": (12012, 38.4804, 0.980206, 51.5908, 0.5108), "solis-2c9e": (41688, 39.7621, 0.977743, 52.8799, 0.4107), "horizon-4e2a": (236207, 34.6326, 0.903669, 41.1312, 1.5733), "meadow-6d3b": (160150, 35.1287, 0.965276, 44.2735, 1.1145), "noctis-8c1f": (817182, 40.2382, 0.972645, 52.6663, 0.4219)},
    85: {"ember-7f3a": (34515, 38.7462, 0.98814, 49.5626, 0.6283), "mira-5b8d": (16322, 41.0165, 0.987784, 53.2826, 0.4313), "solis-2c9e": (62580, 42.6811, 0.987054, 54.4301, 0.3495), "horizon-4e2a": (439099, 37.2206, 0.932668, 44.4821, 1.1257), "meadow-6d3b": (228143, 39.9572, 0.98489, 48.008, 0.7549), "noctis-8c1f": (1240324, 42.3331, 0.982403, 54.1328, 0.3613)},
}
ROLLUPS = {
    75: {"overall": (6, 1290454, 37.4446, 0.963024, 48.3577, 0.8023, 0.5095), "people": (3, 76915, 38.2227, 0.978852, 50.6917, 0.568, 0.4633), "scenery": (3, 1213539, 36.6665, 0.947197, 46.0237, 1.0366, 0.5557), "balanced": (4, 1012559, 37.5682, 0.974184, 49.0338, 0.7074, 0.4756), "bright": (2, 277895, 37.1974, 0.940706, 47.0056, 0.992, 0.5772), "people|balanced": (2, 35227, 37.453, 0.979407, 49.5976, 0.6466, 0.4583), "people|bright": (1, 41688, 39.7621, 0.977743, 52.8799, 0.4107, 0.4732), "scenery|balanced": (2, 977332, 37.6834, 0.96896, 48.4699, 0.7682, 0.493), "scenery|bright": (1, 236207, 34.6326, 0.903669, 41.1312, 1.5733, 0.6811)},
    85: {"overall": (6, 2020983, 40.3258, 0.977156, 50.6497, 0.6085, 0.5095), "people": (3, 113417, 40.8146, 0.987659, 52.4251, 0.4697, 0.4633), "scenery": (3, 1907566, 39.837, 0.966654, 48.8743, 0.7473, 0.5557), "balanced": (4, 1519304, 40.5132, 0.985804, 51.2465, 0.544, 0.4756), "bright": (2, 501679, 39.9508, 0.959861, 49.4561, 0.7376, 0.5772), "people|balanced": (2, 50837, 39.8814, 0.987962, 51.4226, 0.5298, 0.4583), "people|bright": (1, 62580, 42.6811, 0.987054, 54.4301, 0.3495, 0.4732), "scenery|balanced": (2, 1468467, 41.1452, 0.983647, 51.0704, 0.5581, 0.493), "scenery|bright": (1, 439099, 37.2206, 0.932668, 44.4821, 1.1257, 0.6811)},
}


@pytest.mark.parametrize("q", [75, 85])
def test_published_rollups(spark, q):
    rows = [(f"photos/{SOURCES[n][0]}/{n}.jpg", *SOURCES[n][:2], *RESULTS[q][n], SOURCES[n][2]) for n in SOURCES]
    df = spark.createDataFrame(rows, "relative_path string, scene_group string, lighting_bucket string, bytes long, psnr double, ssim double, chroma_psnr double, weighted_chroma_mae double, source_mean_luma double")
    got = {r["key"]: (r["count"], r["total_bytes"], *[r[f"avg_{n}"] for n in rollup.MEANS]) for r in rollup.with_keys(rollup.rollup(df)).collect()}
    assert got == ROLLUPS[q]


def test_lighting(spark):
    df = spark.createDataFrame([(n, b, luma, dark, bright) for n, (_, b, luma, dark, bright) in SOURCES.items()], "n string, b string, luma double, dark double, bright double")
    assert df.where(quality.lighting_bucket(F.col("luma"), F.col("dark"), F.col("bright")) != F.col("b")).count() == 0
    only = df.select(quality.lighting_bucket(F.lit(0.9), F.lit(0.4), F.lit(0.9)).alias("x")).first()["x"]
    assert only == "dark"


def image(spark, f, n, image_id=1):
    return spark.createDataFrame([(image_id, y, x, *map(int, f(y, x))) for y in range(n) for x in range(n)], "image_id long, y int, x int, r int, g int, b int")


def test_metrics(spark):
    a = image(spark, lambda y, x: (90, 120, 200), 16)
    same = metrics.compare(a, a).first()
    assert (same["mae"], same["psnr"], same["ssim"], same["max_abs_error"]) == (0, 100, 1, 0)
    b = image(spark, lambda y, x: (90, 120, 224), 16)
    r = metrics.compare(a, b).first()
    assert r["max_abs_error"] == 24 and r["ycbcr"]["Cb"]["mae"] > 0 and r["ycbcr"]["Cr"]["mae"] > 0 and abs(r["mae"] - 8) < 1e-9
    assert metrics.compare(a, image(spark, lambda y, x: (1, 1, 1), 15)).count() == 0
    bad = metrics.mismatches(a.union(image(spark, lambda y, x: (1, 1, 1), 4, 2)), image(spark, lambda y, x: (1, 1, 1), 15))
    assert {tuple(x) for x in bad.collect()} == {(1, "dimensions"), (2, "missing")}
    edge = lambda y, x: (35, 90, 210) if x < 8 else (215, 60, 40)
    shifted = lambda y, x: np.clip(np.array(edge(y, x)) + ((18, -12, -22) if x in (7, 8) else (0, 0, 0)), 0, 255)
    e = metrics.artifacts(metrics.paired(image(spark, edge, 16), image(spark, shifted, 16))).first()
    assert e["weighted_chroma_mae"] > e["chroma_mae"]
    for v, name in ((18, "dark_fraction"), (240, "bright_fraction")):
        s = metrics.statistics(image(spark, lambda y, x, v=v: (v, v, v), 4)).first()
        assert s[name] > 0.99 and s["mean_chroma"] < 1e-6


def test_transforms(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(0, 255, (5, 64)).tolist() + [[128.0] * 64]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "block_id long, v array<double>")
    rows = df.select("v", blocks.dct(F.col("v")).alias("f")).select("v", "f", blocks.idct(F.col("f")).alias("back"), blocks.unzigzag(blocks.zigzag(F.col("v"))).alias("z")).collect()
    for r in rows:
        assert np.allclose(r["v"], r["back"]) and r["z"] == r["v"] and np.isclose(np.square(r["f"]).sum(), np.square(r["v"]).sum())
    assert np.allclose(rows[-1]["f"][1:], 0) and np.isclose(rows[-1]["f"][0], 1024)
    base = [quality.LUMA_BASE[z] for z in blocks.ZIGZAG]
    assert quality.steps(50) == base and quality.steps(50, bit_depth=10) == [4 * s for s in base]


def test_prediction(spark):
    above, left = [100 + 5 * i for i in range(8)], [80 + 10 * i for i in range(8)]
    df = spark.createDataFrame([(above, left, 128)], "above array<int>, left array<int>, corner int")
    one = lambda m, a="above", b="left", top=255: df.select(blocks.predict(m, F.col(a) if a else F.lit(None).cast("array<int>"), F.col(b) if b else F.lit(None).cast("array<int>"), F.col("corner"), top).alias("p")).first()["p"]
    assert one("DC") == [(sum(above) + sum(left) + 8) // 16] * 64
    assert one("V")[:8] == above and one("H")[::8] == left
    assert one("TM")[9] == left[1] + above[1] - 128 and one("DC_128") == [128] * 64 and one("DC_128", top=1023) == [512] * 64
    assert one("V", a=None) == [128] * 64
    from rasterloom.codec import lossy

    for n, m in enumerate(blocks.MODES):
        assert one(m) == lossy.prediction(n, np.array(above), np.array(left), 128, 255).tolist(), m
    mode = lambda a, b, c: spark.createDataFrame([(a, b, c)], "a array<int>, b array<int>, c int").select(blocks.neighbour_mode(F.col("a"), F.col("b"), F.col("c")).alias("m")).first()["m"]
    assert mode([130, 131, 131, 132, 132, 133, 133, 134], [130, 130, 131, 131, 132, 132, 133, 133], 130) == "TM"
    assert mode([200] * 8, [40] * 8, 128) == "DC" and mode(None, None, 0) == "DC_128" and mode([1] * 8, None, 0) == "V" and mode(None, [1] * 8, 0) == "H"


def test_frequencies(spark):
    from rasterloom.codec.rans import normalize

    rng = np.random.default_rng(3)
    tables = [[1, 1, 1, 1000, 500, 200, 50, 10], [5], rng.integers(1, 9, 300).tolist(), [100000, *[1] * 200], rng.integers(1, 4000, 40).tolist()]
    rows = [(k, s, int(n)) for k, t in enumerate(tables) for s, n in enumerate(t)]
    got = statistics.normalized(spark.createDataFrame(rows, "k int, symbol int, n long")).collect()
    for k, t in enumerate(tables):
        f = [r["freq"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["symbol"])]
        assert sum(f) == 4096 and min(f) >= 1 and f == normalize(t)


def test_metadata(spark):
    rows = [(1, 0, 5, 1, 9, "Hallo", "de"), (1, 1, 5, 1, 9, "Hello", "en"), (1, 2, 2, 1, 7, "1.5", None), (1, 3, 3, 1, 10, "no time", None), (1, 4, 2, 17, 14, "99", None)]
    e = spark.createDataFrame(rows, "image_id long, ord int, ns int, tag int, type_id int, value string, lang string")
    assert meta.title(e).first()["title"] == "Hallo" and meta.title(e, "en").first()["title"] == "Hello" and meta.title(e, "fr").count() == 0
    w = meta.wide(e).first()
    assert w["latitude"] == 1.5 and w["capture_us"] is None and w["longitude"] is None
    c = spark.createDataFrame([(1, 0, 5, 1, 10, "New", None), (1, 1, 9, 1, 1, "5", None), (1, 2, 9, 1, 1, "4", None)], "image_id long, seq int, ns int, tag int, type_id int, value string, lang string")
    got = [(r["ord"], r["ns"], r["value"]) for r in meta.upsert(e, c).orderBy("ord").collect()]
    assert got == [(0, 5, "New"), (1, 5, "Hello"), (2, 2, "1.5"), (3, 3, "no time"), (4, 2, "99"), (5, 9, "4")]
    assert meta.remove(e, 5, 1).count() == 3
    assert meta.to_json(e).first()["json"].startswith('{\n  "geo": {\n    "0x0001": 1.5,\n')


def test_text(spark):
    df = spark.createDataFrame([("Photos/A b/lake-7f_q75_yuv444.JPG",)], "p string")
    r = df.select(text.match_keys(text.stem(F.col("p"))).alias("k"), text.declared_format(F.col("p")).alias("f"), text.scene_group(F.lit("a.jpg")).alias("s"), text.micros_from_iso(F.lit("2021-01-01T00:00:00Z")).alias("t"), text.micros_from_iso(F.lit("nothing")).alias("z"), text.iso_from_micros(F.lit(1609459200123456)).alias("i")).first()
    assert r["k"] == ["lake_7f_q75_yuv444", "lake_7f", "7f"] and (r["f"], r["s"]) == ("jpeg", "root")
    assert (r["t"], r["z"], r["i"]) == (1609459200000000, 0, "2021-01-01T00:00:00.123456Z")


def test_matching(spark):
    f = spark.createDataFrame([("d", "d/lake_q75.wk"), ("d", "d/other.wk")], "folder string, path string")
    c = spark.createDataFrame([("d", "d/lake.png"), ("d", "d/Lake.jpg"), ("d", "d/hill.ppm")], "folder string, path string")
    got = {r["file"]: r["source"] for r in match.best_sources(f, c).collect()}
    assert got == {"d/lake_q75.wk": "d/Lake.jpg", "d/other.wk": "d/Lake.jpg"}  # a jpg's bonus is enough where nothing fits


def test_transfer(spark):
    df = spark.createDataFrame([(x / 20,) for x in range(21)], "v double")
    for there, back in ((colour.srgb_oetf, colour.srgb_eotf), (colour.bt709_oetf, colour.bt709_eotf), (colour.hlg_oetf, colour.hlg_inverse_oetf), (lambda v: colour.pq_oetf(v * 10000), lambda v: colour.pq_eotf(v) / 10000)):
        assert df.where(F.abs(back(there(F.col("v"))) - F.col("v")) > 1e-3).count() == 0


def test_resample_sends_no_pixels_to_all_tasks(spark):
    """Larger and smaller sizes than the image's, which lacks places and a whole row, against a loop; no join, whose side
    Spark could collect in the driver."""
    rng = np.random.default_rng(7)
    full = {i: rng.integers(0, 256, (h, w)) for i, (h, w) in enumerate([(5, 7), (1, 1), (16, 3)])}
    full[0][2], full[2][4, 1] = 0, 0
    rows = [(i, y, x, int(a[y, x])) for i, a in full.items() for y in range(a.shape[0]) for x in range(a.shape[1]) if a[y, x] or (y, x) == (0, 0)]
    rows += [(i, a.shape[0] - 1, a.shape[1] - 1, int(a[-1, -1])) for i, a in full.items() if not a[-1, -1]]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    place = lambda at, n, n2: min(max((at + 0.5) * n / n2 - 0.5, 0.0), n - 1.0)
    half = lambda v: math.floor(v + 0.5)
    for size in ((32, 32), (4, 2), (11, 7), (1, 1)):
        for smooth in (True, False):
            want = {}
            for i, a in full.items():
                h, w = a.shape
                for y in range(size[1]):
                    for x in range(size[0]):
                        sx, sy = place(x, w, size[0]), place(y, h, size[1])
                        x0, y0 = int(sx), int(sy)
                        x1, y1, tx, ty = min(x0 + 1, w - 1), min(y0 + 1, h - 1), sx - x0, sy - y0
                        mean = a[y0, x0] * (1 - tx) * (1 - ty) + a[y0, x1] * tx * (1 - ty) + a[y1, x0] * (1 - tx) * ty + a[y1, x1] * tx * ty
                        want[i, y, x] = half(round(mean, 9)) if smooth else int(a[half(sy), half(sx)])
            out = blocks.resample(px, size, ["v"], smooth)
            assert {(r["image_id"], r["y"], r["x"]): r["v"] for r in out.collect()} == want, (size, smooth)
            assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in blocks.completed(px)._jdf.queryExecution().optimizedPlan().toString()
