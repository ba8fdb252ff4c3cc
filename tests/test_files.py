"""Files, sources, reports, order and matching on small fixtures."""

import json
import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.codec import Reader
from rasterloom.codec import streams as ST
from rasterloom.codec.container import Header, Tile, read_chunks, write
from rasterloom.functions import binary, surface, text
from rasterloom.operators import blocks, match, meta, metrics, order, report
from rasterloom.sources import container as SC
from rasterloom.sources import files as SF


def test_no_two_images_share_a_file(spark, tmp_path):
    ids = ["img.1", "img.2", "a/p", "b/p", "a%2Fp", "ü/é", "x" * 300 + "1", "x" * 300 + "2", ".."]
    files = spark.createDataFrame([(i, write(Header(8, 8), [Tile(0, 0, 1, i.encode())])) for i in ids], "path string, content binary")
    SC.write(SC.parsed(files).drop("_error_code"), f"file://{tmp_path}/out")
    names = os.listdir(tmp_path / "out")
    assert len(names) == len(ids) and all(n.endswith(".wk") for n in names)
    for back in (SC.read(spark, f"file://{tmp_path}/out", "tiles"), spark.read.format("rasterchunks").option("table", "tiles").load(str(tmp_path / "out"))):
        assert sorted(bytes(r["payload"]).decode() for r in back.collect()) == sorted(ids)
    (tmp_path / "out" / "bad.wk").write_bytes(b"no")
    assert SC.read(spark, f"file://{tmp_path}/out", "frames").where("_error_code = 'InvalidMagic'").count() == 1
    assert spark.read.format("rasterchunks").option("table", "frames").load(f"file://{tmp_path}/nothing").count() == 0


def test_collect(spark, tmp_path):
    for name in ("b/Z.jpg", "b/a.PNG", "A/c.ppm", "A/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: [r["path"].rpartition(str(tmp_path))[2] for r in df.orderBy("n").collect()]
    assert names(SF.collect(spark, str(tmp_path), text.is_source_image)) == ["/A/c.ppm", "/b/a.PNG", "/b/Z.jpg"]
    (tmp_path / "top.jpg").write_bytes(b"x")
    assert names(SF.collect(spark, str(tmp_path), text.is_source_image)) == ["/top.jpg"]
    assert len(names(SF.collect(spark, str(tmp_path), text.is_source_image, recursive=True))) == 4
    assert SF.collect(spark, str(tmp_path / "none"), text.is_source_image).count() == 0


def test_clustering():
    """A bank whose ranks may share tables is smaller, reads back alike, and never grows."""
    q = np.zeros((16, 64), np.int64)
    q[:, 0] = [i % 5 - 2 for i in range(16)]
    q[:, 1] = [2] * 4 + [1] * 4 + [0] * 4 + [-1] * 4
    q[:, 2] = [2] * 3 + [1] * 4 + [0] * 4 + [-1] * 5
    syntax, spans = ST.Syntax(bank=True), np.full(16, 3)
    assert len(ST.write_planes([q], spans, 3, syntax)) < len(ST.write_planes([q], spans, 3, replace(syntax, cluster=False)))
    rng = np.random.default_rng(2)
    for flags in (16, 20, 52, 116, 244):
        planes = [(rng.laplace(size=(40, 64)) * np.linspace(5, 0.2, 64)).astype(int) for _ in range(2)]
        live = np.logical_or(*[p != 0 for p in planes])
        spans = np.where(live.any(axis=1), 64 - np.argmax(live[:, ::-1], axis=1), 0)
        s = ST.with_flags(flags)
        data = ST.write_planes(planes, spans, int(spans.max()), s)
        assert len(data) <= len(ST.write_planes(planes, spans, int(spans.max()), replace(s, cluster=False)))
        assert all((a == b).all() for a, b in zip(ST.read_planes(Reader(data), 2, spans, int(spans.max()), s), planes, strict=True))
    assert ST.write_planes([np.zeros((0, 64), np.int64)], np.zeros(0, int), 0, syntax)


def test_report(spark):
    px = spark.createDataFrame([(1, y, x, 10 * y, 9 * x, 90) for y in range(9) for x in range(9)], "image_id long, y int, x int, r int, g int, b int")
    other = px.withColumn("g", F.col("g") + 3)
    row = metrics.compare(px, other).withColumns({"reference_path": F.lit('a "b"'), "candidate_path": F.lit("c"), "width": F.lit(9), "height": F.lit(9), "bit_depth": F.lit(8), "reference_bytes": F.lit(0), "candidate_bytes": F.lit(5)})
    got = row.select("*", report.report_json().alias("json"), report.report_text().alias("text")).first()
    j = json.loads(got["json"])
    assert j["reference_path"] == 'a "b"' and j["size_ratio"] == 0 and j["compared_alpha"] is False and j["channels"]["G"]["mae"] == 3
    for k in ("mae", "mse", "psnr", "ssim"):
        assert abs(j[k] - got[k]) <= 5e-7
    assert abs(j["artifacts"]["weighted_luma_mae"] - got["weighted_luma_mae"]) <= 5e-7
    lines = got["text"].splitlines()
    assert "Size ratio" not in got["text"] and lines[2] == "Dimensions:     9x9" and "G: MAE=3.0000 MSE=9.0000" in got["text"]
    half = spark.range(1).select(*[report.fixed(F.lit(v), 4).alias(f"c{i}") for i, v in enumerate((0.03125, 0.09375, 1e-7, 12345678.5))]).first()
    assert list(half) == ["0.0312", "0.0938", "0.0000", "12345678.5000"]


def test_rollup_files(spark):
    rows = spark.createDataFrame([("a", "dark", "p1", 10, *[1.0] * 5), ("a", "bright", "p2", 20, *[2.0] * 5), ("b", "dark", "p3", 5, *[4.0] * 5)], "scene_group string, lighting_bucket string, relative_path string, bytes long, psnr double, ssim double, chroma_psnr double, weighted_chroma_mae double, source_mean_luma double")
    got = {r["path"]: bytes(r["content"]) for r in report.rollup_files(rows, "q", "in").collect()}
    assert set(got) == {"rollup/rollup_q.json", "a/rollup/rollup_q.json", "b/rollup/rollup_q.json"}
    assert all(v.startswith(b"\xef\xbb\xbf") for v in got.values())
    top = json.loads(got["rollup/rollup_q.json"].decode("utf-8-sig"))
    assert top["overall"]["total_bytes"] == 35 and [x["name"] for x in top["by_lighting_bucket"]] == ["bright", "dark"] and len(top["by_scene_and_lighting"]) == 3
    assert [x["name"] for x in json.loads(got["a/rollup/rollup_q.json"].decode("utf-8-sig"))["by_lighting_bucket"]] == ["bright", "dark"]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbered(spark, n):
    keys = random.Random(n).sample(range(10**6), n)
    df = spark.createDataFrame([(k if k % 7 else None, k) for k in keys], "a long, b long")
    want = sorted(keys, key=lambda k: (k % 7 != 0, k if k % 7 else 0, k))
    assert [r["b"] for r in order.numbered(df, ["a", "b"]).orderBy("n").collect()] == want
    assert sorted(r["n"] for r in order.numbered(df, ["a", "b"]).collect()) == list(range(n))


def test_matching_against_all_pairs(spark):
    """The joins by parts of names against every pair of a folder."""
    rng = random.Random(3)
    words = ["a", "ab", "abc", "b", "night", "q75", "lossless", "x1", ""]
    path = lambda ending: "F/" + "_".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + ending
    wanted = sorted({path(e) for e in (".wk", ".jpg", "") for _ in range(25)})
    files = sorted({path(e) for e in (".jpg", ".PNG", ".ppm", ".wk", "") for _ in range(25)})
    df = lambda xs: spark.createDataFrame([("F/", x) for x in xs], "folder string, path string")
    both = df(wanted).withColumnRenamed("path", "w").join(df(files), "folder")
    keys, name = text.match_keys(text.stem(F.col("w"))), text.match_text(text.stem(F.col("path")))
    ext = text.lower_extension(F.col("path"))
    score = F.array_max(F.transform(keys, lambda k: text.match_score(k, name))) + F.when(ext.isin(".jpg", ".jpeg"), 8).when(ext == ".png", 4).otherwise(0)
    pairs = [tuple(r) for r in both.select("w", "path", score.alias("s")).where("s > 0").collect()]
    want = {w: min(((-s, p.lower(), p) for x, p, s in pairs if x == w), default=(None, None, None)) for w in wanted}
    got = {r["file"]: (r["source"], r["score"]) for r in match.best_sources(df(wanted), df(files)).collect()}
    assert got == {w: (p, -s if s is not None else None) for w, (s, _, p) in want.items()}

    stem, end = (lambda p: p.rpartition("/")[2].rpartition(".")[0] or p.rpartition("/")[2]), (lambda p: "." + p.rpartition(".")[2] if "." in p else "")
    expected = set()
    for w in wanted:
        ws, we, found = stem(w).lower(), end(w).lower(), []
        for p in files:
            fs, fe = stem(p).lower(), end(p).lower()
            if we in ("", fe):
                s = 100 * (ws == fs) + bool(ws) * (40 * fs.startswith(ws) + 20 * (ws in fs) + 10 * (fs in ws)) + 5 * (we == fe)
                found += [(-s, len(p), p)] if s else []
        expected |= {(w, n, p, -s) for n, (s, _, p) in enumerate(sorted(found)[:3], 1)}
    assert {(r["wanted"], r["rank"], r["path"], r["score"]) for r in match.suggestions(df(wanted), df(files)).collect()} == expected


def test_completed(spark):
    px = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 2, 7)], "image_id long, y int, x int, v int")
    assert {(r["y"], r["x"]): r["v"] for r in blocks.completed(px).collect()} == {(0, 0): 5, (0, 1): 0, (0, 2): 0, (1, 0): 0, (1, 1): 0, (1, 2): 7}


def test_little_endian(spark):
    data = bytes(range(250, 256)) + bytes(range(6))
    df = spark.createDataFrame([(data,)], "b binary")
    for at in range(12):
        for size in (1, 2, 4, 8):
            want = int.from_bytes(data[at : at + size], "little", signed=size == 8) if at + size <= 12 else None
            assert df.select(binary.le_number(F.col("b"), at, size)).first()[0] == want
            assert df.select(binary.le_number(F.col("b"), at, size, signed=True)).first()[0] == (int.from_bytes(data[at : at + size], "little", signed=True) if at + size <= 12 else None)
    for n in (0, 1, -1, 255, 65536, -(2**63), 2**63 - 1):
        assert bytes(spark.range(1).select(binary.le_bytes(F.lit(n), 8)).first()[0]) == n.to_bytes(8, "little", signed=True)


def test_typed_json(spark):
    rows = [(1, 0, 3, 1, 14, "1500000", None, None), (1, 1, 1, 2, 7, "0.1", None, None), (1, 2, 1, 2, 7, "1.0E20", None, None), (1, 3, 1, 3, 7, "2.5E-7", None, None), (1, 4, 1, 4, 12, "[1, 2]", None, None), (1, 5, 7, 1, 13, '[{"tag": 1, "type": 10, "value": "x\\"y"}, {"tag": 5, "type": 7, "value": "0.5"}]', None, None), (1, 6, 10, 9, 99, None, None, bytearray(b"??")), (1, 7, 5, 1, 9, "t", "", None), (1, 8, 1, 5, 8, "1/-3", None, None)]
    df = spark.createDataFrame(rows, "image_id long, ord int, ns int, tag int, type_id int, value string, lang string, opaque binary")
    text_ = meta.to_json(df).first()["json"]
    got = json.loads(text_, object_pairs_hook=list)
    assert dict(got)["capture"] == [("0x0002", 0.1), ("0x0002", 1e20), ("0x0003", 2.5e-7), ("0x0004", [1, 2]), ("0x0005", [("numerator", 1), ("denominator", -3)])]
    assert dict(got)["time"] == [("0x0001", "1970-01-01T00:00:01.500000Z")] and dict(got)["region"] == [("0x0001", [("1", 'x"y'), ("5", 0.5)])]
    assert dict(got)["custom"] == [("0x0009", "<opaque 2 bytes>")] and dict(got)["content"] == [("0x0001", [("default", "t")])]
    assert "1e+20" in text_ and "2.5e-07" in text_


def test_sql_surface(spark):
    surface.register(spark)
    row = spark.sql("SELECT psnr(0D) AS p, lighting_bucket(0.9D, 0.4D, 0.9D) AS l, sniff_format(X'FFD8FF00') AS s, declared_format('a.JPG') AS d, scene_group('People/x.jpg') AS g, round(pq_eotf(pq_oetf(100D)), 6) AS e").first()
    assert tuple(row) == (100.0, "dark", "jpeg", "jpeg", "people", 100.0)
    block = __import__("rasterloom.codec.metablock", fromlist=["x"])
    data = write(Header(8, 8), [Tile(0, 0, 1, b"x")], block.pack([block.Entry(5, 1, 10, "title")]))
    spark.createDataFrame([(data, read_chunks(data)[1][2])], "content binary, block binary").createOrReplaceTempView("one_file")
    assert [r["type"] for r in spark.sql("SELECT c.type FROM one_file, LATERAL parse_container(content) c").collect()] == ["FHDR", "META", "TILE", "FEND"]
    assert spark.sql("SELECT m.value FROM one_file, LATERAL parse_meta(block) m").first()[0] == "title"
    assert spark.sql("SELECT count(*) FROM one_file, LATERAL exif(content)").first()[0] == 0


def test_streams(spark, tmp_path):
    """Files as they arrive, and errors by windows of time."""
    from rasterloom import streaming

    folder = f"file://{tmp_path}/in"
    SF.write_files(spark.createDataFrame([(f"{i}.wk", write(Header(8 + i, 8), [Tile(0, 0, 1, b"x")])) for i in range(3)] + [("bad.wk", b"no")], "path string, content binary"), folder)

    def all_of(df, mode="append"):
        name = f"t{random.randrange(10**9)}"
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    got = all_of(streaming.incoming(spark, folder, "frames"))
    assert sorted(r["width"] or 0 for r in got) == [0, 8, 9, 10] and {r["_error_code"] for r in got} == {None, "InvalidMagic"}
    rows = [("2024-01-01 00:01:00", 1.0, 2.0), ("2024-01-01 00:04:00", 5.0, 2.0), ("2024-01-01 00:06:00", 0.0, 0.0)]
    spark.createDataFrame(rows, "ts string, a double, c double").write.json(f"{tmp_path}/pairs")
    pairs = spark.readStream.schema("ts timestamp, a double, c double").json(f"{tmp_path}/pairs")
    out = all_of(streaming.windowed_errors(pairs), "complete")
    assert sorted((r["n"], r["mae"], r["mse"]) for r in out) == [(1, 0.0, 0.0), (2, 2.0, 5.0)]


def test_table_function_makes_each_file_once(spark):
    """On many tasks, and not again for the ids of what is no file."""
    import __spark_entry__ as entry

    df = entry.queries()["sql_table_functions"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert df.rdd.getNumPartitions() >= 32


def test_files_are_written_of_images_made_once(spark, monkeypatch):
    """An image's file and the file beside it come of one row."""
    from rasterloom.plans import files as plans_files

    seen = []
    monkeypatch.setattr(plans_files.SF, "write_files", lambda df, to: seen.append(df))
    plans_files._written(spark, "/root/testdata/sf0.001")
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
