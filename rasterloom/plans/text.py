"""Path, name, format, time and markup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import table
from ..functions import text as T
from ..operators import match as M
from ..operators.order import numbered
from . import query

#: File names made of urls: folder, stem and ending, in mixed case.
_FILES = """fl AS (SELECT page_id, 'Photos/' || CASE page_id % 4 WHEN 0 THEN 'People' WHEN 1 THEN 'scenery\\Alps' WHEN 2 THEN './Night' ELSE '' END || '/' || regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^a-zA-Z0-9]', '-', 'g') || '_' || page_id || CASE page_id % 5 WHEN 0 THEN '_q75_yuv444' WHEN 1 THEN '_clean' ELSE '' END || CASE page_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.wk' WHEN 3 THEN '.ppm' WHEN 4 THEN '' ELSE '.jpeg' END AS path FROM pages)"""


def _files(spark, d) -> DataFrame:
    p, i = table(spark, d, "pages").select("page_id", "url"), F.col("page_id")
    folder = F.when(i % 4 == 0, "People").when(i % 4 == 1, "scenery\\Alps").when(i % 4 == 2, "./Night").otherwise("")
    name = F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), "[^a-zA-Z0-9]", "-")
    profile = F.when(i % 5 == 0, "_q75_yuv444").when(i % 5 == 1, "_clean").otherwise("")
    ending = F.when(i % 6 == 0, ".JPG").when(i % 6 == 1, ".png").when(i % 6 == 2, ".wk").when(i % 6 == 3, ".ppm").when(i % 6 == 4, "").otherwise(".jpeg")
    return p.select("page_id", F.concat(F.lit("Photos/"), folder, F.lit("/"), name, F.lit("_"), i.cast("string"), profile, ending).alias("path"))


_EXT = r"lower(regexp_extract(path, '\.([^./\\]*)$', 1))"


@query("src14_declared_format", f"WITH {_FILES} SELECT page_id, CASE WHEN {_EXT} = 'jpg' THEN 'jpeg' ELSE {_EXT} END AS format, CASE WHEN {_EXT} = '' THEN '' ELSE '.' || {_EXT} END AS ext FROM fl")
def declared_format(spark, d):
    return _files(spark, d).select("page_id", T.declared_format(F.col("path")).alias("format"), T.lower_extension(F.col("path")).alias("ext"))


_HEAD = "CASE event_id % 6 WHEN 0 THEN '524946460000000057454250' WHEN 1 THEN '89504E470D0A1A0A00' WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '503620' WHEN 4 THEN '52494646' ELSE 'FFD8' END"
_SNIFF = "CASE event_id % 6 WHEN 0 THEN 'webp' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'ppm' ELSE 'unknown' END"


def _heads(spark, d) -> DataFrame:
    i = F.col("event_id") % 6
    h = F.when(i == 0, "524946460000000057454250").when(i == 1, "89504E470D0A1A0A00").when(i == 2, "FFD8FFE0").when(i == 3, "503620").when(i == 4, "52494646").otherwise("FFD8")
    return table(spark, d, "events").select("event_id", F.unhex(h).alias("content"))


@query("src13_sniff_format", f"SELECT event_id, {_SNIFF} AS format FROM events")
def sniff_format(spark, d):
    return _heads(spark, d).select("event_id", T.sniff_format(F.col("content")).alias("format"))


@query("flt1_format_filter", f"SELECT event_id FROM events WHERE {_SNIFF} = 'jpeg'")
def format_filter(spark, d):
    return _heads(spark, d).where(T.format_filter(T.sniff_format(F.col("content")), "jpeg")).select("event_id")


@query("flt2_format_mismatch", f"WITH s AS (SELECT event_id, {_SNIFF} AS detected, CASE event_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'ppm' END AS declared FROM events) SELECT * FROM s WHERE detected <> 'unknown' AND detected <> declared")
def format_mismatch(spark, d):
    i = F.col("event_id") % 4
    s = _heads(spark, d).select("event_id", T.sniff_format(F.col("content")).alias("detected"), F.when(i == 0, "jpeg").when(i == 1, "png").when(i == 2, "webp").otherwise("ppm").alias("declared"))
    return s.where(T.format_mismatch(F.col("detected"), F.col("declared")))


@query("flt7_file_types", f"WITH {_FILES} SELECT page_id, {_EXT} = 'wk' AS container, {_EXT} IN ('jpg', 'jpeg', 'png', 'ppm') AS source_image FROM fl")
def file_types(spark, d):
    return _files(spark, d).select("page_id", T.is_container_file(F.col("path")).alias("container"), T.is_source_image(F.col("path")).alias("source_image"))


@query("src6_format_dispatch", f"WITH {_FILES} SELECT page_id, CASE WHEN {_EXT} = 'wk' THEN 'container' WHEN {_EXT} = 'ppm' THEN 'ppm' WHEN {_EXT} IN ('jpg', 'jpeg', 'png') THEN 'image' ELSE 'unsupported' END AS loader FROM fl")
def format_dispatch(spark, d):
    return _files(spark, d).select("page_id", T.loader_of(F.col("path")).alias("loader"))


_PORT = r"regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '^[./]+', '')"


@query("str6_portable_paths", f"WITH {_FILES}, r AS (SELECT page_id, path, CASE WHEN starts_with(path, 'Photos/') THEN substr(path, 8) ELSE path END AS rel FROM fl), p AS (SELECT *, {_PORT.replace('path', 'rel')} AS pr FROM r) SELECT page_id, {_PORT} AS portable, rel, CASE WHEN len(string_split(pr, '/')) <= 1 THEN 'root' ELSE lower(string_split(pr, '/')[1]) END AS scene, " + r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(rel, '\.[^./\\]*$', ''), '[\\/]+', '_', 'g'), '[^A-Za-z0-9._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS stem FROM p")
def portable_paths(spark, d):
    f = _files(spark, d).withColumn("rel", T.relative_path(F.col("path"), "Photos"))
    return f.select("page_id", T.portable_path(F.col("path")).alias("portable"), "rel", T.scene_group(F.col("rel")).alias("scene"), T.output_stem(F.col("rel")).alias("stem"))


@query("str7_profile_name", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'lossless' ELSE 'q' || CAST(round_even(least(greatest(value / 6, 0.0::DOUBLE), 100.0::DOUBLE), 0) AS INTEGER) || '_yuv' || CASE WHEN event_id % 2 = 0 THEN '444' ELSE '420' END END || CASE WHEN event_id % 3 = 0 THEN '' ELSE '_srcjpeg' END AS profile FROM events")
def profile_name(spark, d):
    i = F.col("event_id")
    name = T.profile_name(F.least(F.greatest(F.col("value") / 6, F.lit(0.0)), F.lit(100.0)), F.when(i % 2 == 0, "444").otherwise("420"), i % 5 == 0, F.when(i % 3 == 0, "any").otherwise("jpeg"))
    return table(spark, d, "events").select("event_id", name.alias("profile"))


_MT = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_STEM = r"regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"


@query("str8_match_text", f"WITH {_FILES} SELECT page_id, {_MT.format(_STEM)} AS name FROM fl")
def match_text(spark, d):
    return _files(spark, d).select("page_id", T.match_text(T.stem(F.col("path"))).alias("name"))


_KEYS = f"""nm AS (SELECT page_id, path, {_MT.format(_STEM)} AS whole FROM fl), wd AS (SELECT *, list_filter(string_split(whole, '_'), lambda w: w <> '') AS w FROM nm),
kp AS (SELECT *, least(greatest(1, coalesce(list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN NOT regexp_full_match(w[i], 'q[0-9]*|yuv444|yuv420|srcjpeg|lossless|lossy|clean') THEN i END)), 1)), len(w)) AS kept FROM wd),
ky AS (SELECT page_id, path, list_filter([whole, array_to_string(w[1:kept], '_'), CASE WHEN kept > 1 THEN array_to_string(w[2:kept], '_') END, CASE WHEN kept > 1 THEN w[kept] END, CASE WHEN kept > 2 THEN array_to_string(w[kept - 1:kept], '_') END], lambda k: k IS NOT NULL AND k <> '') AS keys FROM kp)"""


@query("str9_match_keys", f"WITH {_FILES}, {_KEYS} SELECT page_id, array_to_string(list_sort(list_distinct(keys)), ' ') AS keys FROM ky")
def match_keys(spark, d):
    return _files(spark, d).select("page_id", F.array_join(F.array_sort(T.match_keys(T.stem(F.col("path")))), " ").alias("keys"))


@query("set3_unique_keys", f"WITH {_FILES}, {_KEYS} SELECT page_id, CAST(len(list_distinct(keys)) AS INTEGER) AS n FROM ky")
def unique_keys(spark, d):
    return _files(spark, d).select("page_id", F.size(T.match_keys(T.stem(F.col("path")))).alias("n"))


_FOLDER = r"regexp_replace(path, '[^/\\]*$', '')"


def _in_folders(spark, d) -> DataFrame:
    return _files(spark, d).select(F.regexp_replace("path", r"[^/\\]*$", "").alias("folder"), "path")


_SCORE = "CASE WHEN k = '' OR name = '' THEN 0 WHEN k = name THEN 500 WHEN instr(k, name) > 0 THEN 280 WHEN instr(name, k) > 0 THEN 200 ELSE 0 END"


@query(
    "jn7_best_source",
    f"""WITH {_FILES}, {_KEYS}, kk AS (SELECT {_FOLDER} AS folder, path AS file, unnest(keys) AS k FROM ky WHERE {_EXT} = 'wk'), cs AS (SELECT {_FOLDER} AS folder, path AS source, {_MT.format(_STEM)} AS name, CASE WHEN {_EXT} IN ('jpg', 'jpeg') THEN 8 WHEN {_EXT} = 'png' THEN 4 ELSE 0 END AS bonus FROM fl WHERE {_EXT} IN ('jpg', 'jpeg', 'png', 'ppm')),
    sc AS (SELECT folder, file, source, max({_SCORE}) + bonus AS score FROM kk JOIN cs USING (folder) GROUP BY folder, file, source, bonus), rk AS (SELECT *, row_number() OVER (PARTITION BY folder, file ORDER BY score DESC, lower(source)) AS r FROM sc WHERE score > 0)
    SELECT f.folder, f.file, source, CAST(score AS INTEGER) AS score FROM (SELECT DISTINCT folder, file FROM kk) f LEFT JOIN (SELECT * FROM rk WHERE r = 1) USING (folder, file)""",
)
def best_source(spark, d):
    f = _in_folders(spark, d)
    return M.best_sources(f.where(T.is_container_file(F.col("path"))), f.where(T.is_source_image(F.col("path"))))


_SUG = f"""ff AS (SELECT {_FOLDER} AS folder, path, lower({_STEM}) AS st, CASE WHEN {_EXT} = '' THEN '' ELSE '.' || {_EXT} END AS ex FROM fl),
mm AS (SELECT w.folder, w.path AS wanted, f.path, CASE WHEN w.st = f.st THEN 100 ELSE 0 END + CASE WHEN w.st <> '' AND starts_with(f.st, w.st) THEN 40 ELSE 0 END + CASE WHEN w.st <> '' AND contains(f.st, w.st) THEN 20 ELSE 0 END + CASE WHEN w.st <> '' AND contains(w.st, f.st) THEN 10 ELSE 0 END + CASE WHEN w.ex = f.ex THEN 5 ELSE 0 END AS score FROM ff w JOIN ff f USING (folder) WHERE w.ex = '' OR w.ex = f.ex)"""


@query("jn8_suggestions", f"WITH {_FILES}, {_SUG}, r AS (SELECT folder, wanted, CAST(row_number() OVER (PARTITION BY folder, wanted ORDER BY score DESC, length(path), path) AS INTEGER) AS rank, path, score FROM mm WHERE score > 0) SELECT * FROM r WHERE rank <= 3")
def suggestions(spark, d):
    f = _in_folders(spark, d)
    return M.suggestions(f, f)


@query("top4_first_suggestion", f"WITH {_FILES}, {_SUG}, r AS (SELECT folder, wanted, row_number() OVER (PARTITION BY folder, wanted ORDER BY score DESC, length(path), path) AS rank, path, score FROM mm WHERE score > 0) SELECT folder, wanted, path, score FROM r WHERE rank = 1")
def first_suggestion(spark, d):
    f = _in_folders(spark, d)
    return M.suggestions(f, f, 1).drop("rank")


@query("srt1_path_order", f"WITH {_FILES} SELECT page_id, CAST(row_number() OVER (ORDER BY lower(path), page_id) AS INTEGER) AS n FROM fl")
def path_order(spark, d):
    f = _files(spark, d).select("page_id", F.lower("path").alias("lower"))
    return numbered(f, ["lower", "page_id"]).select("page_id", (F.col("n") + 1).cast("int").alias("n"))


def _fixed(x: str) -> str:
    return f"CASE WHEN {x} >= 100 THEN printf('%.0f', {x}) WHEN {x} >= 10 THEN printf('%.1f', {x}) ELSE printf('%.2f', {x}) END"


_UNITS = " ".join(f"WHEN n < {1024 ** (k + 1) if k < 3 else 1 << 62} THEN {_fixed(f'(n / {1024**k}.0::DOUBLE)')} || ' {u}'" for k, u in enumerate(("KB", "MB", "GB"), 1))


@query("str10_human_size", f"WITH t AS (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 37 + 5 AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' {_UNITS} END AS size FROM t")
def human_size(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.human_size((F.col("o_orderkey") * F.col("o_orderkey") * 37 + 5).cast("bigint")).alias("size"))


@query("str12_size_ratio", "SELECT event_id, round(CASE WHEN user_id % 7 = 0 THEN 0.0::DOUBLE ELSE CAST(event_id AS DOUBLE) / (user_id % 7) END, 6) AS ratio FROM events")
def size_ratio(spark, d):
    from ..functions.quality import size_ratio

    return table(spark, d, "events").select("event_id", F.round(size_ratio(F.col("event_id").cast("double"), F.col("user_id") % 7), 6).alias("ratio"))


@query("str1_iso_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS iso FROM (SELECT event_id, make_timestamp(epoch_us(ts) + CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END) AS ts FROM events)")
def iso_format(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(0)
    return table(spark, d, "events").select("event_id", T.iso_from_micros(us).alias("iso"))


@query("str2_iso_parse", "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 0 ELSE (epoch_us(ts) // 1000000) * 1000000 + CASE WHEN event_id % 2 = 0 THEN (event_id % 1000) * 1000 ELSE 0 END END AS us FROM events")
def iso_parse(spark, d):
    i = F.col("event_id")
    text = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(i % 2 == 0, F.concat(F.lit("."), F.lpad((i % 1000).cast("string"), 3, "0"))).otherwise(""), F.lit("+05:00"))
    return table(spark, d, "events").select("event_id", T.micros_from_iso(F.when(i % 10 == 3, "no time at all").otherwise(text)).alias("us"))


@query("str3_uuid", "WITH h AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events) SELECT event_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uuid, h AS parsed, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || substr('89ab', 1 + (CAST('0x' || h[17:17] AS INTEGER) % 4), 1) || h[18:20] || '-' || h[21:32] AS v4 FROM h")
def uuids(spark, d):
    data = F.unhex(F.md5(F.col("event_id").cast("string")))
    t = table(spark, d, "events").select("event_id", T.uuid_text(data).alias("uuid"), T.uuid_v4(data).alias("v4"))
    return t.select("event_id", "uuid", F.lower(F.hex(T.uuid_bytes(F.col("uuid")))).alias("parsed"), "v4")


@query("str4_json_escape", r"""SELECT page_id, replace(replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS escaped FROM pages""")
def json_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.json_escape(F.col("html")).alias("escaped"))


@query("str5_rational", "SELECT event_id, round(CASE WHEN user_id % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(event_id AS DOUBLE) / (user_id % 5) END, 6) AS v FROM events")
def rational(spark, d):
    return table(spark, d, "events").select("event_id", F.round(T.rational(F.col("event_id").cast("double"), F.col("user_id") % 5), 6).alias("v"))


@query("src12_xmp_read", "SELECT page_id, CASE WHEN contains(html, '<title>') THEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title, CASE WHEN contains(html, '<p>') THEN regexp_extract(html, '(?s)<p>(.*?)</p>', 1) END AS first_p FROM pages")
def xmp_read(spark, d):
    return table(spark, d, "pages").select("page_id", T.tag_text(F.col("html"), "title").alias("title"), T.tag_text(F.col("html"), "p").alias("first_p"))


@query("snk6_xmp_write", "SELECT page_id, '<dc:title>' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</dc:title>' AS xmp FROM pages")
def xmp_write(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("<dc:title>"), T.xml_escape(F.col("url")), F.lit("</dc:title>")).alias("xmp"))


@query("met15_gps_degrees", "SELECT event_id, round(CASE WHEN event_id % 4 IN (1, 3) THEN -1 ELSE 1 END * (user_id % 90 + (event_id % 60) / 60.0::DOUBLE + (value / 10) / 3600.0::DOUBLE), 8) AS degrees FROM events")
def gps_degrees(spark, d):
    i = F.col("event_id")
    ref = F.when(i % 4 == 0, "N").when(i % 4 == 1, "S").when(i % 4 == 2, "E").otherwise("W")
    return table(spark, d, "events").select("event_id", F.round(T.gps_degrees((F.col("user_id") % 90).cast("double"), (i % 60).cast("double"), F.col("value") / 10, ref), 8).alias("degrees"))


@query("met16_gps_timestamp", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch_us(date_trunc('day', ts)) + CAST(floor(((event_id % 24) * 3600 + (event_id % 60) * 60 + 12.5::DOUBLE) * 1000000 + 0.5) AS BIGINT) END AS us FROM events")
def gps_timestamp(spark, d):
    i = F.col("event_id")
    date = F.when(i % 9 == 0, "1969:05:01").otherwise(F.date_format("ts", "yyyy:MM:dd"))
    return table(spark, d, "events").select("event_id", T.gps_micros(date, i % 24, i % 60, F.lit(12.5)).cast("bigint").alias("us"))


@query("met17_altitude_sign", "SELECT event_id, round(CAST(CAST(CASE WHEN event_id % 2 = 1 THEN -value ELSE value END AS FLOAT) AS DOUBLE), 3) AS altitude FROM events")
def altitude_sign(spark, d):
    return table(spark, d, "events").select("event_id", F.round(T.gps_altitude(F.col("value"), F.col("event_id") % 2).cast("double"), 3).alias("altitude"))
