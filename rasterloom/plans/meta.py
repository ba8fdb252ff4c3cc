"""Metadata queries: entries are made of events, sixteen to an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import table
from ..operators import meta as M
from ..schemas import NAMESPACES
from . import query

_EN = """en AS (SELECT event_id // 16 AS image_id, CAST(event_id % 16 AS INTEGER) AS ord, CAST(1 + user_id % 12 AS INTEGER) AS ns, CAST(1 + (event_id + user_id) % 5 AS INTEGER) AS tag,
  CAST(CASE WHEN user_id % 3 = 0 THEN 9 ELSE 10 END AS INTEGER) AS type_id, event_type || ' "' || event_id AS value, CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'fr' END END AS lang FROM events)"""


def _entries(spark, d) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select(
        F.floor(i / 16).cast("bigint").alias("image_id"), (i % 16).cast("int").alias("ord"), (1 + u % 12).cast("int").alias("ns"), (1 + (i + u) % 5).cast("int").alias("tag"),
        F.when(u % 3 == 0, 9).otherwise(10).alias("type_id"), F.concat("event_type", F.lit(' "'), i.cast("string")).alias("value"), F.when(u % 3 == 0, F.when(i % 2 == 0, "en").otherwise("fr")).alias("lang"),
    )


@query("met3_get", f"WITH {_EN}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS k FROM en WHERE ns = 5 AND tag = 1) SELECT image_id, ord, type_id, value, lang FROM r WHERE k = 1")
def get(spark, d):
    return M.get(_entries(spark, d), 5, 1)


_CH = "ch AS (SELECT image_id, ns, tag, arg_min(struct_pack(seq := seq, value := value, type_id := type_id, lang := lang), seq) AS f FROM cs GROUP BY ALL)"


@query(
    "met4_set",
    f"""WITH {_EN}, cs AS (SELECT image_id, ord AS seq, CAST(5 AS INTEGER) AS ns, CAST(1 + ord % 3 AS INTEGER) AS tag, CAST(10 AS INTEGER) AS type_id, 'new ' || ord AS value, CAST(NULL AS VARCHAR) AS lang FROM en WHERE ord IN (2, 5, 9, 10)),
    lw AS (SELECT image_id, ns, tag, min(seq) AS born, arg_max(type_id, seq) AS type_id, arg_max(value, seq) AS value FROM cs GROUP BY ALL), fo AS (SELECT image_id, ns, tag, min(ord) AS first FROM en GROUP BY ALL),
    k AS (SELECT en.image_id, en.ord AS o, 0 AS s, en.ns, en.tag, CASE WHEN lw.value IS NOT NULL AND en.ord = fo.first THEN lw.type_id ELSE en.type_id END AS type_id, CASE WHEN lw.value IS NOT NULL AND en.ord = fo.first THEN lw.value ELSE en.value END AS value, CASE WHEN lw.value IS NOT NULL AND en.ord = fo.first THEN NULL ELSE en.lang END AS lang FROM en JOIN fo USING (image_id, ns, tag) LEFT JOIN lw USING (image_id, ns, tag)
      UNION ALL SELECT lw.image_id, 1000, born, ns, tag, type_id, value, NULL FROM lw ANTI JOIN fo USING (image_id, ns, tag))
    SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY o, s) - 1 AS INTEGER) AS ord, ns, tag, type_id, value, lang FROM k""",
)
def set_(spark, d):
    e = _entries(spark, d)
    c = e.where("ord IN (2, 5, 9, 10)").select("image_id", F.col("ord").alias("seq"), F.lit(5).alias("ns"), (1 + F.col("ord") % 3).alias("tag"), F.lit(10).alias("type_id"), F.concat(F.lit("new "), F.col("ord").cast("string")).alias("value"), F.lit(None).cast("string").alias("lang"))
    return M.upsert(e, c)


@query("met5_remove", f"WITH {_EN} SELECT * FROM en WHERE NOT (ns = 5 AND tag = 1)")
def remove(spark, d):
    return M.remove(_entries(spark, d), 5, 1)


_MERGE = f"""WITH {_EN}, dst AS (SELECT * FROM en WHERE ord < 8), src AS (SELECT image_id, ns, tag, min(ord) AS seq, arg_min(type_id, ord) AS type_id, arg_min(value, ord) AS value, arg_min(coalesce(lang, ''), ord) AS lang FROM en WHERE ord >= 8 GROUP BY ALL),
fo AS (SELECT image_id, ns, tag, min(ord) AS first FROM dst GROUP BY ALL),
k AS (SELECT d.image_id, d.ord AS o, 0 AS s, d.ns, d.tag, CASE WHEN s.value IS NOT NULL AND d.ord = first THEN s.type_id ELSE d.type_id END AS type_id, CASE WHEN s.value IS NOT NULL AND d.ord = first THEN s.value ELSE d.value END AS value, CASE WHEN s.value IS NOT NULL AND d.ord = first THEN nullif(s.lang, '') ELSE d.lang END AS lang FROM dst d JOIN fo USING (image_id, ns, tag) LEFT JOIN src s USING (image_id, ns, tag)
  UNION ALL SELECT image_id, 1000, seq, ns, tag, type_id, value, nullif(lang, '') FROM src ANTI JOIN fo USING (image_id, ns, tag))
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY o, s) - 1 AS INTEGER) AS ord, ns, tag, type_id, value, lang FROM k"""


@query("jn9_metadata_merge", _MERGE)
@query("met14_merge", _MERGE)
def merge(spark, d):
    e = _entries(spark, d)
    return M.merge(e.where("ord < 8"), e.where("ord >= 8"))


_TY = """ty AS (SELECT o_orderkey // 8 AS image_id, CAST(o_orderkey % 8 AS INTEGER) AS ord, CAST(CASE o_orderkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 5 END AS INTEGER) AS ns, CAST(CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 17 ELSE 1 END AS INTEGER) AS tag,
  CAST(CASE WHEN o_orderkey % 8 <= 1 THEN CASE WHEN o_custkey % 4 = 0 THEN 10 ELSE 7 END WHEN o_orderkey % 8 = 2 THEN 10 WHEN o_orderkey % 8 IN (3, 4) THEN CASE WHEN o_custkey % 5 = 0 THEN 10 ELSE 14 END ELSE 9 + o_custkey % 2 END AS INTEGER) AS type_id,
  CAST(o_custkey AS VARCHAR) AS value, CASE WHEN o_orderkey % 8 >= 5 AND o_custkey % 2 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'de' ELSE 'en' END END AS lang FROM orders WHERE o_custkey % 6 <> 1)"""


def _typed(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = k % 8
    pick = lambda *xs: F.when(m == 0, xs[0]).when(m == 1, xs[1]).when(m == 2, xs[2]).when(m == 3, xs[3]).when(m == 4, xs[4]).otherwise(xs[5])
    kind = F.when(m <= 1, F.when(c % 4 == 0, 10).otherwise(7)).when(m == 2, 10).when(m.isin(3, 4), F.when(c % 5 == 0, 10).otherwise(14)).otherwise(9 + c % 2)
    return table(spark, d, "orders").where(c % 6 != 1).select(
        F.floor(k / 8).cast("bigint").alias("image_id"), m.cast("int").alias("ord"), pick(2, 2, 4, 3, 2, 5).alias("ns"), pick(1, 2, 4, 1, 17, 1).alias("tag"), kind.cast("int").alias("type_id"), c.cast("string").alias("value"),
        F.when((m >= 5) & (c % 2 == 0), F.when(c % 3 == 0, "de").otherwise("en")).alias("lang"),
    )


_FIRST = "arg_min(struct_pack(t := type_id, v := value), ord) FILTER (WHERE ns = {0} AND tag = {1})"


@query(
    "met6_typed_getters",
    f"""WITH {_TY}, g AS (SELECT image_id, {_FIRST.format(2, 1)} AS lat, {_FIRST.format(2, 2)} AS lon, {_FIRST.format(4, 4)} AS lic, {_FIRST.format(3, 1)} AS utc, {_FIRST.format(2, 17)} AS gts, {_FIRST.format(5, 1)} AS ti FROM ty GROUP BY image_id)
    SELECT image_id, CAST(CASE WHEN lat.t = 7 THEN lat.v END AS DOUBLE) AS latitude, CAST(CASE WHEN lon.t = 7 THEN lon.v END AS DOUBLE) AS longitude, CASE WHEN lic.t = 10 THEN lic.v END AS license,
    CAST(CASE WHEN utc IS NOT NULL THEN CASE WHEN utc.t = 14 THEN utc.v END WHEN gts.t = 14 THEN gts.v END AS BIGINT) AS capture_us, CASE WHEN ti.t IN (9, 10) THEN ti.v END AS title FROM g""",
)
def typed_getters(spark, d):
    return M.wide(_typed(spark, d))


@query("met7_capture_time", f"WITH {_TY}, g AS (SELECT image_id, {_FIRST.format(3, 1)} AS utc, {_FIRST.format(2, 17)} AS gts FROM ty GROUP BY image_id) SELECT image_id, CAST(CASE WHEN utc IS NOT NULL THEN CASE WHEN utc.t = 14 THEN utc.v END WHEN gts.t = 14 THEN gts.v END AS BIGINT) AS capture_us FROM g")
def capture_time(spark, d):
    return M.wide(_typed(spark, d)).select("image_id", "capture_us")


@query("met8_title", f"WITH {_TY}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS k FROM ty WHERE ns = 5 AND tag = 1 AND (type_id = 10 OR (type_id = 9 AND lang = 'de'))) SELECT image_id, value AS title FROM r WHERE k = 1")
def title(spark, d):
    return M.title(_typed(spark, d), "de")


@query("met9_regions", "SELECT s_suppkey // 4 AS image_id, CAST(s_suppkey % 4 AS INTEGER) AS ord, s_name AS name, 'face' AS type, CAST(s_nationkey AS VARCHAR) AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'P' || s_suppkey END AS person_name, CAST(NULL AS VARCHAR) AS object_class FROM supplier")
def regions(spark, d):
    k = F.col("s_suppkey")
    item = lambda tag, v: F.struct(F.lit(tag).alias("tag"), v.alias("value"))
    items = F.array(item(1, F.col("s_name")), item(2, F.lit("face")), item(5, F.col("s_nationkey").cast("string")))
    items = F.when(k % 2 == 0, F.concat(items, F.array(item(6, F.concat(F.lit("P"), k.cast("string")))))).otherwise(items)
    e = table(spark, d, "supplier").select(F.floor(k / 4).cast("bigint").alias("image_id"), (k % 4).cast("int").alias("ord"), F.lit(7).alias("ns"), F.lit(1).alias("tag"), F.lit(13).alias("type_id"), F.to_json(items).alias("value"), F.lit(None).cast("string").alias("lang"))
    return M.regions(e)


_NS = "CASE ns " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in NAMESPACES.items()) + " ELSE 'unknown_' || ns END"


@query("met10_namespace_name", f"WITH {_EN} SELECT image_id, ord, {_NS} AS name FROM en")
def namespace_name(spark, d):
    return _entries(spark, d).select("image_id", "ord", M.namespace_name(F.col("ns")).alias("name"))


_KEY = "CASE event_id % 8 WHEN 0 THEN 'geo.lat' WHEN 1 THEN 'CONTENT.TITLE' WHEN 2 THEN 'CAPTURE.ISO' WHEN 3 THEN 'RATING.0x0003' WHEN 4 THEN 'CUSTOM.12' WHEN 5 THEN 'NOWHERE.X' WHEN 6 THEN 'GEO' ELSE 'TIME.NO.TAG' END"
_VALUE = "CASE user_id % 4 WHEN 0 THEN 'en:Lake ' || user_id WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'long:text' ELSE 'plain' END"


def _keys(spark, d) -> DataFrame:
    i, u = F.col("event_id") % 8, F.col("user_id")
    names = ["geo.lat", "CONTENT.TITLE", "CAPTURE.ISO", "RATING.0x0003", "CUSTOM.12", "NOWHERE.X", "GEO", "TIME.NO.TAG"]
    key = F
    for n, name in enumerate(names):
        key = key.when(i == n, name)
    value = F.when(u % 4 == 0, F.concat(F.lit("en:Lake "), u.cast("string"))).when(u % 4 == 1, u.cast("string")).when(u % 4 == 2, "long:text").otherwise("plain")
    return table(spark, d, "events").select("event_id", key.alias("key"), value.alias("value"))


@query("met11_split_key", f"WITH k AS (SELECT event_id, {_KEY} AS key FROM events) SELECT event_id, CASE WHEN instr(key, '.') > 0 THEN substr(key, 1, instr(key, '.') - 1) ELSE key END AS ns, CASE WHEN instr(key, '.') > 0 THEN substr(key, instr(key, '.') + 1) END AS tag FROM k")
def split_key(spark, d):
    ns, tag = M.split_key(F.col("key"))
    return _keys(spark, d).select("event_id", ns.alias("ns"), tag.alias("tag"))


@query("met12_resolve_key", "SELECT event_id, CAST(CASE event_id % 8 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 1 WHEN 3 THEN 9 WHEN 4 THEN 10 WHEN 6 THEN 2 WHEN 7 THEN 3 END AS INTEGER) AS ns, CAST(CASE event_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN 3 WHEN 4 THEN 12 END AS INTEGER) AS tag FROM events")
def resolve_key(spark, d):
    return M.resolve_keys(_keys(spark, d)).select("event_id", "ns", "tag")


@query("met13_typed_value", f"WITH k AS (SELECT event_id, {_KEY} AS key, {_VALUE} AS v FROM events), t AS (SELECT *, CASE WHEN key = 'geo.lat' THEN 7 WHEN key = 'CONTENT.TITLE' AND v LIKE 'en:%' THEN 9 ELSE 10 END AS type_id FROM k) SELECT event_id, CAST(type_id AS INTEGER) AS type_id, CASE WHEN type_id = 9 THEN substr(v, 4) ELSE v END AS value, CASE WHEN type_id = 9 THEN 'en' END AS lang FROM t")
def typed_value(spark, d):
    return _keys(spark, d).select("event_id", M.typed_value(F.col("key"), F.col("value")).alias("t")).select("event_id", "t.*")


_TYPED = """ty AS (SELECT event_id // 16 AS image_id, event_id % 16 AS ord, 1 + user_id % 12 AS ns, 1 + (event_id + user_id) % 5 AS tag, event_id % 6 AS k, event_id AS i, event_type AS w FROM events),
vs AS (SELECT image_id, ord, ns, tag, CASE k WHEN 0 THEN CAST(i AS VARCHAR) WHEN 1 THEN printf('%.10g', i / 8.0::DOUBLE) WHEN 2 THEN '{"numerator":' || i || ',"denominator":3}' WHEN 3 THEN CASE WHEN i % 4 = 1 THEN '{"fr":"' ELSE '{"default":"' END || w || ' \\"' || i || '"}'
  WHEN 4 THEN '"' || w || '\\n\\\\' || i || '"' ELSE '"' || strftime(make_timestamp(i * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '"' END AS v FROM ty)"""


@query("snk5_metadata_json", f"""WITH {_TYPED}, n AS (SELECT image_id, ns, '  "' || {_NS} || '": {{' || chr(10) || string_agg('    "' || printf('0x%04X', tag) || '": ' || v, ',' || chr(10) ORDER BY ord) || chr(10) || '  }}' AS j FROM vs GROUP BY image_id, ns) SELECT image_id, '{{' || chr(10) || string_agg(j, ',' || chr(10) ORDER BY ns) || chr(10) || '}}' || chr(10) AS json FROM n GROUP BY image_id""")
def metadata_json(spark, d):
    """Entries of six types in turn."""
    i, k, w = F.col("event_id"), F.col("event_id") % 6, F.col("event_type")
    text = F.when(k == 0, i.cast("string")).when(k == 1, (i / 8.0).cast("string")).when(k == 2, F.concat(i.cast("string"), F.lit("/3"))).when(k == 3, F.concat(w, F.lit(' "'), i.cast("string"))).when(k == 4, F.concat(w, F.lit("\n\\"), i.cast("string"))).otherwise((i * 1_000_000).cast("string"))
    type_id = F.element_at(F.array(*[F.lit(t) for t in (3, 7, 8, 9, 10, 14)]), (k + 1).cast("int"))
    e = _entries(spark, d).join(table(spark, d, "events").select(F.floor(i / 16).cast("bigint").alias("image_id"), (i % 16).cast("int").alias("ord"), type_id.alias("t"), text.alias("v"), F.when(i % 4 == 1, "fr").alias("l")), ["image_id", "ord"])
    return M.to_json(e.select("image_id", "ord", "ns", "tag", F.col("t").alias("type_id"), F.col("v").alias("value"), F.col("l").alias("lang")))
