"""Metadata as rows: entries(image_id, ord, ns, tag, type_id, value, lang), in the order of ord within an image.

value is the entry's text form; lang is set for language strings only. A look-up finds the first match; setting
replaces it in place or appends; removing takes all matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_from_micros, json_escape
from ..schemas import NAMESPACES

KEY = ["image_id", "ns", "tag"]
COLUMNS = ["image_id", "ord", "ns", "tag", "type_id", "value", "lang"]

# The tags of each namespace, numbered from 1 in this order.
TAGS = {
    "CAPTURE": "MAKE MODEL SERIAL LENS_MAKE LENS_MODEL FOCAL_LEN FOCAL_35MM FNUMBER EXPOSURE_TIME ISO EV_COMP FLASH WHITE_BAL METERING SCENE_TYPE SHARPNESS SATURATION SOFTWARE UNIQUE_IMG_ID BURST_INDEX BURST_COUNT HDR_FRAMES",
    "GEO": "LAT LON ALT HPOS_ERR VPOS_ERR SPEED HEADING PITCH ROLL COUNTRY REGION CITY SUBLOC PLACE_NAME WHAT3WORDS PLUS_CODE CAPTURE_TS DEST_LAT DEST_LON",
    "TIME": "CAPTURE_UTC OFFSET_SEC CREATED_UTC MODIFIED_UTC DIGITIZED_UTC SUBSEC TIMEZONE_ID",
    "RIGHTS": "CREATOR CREATOR_ROLE COPYRIGHT LICENSE_SPDX LICENSE_URL CREDIT_LINE SOURCE INSTRUCTIONS EMBARGO_UTC",
    "CONTENT": "TITLE DESCRIPTION ALT_TEXT KEYWORDS GENRE SUBJECT_CODES SCENE_CODES EVENT OBJECT_NAME CATEGORY LANGUAGE SMARTCROP",
    "ANIM": "TITLE DESCRIPTION CREATOR DURATION_MS FPS_TARGET CATEGORY SCENE_LABELS THUMB_TILE",
    "REGION": "NAME TYPE ROLE RECT_NORM CONFIDENCE PERSON_NAME PERSON_ID OBJECT_CLASS CREATOR",
    "DEVICE": "", "RATING": "STARS AUDIENCE NSFW AI_GENERATED QUALITY_SCORE CAPTION_SRC", "CUSTOM": "", "PROV_REF": "",
}
NUMBER = {name: n for n, name in enumerate(TAGS, 1)}
FLOAT64, UINT8, FLOAT32, LSTR, STR, STRUCT, TS64 = 7, 1, 6, 9, 10, 13, 14
# Namespaces whose "xx:text" values are language strings, and keys with a type of their own.
LANGUAGE_NAMESPACES = ("CONTENT", "RIGHTS", "ANIM", "REGION")
TYPED = {("GEO", "LAT"): FLOAT64, ("GEO", "LON"): FLOAT64, ("GEO", "ALT"): FLOAT32, ("RATING", "STARS"): UINT8}


def dictionary(spark) -> DataFrame:
    """ns, ns_name, tag, tag_name: a row for each named tag."""
    rows = [(NUMBER[ns], ns, t, name) for ns, names in TAGS.items() for t, name in enumerate(names.split(), 1)]
    return spark.createDataFrame(rows, "ns int, ns_name string, tag int, tag_name string")


def namespace_name(ns: Column) -> Column:
    """As JSON writes it; unknown_<n> for numbers without a name."""
    out = F
    for n, name in NAMESPACES.items():
        out = out.when(ns == n, name)
    return out.otherwise(F.concat(F.lit("unknown_"), ns.cast("string")))


def split_key(key: Column) -> tuple[Column, Column]:
    """NS.TAG at the first dot; a key without one has no tag."""
    at = F.instr(key, ".")
    return F.when(at > 0, F.substring(key, F.lit(1), at - 1)).otherwise(key), F.when(at > 0, F.substring(key, at + 1, F.length(key)))


def resolve_keys(rows: DataFrame, key: str = "key") -> DataFrame:
    """rows with ns and tag: by name, 0x<hex> or number; null where there is no such name."""
    ns, tag = split_key(F.col(key))
    known = F.broadcast(dictionary(rows.sparkSession).select(F.col("ns_name").alias("_n"), F.col("tag_name").alias("_t"), F.col("tag").alias("_tag")))  # a fixed number of rows
    number = F
    for name, n in NUMBER.items():
        number = number.when(F.upper(ns) == name, n)
    out = rows.withColumns({"_ns": F.upper(ns), "_text": F.upper(tag), "ns": number.otherwise(None)})
    out = out.join(known, (F.col("_ns") == F.col("_n")) & (F.col("_text") == F.col("_t")), "left")
    plain = F.when(F.col("_text").rlike("^0X[0-9A-F]{1,4}$"), F.conv(F.substring("_text", 3, 4), 16, 10)).when(F.col("_text").rlike("^[0-9]{1,5}$"), F.col("_text"))
    return out.withColumn("tag", F.coalesce("_tag", plain.cast("int"))).drop("_ns", "_text", "_n", "_t", "_tag")


def typed_value(key: Column, value: Column) -> Column:
    """struct(type_id, value, lang) of what a user types for a key."""
    ns, tag = split_key(key)
    is_lang = F.upper(ns).isin(*LANGUAGE_NAMESPACES) & value.rlike("^[^:]{1,3}:")
    at = F.instr(value, ":")
    kind = F
    for (n, t), number in TYPED.items():
        kind = kind.when((F.upper(ns) == n) & (F.upper(tag) == t), number)
    kind = kind.when(is_lang, LSTR).otherwise(STR)
    text = F.when(kind == LSTR, F.substring(value, at + 1, F.length(value))).otherwise(value)
    return F.struct(kind.alias("type_id"), text.alias("value"), F.when(kind == LSTR, F.substring(value, F.lit(1), at - 1)).alias("lang"))


def get(entries: DataFrame, ns: int, tag: int) -> DataFrame:
    """image_id and the first matching entry."""
    hit = entries.where((F.col("ns") == ns) & (F.col("tag") == tag))
    return hit.groupBy("image_id").agg(F.min_by(F.struct("ord", "type_id", "value", "lang"), "ord").alias("e")).select("image_id", "e.*")


def find_all(entries: DataFrame) -> DataFrame:
    """The first entry of each key."""
    return entries.groupBy(*KEY).agg(F.min_by(F.struct("ord", "type_id", "value", "lang"), "ord").alias("e")).select(*KEY, "e.*")


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(image_id, seq, ns, tag, type_id, value, lang): in order of seq, each replaces its key's first entry or is
    appended. One shuffle by image."""
    n = F.max("ord").over(Window.partitionBy("image_id"))
    old = entries.select(*COLUMNS, F.lit(-1).alias("seq"))
    new = changes.select("image_id", F.lit(None).cast("int").alias("ord"), "ns", "tag", "type_id", "value", "lang", "seq")
    both = old.unionByName(new).withColumn("_n", F.coalesce(n, F.lit(-1)))
    by = Window.partitionBy(*KEY)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min("ord").over(every)
    last = F.max(F.when(F.col("seq") >= 0, F.struct("seq", "type_id", "value", "lang"))).over(every)
    born = F.min(F.when(F.col("seq") >= 0, F.col("seq"))).over(every)
    both = both.withColumns({"_first": first, "_last": last, "_born": born})
    kept = both.where((F.col("seq") < 0) | (F.col("_first").isNull() & (F.col("seq") == F.col("_born"))))
    changed = F.col("_last").isNotNull() & (F.col("_first").isNull() | (F.col("ord") == F.col("_first")))
    pick = lambda c: F.when(changed, F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("ord").asc_nulls_last(), "seq")) - 1
    return kept.select("image_id", rank.cast("int").alias("ord"), "ns", "tag", *[pick(c) for c in ("type_id", "value", "lang")])


def remove(entries: DataFrame, ns: int, tag: int) -> DataFrame:
    return entries.where(~((F.col("ns") == ns) & (F.col("tag") == tag)))


def merge(target: DataFrame, source: DataFrame) -> DataFrame:
    """The source's first entry of each key replaces the target's or is appended, in the source's order."""
    return upsert(target, find_all(source).withColumnRenamed("ord", "seq"))


def wide(entries: DataFrame) -> DataFrame:
    """image_id, latitude, longitude, license, capture_us, title (any language): typed look-ups; a value of another type
    counts as none, and capture time only falls back to the position's where it has no entry at all."""

    def one(ns: str, tag: str) -> Column:
        hit = (F.col("ns") == NUMBER[ns]) & (F.col("tag") == TAGS[ns].split().index(tag) + 1)
        return F.min_by(F.struct("type_id", "value"), F.when(hit, F.col("ord")))

    e = entries.groupBy("image_id").agg(
        one("GEO", "LAT").alias("lat"), one("GEO", "LON").alias("lon"), one("RIGHTS", "LICENSE_SPDX").alias("lic"), one("TIME", "CAPTURE_UTC").alias("utc"), one("GEO", "CAPTURE_TS").alias("gts"), one("CONTENT", "TITLE").alias("title")
    )
    typed = lambda c, *kinds: F.when(F.col(f"{c}.type_id").isin(*kinds), F.col(f"{c}.value"))
    micros = F.when(F.col("utc").isNotNull(), typed("utc", TS64)).otherwise(typed("gts", TS64))
    return e.select(
        "image_id", F.expr("try_cast(CASE WHEN lat.type_id = 7 THEN lat.value END AS DOUBLE)").alias("latitude"), F.expr("try_cast(CASE WHEN lon.type_id = 7 THEN lon.value END AS DOUBLE)").alias("longitude"),
        typed("lic", STR).alias("license"), micros.cast("bigint").alias("capture_us"), typed("title", STR, LSTR).alias("title"),
    )


def title(entries: DataFrame, lang: str = "") -> DataFrame:
    """image_id, title: the first that is plain, or of the language asked for (any, if none is)."""
    fits = (F.col("type_id") == STR) | ((F.col("type_id") == LSTR) & ((F.col("lang") == lang) if lang else F.lit(True)))
    hit = entries.where((F.col("ns") == NUMBER["CONTENT"]) & (F.col("tag") == 1) & fits)
    return hit.groupBy("image_id").agg(F.min_by("value", "ord").alias("title"))


def regions(entries: DataFrame) -> DataFrame:
    """image_id, ord, name, type, confidence, person_name, object_class of region structs, whose value is a JSON list of
    {tag, value}."""
    items = F.from_json("value", "array<struct<tag:int,value:string>>")
    r = entries.where((F.col("ns") == NUMBER["REGION"]) & (F.col("type_id") == STRUCT)).select("image_id", "ord", items.alias("items"))
    names = TAGS["REGION"].split()
    field = lambda name: F.get(F.filter("items", lambda x: x["tag"] == names.index(name) + 1), F.lit(0))["value"].alias(name.lower())
    return r.select("image_id", "ord", *[field(n) for n in ("NAME", "TYPE", "CONFIDENCE", "PERSON_NAME", "OBJECT_CLASS")])


def _short(v: Column, digits: int = 10) -> Column:
    """A double with so many digits that count, without zeros at the end, in powers of ten where it is very large or
    small."""
    sci = F.format_string(f"%.{digits - 1}e", v)
    power = F.regexp_extract(sci, "e([+-].*)$", 1).cast("int")
    bare = lambda c: F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.?0+$", "")).otherwise(c)
    plain = F
    for k in range(-4, digits):
        plain = plain.when(power == k, bare(F.format_string(f"%.{digits - 1 - k}f", v)))
    return F.when(v == 0, "0").otherwise(plain.otherwise(F.concat(bare(F.substring_index(sci, "e", 1)), F.lit("e"), F.substring_index(sci, "e", -1))))


def json_value(type_id: Column, value: Column, lang: Column | None = None, opaque: Column | None = None) -> Column:
    """A value's JSON, by its type: numbers bare, a rational as an object, a text with a language as an object of it."""
    quoted = lambda c: F.concat(F.lit('"'), json_escape(c), F.lit('"'))
    language = F.when(F.coalesce(lang, F.lit("")) == "", "default").otherwise(lang) if lang is not None else F.lit("default")
    parts = F.from_json(value, "array<struct<tag:int,type:int,value:string>>")
    field = lambda x: F.concat(quoted(x["tag"].cast("string")), F.lit(":"), F.when(x["type"].between(1, 7), x["value"]).otherwise(quoted(x["value"])))
    out = (
        F.when(type_id == 8, F.concat(F.lit('{"numerator":'), F.substring_index(value, "/", 1), F.lit(',"denominator":'), F.substring_index(value, "/", -1), F.lit("}")))
        .when(type_id == 7, _short(F.when(type_id == 7, value).cast("double")))
        .when(type_id < 7, value)
        .when(type_id == LSTR, F.concat(F.lit("{"), quoted(language), F.lit(":"), quoted(value), F.lit("}")))
        .when(type_id == 12, F.replace(value, F.lit(", "), F.lit(",")))
        .when(type_id == STRUCT, F.concat(F.lit("{"), F.array_join(F.transform(parts, field), ","), F.lit("}")))
        .when(type_id == 14, quoted(iso_from_micros(F.when(type_id == 14, value).cast("bigint"))))
        .otherwise(quoted(value))
    )
    if opaque is not None:
        out = F.when(opaque.isNotNull(), F.concat(F.lit('"<opaque '), F.octet_length(opaque).cast("string"), F.lit(' bytes>"'))).otherwise(out)
    return out


def to_json(entries: DataFrame) -> DataFrame:
    """image_id, json: an object for each namespace, in order of numbers, of keys 0x%04X with typed values, in the order of
    the entries, repeated ones included."""
    has = lambda c: F.col(c) if c in entries.columns else None
    line = F.concat(F.format_string('    "0x%04X": ', "tag"), json_value(F.col("type_id"), F.col("value"), has("lang"), has("opaque")))
    of_ns = entries.groupBy("image_id", "ns").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("es"))
    body = F.array_join(F.transform("es", lambda e: e["line"]), ",\n")
    of_ns = of_ns.select("image_id", "ns", F.concat(F.lit('  "'), namespace_name(F.col("ns")), F.lit('": {\n'), body, F.lit("\n  }")).alias("part"))
    all_ = of_ns.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ns", "part"))).alias("all"))
    return all_.select("image_id", F.concat(F.lit("{\n"), F.array_join(F.transform("all", lambda n: n["part"]), ",\n"), F.lit("\n}\n")).alias("json"))
