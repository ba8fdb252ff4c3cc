"""Paths, names, match keys, formats and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SUFFIX

#: What a file name's last words may say about how it was made.
PROFILE_WORD = r"^(q\d*|yuv444|yuv420|srcjpeg|lossless|lossy|clean)$"


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def lower_extension(path: Column) -> Column:
    """With its dot; "" if there is none."""
    ext = _extension(path)
    return F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))


def declared_format(path: Column) -> Column:
    ext = _extension(path)
    return F.when(ext == "jpg", "jpeg").otherwise(ext)


def sniff_format(data: Column) -> Column:
    """By the first bytes: webp, png, jpeg, ppm or unknown."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.rlike("^52494646.{8}57454250$"), "webp")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("5036"), "ppm")
        .otherwise("unknown")
    )


def format_mismatch(detected: Column, declared: Column) -> Column:
    return (detected != "unknown") & (detected != declared)


def format_filter(detected: Column, wanted: str = "any") -> Column:
    return F.lit(True) if wanted == "any" else detected == wanted


def loader_of(path: Column) -> Column:
    """Which reader takes a file, by its name's ending."""
    ext = _extension(path)
    return F.when(ext == SUFFIX, "container").when(ext == "ppm", "ppm").when(ext.isin("jpg", "jpeg", "png"), "image").otherwise("unsupported")


def is_container_file(path: Column) -> Column:
    return _extension(path) == SUFFIX


def is_source_image(path: Column) -> Column:
    return _extension(path).isin("jpg", "jpeg", "png", "ppm")


def portable_path(path: Column) -> Column:
    """Single forward slashes, without dots and slashes in front."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^[./]+", "")


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def scene_group(relative: Column) -> Column:
    """The first folder's name; root where there is no folder."""
    parts = F.split(portable_path(relative), "/")
    return F.when(F.size(parts) <= 1, "root").otherwise(F.lower(F.get(parts, F.lit(0))))


def output_stem(relative: Column) -> Column:
    bare = F.regexp_replace(relative, r"\.[^./\\]*$", "")
    flat = F.regexp_replace(F.regexp_replace(bare, r"[\\/]+", "_"), r"[^A-Za-z0-9._-]", "_")
    return F.regexp_replace(flat, r"^[._]+|[._]+$", "")


def profile_name(quality: Column, subsampling: Column, lossless: Column, source: Column) -> Column:
    """q<rounded>_yuv<subsampling> or lossless, then _src<format> unless that is any. Halves round to even."""
    name = F.when(lossless, "lossless").otherwise(F.concat(F.lit("q"), F.bround(quality, 0).cast("int").cast("string"), F.lit("_yuv"), subsampling))
    return F.concat(name, F.when(source == "any", "").otherwise(F.concat(F.lit("_src"), source)))


def match_text(c: Column) -> Column:
    """Lower-case ASCII letters and digits; anything else is one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def match_keys(stem_: Column) -> Column:
    """Distinct names to look for: the whole, without trailing profile words, and of that without its first word, its
    last word, its last two."""
    whole = match_text(stem_)
    words = F.filter(F.split(whole, "_"), lambda w: w != "")
    # the place of the last word that says something; the first word stays in any case
    kept = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(~w.rlike(PROFILE_WORD), i + 1))), F.lit(1)))
    kept = F.least(kept, F.size(words))
    name = lambda first, n: F.array_join(F.slice(words, first, n), "_")
    none = F.lit(None).cast("string")
    keys = F.array(
        whole, F.when(kept > 0, name(F.lit(1), F.greatest(kept, F.lit(0)))), F.when(kept > 1, name(F.lit(2), F.greatest(kept - 1, F.lit(0)))).otherwise(none),
        F.when(kept > 1, name(F.greatest(kept, F.lit(1)), F.lit(1))).otherwise(none), F.when(kept > 2, name(F.greatest(kept - 1, F.lit(1)), F.lit(2))).otherwise(none),
    )
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def match_score(key: Column, candidate: Column) -> Column:
    """500 equal, 280 the key holds the candidate, 200 the candidate holds the key, else 0."""
    return (
        F.when((key == "") | (candidate == ""), 0)
        .when(key == candidate, 500)
        .when(F.instr(key, candidate) > 0, 280)
        .when(F.instr(candidate, key) > 0, 200)
        .otherwise(0)
    )


def human_size(n: Column) -> Column:
    value = F.when(n < 1024, n.cast("double"))
    unit = F.when(n < 1024, "B")
    for k, name in enumerate(("KB", "MB", "GB"), 1):
        here = (n < 1024 ** (k + 1)) if k < 3 else F.lit(True)
        value, unit = F.coalesce(value, F.when(here, n / float(1024**k))), F.coalesce(unit, F.when(here, name))
    number = F.when(unit == "B", n.cast("string")).when(value >= 100, F.format_string("%.0f", value)).when(value >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
    return F.concat(number, F.lit(" "), unit)


# --- times, identifiers, JSON, XMP -----------------------------------------------------------------------------------


def iso_from_micros(us: Column) -> Column:
    """UTC, with six digits of fraction only where there is one."""
    ts = F.timestamp_micros(us)
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(us, F.lit(1_000_000)) > 0, F.concat(F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def micros_from_iso(text: Column) -> Column:
    """Offsets are not read; fractions are filled or cut to six digits; what is no time is 0."""
    pattern = r"^(\d{4}-\d{2}-\d{2}).(\d{2}:\d{2}:\d{2})(?:\.(\d+))?"
    at = F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    fraction = F.rpad(F.substring(F.regexp_extract(text, pattern, 3), 1, 6), 6, "0").cast("bigint")
    return F.coalesce(F.unix_micros(F.try_to_timestamp(at, F.lit("yyyy-MM-dd HH:mm:ss"))) + fraction, F.lit(0).cast("bigint"))


def uuid_text(data: Column) -> Column:
    h = F.lower(F.hex(data))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid_bytes(text: Column) -> Column:
    """Null where the text is no identifier."""
    bare = F.replace(text, F.lit("-"), F.lit(""))
    return F.when(text.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.unhex(bare))


def uuid_v4(data: Column) -> Column:
    """The identifier of any 16 bytes, with the bits that mark a random one."""
    h = F.lower(F.hex(data))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def json_escape(c: Column) -> Column:
    """Only the backslash, the quote, and the three white-space escapes."""
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def tag_text(markup: Column, tag: str) -> Column:
    """What stands between the first <tag> and the next </tag>; null if there is none."""
    found = F.regexp_extract(markup, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(F.instr(markup, f"<{tag}>") > 0, found)


def xml_escape(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def rational(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, 0.0).otherwise(numerator / F.when(denominator != 0, denominator))


def gps_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def gps_altitude(metres: Column, ref: Column) -> Column:
    return F.when(ref == 1, -metres).otherwise(metres).cast("float")


def gps_micros(date: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    """date as yyyy:mm:dd; null before 1970 or where the date is none."""
    day = F.try_to_timestamp(date, F.lit("yyyy:MM:dd"))
    us = F.unix_micros(day) + F.floor((hours * 3600 + minutes * 60 + seconds) * 1_000_000 + 0.5)
    return F.when(us >= 0, us)
