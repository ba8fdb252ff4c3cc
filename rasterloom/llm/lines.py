"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines (trimmed of blanks, tabs and carriage returns) are the same if equal or, from min_chars characters on, linked
by edit distances of at most `limit`. Of each class of lines the first occurrence, by document id and line number,
stays; all others are removed from their documents. Blank lines always stay.

A line is cut into limit + 1 segments; a line within the limit has one of them, unchanged, at one of a few places.
Each distinct line is therefore indexed by (its length, segment number, segment), and probes the indexes of its own
and the limit's shorter lengths with its substrings at those places (the multi-match-aware windows of Pass-Join).
What meets is verified, without what both lines have in common at their ends, by Hyyrö's banded bit-parallel distance: a word holds the 2 * limit + 1 cells of the band.

Lines that meet in a segment are paired if at most `few` of them are indexed there, so a line has no more than `few`
pairs from a group, however many probe it. In any other group the segment is taken out, and what is left of each line
is cut into segments again, by the same rule, until few are indexed or no more than `limit` characters are left. By
then all indexed lines of the group are within the limit of each other, and each is paired with the least of them.
With limit 1 a longer line is then paired with the one line that it becomes without either of its two characters, so
that all rows are in proportion to the lines' characters. With larger limits it is paired with all indexed lines of
its group, which agree in all but `limit` characters. No pair within the limit is lost, and `few` moves work only.

Defined cases: null and empty texts have no lines and stay as they are; rows equal in id and text are one document,
so they keep the same lines; null ids come first in order; lines are known by two 64-bit hashes; texts and lines are
taken whole, whatever their length; other columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows, saved, together
from .components import components

BLANK = " \t\r"


def occurrences(docs: DataFrame) -> DataFrame:
    """docs(id, th, text) -> id, th, line_no, line (trimmed), a, b (its hashes), for lines that aren't blank."""
    lines = docs.where("text != ''").select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line", F.lit(BLANK))).where("line != ''")
    return lines.withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64(F.lit(7), "line"))


def windows(size: str, limit: int, short: int) -> Iterator[tuple[int, str, str, bool]]:
    """Where a string of size + short characters may hold a segment of one of `size` characters that is within the
    limit: segment number, first character, length, and whether it is the string's own segment."""
    m = limit + 1
    for i in range(m):  # the last segments have one character more, as many as the division leaves
        length = f"({size} div {m} + if({m - i} <= {size} % {m}, 1, 0))"
        first, last = max(-i, short - (m - 1 - i)), min(i, short + (m - 1 - i))
        for shift in range(first, last + 1):
            start = f"(1 + {shift} + {i} * ({size} div {m}) + greatest(0, {i - m} + {size} % {m}))"
            yield i, start, length, short == 0 and shift == 0


def line_keys(limit: int, min_chars: int) -> dict[str, str]:
    """SQL of the keys of a line of n characters: `own*` as an index for its length, `probe*` for other places."""
    out = {}
    for short in range(limit + 1):
        for k, (i, start, length, own) in enumerate(windows(f"(n - {short})", limit, short)):
            key = f"xxhash64(0L, n - {short}, {i}, substring(line, {start}, {length}))"
            out[f"{'own' if own else 'probe'}_{short}_{k}"] = f"if(n - {short} >= {min_chars}, {key}, NULL)"
    return out


def _cut(state: DataFrame, limit: int) -> DataFrame:
    """state(g, a, b, l, own, rest), of which indexed strings are l characters long -> the same for each segment or
    window, g its key and rest what is left without it."""
    by_short = []
    for short in range(limit + 1):
        parts = [
            f"named_struct('g', xxhash64(g, l, {i}, substring(rest, {start}, {length})), 'l', l - {length}, 'own', {'own' if own else 'false'},"
            f" 'rest', concat(substring(rest, 1, {start} - 1), substring(rest, {start} + {length})))"
            for i, start, length, own in windows("l", limit, short)
        ]
        by_short.append(f"WHEN {short} THEN array({', '.join(parts)})")
    found = F.expr(f"array_distinct(CASE n - l {' '.join(by_short)} END)")
    sized = state.withColumn("n", F.length("rest"))
    return sized.select("a", "b", F.explode(found).alias("x")).select("x.g", "a", "b", "x.l", "x.own", "x.rest")


def candidates(texts: DataFrame, limit: int, few: int) -> DataFrame:
    """texts(a, b, line) distinct -> pairs (u, v) of structs (a, b), which hold all that are within the limit."""
    n = F.length("line")
    state = texts.select(F.lit(0).cast("long").alias("g"), "a", "b", F.explode(F.sequence(F.lit(0), F.lit(limit))).alias("short"), "line")
    state = state.select("g", "a", "b", (n - F.col("short")).alias("l"), (F.col("short") == 0).alias("own"), F.col("line").alias("rest")).where(F.col("l") > limit)
    name, found = F.struct("a", "b"), []
    few_indexed, more = F.col("indexed") <= few, F.col("l") > limit
    while True:
        rows = _cut(state, limit)
        sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if("own").alias("indexed")).where("n > 1 AND indexed > 0")
        seen = {"small": F.count_if(few_indexed), "end": F.count_if(~few_indexed & ~more), "more": F.count_if(~few_indexed & more)}
        met = saved(rows.join(sizes.select("g", "indexed"), "g"), "line-groups", **seen)
        small, large = met.where(few_indexed), met.where(~few_indexed)
        left = small.where("own").select("g", name.alias("u"))
        pairs = left.join(small.select("g", name.alias("v"), "own"), "g").where("u != v AND (NOT own OR u < v)").select("u", "v")
        # a round's pairs are made before the next one, and only where there are any
        if met.observed["small"]:
            found.append(saved(pairs, "line-met"))
        if met.observed["end"]:
            found.append(saved(_last(large.where(~more), limit), "line-met"))
        if not met.observed["more"]:
            return together(found) if found else pairs.where(F.lit(False))
        state = large.where(more).drop("indexed")


def _last(rows: DataFrame, limit: int) -> DataFrame:
    """Groups of which at most `limit` characters are left of each indexed line -> pairs that span them."""
    name = F.struct("a", "b")
    least = rows.where("own").groupBy("g").agg(F.min(name).alias("u"))
    close = rows.where(F.length("rest") <= limit).select("g", name.alias("v"))
    star = least.join(close, "g").where("u != v").select("u", "v")
    longer = rows.where(F.length("rest") > limit).select("g", name.alias("v"), "rest")
    own = rows.where("own").select("g", name.alias("u"), F.col("rest").alias("c"))
    if limit == 1:  # two characters, of which one must go
        longer = longer.withColumn("c", F.explode(F.expr("array_distinct(array(substring(rest, 1, 1), substring(rest, 2, 1)))")))
        return star.union(own.join(longer, ["g", "c"]).select("u", "v"))
    return star.union(own.join(longer, "g").where("u != v").select("u", "v"))


def within(a: Column, b: Column, limit: int) -> Column:
    """Whether the edit distance of a and b, of lengths that differ by no more than limit < their lengths, is at most
    limit. Bit o of a word is the cell `o - limit` rows below the diagonal."""
    lit = lambda x: F.lit(x).cast("bigint")
    band = lit((1 << (2 * limit + 1)) - 1)

    def distance(pair: Column) -> Column:
        p, m = pair["p"], pair["m"]

        def step(acc: Column, x: Column) -> Column:
            j, vp, vn = x["j"], acc["vp"], acc["vn"]
            bits = [F.when(F.coalesce(F.get(p, j + (o - limit)) == x["c"], F.lit(False)), lit(1 << o)).otherwise(lit(0)) for o in range(2 * limit + 1)]
            eq = reduce(lambda s, t: s.bitwiseOR(t), bits)
            d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(band)
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(band))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            # the band's last cell goes down the diagonal to the last row, then along it
            at = F.greatest(F.lit(0), F.lit(2 * limit - 1) - (j - (m - limit)))
            bit = lambda w: F.call_function("shiftright", w, at).bitwiseAND(lit(1))
            move = F.when(j < m - limit, 1 - F.shiftright(d0, 2 * limit).bitwiseAND(lit(1))).otherwise(bit(hp) - bit(hn))
            new_vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(band))
            return F.struct(new_vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), (acc["dist"] + move).alias("dist"))

        start = F.struct(lit(((1 << (limit + 1)) - 1) << limit).alias("vp"), lit(0).alias("vn"), lit(limit).alias("dist"))
        return F.aggregate(F.transform(pair["t"], lambda c, j: F.struct(c.alias("c"), j.alias("j"))), start, step)["dist"]

    # an array of one: its element is made once, where a column's expression would be made again at each step
    pair = F.array(F.struct(F.split(a, "").alias("p"), F.length(a).alias("m"), F.split(b, "").alias("t")))
    return F.get(F.transform(pair, distance), F.lit(0)) <= limit


def _begins_alike(a: Column, b: Column, most: Column) -> Column:
    """How many characters a and b have in common at the start, no more than `most`, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])  # more than a string can hold
    pair = F.array(F.struct(a.alias("a"), b.alias("b"), most.alias("most")))

    def count(p: Column) -> Column:
        same = lambda n, k: F.substring(p["a"], n + 1, k) == F.substring(p["b"], n + 1, k)
        return F.aggregate(steps, F.lit(0), lambda n, k: F.when((k <= p["most"] - n) & same(n, k), n + k).otherwise(n))

    return F.get(F.transform(pair, count), F.lit(0))


def _near(pairs: DataFrame, limit: int) -> DataFrame:
    """Of pairs(s, t) those within the limit. What they have in common at both ends doesn't change the distance, and goes
    but for limit + 1 characters, so long lines with a small difference cost little."""
    keep = limit + 1
    p = pairs.withColumn("_n", F.least(F.length("s"), F.length("t")))
    p = p.withColumn("_head", _begins_alike(F.col("s"), F.col("t"), F.col("_n")))
    p = p.withColumn("_tail", _begins_alike(F.reverse("s"), F.reverse("t"), F.col("_n") - F.col("_head")))
    cut = lambda c: F.substring(F.col(c), F.greatest(F.lit(0), F.col("_head") - keep) + 1, F.length(c) - F.greatest(F.lit(0), F.col("_head") - keep) - F.greatest(F.lit(0), F.col("_tail") - keep))
    # with one edit, nothing but it is left between the ends
    p = p.where(F.lit(limit != 1) | (F.greatest(F.length("s"), F.length("t")) - F.col("_head") - F.col("_tail") <= 1))
    p = p.withColumn("_s", cut("s")).withColumn("_t", cut("t")).where(within(F.col("_s"), F.col("_t"), limit))
    return p.drop("_n", "_head", "_tail", "_s", "_t")


def line_links(texts: DataFrame, limit: int = 1, few: int = 4) -> DataFrame:
    """texts(a, b, line) distinct -> links (u, v) of structs (a, b); they span the same classes as all pairs within
    the limit."""
    pairs = saved(candidates(texts, limit, few).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "line-pairs")
    side = lambda u, s: texts.select(F.struct("a", "b").alias(u), F.col("line").alias(s))
    return _near(pairs.join(side("u", "s"), "u").join(side("v", "t"), "v"), limit).select("u", "v")


def _meeting(each: DataFrame, keys: list[str]) -> DataFrame:
    """each(a, b, first, keys) -> a, b, first of the lines that share a key with another one that is indexed by it."""
    own = F.array(*[F.struct(F.lit(k.startswith("own")).alias("own"), F.col(k).alias("g")) for k in keys])
    rows = each.select("a", "b", "first", F.explode(F.array_distinct(own)).alias("x")).select("a", "b", "first", "x.*").where("g IS NOT NULL")
    sizes = saved(rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if("own").alias("indexed")).where("n > 1 AND indexed > 0").select("g"), "line-keys")
    return rows.join(few_rows(sizes), "g", "left_semi").select("a", "b", "first").distinct()


def _place(docs: DataFrame) -> Column:
    """An occurrence's rank by id (null first), text and line number: a number where ids are whole numbers."""
    if docs.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        id_ = F.coalesce(F.col("id").cast("decimal(20,0)"), F.expr("CAST(-9223372036854775809 AS DECIMAL(20,0))"))
        rest = F.shiftrightunsigned("th", 33) * F.lit(1 << 31) + F.col("line_no")
        return (id_ * F.lit(1 << 62).cast("decimal(19,0)") + rest.cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct("id", "th", "line_no")


def removals(docs: DataFrame, limit: int = 1, min_chars: int = 20, few: int = 4) -> DataFrame:
    """docs(id, th, text) -> id, th, removed (line numbers), for documents that lose lines."""
    if min_chars <= limit:
        raise ValueError("min_chars must be over limit")
    keys = line_keys(limit, min_chars)
    found = occurrences(docs).withColumn("n", F.length("line"))
    occ = saved(found.select("id", "th", "line_no", "a", "b", *[F.expr(sql).alias(k) for k, sql in keys.items()]), "line-places")
    occ = occ.withColumn("first", _place(docs))
    each = saved(occ.groupBy("a", "b").agg(F.min("first").alias("first"), F.count("*").alias("n"), *[F.max(k).alias(k) for k in keys]), "lines")
    wanted = saved(_meeting(each, list(keys)), "line-wanted")
    # the texts of those lines, from the documents of their first places
    at = few_rows(wanted)
    places = saved(occ.select("id", "th", "a", "b", "first").join(at, ["a", "b", "first"]).select(F.col("id").alias("jid"), F.col("th").alias("jth")).distinct(), "line-documents")
    held = docs.join(few_rows(places), F.col("id").eqNullSafe(F.col("jid")) & (F.col("th") == F.col("jth")), "left_semi")
    texts = occurrences(held).withColumn("first", _place(docs)).join(at, ["a", "b", "first"]).groupBy("a", "b").agg(F.first("line").alias("line"))
    classes = components(line_links(saved(texts, "line-texts"), limit, few))
    linked = saved(classes.union(classes.select("root", "root")).distinct().select("node.a", "node.b", "root"), "line-classes")
    firsts = each.select("a", "b", "first").join(few_rows(linked), ["a", "b"])
    keepers = firsts.groupBy("root").agg(F.min("first").alias("keep"))
    alone = each.where("n > 1").select("a", "b", F.col("first").alias("keep")).join(few_rows(linked.select("a", "b"), linked.observed["rows"]), ["a", "b"], "left_anti")
    lost = saved(firsts.join(keepers, "root").select("a", "b", "keep").union(alone), "line-lost")
    gone = occ.select("id", "th", "line_no", "a", "b", "first").join(few_rows(lost), ["a", "b"]).where("first != keep")
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, limit: int = 1, min_chars: int = 20, few: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, the text without removed lines, and _lines and _removed, their numbers."""
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    own = own.withColumns({"id": F.col(f"c{docs.columns.index(id_col)}"), "text": F.col(f"c{at}")}).withColumn("th", F.xxhash64("text", F.length("text")))
    gone = removals(own.select("id", "th", "text"), limit, min_chars, few).toDF("jid", "jth", "removed")
    out = own.join(gone, F.col("id").eqNullSafe(F.col("jid")) & (F.col("th") == F.col("jth")), "left")
    # made once for each row, where the lambda would split the text again for each line
    split = F.split("text", "\n", -1)
    parts = F.array(F.struct(split.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "removed").alias("stay")))
    left = F.get(F.transform(parts, lambda p: F.array_join(F.transform(p["stay"], lambda i: F.get(p["lines"], i)), "\n")), F.lit(0))
    out = out.withColumns({names[at]: F.when(F.col("removed").isNotNull(), left).otherwise(F.col("text")), "_lines": F.when(F.length("text") > 0, F.size(split)).otherwise(0), "_removed": F.coalesce(F.size("removed"), F.lit(0))})
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], "_lines", "_removed")
