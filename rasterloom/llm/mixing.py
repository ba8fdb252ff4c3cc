"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target, over its size, is the number of copies that each of its rows should have on average. The whole
part is taken outright. The fractions are rounded in pairs: words move from one row to another until one of the two
fractions is 0 or 1, the direction drawn so that each fraction keeps its expected value. The words taken of a source
are therefore kept to within one row's size. Rows are paired in buckets of about `fan`; each bucket leaves one row
with a fraction, and these are bucketed again, up to one a source: a reduction tree whose levels grow with the
logarithm of the largest source. Rows equal in all that identifies them count as one unit, so no bucket is hot.

Defined cases: null text has size 0; rows of size 0 are rounded among themselves, and a source without words gets
target 0 and one copy of each row; null is a source of its own, last in order; repeated rows share their unit's
copies as evenly as can be; an empty table gives an empty result; names of other columns don't matter, as own
columns are made under names of their own. Draws are hashes of the rows and a seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, saved

ITEM = "struct<p:double,w:double,id:bigint,rk:bigint,src:string,size:bigint,m:bigint>"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """sizes(src, source_size), a row for each source -> with target: shares of all words by weight, repeating over
    the sources in order of code points, at most cap times the size, what is above shared again by weight."""
    one = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("all", F.sum("source_size").over(one).cast("double"))
    # in order of the level at which a source is full; those before are taken as full
    full = Window.partitionBy(F.lit(0)).orderBy((F.col("most") / F.col("weight")), F.col("src").asc_nulls_last())
    s = s.withColumn("left", F.col("all") - F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("open", F.col("weight") * F.col("level") < F.col("most"))
    s = s.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(one))
    return s.select("src", "source_size", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("most")).alias("target"))


def _draw(seed: int, *cols: Column) -> Column:
    """A number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def _item(c: Column, p: Column | None = None) -> Column:
    return F.struct((c["p"] if p is None else p).alias("p"), *[c[x].alias(x) for x in ("w", "id", "rk", "src", "size", "m")])


def _pair(seed: int):
    """One step of the pivotal method: the row with a fraction so far meets the next one."""

    def step(acc: Column, y: Column) -> Column:
        a, b = acc["a"], y["x"]
        out_a, room_a = a["p"] * a["w"], (1 - a["p"]) * a["w"]
        out_b, room_b = b["p"] * b["w"], (1 - b["p"]) * b["w"]
        to_b, to_a = F.least(out_a, room_b), F.least(out_b, room_a)
        forth = _draw(seed, a["id"], a["rk"], b["id"], b["rk"]) * (to_a + to_b) < to_a
        # which of the two is settled, and how; the other goes on with the rest
        a_none, b_full = forth & (out_a <= room_b), forth & (out_a > room_b)
        b_none = ~forth & (out_b <= room_a)
        a_done = a_none | (~forth & (out_b > room_a))
        done = F.when(a_done, _item(a, F.when(a_none, 0.0).otherwise(1.0))).otherwise(_item(b, F.when(b_full, 1.0).otherwise(0.0)))
        rest_a = F.when(b_none, a["p"] + out_b / a["w"]).otherwise(a["p"] - room_b / a["w"])
        rest_b = F.when(a_none, b["p"] + out_a / b["w"]).otherwise(b["p"] - room_a / b["w"])
        keep = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        rest = F.when(a_done, _item(b, keep(rest_b))).otherwise(_item(a, keep(rest_a)))
        first = a["p"].isNull()
        return F.struct(F.when(first, _item(b)).otherwise(rest).alias("a"), F.when(first, acc["done"]).otherwise(F.concat(acc["done"], F.array(done))).alias("done"))

    return step


def copies(units: DataFrame, seed: int = 7, fan: int = 128) -> DataFrame:
    """units(id, rk, src, size, m, f): m equal rows that should have f copies each -> units with total, the whole
    number of copies of all m rows together."""
    u = units.withColumn("whole", F.floor(F.col("m") * F.col("f"))).withColumn("part", F.col("m") * F.col("f") - F.col("whole"))
    u = saved(u, "mix-units")
    open_ = u.where("part > 0").select(F.struct(F.col("part").alias("p"), F.greatest("size", F.lit(1)).cast("double").alias("w"), "id", "rk", "src", "size", "m").cast(ITEM).alias("x"))
    settled = None
    largest = u.where("part > 0").groupBy("src", F.col("size") > 0).count().agg(F.max("count")).first()[0] or 0
    empty = F.from_json(F.lit("[]"), f"array<{ITEM}>")
    start = F.struct(F.lit(None).cast(ITEM).alias("a"), empty.alias("done"))
    level = 0
    while largest:
        n = -(-largest // fan)
        bucket = F.pmod(F.xxhash64(F.lit(seed + level), "x.id", "x.rk", "x.size", "x.src"), F.lit(n))
        groups = open_.groupBy(F.col("x.src"), F.expr("x.size > 0"), bucket).agg(F.collect_list("x").alias("xs"))
        mixed = F.array_sort(F.transform("xs", lambda x: F.struct(F.xxhash64(F.lit(seed - 1 - level), x["id"], x["rk"], x["size"]).alias("h"), x["id"].alias("id"), x["rk"].alias("rk"), x.alias("x"))))
        done = groups.select(F.aggregate(mixed, start, _pair(seed + 100 + level)).alias("r")).select("r.*")
        if n == 1:  # the last row of a source falls either way
            last = F.expr("a").alias("x")
            done = saved(done, "mix-level")
            end = done.select(last).select(_item(F.col("x"), (_draw(seed + 999, F.col("x.id"), F.col("x.rk")) < F.col("x.p")).cast("double")).alias("x"))
            settled = _plus(settled, _plus(done.select(F.explode("done").alias("x")), end))
            break
        done = saved(done, "mix-level")
        settled = _plus(settled, done.select(F.explode("done").alias("x")))
        open_ = done.select(F.col("a").alias("x"))
        largest, level = open_.groupBy(F.col("x.src"), F.expr("x.size > 0")).count().agg(F.max("count")).first()[0] or 0, level + 1
    out = ["id", "rk", "src", "size", "m", "total"]
    whole = u.where("part <= 0").withColumn("total", F.col("whole").cast("long")).select(out)
    if settled is None:
        return whole
    f = u.select("src", "f").distinct()
    drawn = settled.select("x.*").alias("s").join(f.alias("f"), F.expr("s.src <=> f.src"))
    return whole.unionByName(drawn.withColumn("total", (F.floor(F.col("m") * F.col("f")) + F.round("p")).cast("long")).select("id", "rk", F.col("s.src").alias("src"), "size", "m", "total"))


def _plus(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.union(b)


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """rows(id, rk, src, size) -> units with their copies (total, for m rows), and the sources' targets."""
    units = saved(rows.groupBy("id", "rk", "src", "size").agg(F.count("*").alias("m")), "mix-rows")
    sizes = units.groupBy("src").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    goal = saved(targets(sizes, weights, cap), "mix-targets")
    per = goal.select(F.col("src").alias("_src"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0).alias("f"))
    return copies(units.join(per, F.expr("src <=> _src")).drop("_src")), goal


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id_col, size, source_size, target (its source's), taken (words, copies counted)."""
    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("rk"), F.col(source_col).alias("src"), n_words(F.col(text_col)).alias("size"))
    units, goal = plan_mix(rows)
    each = units.join(goal.withColumnRenamed("src", "_src"), F.expr("src <=> _src")).select("*", F.explode(F.expr("sequence(1L, m)")).alias("i"))
    mine = F.expr("total div m + if(i <= total % m, 1, 0)")
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", (mine * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    names = docs.columns
    key = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{names.index(c)}" for c in (id_col, text_col, source_col)}
    key = key.withColumns({"id": F.col(at[id_col]), "rk": F.xxhash64(*[f"c{i}" for i in range(len(names))]), "src": F.col(at[source_col]), "size": n_words(F.col(at[text_col]))})
    units, _ = plan_mix(key.select("id", "rk", "src", "size"))
    # equal rows meet before the shuffle; the join then finds them where they are
    once = key.groupBy(F.coalesce("id", F.lit(0)).alias("jid"), F.col("rk").alias("jrk"), F.col("id").isNull().alias("jnull")).agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    taken = units.where("total > 0").select(F.coalesce("id", F.lit(0)).alias("jid"), F.col("rk").alias("jrk"), F.col("id").isNull().alias("jnull"), "total")
    out = once.join(taken, ["jid", "jrk", "jnull"]).select("*", F.explode(F.expr("sequence(1L, total)")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
