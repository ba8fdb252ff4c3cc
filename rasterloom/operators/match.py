"""Matching files by name. Files of one folder are compared with each other, never all with all, and within a folder
names meet by the parts they share: a name that holds another has it among its substrings, so a folder's files take
rows in proportion to their names' characters, not pairs. Of files that would score alike only the first are kept
before they meet anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_extension, match_keys, match_text, stem


def _parts(c: str) -> Column:
    """All distinct substrings of a column, which must not be empty."""
    return F.expr(f"array_distinct(flatten(transform(sequence(1, length({c})), i -> transform(sequence(1, length({c}) - i + 1), n -> substring({c}, i, n)))))")


def best_sources(files: DataFrame, candidates: DataFrame, by: str = "folder") -> DataFrame:
    """files(by, path) with the candidate of the same folder whose name fits best, null if none does: the best key's
    score (500 equal, 280 the key holds the name, 200 the name holds the key, else 0), and 8 for jpg or 4 for png; the
    first in order of lower-case paths on a tie."""
    keys = files.select(by, F.col("path").alias("file"), match_keys(stem(F.col("path"))).alias("keys"))
    each = keys.select(by, "file", F.explode("keys").alias("k"))
    ext = lower_extension(F.col("path"))
    bonus = F.when(ext.isin(".jpg", ".jpeg"), 8).when(ext == ".png", 4).otherwise(0)
    c = candidates.select(by, F.col("path").alias("source"), match_text(stem(F.col("path"))).alias("name"), bonus.alias("bonus"))
    rank = F.struct((-F.col("bonus")).alias("less"), F.lower("source").alias("lower"), F.col("source").alias("source"))
    named = c.where("name != ''").groupBy(by, F.col("name").alias("part")).agg(F.min(rank).alias("best"))
    held = c.where("name != ''").withColumn("part", F.explode(_parts("name"))).groupBy(by, "part").agg(F.min(rank).alias("best"))
    holds = each.withColumn("part", F.explode(_parts("k"))).join(named, [by, "part"]).select(by, "file", F.when(F.col("part") == F.col("k"), 500).otherwise(280).alias("points"), "best")
    inside = each.withColumn("part", F.col("k")).join(held, [by, "part"]).select(by, "file", F.lit(200).alias("points"), "best")
    ending = each.select(by, "file").distinct().join(c.where("bonus > 0").groupBy(by).agg(F.min(rank).alias("best")), by).select(by, "file", F.lit(0).alias("points"), "best")
    found = holds.union(inside).union(ending).select(by, "file", F.struct((F.col("best.less") - F.col("points")).alias("less"), "best.lower", "best.source").alias("best"))
    best = found.groupBy(by, "file").agg(F.min("best").alias("best")).select(by, "file", "best.source", (-F.col("best.less")).cast("int").alias("score"))
    return keys.select(by, "file").join(best, [by, "file"], "left")


def suggestions(wanted: DataFrame, files: DataFrame, n: int = 3, by: str = "folder") -> DataFrame:
    """wanted(by, path) with up to n files of the same folder and ending with similar names: by score, then by the
    shorter name, then by name. 100 equal names, 40 one that begins with the wanted, 20 holds it, 10 is held by it;
    5 for the ending."""
    w = wanted.select(by, F.col("path").alias("wanted"), F.lower(stem(F.col("path"))).alias("ws"), lower_extension(F.col("path")).alias("we"))
    f = files.select(by, "path", F.lower(stem(F.col("path"))).alias("fs"), lower_extension(F.col("path")).alias("fe"))
    short = [F.length("path"), F.col("path")]

    def first(df: DataFrame, *same: str) -> DataFrame:
        """The n first files of those that are alike in all that a score asks."""
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(by, *same).orderBy(*short))).where(F.col("_n") <= n).drop("_n")

    # names that hold the wanted one: alike if they begin with it or not, and equal or not
    parts = f.where("fs != ''").withColumn("part", F.explode(_parts("fs"))).withColumns({"begins": F.col("fs").startswith(F.col("part")), "equal": F.col("fs") == F.col("part")})
    holds = w.where("ws != ''").join(first(parts, "part", "begins", "equal", "fe").drop("begins", "equal"), (F.col("part") == F.col("ws")) & (w[by] == f[by])).select(w[by], "wanted", "ws", "we", "path", "fs", "fe")
    # names that the wanted one holds
    names = first(f, "fs", "fe")
    inner = w.withColumn("part", F.explode(F.when(F.col("ws") == "", F.array(F.lit(""))).otherwise(F.concat(_parts("ws"), F.array(F.lit(""))))))
    inside = inner.join(names, (F.col("part") == F.col("fs")) & (inner[by] == f[by])).select(inner[by], "wanted", "ws", "we", "path", "fs", "fe")
    # no name in common: the ending alone
    ending = w.join(first(f, "fe"), (F.col("we") == F.col("fe")) & (w[by] == f[by])).select(w[by], "wanted", "ws", "we", "path", "fs", "fe")
    met = holds.union(inside).union(ending).where("we = '' OR we = fe").dropDuplicates([by, "wanted", "path"])
    some = F.col("ws") != ""
    points = lambda c, p: F.when(c, p).otherwise(0)
    score = points(F.col("ws") == F.col("fs"), 100) + points(some & F.col("fs").startswith(F.col("ws")), 40) + points(some & F.col("fs").contains(F.col("ws")), 20) + points(some & F.col("ws").contains(F.col("fs")), 10) + points(F.col("we") == F.col("fe"), 5)
    met = met.withColumn("score", score).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(by, "wanted").orderBy(F.desc("score"), *short))
    return met.withColumn("rank", rank).where(F.col("rank") <= n).select(by, "wanted", "rank", "path", "score")
