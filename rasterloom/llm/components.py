"""Connected components by alternating large and small stars (Kiveris et al., 2014), each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, release, saved


#: Up to so many links the least neighbours, a row for each node, are sent to all tasks; beyond, they are joined by a
#: shuffle.
BROADCAST_LINKS = 100_000


def _least(e: DataFrame, few: bool) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return F.broadcast(least) if few else least


def _large(e: DataFrame, few: bool) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.where("v > u").join(_least(both, few), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return met.where("u != v")


def _small(e: DataFrame, few: bool) -> DataFrame:
    """u > v in e. u and its lower neighbours are linked to the least of them."""
    met = e.join(_least(e, few), "u")
    links = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return met.select(F.explode(links).alias("x")).select("x.u", "x.v").where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of an ordered type -> (node, root), root the least node that can be reached; one row for each
    node of an edge that isn't a root itself. Rounds grow with the logarithm of the number of nodes."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    check = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    e, before, since = saved(e, "edges", check=check), None, marked() - 1
    while True:
        now = e.observed["rows"], e.observed["check"]
        if now == before or not now[0]:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.observed = e.observed
            return out
        before = now
        few = now[0] <= BROADCAST_LINKS
        e = saved(_small(_large(e, few), few), "edges", check=check)
        release(edges.sparkSession, since)  # the rounds before it
