"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are made integers (floor(scale * x)), and scores are their integer inner products: where the largest components
could make a double round, components are cut into a high and a low part whose products are exact. A bounded number of pivots, the vectors of least
id hash, cut the space into cells. Each cell's summary is its pivot, its radius and the k vectors nearest the pivot.
The summaries' vectors are real candidates, so a query's k-th best score among them is a floor under its answer.
Queries, in a number of cells that grows with theirs, form groups of about `block` at most, with a center, a radius, and the least floor of their queries. By
Cauchy and Schwarz no query of a group scores more than x.center + |x| * radius with x; x is sent to those groups for
which that reaches the group's floor, and to no other. Each group is solved in chunks of bounded size, and the
chunks' best k are merged. Groups are taken `wave` at a time, so what each task holds of them is bounded.

Defined cases: vectors that are null or hold a null or non-finite component take no part, and neither do rows with a
null id; shorter vectors count as filled up with zeros; the score of an empty vector is 0; rows that share an id are
never each other's candidates, and a repeated query is answered once (of its vectors, the least in order); equal
scores go to the smaller id; other columns are ignored; an empty table gives an empty result; components so large that a
score might not fit into a long are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import saved

SLACK = 1e-6
EXACT, LONG = 1 << 53, 1 << 63  # whole numbers below are exact in a double, fit into a long


def inner(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """a @ b.T of whole numbers of at most `most`, as long."""
    dim = a.shape[1]
    if dim * most * most < EXACT:
        return (a @ b.T).astype(np.int64)
    bits = (int(most).bit_length() + 1) // 2  # products of halves, added up, are exact: most is at most 2^31
    (ah, al), (bh, bl) = [(np.floor(x / (1 << bits)), x - np.floor(x / (1 << bits)) * (1 << bits)) for x in (a, b)]
    whole = lambda x, y: (x @ y.T).astype(np.int64)
    return (whole(ah, bh) << (2 * bits)) + ((whole(ah, bl) + whole(al, bh)) << bits) + whole(al, bl)


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """id, v (array<double> of whole numbers)."""
    whole = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(vs: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vs), dim))
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (pivots**2).sum(1) / 2
        for pdf in batches:
            x = _matrix(pdf["v"], pivots.shape[1])
            cell = np.argmax(x @ pivots.T - half, axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pdf.assign(cell=cell.astype("int32"), far=far)

    return run


def _groups(summary: np.ndarray, ids: np.ndarray, k: int, dim: int):
    """The queries of a group -> one row: center, radius, floor, and the queries."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["v"], dim)
        center = x.mean(axis=0)
        radius = np.sqrt(((x - center) ** 2).sum(1)).max()
        scores = x @ summary.T
        scores[pdf["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        floors = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -np.inf)
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "center": [center], "radius": [radius], "floor": [floors.min()], "ids": [pdf["id"].to_numpy()], "vs": [x.ravel()]})

    return run


def _needed(groups: list, chunks: int, dim: int):
    """Data -> a row for each group that may need it."""
    center = np.array([g["center"] for g in groups])
    far = np.sqrt((center**2).sum(1))
    radius, floor = np.array([g["radius"] for g in groups]), np.array([g["floor"] for g in groups])
    number = np.array([g["group"] for g in groups])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"], dim)
            most = x @ center.T + np.sqrt((x**2).sum(1))[:, None] * radius
            error = SLACK * (1 + np.sqrt((x**2).sum(1))[:, None] * (far + radius))  # far more than doubles round
            near = most + error >= floor
            pdf["chunk"] = (pd.util.hash_array(pdf["id"].to_numpy()) % np.uint64(chunks)).astype("int32")
            for g, needed in enumerate(near.T):  # a group at a time, so no more than a batch is copied at once
                if needed.any():
                    yield pdf.loc[needed, ["id", "v"]].assign(group=number[g], chunk=pdf["chunk"][needed])

    return run


def _solve(k: int, dim: int, largest: float):
    schema = ["query_id", "vec_id", "score"]

    def run(_: tuple, data: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(group):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in schema})
        data = data.sort_values("id", kind="stable")
        queries = np.asarray(group["ids"].iloc[0])
        q = np.asarray(group["vs"].iloc[0]).reshape(len(queries), dim)
        none = np.iinfo(np.int64).min
        score, best = np.empty((len(queries), 0), np.int64), np.empty((len(queries), 0), np.int64)
        for at in range(0, len(data), 2048):
            part = data.iloc[at : at + 2048]
            ids = part["id"].to_numpy()
            new = inner(q, _matrix(part["v"], dim), largest)
            new[queries[:, None] == ids[None, :]] = none
            score, best = np.concatenate([score, new], axis=1), np.concatenate([best, np.broadcast_to(ids, new.shape)], axis=1)
            top = np.argsort(~score, axis=1, kind="stable")[:, :k]  # descending; ids ascend, so ties go to the smaller
            score, best = np.take_along_axis(score, top, axis=1), np.take_along_axis(best, top, axis=1)
        out = pd.DataFrame({"query_id": np.repeat(queries, best.shape[1]), "vec_id": best.ravel(), "score": score.ravel()})
        return out[out["score"] != none]

    return run


@dataclass
class Plan:
    rows: DataFrame
    groups: DataFrame  # group, center, radius, floor, ids, vs
    chunks: int
    dim: int
    largest: float

    def sent(self, numbers: list[int]) -> DataFrame:
        """id, v, group, chunk: the rows that each of these groups may need."""
        bounds = self.groups.where(F.col("group").isin(numbers)).select("group", "center", "radius", "floor").collect()
        return self.rows.mapInPandas(_needed(bounds, self.chunks, self.dim), "id long, v array<double>, group long, chunk int")


def plan(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, scale: int, n_pivots: int, block: int, chunk_rows: int) -> Plan | None:
    """The groups of queries with their bounds; None if no vector takes part."""
    rows = saved(integers(vectors, id_col, vec_col, scale), "knn-vectors")
    queries = integers(vectors.where(is_query), id_col, vec_col, scale)
    n, dim, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return None
    dim, largest = max(dim, 1), largest or 0.0
    if dim * largest * largest >= LONG or largest >= 1 << 31:
        raise ValueError(f"components of up to {largest:.0f} are too large for scores in a long")
    pivots = _matrix(pd.Series([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(n_pivots).collect()]), dim)
    schema = "id long, v array<double>, cell int, far double"
    placed = rows.mapInPandas(_cells(pivots), schema)
    # per cell: the k vectors nearest its pivot; a bounded number of rows, merged from each task's own
    near = Window.partitionBy("cell", "task").orderBy("far", "id")
    some = placed.withColumn("task", F.spark_partition_id()).withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("far", "id"))).where(F.col("n") <= k + 1)
    summary = some.select("id", "v").dropDuplicates(["id"]).orderBy("id").collect()
    summary_v, summary_id = _matrix(pd.Series([r["v"] for r in summary]), dim), np.array([r["id"] for r in summary])
    # queries keep to fewer cells, so that a group is worth the data sent to it
    n_queries = queries.select("id").distinct().count()
    wide = pivots[: max(1, min(n_pivots, -(-4 * n_queries // block)))]
    asked = queries.groupBy("id").agg(F.min("v").alias("v")).mapInPandas(_cells(wide), schema)
    sizes = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row for each pivot
    split = F.lit(1)
    for cell, count in sizes.items():
        split = F.when(F.col("cell") == cell, -(-count // block)).otherwise(split)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), split).cast("int"))
    groups = asked.groupBy("cell", "part").applyInPandas(_groups(summary_v, summary_id, k, dim), "cell int, part int, center array<double>, radius double, floor double, ids array<long>, vs array<double>")
    groups = saved(groups.withColumn("group", F.struct("cell", "part")).withColumn("group", (F.col("cell").cast("long") * (1 << 31)) + F.col("part")), "knn-groups")
    return Plan(rows, groups, max(1, -(-n // chunk_rows)), dim, largest)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, n_pivots: int = 64, block: int = 512, chunk_rows: int = 20_000, wave: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row of vectors for which is_query holds."""
    spark, result = vectors.sparkSession, "query_id long, vec_id long, score long"
    found = spark.createDataFrame([], result)
    if p := plan(vectors, is_query, k, id_col, vec_col, scale, n_pivots, block, chunk_rows):
        numbers = [r["group"] for r in p.groups.select("group").orderBy("group").collect()]  # block-fold fewer than queries
        for at in range(0, len(numbers), wave):
            now = p.groups.where(F.col("group").isin(numbers[at : at + wave]))
            spread = now.select("group", "ids", "vs", F.explode(F.sequence(F.lit(0), F.lit(p.chunks - 1))).alias("chunk"))
            best = p.sent(numbers[at : at + wave]).groupBy("group", "chunk").cogroup(spread.groupBy("group", "chunk")).applyInPandas(_solve(k, p.dim, p.largest), result)
            found = found.union(best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: CAST(q.e[i] AS HUGEINT) * CAST(c.e[i] AS HUGEINT))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
