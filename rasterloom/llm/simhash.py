"""SimHash near-duplicates over pigeonhole blocks.

Fingerprints of 64 bits are cut into `blocks` blocks. Two that differ in at most `distance` bits agree on at least
blocks - distance blocks, so each fingerprint is keyed by every choice of that many blocks; those that share a key
are compared. Keys are about half the bits, so few pairs meet by chance even among billions. A key with more than
`group` distinct fingerprints is keyed again by the rest of its bits, cut into `fine` blocks: what then shares a key
agrees on all but a few bits, so a group has a few thousand distinct fingerprints at most, whatever the input. No
pair is lost and no group is unbounded. Only spanning links leave a group, never all its pairs.

Defined cases: null text is empty text, fingerprint zero, linked like any other; fewer words than a shingle give one
shingle of them all; copies share a node; a null doc_id gets a row, and links others, but is never a class id
(null if a class has no other id); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, saved
from .components import components

SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.astype("<u8", copy=False).view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)


def majority(h: np.ndarray, chunk: int = 1 << 16) -> int:
    """The unsigned fingerprint of shingles of these unsigned hashes."""
    ones = sum((_ones(h[at : at + chunk]) for at in range(0, len(h), chunk)), np.zeros(64, np.int64))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, chunk: int = 1 << 16) -> int:
    """The unsigned fingerprint of a text; chunk bounds the memory that a long text takes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    join = b" ".join
    for at in range(0, n, chunk):
        ones += _ones(np.array([xxh64_intdigest(join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + chunk))], dtype="<u8"))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(x.as_py(), shingle)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return run


def _masks(bits: list[int], blocks: int, keep: int, base: int = 0) -> list[int]:
    cut = np.array_split(np.array(bits), blocks)
    return [_signed(base | sum(1 << int(b) for k in chosen for b in cut[k])) for chosen in combinations(range(blocks), keep)]


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n, over links u - v."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != (up := root[root])).any():
            root = up
        live = root[u] != root[v]
        u, v = u[live], v[live]
    return root


def _links(distance: int, at_once: int = 1 << 17):
    """Rows (k, mask, fp), sorted by all three -> spanning links of what shares (k, mask) and is that close."""

    def solve(key: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u, v = [], []
        live = np.arange(len(fp) - 1)
        for lag in range(1, len(fp)):
            live = live[live + lag < len(fp)]
            live = live[(key[live] == key[live + lag]) & (mask[live] == mask[live + lag])]
            if not len(live):
                break
            near = live[np.bitwise_count(fp[live] ^ fp[live + lag]) <= distance]
            u.append(near)
            v.append(near + lag)
            if len(u) >= 64:  # pairs are folded into spanning links as they come
                root = _roots(len(fp), np.concatenate(u), np.concatenate(v))
                child = np.flatnonzero(root != np.arange(len(fp)))
                u, v = [child], [root[child]]
        if not u:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["u", "v"])
        root = _roots(len(fp), np.concatenate(u), np.concatenate(v))
        child = np.flatnonzero(root != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root[child]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if len(held[0]) >= at_once:  # up to the last key, which may go on
                ends = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
                if len(ends):
                    yield solve(held[0][: ends[-1]], held[1][: ends[-1]], held[2][: ends[-1]].view(np.uint64))
                    held = [h[ends[-1] :] for h in held]
        if len(held[0]):
            yield solve(held[0], held[1], held[2].view(np.uint64))

    return run


def close_links(fps: DataFrame, distance: int = 3, blocks: int = 6, group: int = 2048, fine: int = 8) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) that span the same classes as all pairs within distance."""
    spark = fps.sparkSession
    n = parts(spark)
    masks = _masks(list(range(64)), blocks, blocks - distance)
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select("mask", F.expr("fp & mask").alias("k"), "fp")
    sizes = saved(keyed.groupBy("mask", "k").count().where("count > 1"), "simhash-keys")
    shared = keyed.join(sizes, ["mask", "k"])
    finer = [(m, x) for m in masks for x in _masks([b for b in range(64) if not (m >> b) & 1], fine, fine - distance, m % (1 << 64))]
    large = sizes.where(F.col("count") > group).limit(1).count()
    members = shared.where(F.col("count") <= group).select("k", "mask", "fp")
    if large:
        again = F.broadcast(spark.createDataFrame(finer, "mask long, sub long"))  # a fixed number of rows
        hot = shared.where(F.col("count") > group).join(again, "mask").select(F.expr("fp & sub").alias("k"), F.col("sub").alias("mask"), "fp")
        members = members.union(hot)
    return members.repartition(n, "k", "mask").sortWithinPartitions("k", "mask", "fp").mapInArrow(_links(distance), "u long, v long")


def _each(docs: DataFrame, id_: Column, text: Column, shingle: int) -> DataFrame:
    rows = docs.select(id_.alias("doc_id"), text.alias("text"))
    return saved(rows.mapInArrow(_fingerprints(shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long"), "simhash")


def _classes(each: DataFrame, distance: int) -> DataFrame:
    """each(doc_id, fp) -> fp, component_id."""
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(close_links(nodes.select("fp"), distance))
    # a root has no row in found: it stands for itself
    labelled = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(least, "root").select("fp", "component_id", "least")


def simhash(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id (least id of its class)."""
    each = _each(docs, F.col(id_col), F.col(text_col), shingle)
    # written down, so that the join is of two shuffles alone and Spark can split a fingerprint that many rows share
    labels = saved(_classes(each, distance).drop("least"), "simhash-labels")
    return each.join(labels, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with one row of each class: the one of least id (null last), then text hash, then all columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    i, text = F.col(f"c{docs.columns.index(id_col)}"), F.col(f"c{docs.columns.index(text_col)}")
    own = own.withColumns({"jnull": i.isNull(), "jid": F.coalesce(i, F.lit(0)), "jth": F.xxhash64(text, F.length(text))})
    key = ["jnull", "jid", "jth"]
    each = _each(own, F.struct(*key), text, shingle)
    stay = _classes(each, distance).select("component_id.*").distinct()
    rows = own.join(stay, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
