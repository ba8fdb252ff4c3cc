"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared lower-cased, with runs of white space as one space. An item of L characters
may be found with k = floor(rate * L) edits. A copy with that many keeps at least L + 1 - q * (k + 1) of its
q-grams, all within k + 1 neighbouring diagonals (place in the text less place in the item). Diagonals are cut into
bands of twice that width, each overlapping the next by half, so that some band holds them all; bands with that many
shared q-grams are retained and verified by alignment within the band. The bound is a guarantee, so nothing within
the budget is missed.

The items are indexed in blocks of about `block_chars` characters, each sent to all tasks and matched against every
document, whole; texts are joined up to `at_once` characters, so memory is bounded by that and the longest text.

Defined cases: null and empty texts have no matches; a null or empty item matches nothing; an item under min_chars
characters only matches a text that equals it; one too short for its budget (L < q * (k + 1)) gets the largest that
the lemma allows; items with equal text each match; repeated rows each give their matches; null ids are ordinary
values; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MATCH = "edits int, n_regions int, region_start long, region_end long"


def normalised(text: str | None) -> str:
    return " ".join((text or "").replace("\0", " ").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


BASE, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _hashes(x: np.ndarray, q: int) -> np.ndarray:
    """The polynomial hash of every q-gram of x, from those of its halves."""
    if q == 1:
        return x.astype(np.uint64) * np.uint64(MIX)
    half, n = q // 2, max(0, len(x) - q + 1)
    part = _hashes(x, half)
    out = part[:n] * np.uint64(pow(BASE, half, 1 << 64)) + part[half : half + n]
    if q % 2:
        out = out * np.uint64(BASE) + x[q - 1 :].astype(np.uint64) * np.uint64(MIX)
    return out


def _spread(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(BASE)


class Index:
    """The q-grams of a block of items, with each item's edit budget and bound."""

    def __init__(self, items: list[tuple[int, str]], q: int = 8, rate: float = 0.1, min_chars: int = 20):
        self.q = q
        self.whole: dict[str, list[int]] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, of, at, budget = [], [], [], []
        for i, raw in items:
            text = normalised(raw)
            if not text:
                continue
            x = codes(text)
            if len(x) < max(min_chars, q):
                self.whole.setdefault(text, []).append(i)
                continue
            h = _spread(_hashes(x, q))
            hashes.append(h)
            of.append(np.full(len(h), len(self.items)))
            at.append(np.arange(len(h)))
            budget.append(min(int(rate * len(x)), len(x) // q - 1))
            self.items.append((i, x))
        self.k = np.array(budget, dtype=np.int64)
        self.length = np.array([len(x) for _, x in self.items], dtype=np.int64)
        self.bound = self.length + 1 - q * (self.k + 1)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.of = (np.concatenate(of) if of else np.empty(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, np.int64))[order]
        self.hash, self.start, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = max(16, int(len(flat)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self.hash >> np.uint64(64 - self.bits)] = True

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item id, edits, regions, start, end) for normalised texts; places are characters of the text."""
        for t, text in enumerate(texts):
            for i in self.whole.get(text, ()):
                yield t, i, 0, 1, 0, len(text)
        if not self.items:
            return
        between = "\0" * (int(self.k.max()) + 1)  # more than any budget, so no alignment reaches into the next text
        x = codes(between.join(texts))
        if len(x) < self.q:
            return
        begins = np.cumsum([0, *[len(s) + len(between) for s in texts]])
        h = _spread(_hashes(x, self.q))
        place = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
        h = h[place]
        found = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = self.hash[found] == h
        place, found = place[same], found[same]
        n = self.count[found]
        total = int(n.sum())
        if not total:
            return
        row = np.repeat(np.arange(len(found)), n)
        entry = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + self.start[found][row]
        item = self.of[entry]
        # the first character of the text at which the item would start, moved to stay above zero
        diagonal = place[row] - self.at[entry] + int(self.length.max())
        band = diagonal // (self.k[item] + 1)
        key = item * np.int64(len(x) + int(self.length.max()) + 2) + band
        key = np.concatenate([key, key[band > 0] - 1])
        key, votes = np.unique(key, return_counts=True)
        item, band = np.divmod(key, np.int64(len(x) + int(self.length.max()) + 2))
        kept = votes >= self.bound[item]
        item, band = item[kept], band[kept]
        hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        cuts = np.flatnonzero(np.diff(item)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(item)], strict=True) if len(item) else ():
            j = int(item[lo])
            for a in range(lo, hi, 4096):
                self._verify(j, band[a : min(hi, a + 4096)], x, begins, hits)
        for (t, j), found in hits.items():
            regions = _regions(found, len(self.items[j][1]))
            edits, start, end = min(regions)
            yield t, self.items[j][0], edits, len(regions), start, end

    def _verify(self, j: int, band: np.ndarray, x: np.ndarray, begins: np.ndarray, hits: dict) -> None:
        """Aligns item j with the bands' regions: the item whole, the region's ends free. A cell holds its edits and,
        in its lower half, the diagonal on which its alignment began."""
        y, k = self.items[j][1], int(self.k[j])
        low = band * (k + 1) - int(self.length.max()) - k  # the band's first diagonal, with room for k on both sides
        width = 4 * k + 3
        steps, one = np.arange(width), np.int64(1) << np.int64(32)
        reach = low[:, None] + np.arange(len(y) + width)
        window = np.where((reach >= 0) & (reach < len(x)), x[np.clip(reach, 0, len(x) - 1)], 0)
        d = np.broadcast_to(steps.astype(np.int64), (len(band), width))
        edge = np.full((len(band), 1), one * len(y))
        for i in range(len(y)):
            up = np.concatenate([d[:, 1:], edge], axis=1) + one
            d = np.minimum(d + (window[:, i : i + width] != y[i]) * one, up)
            d = np.minimum.accumulate(d - steps * one, axis=1) + steps * one
        end, least = d.argmin(axis=1), d.min(axis=1)
        edits, begin = least >> np.int64(32), least & (one - 1)
        for r in np.flatnonzero(edits <= k):
            stop = int(low[r] + len(y) + end[r])  # behind the last character that takes part
            t = int(np.searchsorted(begins, max(stop - 1, 0), side="right")) - 1
            hits.setdefault((t, j), []).append((int(edits[r]), int(low[r] + begin[r] - begins[t]), stop - int(begins[t])))


def _regions(found: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """Alignments (edits, start, end) of an item -> the best of each region: those that overlap by more than half of the
    item are one, as overlapping bands see a copy twice."""
    out: list[tuple[int, int, int]] = []
    for hit in sorted(set(found), key=lambda h: (h[2], h[1])):
        if out and out[-1][2] - hit[1] > length // 2:
            out[-1] = min(out[-1], hit)
        else:
            out.append(hit)
    return out


def _batches(texts: Iterable[str | None], at_once: int) -> Iterator[tuple[list[int], list[str]]]:
    """The numbers and normalised texts of those that aren't empty, by about at_once characters."""
    rows, held, size = [], [], 0
    for r, text in enumerate(texts):
        if text := normalised(text):
            rows.append(r)
            held.append(text)
            size += len(text)
            if size >= at_once:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def _search(index, at_once: int, schema: StructType):
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (x.as_py() for x in b.column(1))
            out = [(rows[t], *match) for rows, held in _batches(texts, at_once) for t, *match in index.value.matches(held)]
            if out:
                row, *cols = zip(*out, strict=True)
                found = [pa.array(c, f.type) for c, f in zip(cols, list(types)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *found], types.names)

    return run


def _indexes(benchmark: DataFrame, q: int, rate: float, block_chars: int, item_col: str, text_col: str) -> Iterator:
    """The blocks of items, each as a broadcast index."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in rows], q, rate))


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_chars: int = 4_000_000, at_once: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item found in it: id_col, item_id (of its own type), its least edits, the number of
    regions (alignments that overlap by more than half of the item are one), and the region of least edits, the first
    of them, in characters of the normalised text."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType.fromDDL(f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, {MATCH}")
    found = [narrow.mapInArrow(_search(index, at_once, schema), schema) for index in _indexes(benchmark, q, rate, block_chars, item_col, item_text_col)]
    return reduce(DataFrame.union, found).withColumnRenamed("doc_id", id_col)


def _leaks(index, at_once: int):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), dtype=bool)
        for rows, held in _batches(texts, at_once):
            for t, *_ in index.value.matches(held):
                out[rows[t]] = True
        return pd.Series(out)

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_chars: int = 4_000_000, at_once: int = 1 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows in which an item is found."""
    for index in _indexes(benchmark, q, rate, block_chars, item_col, item_text_col):
        docs = docs.where(~_leaks(index, at_once)(F.col(f"`{text_col}`")))
    return docs
