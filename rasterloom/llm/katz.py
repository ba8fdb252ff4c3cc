"""Language-model scoring: a Katz backoff bigram model over all training documents.

    P(w | h) = d(c) * c(h, w) / N(h)   where h w occurs in training, c its count, N(h) the sum of h's counts
             = a(h) * P(w)             elsewhere; a(h) gives h's left mass to the words not seen behind it
    P(w)     = d(c) * c(w) / N         for the words of the training documents
             = the mass that is left   for the one class of all other words

d is the Good-Turing discount of counts up to 5 (an absolute discount where the counts of counts allow none, and no
discount but one count more in the sum where there are no single counts), so each distribution sums to 1 over the
words of training and the class of the unknown. The context before a text's first word is a symbol of its own.

Documents are cut into chunks of tokens, written once as local word numbers. A chunk asks for each of its distinct
words once, and for each of its distinct bigrams once, whatever their frequency, so no word or bigram is a hot key.
The tables are partitioned by word and by context; each part counts what all chunks send it and answers each chunk.
Part numbers grow with the input, so a part's size does not. Words are known by 64-bit hashes.

Defined cases: null and empty texts have one token, the end; repeated rows count as often as they come; a null id
counts as the empty text when rows are dealt to training; a text of any length is taken whole (a chunk holds whole
texts); without training rows every word is of the unknown class; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

TOP = 5  # counts up to this are discounted
UNKNOWN, BEGIN = 0, 1 << 62  # word numbers that no word has
END_WORD = b""


def pack(a: np.ndarray) -> bytes:
    """Whole numbers, in as few bytes as the largest needs, compressed."""
    import zstandard

    kind = next(t for t in ("u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) <= np.iinfo(t).max)
    return kind[-1].encode() + zstandard.compress(a.astype(kind).tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(b[1:]), dtype=f"<u{b[:1].decode()}")


def discounts(n: list[int]) -> np.ndarray:
    """n: how many types have count 1 .. TOP + 1 -> the factors of counts 0 .. TOP (of count 0: unused)."""
    n = np.array([0, *n], dtype=float)
    if n[1] > 0 and (n[1:] > 0).all():
        r = np.arange(1, TOP + 1)
        most = (TOP + 1) * n[TOP + 1] / n[1]
        d = ((r + 1) * n[2:] / (r * n[1 : TOP + 1]) - most) / (1 - most) if most < 1 else np.zeros(TOP)
        if (d > 0).all() and (d <= 1).all():
            return np.array([1.0, *d])
    if n[1] > 0:
        off = n[1] / (n[1] + 2 * n[2])
        off = off if off < 1 else 0.5
        return np.array([1.0, *(1 - off / np.arange(1, TOP + 1))])
    return np.ones(TOP + 1)


def left_mass(d: np.ndarray, total, types) -> tuple:
    """total: a sum of counts; types[r - 1]: how many of them are r -> the sum that probabilities are taken of, and
    the mass left for what was not seen."""
    total = np.asarray(total, dtype=float)
    kept = total - sum((1 - d[r]) * r * np.asarray(types[r - 1], dtype=float) for r in range(1, TOP + 1))
    none = kept > total * (1 - 1e-12)
    of = np.where(none, total + 1, np.maximum(total, 1))
    return of, np.where(none, 1 / of, 1 - kept / of)


class Unigrams:
    def __init__(self, total: int, types: list[int]):
        self.d = discounts(types)
        of, left = left_mass(self.d, total, types)
        self.of, self.unknown = float(of), float(left)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c > 0, self.d[np.where(c <= TOP, c, 0)] * c / self.of, self.unknown)


def _chunks(size: int):
    """Documents (doc_id, text, train) -> chunks. Local word numbers are in order of the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        task, seq = TaskContext.get().partitionId(), 0
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, train, ends, tokens = [], [], [], []

        def chunk(kind: pa.DataType) -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            words = np.fromiter(map(xxh64_intdigest, number), dtype=np.uint64, count=len(number))
            order = np.argsort(words, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            flat, lengths, trained = rank[flat], np.array(ends), np.array(train)
            counts = np.bincount(flat[np.repeat(trained, lengths)], minlength=len(order))
            cols = [pa.array([(task << 32) + seq]), pa.array([ids], pa.list_(kind)), *[pa.array([pack(x)], pa.binary()) for x in (trained, lengths, flat, words[order], counts)]]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "train", "lengths", "tokens", "words", "counts"])

        held = 0
        for b in batches:
            kind = b.column(0).type
            for i, text, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END_WORD)
                tokens.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
                ids.append(i.as_py())
                train.append(t.as_py())
                ends.append(len(words))
                held += len(words)
                if held >= size:
                    yield chunk(kind)
                    seq, held = seq + 1, 0
                    number.clear()
                    ids, train, ends, tokens = [], [], [], []
        if ids:
            yield chunk(kind)

    return run


def _word_requests(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, words, counts in zip(pdf["chunk"], pdf["words"], pdf["counts"], strict=True):
                words, counts = unpack(words), unpack(counts)
                cut = np.searchsorted(words.astype(np.uint64), np.arange(1, n, dtype=np.uint64) * np.uint64((1 << 64) // n))
                yield pd.DataFrame([(b, chunk, pack(w), pack(c)) for b, (w, c) in enumerate(zip(np.split(words, cut), np.split(counts, cut), strict=True)) if len(w)], columns=["bucket", "chunk", "words", "counts"])

    return run


def _types(c: np.ndarray) -> list[int]:
    return np.bincount(c[c <= TOP + 1].astype(np.int64), minlength=TOP + 2)[1:].tolist()


WORDS = "chunk long, bucket int, numbers binary, counts binary, stats array<long>"


def _count_words(n: int):
    """All chunks' words of a bucket -> each chunk's answer (word numbers, counts), and one row of statistics."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        each = [unpack(w) for w in pdf["words"]]
        words, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack(c) for c in pdf["counts"]]), minlength=len(words)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = 1 + np.arange(len(words)) * n + key[0]  # frequent words have small numbers
        number[total == 0] = UNKNOWN
        rows, begin = [], 0
        for chunk, w in zip(pdf["chunk"], each, strict=True):
            mine = at[begin : begin + len(w)]
            rows.append((chunk, key[0], pack(number[mine]), pack(total[mine]), None))
            begin += len(w)
        rows.append((-1, key[0], None, None, [int(total.sum()), int((total > 0).sum()), *_types(total)]))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "numbers", "counts", "stats"])

    return run


class Bigrams:
    """A chunk's distinct bigrams, by context; the same on each call for the same chunk."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame):
        answers = answers.sort_values("bucket")
        self.number = np.concatenate([unpack(x) for x in answers["numbers"]]).astype(np.int64)
        self.count = np.concatenate([unpack(x) for x in answers["counts"]]).astype(np.int64)
        self.lengths, self.train = unpack(row["lengths"]).astype(np.int64), unpack(row["train"]).astype(bool)
        self.tokens = unpack(row["tokens"]).astype(np.int32)
        n = len(self.number)
        key = np.empty(len(self.tokens), np.int64)
        key[0], key[1:] = n, self.tokens[:-1]
        key[np.cumsum(self.lengths)[:-1]] = n
        key *= n + 1
        key += self.tokens
        # as np.unique, which holds twice as much; a chunk's arrays are most of what a task takes
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.at = np.empty(len(key), np.int32)
        self.at[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        key = key[new]
        self.word = (key % (n + 1)).astype(np.int32)
        key //= n + 1
        first = np.concatenate([[True], key[1:] != key[:-1]])
        self.starts, self.of = np.flatnonzero(first), np.cumsum(first, dtype=np.int32) - 1
        self.contexts = key[self.starts]
        self.runs = np.diff([*self.starts, len(key)])
        self.context_number = np.where(self.contexts == n, BEGIN, self.number[np.minimum(self.contexts, n - 1)])

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, its contexts, their bigrams); contexts that were not seen in training have none."""
        bucket = (self.context_number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n
        known = np.flatnonzero(self.context_number != UNKNOWN)
        order = known[np.lexsort((self.context_number[known], bucket[known]))]
        cut = np.searchsorted(bucket[order], np.arange(1, n))
        for b, mine in enumerate(np.split(order, cut)):
            if len(mine):
                runs = self.runs[mine]
                rows = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(self.starts[mine], runs)
                yield b, mine, rows


ASK = "bucket int, chunk long, contexts binary, runs binary, words binary, counts binary, single binary"


def _bigram_requests(n: int):
    def run(key: tuple, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in ASK.split(", ")]
        if not len(chunk):
            return pd.DataFrame(columns=names)
        g = Bigrams(chunk.iloc[0], answers)
        trained = np.bincount(g.at[np.repeat(g.train, g.lengths)], minlength=len(g.word))
        single = g.count[g.word]
        rows = [(b, key[0], pack(np.diff(g.context_number[mine], prepend=0)), pack(g.runs[mine]), pack(g.number[g.word[at]]), pack(trained[at]), pack(single[at])) for b, mine, at in g.buckets(n)]
        return pd.DataFrame(rows, columns=names)

    return run


PAIRS = "chunk long, bucket int, counts binary, total binary, types array<binary>, seen binary, stats array<long>"


def _count_bigrams(unigrams: Unigrams):
    """All chunks' bigrams of a bucket -> each chunk's answer: its bigrams' counts, and for each of its contexts the
    sum of counts, how many are 1 .. TOP, and the unigram mass of the words seen; and one row of statistics."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [unpack(x).astype(np.int64) for x in pdf["runs"]]
        contexts, which = np.unique(np.concatenate([np.cumsum(unpack(x).astype(np.int64)) for x in pdf["contexts"]]), return_inverse=True)
        words, word = np.unique(np.concatenate([unpack(x).astype(np.int64) for x in pdf["words"]]), return_inverse=True)
        pair, at = np.unique(np.repeat(which, np.concatenate(runs)) * np.int64(len(words)) + word, return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([unpack(x) for x in pdf["counts"]]), minlength=len(pair)).astype(np.int64)
        single = np.zeros(len(words), np.int64)
        single[word] = np.concatenate([unpack(x) for x in pdf["single"]])
        of, what = np.divmod(pair, len(words))
        sums = lambda w: np.bincount(of, weights=w, minlength=len(contexts))
        total = sums(count).astype(np.int64)
        types = [sums(count == r).astype(np.int64) for r in range(1, TOP + 1)]
        seen = sums(np.where(count > 0, unigrams(single[what]), 0.0))
        rows, begin, first = [], 0, 0
        for chunk, r in zip(pdf["chunk"], runs, strict=True):
            mine, own = at[begin : begin + r.sum()], which[first : first + len(r)]
            rows.append((chunk, key[0], pack(count[mine]), pack(total[own]), [pack(t[own]) for t in types], seen[own].astype("<f8").tobytes(), None))
            begin, first = begin + r.sum(), first + len(r)
        rows.append((-1, key[0], None, None, None, None, _types(count)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PAIRS.split(", ")])

    return run


def _scores(n: int, unigrams: Unigrams, d: np.ndarray, total: int, types: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(_: tuple, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame(columns=names)
        g = Bigrams(chunk.iloc[0], answers[answers["kind"] == 0])
        pairs = answers[answers["kind"] == 1].set_index("bucket")
        single = unigrams(np.where(g.number > 0, g.count, 0))[g.word]
        count = np.zeros(len(g.word), np.int64)
        of, backoff = np.ones(len(g.contexts)), np.ones(len(g.contexts))
        for b, mine, rows in g.buckets(n):
            a = pairs.loc[b]
            count[rows] = unpack(a["counts"])
            sums, kinds = unpack(a["total"]).astype(np.int64), [unpack(x) for x in a["types"]]
            by, left = left_mass(d, sums, kinds)
            seen = np.frombuffer(a["seen"], dtype="<f8")
            of[mine] = np.where(sums > 0, by, 1.0)
            backoff[mine] = np.where(sums > 0, left / np.maximum(1 - seen, 1e-15), 1.0)
        p = np.log10(np.where(count > 0, d[np.where(count <= TOP, count, 0)] * count / of[g.of], backoff[g.of] * single))
        del single, count
        doc = np.repeat(np.arange(len(g.lengths), dtype=np.int32), g.lengths)
        base = np.log10((g.count + 0.5) / (total + 0.5 * (types + 1)))

        def add(x: np.ndarray, at: np.ndarray, step: int = 1 << 18) -> np.ndarray:
            """Sums of x[at] by document."""
            out = np.zeros(len(g.lengths))
            for k in range(0, len(at), step):
                part = doc[k : k + step]
                out[part[0] : part[-1] + 1] += np.bincount(part - part[0], weights=x[at[k : k + step]])
            return out

        return pd.DataFrame({
            "doc_id": pd.Series(list(chunk.iloc[0]["ids"]), dtype=object), "held_out": ~g.train, "n_tokens": g.lengths, "n_known": add(g.count > 0, g.tokens).astype(np.int64),
            "train_tokens": total, "base_score": add(base, g.tokens), "score": add(p, g.at),
        })

    return run


def _power(n: float) -> int:
    return max(8, 1 << int(np.ceil(np.log2(max(n, 1)))))


def katz(docs: DataFrame, chunk_tokens: int = 3_000_000, part: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score. The model
    learns from the rows that are not held out."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (~held).alias("train"))
    binary = ", ".join(f"{x} binary" for x in ("train", "lengths", "tokens", "words", "counts"))
    chunks = saved(rows.mapInArrow(_chunks(chunk_tokens), f"chunk long, ids array<{kind}>, {binary}"), "katz-chunks")
    size = chunks.agg(F.count("*"), F.sum(F.octet_length("words")) / 8, F.sum(F.octet_length("tokens"))).first()
    n_words, n_pairs = _power((size[1] or 0) / part), _power((size[2] or 0) / part)

    asked = chunks.select("chunk", "words", "counts").mapInPandas(_word_requests(n_words), "bucket int, chunk long, words binary, counts binary")
    words = saved(asked.groupBy("bucket").applyInPandas(_count_words(n_words), WORDS), "katz-words")
    total, types, *each = _sums(words, 2 + TOP + 1)
    unigrams = Unigrams(total, each)
    replies = words.where("stats is null").drop("stats")

    asked = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(_bigram_requests(n_pairs), ASK)
    pairs = saved(asked.groupBy("bucket").applyInPandas(_count_bigrams(unigrams), PAIRS), "katz-bigrams")
    d = discounts(_sums(pairs, TOP + 1))

    both = replies.withColumn("kind", F.lit(0)).unionByName(pairs.where("stats is null").drop("stats").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(_scores(n_pairs, unigrams, d, total, types), result)
    return out.withColumnRenamed("doc_id", id_col)


def _sums(parts: DataFrame, n: int) -> list[int]:
    """The parts' statistics, added up; a row of n numbers."""
    row = parts.where("stats is not null").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()
    return [int(x or 0) for x in row]
