"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null is the empty text; nothing else is changed, as any
other folding could change a count) next to the digest of the tokenizer's file. Counts already in the cache are
joined; of the rest each distinct text is encoded once and appended.

Defined cases: null and empty text count 0; repeated rows and copies get the same count, from one encoding; a text
of any length is encoded whole; a null doc_id is an ordinary value; other columns are ignored; an empty table gives
an empty result and an empty cache.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir

CACHE = "version string, digest binary, n_tokens long"


@lru_cache(maxsize=4)
def _encoder(path: str):
    """texts -> counts, for the library that the file's ending names."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counts(path: str, batch_chars: int = 1 << 20):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path)
        for pdf in batches:
            out, held, chars = [], [], 0
            for text in pdf["text"]:
                held.append(text)
                chars += len(text)
                if chars > batch_chars:
                    out += encode(held)
                    held, chars = [], 0
            if held:
                out += encode(held)
            yield pd.DataFrame({"version": pdf["version"], "digest": pdf["digest"], "n_tokens": pd.Series(out, dtype="int64")})

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_tokens, over_limit. cache: a Parquet folder all machines
    see; by default one of its own in the shared folder, for one call."""
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    tag = version(tokenizer)
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    known = read_cache(spark, cache).where(F.col("version") == tag)
    # copies go before the shuffle (partial aggregation), so a text of which there are many is no hot key
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(known.select("digest"), "digest", "left_anti")
    misses.withColumn("version", F.lit(tag)).mapInPandas(_counts(tokenizer), CACHE).write.mode("append").parquet(cache)
    # written down, so that the join below is of two shuffles alone and Spark can split a digest that many rows share
    counts = saved(read_cache(spark, cache).where(F.col("version") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    rows = keyed.select("_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "digest").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
