"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_saved: list[str] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: So many narrow rows, some tens of MB, are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str, **more: Column) -> DataFrame:
    """df, computed once and read back from the shared folder: a cut in the lineage that outlives any executor. Its
    `observed` has the number of rows, and what more is asked for, without another job."""
    spark = df.sparkSession
    path, seen = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in more.items()]).write.parquet(path)
    _saved.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.observed, out.path = seen.get, path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of saved tables of one schema, in a single scan. The driver holds some MB for each scan, stage and broadcast
    of a plan, all at once, so a union of many plans costs it hundreds."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.path for t in tables])


def marked() -> int:
    """How many tables are saved by now, for release()."""
    return len(_saved)


def release(spark: SparkSession, since: int) -> None:
    """Deletes the tables saved since that mark but the last one. Only for what no later read needs."""
    for path in _saved[since:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _saved[since:-1]


def sweep(spark: SparkSession) -> None:
    """Collects the driver's garbage. Spark deletes a shuffle's files once nothing in the driver refers to it, which it
    notices then only; a stage of many tables otherwise keeps the files of all its shuffles."""
    gc.collect()
    spark._jvm.System.gc()


def few_rows(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for a broadcast if it has at most BROADCAST_ROWS rows, which are known of a saved table, or told, or
    counted here."""
    if rows is None:
        rows = df.observed["rows"] if hasattr(df, "observed") else df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z. lower() gives the same ASCII letters, and is much faster, unless one of the two
    characters occurs that it turns into ASCII."""
    return F.when(F.instr(c, "\u212a") + F.instr(c, "\u0130") > 0, F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
