"""How rows are dealt: to many tasks, and in a global order without one task that holds all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by those columns to many tasks, for steps that cost far more than their rows' bytes: by bytes alone Spark
    would join what it shuffles for them into a few tasks, and leave most cores idle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from the shared folder, for what is costly and asked for several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """df with its rows' numbers (from 0) in the order of `by`, which must tell rows apart: rows are dealt by ranges, each
    range is numbered by itself, and the numbers of rows before it are added. The ranges come from a sample, so what they
    are is written down once, where all tasks see it."""
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))  # a row for each range
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    order = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in by])
    ranked = dealt.withColumn("_at", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")
