"""Ours, beyond the batch operators: files as they come, and tiles as they complete images."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.container import parsed


def incoming(spark: SparkSession, folder: str, table: str = "tiles", per_trigger: int = 100) -> DataFrame:
    """A container table of the files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return parsed(files, table)


def complete_images(tiles: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """tiles(image_id, tile_x, tile_y, expected) as a stream -> image_id, n_tiles, complete: a row once all expected
    tiles of an image have come, or once none has for idle_ms of processing time. Repeated tiles count once."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, expected = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"image_id": [key[0]], "n_tiles": [len(seen)], "complete": [False]})
            return
        for pdf in parts:
            seen |= {int(x) << 16 | int(y) for x, y in zip(pdf["tile_x"], pdf["tile_y"], strict=True)}
            expected = max(expected, int(pdf["expected"].max()))
        if len(seen) >= expected:
            state.remove()
            yield pd.DataFrame({"image_id": [key[0]], "n_tiles": [len(seen)], "complete": [True]})
        else:
            state.update((sorted(seen), expected))
            state.setTimeoutDuration(idle_ms)

    return tiles.groupBy("image_id").applyInPandasWithState(run, "image_id string, n_tiles int, complete boolean", "seen array<int>, expected int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_errors(pairs: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """pairs(ts, a, c) as a stream -> window, n, mae, mse; rows later than `late` are left out."""
    d = F.col("a") - F.col("c")
    out = pairs.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))
    return out.select("window.start", "window.end", "n", "mae", "mse")
