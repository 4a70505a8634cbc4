"""The history operators over streams: exactly-once first sightings, session counts, and events with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import REPOST_AFTER


def first_sightings(stream: DataFrame, key: list[str], at: str, overlap: str = "6 hours") -> DataFrame:
    """Each key once within the overlap that runs re-read; later repeats of a key count again."""
    return stream.withWatermark(at, overlap).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, at: str, by: list[str], window: str = "12 hours", late: str = "6 hours") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


#: Keys share so many rows of state by their hash, so a batch has at most so many groups for Python, however many keys it holds.
#: A checkpoint is bound to the number it was begun with.
BUCKETS = 1 << 12
CHUNK = 1 << 16
OUT = "job_key string, at bigint, mark bigint"
STATE = "keys array<string>, marks array<bigint>"
NONE = -(1 << 63)  # no date: null would make the longs floats in pandas


def _marks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The watermark before each row of a bucket: the newest date of its key in the state and in earlier rows. It never goes back.

    Of a row two numbers are held, and rows are given out in chunks, so that a key may have many.
    """
    known, marks = state.get if state.exists else ([], [])
    number: dict[str | None, int] = {k: n for n, k in enumerate(known)}
    parts = [(np.array([number.setdefault(k, len(number)) for k in b["job_key"]]), b["at"].to_numpy("int64")) for b in batches]
    codes, at = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((np.where(at == NONE, np.iinfo("int64").max, at), codes))  # by date in a key, undated rows last
    codes, at, keys = codes[order], at[order], np.array(list(number), object)
    stored = np.full(len(keys), NONE)
    stored[: len(known)] = marks
    newest = stored.copy()
    np.maximum.at(newest, codes, at)
    before = np.full(len(at), NONE)
    before[1:] = np.where(codes[1:] == codes[:-1], at[:-1], NONE)
    mark = np.where(at == NONE, newest[codes], np.maximum(before, stored[codes]))
    state.update((list(number), newest.tolist()))
    for n in range(0, len(at), CHUNK):
        part = slice(n, n + CHUNK)
        yield pd.DataFrame({"job_key": keys[codes[part]], "at": at[part], "mark": mark[part]})


def classify(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Events of (job_key, posted_at) rows with a watermark per key as state; rows of a key come in date order across batches.

    new until a key has a date, reposted past its watermark plus 12 hours, else seen. Within a batch rows go by date, undated ones last;
    rows of a key with one date give the same rows in any order. Python reads longs, so no time zone or range of pandas takes part.
    """
    micros = F.coalesce(F.unix_micros("posted_at"), F.lit(NONE))
    instant = lambda c: F.timestamp_micros(F.nullif(F.col(c), F.lit(NONE)))
    rows = stream.select(F.pmod(F.xxhash64("job_key"), F.lit(buckets)).alias("bucket"), "job_key", micros.alias("at"))
    out = rows.groupBy("bucket").applyInPandasWithState(_marks, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    out = out.select("job_key", instant("at").alias("posted_at"), instant("mark").alias("watermark"))
    event = F.when(F.col("watermark").isNull(), "new").when(F.col("posted_at") > F.col("watermark") + F.expr(REPOST_AFTER), "reposted").otherwise("seen")
    return out.select("job_key", "posted_at", event.alias("event"), "watermark")


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Work off what is there, batch by batch, each written once per batch id, and stop."""
    query = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def to_table(df: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Stream into a Parquet table (exactly once) until the input is used up."""
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def crawl_stream(spark: SparkSession, payload_path: str, checkpoint: str, run: Callable[[DataFrame, int], Any], max_files: int = 64) -> None:
    """Run the pipeline once per micro-batch of newly landed payload files."""
    from ..sources.base import PAYLOAD

    stream = spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", max_files).parquet(payload_path)
    run_available(stream, checkpoint, run)
