import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import spark_rows, sql_rows
from postlake.queries import QUERIES, SQL
from postlake.streaming import events
from postlake.streaming.events import classify, first_sightings, run_available, to_table, windowed_counts

SF = "/root/testdata/sf0.001"


def stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF).withColumn("at", F.col("ts").cast("timestamp"))


def test_first_sightings_are_found_once(spark, tmp_path):
    out = []
    run_available(first_sightings(stream(spark), ["event_id"], "at"), f"{tmp_path}/c", lambda df, n: out.append(df.count()))
    assert sum(out) == spark.read.parquet(f"{SF}/events.parquet").select("event_id").distinct().count()


def test_stateful_events_equal_the_window_form(spark, tmp_path):
    keyed = stream(spark).select(F.concat_ws("|", "user_id", "event_type").alias("job_key"), F.col("at").alias("posted_at"), F.col("event_id").alias("seq"))
    to_table(classify(keyed), f"{tmp_path}/c", f"{tmp_path}/t")
    got = spark.read.parquet(f"{tmp_path}/t").groupBy("event").count()
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("prev", F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    event = F.when(F.col("prev").isNull(), "new").when(F.col("ts") > F.col("prev") + F.expr("interval 12 hours"), "reposted").otherwise("seen")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, e.groupBy(event.alias("event")).count().collect()))


def test_windowed_counts_add_up(spark, tmp_path):
    to_table(windowed_counts(stream(spark), "at", ["event_type"]), f"{tmp_path}/c", f"{tmp_path}/t")
    n = spark.read.parquet(f"{tmp_path}/t").agg(F.sum("n")).first()[0]
    assert 0 < n <= 1000  # windows past the watermark are out, the newest ones wait


def test_state_rows_are_bounded_whatever_the_keys(spark, tmp_path):
    """Python is called once for each row of state that a batch touches."""
    keys = 10_000
    spark.range(keys).repartition(1).write.parquet(f"{tmp_path}/in")
    keyed = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").select(F.col("id").cast("string").alias("job_key"), F.timestamp_seconds("id").alias("posted_at"), F.col("id").alias("seq"))
    to_table(classify(keyed), f"{tmp_path}/c", f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").where("event = 'new' and watermark is null and posted_at = timestamp_seconds(cast(job_key as long))").distinct().count() == keys
    assert spark.read.format("statestore").load(f"{tmp_path}/c").count() <= 4096 < keys


def test_keys_of_one_bucket_go_their_own_ways_over_batches(spark, tmp_path):
    """Ties, undated rows, a key that is null and dates that pandas can't hold; each file is a batch of its own."""
    day = [datetime(2024, 1, 1), datetime(2400, 1, 1)]
    rows = [(b, f"k{k}" if k else None, None if (k + n) % 5 == 0 else day[b] + timedelta(hours=(n * 7 * k) % 50 // 2)) for b in range(2) for k in range(6) for n in range(12) if k != 5 or b]
    for b in range(2):
        df = spark.createDataFrame([r for r in rows if r[0] == b], "b int, job_key string, posted_at timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in (tmp_path / "in").glob("part-*.parquet"):
            if not (tmp_path / f"seen-{f.name}").exists():
                (tmp_path / f"seen-{f.name}").touch()
                os.utime(f, (1e9 + b * 1000, 1e9 + b * 1000))
    stream = spark.readStream.schema("b int, job_key string, posted_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    to_table(classify(stream, buckets=2), f"{tmp_path}/c", f"{tmp_path}/t")
    want, mark = [], {}
    for _, key, at in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2] is None, r[2] or day[0])):
        before = mark.get(key)
        want.append((key, at, "new" if before is None else "reposted" if at and at > before + timedelta(hours=12) else "seen", before))
        mark[key] = max(filter(None, (before, at)), default=None)
    assert {r[2] for r in want} == {"new", "reposted", "seen"}
    got = spark.read.parquet(f"{tmp_path}/t").select("job_key", "posted_at", "event", "watermark").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rows_of_a_bucket_are_given_out_in_chunks(monkeypatch):
    class State:
        exists, get = True, (["b"], [2])

        def update(self, value):
            self.get = value

    monkeypatch.setattr(events, "CHUNK", 3)
    state, batches = State(), [pd.DataFrame({"job_key": k, "at": at}) for k, at in ((["a", "b", "a"], [5, 1, 3]), (["b", "a"], [4, 4]))]
    got = list(events._marks((0,), iter(batches), state))
    assert [len(g) for g in got] == [3, 2] and state.get == (["b", "a"], [4, 5])
    assert pd.concat(got).values.tolist() == [["b", 1, 2], ["b", 4, 2], ["a", 3, events.NONE], ["a", 4, 3], ["a", 5, 4]]


@pytest.mark.parametrize("rows", [0, 1000])
def test_stream_of_a_folder_of_files(spark, tmp_path, rows):
    """Larger tables are folders; an empty one has no events."""
    e = spark.read.parquet(f"{SF}/events.parquet").limit(rows)
    e.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    (tmp_path / "one").mkdir()
    e.toPandas().to_parquet(tmp_path / "one" / "events.parquet", coerce_timestamps="us")
    assert spark_rows(QUERIES["q_stream_events"](spark, str(tmp_path))) == sql_rows(SQL["q_stream_events"], f"{tmp_path}/one")
