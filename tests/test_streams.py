"""Completion, waits and windows as streams: over many micro-batches, with late events, restarted, and what state is left."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from leafmark.streaming import jobs

SCHEMA = "event_id long, job_id long, batch_id long, status string, ts timestamp"
START = dt.datetime(2024, 3, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


class Feed:
    """A folder that events are added to, and streams over it that are stopped and started again."""

    def __init__(self, spark, tmp_path):
        self.spark, self.folder, self.n = spark, tmp_path / "in", 0
        self.checkpoint, self.out = str(tmp_path / "state"), str(tmp_path / "out")

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(self.folder / f"n={self.n:03}"))

    def events(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "*"))

    def run(self, stream):
        """What the stream has written in all, and the numbers of rows in its operators' state."""
        with jobs.with_rocksdb(self.spark):
            query = stream.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]]
        return sorted(tuple(r) for r in self.spark.read.schema(stream.schema).parquet(self.out).collect()), state


def test_each_batch_completes_once_and_leaves_no_state(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    make = lambda: jobs.stream_batch_complete(feed.events(), 3, "10 minutes", 30 * 60_000)
    feed.add([(1, 1, 1, "finished", at(0)), (2, 2, 1, "failed", at(1)), (3, 3, 2, "finished", at(2)), (4, 4, 1, "queued", at(3))])
    feed.add([(5, 5, 1, "finished", at(6)), (6, 6, 1, "finished", at(5)), (7, 7, 2, "finished", at(7))])
    want = [(1, 3, at(5))]
    got, state = feed.run(make())
    assert got == want and state[0] > 0
    # Started again with nothing new, and with more events of a completed batch: it comes out once.
    assert feed.run(make())[0] == want
    feed.add([(8, 8, 1, "finished", at(8)), (9, 9, 1, "failed", at(9)), (10, 10, 1, "failed", at(9)), (11, 11, 2, "failed", at(12))])
    want.append((2, 3, at(12)))
    assert feed.run(make())[0] == want
    # An event that opens another batch and never completes it, then only events that are not counted.
    feed.add([(12, 12, 3, "finished", at(20))])
    feed.add([(13, 13, 9, "queued", at(120))])
    feed.add([(14, 14, 9, "queued", at(121)), (15, 15, 3, "finished", at(15))])
    got, state = feed.run(make())
    assert got == want and state == [0]


def test_waits_are_those_of_the_table_and_state_is_bounded(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, r.randrange(12), 0, r.choice(["queued", "started", "finished"]), at(3 * i + r.choice([0, 0, 1, -20]))) for i in range(240)]
    table = spark.createDataFrame(rows, SCHEMA)
    feed = Feed(spark, tmp_path)
    for i in range(0, 240, 60):
        feed.add(rows[i : i + 60])
    make = lambda: jobs.stream_wait_pairs(feed.events(), "5 hours", "30 minutes")
    _, state = feed.run(make())
    pairs = spark.read.schema(make().schema).parquet(feed.out)
    want = sorted(tuple(x) for x in jobs.queue_wait(table).where(f"wait_ms <= {5 * 3_600_000}").collect())
    got = sorted(tuple(x) for x in jobs.waits(pairs).collect())
    assert got == want and len(want) > 20
    # Held are events of the last hours only, not all 240 of both sides.
    assert sum(state) < 240
    # An event that is later than the delay finds nothing.
    feed.add([(500, 3, 0, "started", at(10))])
    feed.run(make())
    assert sorted(tuple(x) for x in jobs.waits(spark.read.schema(make().schema).parquet(feed.out)).collect()) == want


def test_settled_waits_come_out_once(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([(1, 1, 0, "queued", at(0)), (2, 1, 0, "queued", at(5)), (3, 1, 0, "started", at(9)), (4, 2, 0, "queued", at(1)), (5, 2, 0, "started", at(2)), (6, 2, 0, "started", at(3))])
    feed.add([(7, 9, 0, "queued", at(300))])
    feed.add([(8, 9, 0, "queued", at(600))])
    make = lambda: jobs.waits(jobs.stream_wait_pairs(feed.events(), "1 hour", "10 minutes"))
    assert feed.run(make())[0] == [(3, 1, 240_000), (5, 2, 60_000)]
    assert feed.run(make())[0] == [(3, 1, 240_000), (5, 2, 60_000)]


def test_windows_of_panes(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, 1, 1, r.choice(jobs.STATUSES), at(r.randrange(6000))) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    direct = table.groupBy(F.window("ts", "24 hours", "1 hour")).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == k).alias(k) for k in jobs.STATUSES])
    want = sorted(tuple(x) for x in direct.select("window.start", "n", *jobs.STATUSES).collect())
    got = jobs.queue_window(table, slide="1 hour")
    assert sorted(tuple(x) for x in got.collect()) == want
    # Events are counted before anything is copied: below the expansion there is an aggregation.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")
    feed = Feed(spark, tmp_path)
    rows.sort(key=lambda x: x[4])
    for i in range(0, 400, 100):
        feed.add(rows[i : i + 100])
    streamed, _ = feed.run(jobs.queue_window(feed.events().withWatermark("ts", "2 hours"), slide="1 hour"))
    end = max(x[4] for x in rows) - dt.timedelta(hours=2)
    assert streamed == [w for w in want if w[0] + dt.timedelta(hours=24) <= end] and len(streamed) > 50
