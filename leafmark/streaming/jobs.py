"""Job status events: batch reports, and the same as streams.

Streams read growing folders of Parquet or text files. State is keyed by job or batch; windows have watermarks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmark.plans import tables as T


def job_latest(events: DataFrame) -> DataFrame:
    """Latest status of each job, with its first start and last end. Works on tables and, in update mode, on streams."""
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.min(F.when(F.col("status") == "started", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("finished", "failed"), F.col("ts"))).alias("finished_at"),
        F.min("ts").alias("created_at"),
    )


def queue_status(latest: DataFrame, default_seconds: float = 15.0, rough_seconds: float = 20.0) -> DataFrame:
    """Jobs by status and the estimated time that the pending ones take."""
    done = F.col("status").isin("finished", "failed")
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    taken = F.when(F.col("status") == "finished", F.coalesce(seconds, F.lit(default_seconds))).when(F.col("status") == "failed", default_seconds)
    counts = latest.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == k).alias(n) for k, n in (("finished", "completed"), ("failed", "failed"), ("started", "in_progress"), ("queued", "pending"))], F.avg(taken).alias("__mean"), F.count_if(done).alias("__done")
    )
    estimate = F.when(F.col("pending") == 0, 0.0).when(F.col("__done") > 0, F.col("__mean") * F.col("pending")).otherwise(F.col("pending") * rough_seconds)
    return counts.withColumn("remaining_seconds", estimate).drop("__mean", "__done")


def stuck_jobs(latest: DataFrame, now: str, minutes: int = 2) -> DataFrame:
    """Jobs that have been queued for longer than some minutes at a given time."""
    return latest.where((F.col("status") == "queued") & (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("created_at") > minutes * 60_000_000)).select("job_id", "created_at")


def newest_status(latest: DataFrame, n: int = 10) -> DataFrame:
    """Status counts of the newest jobs; of those created together, the smaller ids come first."""
    return latest.orderBy(F.desc("created_at"), "job_id").limit(n).groupBy("status").agg(F.count("*").alias("n"))


def next_job(events: DataFrame) -> DataFrame:
    """The next queued row of each batch: highest value first, then the oldest. A report; nothing is claimed."""
    first = F.struct(F.col("value").isNull(), -F.col("value"), "ts", "event_id")
    return events.where("status = 'queued'").groupBy("batch_id").agg(F.min_by(F.struct("event_id", "job_id"), first).alias("next")).select("batch_id", "next.event_id", "next.job_id")


def queue_wait(events: DataFrame) -> DataFrame:
    """Milliseconds from the previous queued event of a job to each start."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    before = events.where("status in ('queued', 'started')").withColumn("__s", F.lag("status").over(order)).withColumn("__t", F.lag("ts").over(order))
    starts = before.where("status = 'started' and __s = 'queued'")
    return starts.select("event_id", "job_id", F.floor((F.unix_micros("ts") - F.unix_micros("__t")) / 1000).cast("long").alias("wait_ms"))


def batch_complete(events: DataFrame, wanted: int) -> DataFrame:
    """Batches whose ended events reach the wanted number, and the time at which they did.

    Events are counted by hour first; only those of the hour in which a batch reaches the number are sorted.
    """
    ended = events.where("status in ('finished', 'failed')").select("batch_id", "ts", "event_id", F.date_trunc("hour", "ts").alias("hour"))
    hours = ended.groupBy("batch_id", "hour").agg(F.count("*").alias("n"))
    reached = hours.withColumn("upto", F.sum("n").over(Window.partitionBy("batch_id").orderBy("hour"))).where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
    last = reached.select(F.col("batch_id").alias("b"), F.col("hour").alias("h"), (wanted - F.col("upto") + F.col("n")).alias("nth"))
    rows = ended.join(last, F.col("batch_id").eqNullSafe(F.col("b")) & F.col("hour").eqNullSafe(F.col("h")))
    order = Window.partitionBy("batch_id").orderBy("ts", "event_id")
    return rows.withColumn("i", F.row_number().over(order)).where("i = nth").select("batch_id", F.col("ts").alias("completed_at"))


STATUSES = ("queued", "started", "finished", "failed")


def panes(events: DataFrame, length: str) -> DataFrame:
    """Events by status in adjoining windows of this length."""
    return events.groupBy(F.window("ts", length)).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == k).alias(k) for k in STATUSES])


def queue_window(events: DataFrame, size: str = "24 hours", slide: str = "6 hours") -> DataFrame:
    """Events by status over sliding windows, size being a multiple of slide.

    Events are counted by panes of one slide, once each, and windows add up panes, so no event is copied into all of its windows. On
    a stream, give it a watermark first: both aggregations then chain in append mode.
    """
    wide = panes(events, slide).groupBy(F.window("window", size, slide)).agg(*[F.sum(c).alias(c) for c in ("n", *STATUSES)])
    return wide.select(F.col("window.start").alias("window_start"), "n", *STATUSES)


def metric_clean(metrics: DataFrame) -> DataFrame:
    """Metric rows as they are appended: blank text is null, the status is lower case."""
    return metrics.select(F.nullif(F.trim("doc_class"), F.lit("")).alias("doc_class"), F.lower(F.nullif(F.trim("status"), F.lit(""))).alias("status"), "processing_ms")


# Streams.


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def stream_intake(documents: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """New documents under their content's id, re-sent ones dropped. State grows with the ids unless a (column, delay) bounds it; then late re-sends can pass."""
    named = documents.withColumn("submission_id", F.substring(F.sha2("text", 256), 1, 12))
    if watermark:
        return named.withWatermark(*watermark).dropDuplicatesWithinWatermark(["submission_id"])
    return named.dropDuplicates(["submission_id"])


class Completion(StatefulProcessor):
    """Counts a batch's ended events and emits it once, when the wanted number is reached.

    What remains then is a mark that it is done, which a timer removes when the watermark is `keep` beyond the completion; a batch that never
    gets there is forgotten as long after its last event. So state holds open and just completed batches only.
    """

    def __init__(self, wanted: int, keep_ms: int) -> None:
        self.wanted, self.keep_ms = wanted, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", "seen long, done boolean, until long")

    def _wait_until(self, moment: int, before: int | None) -> None:
        if before is not None and before != moment:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(moment)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen, done, until = self.state.get() if self.state.exists() else (0, False, None)
        for row in sorted(rows, key=lambda r: (r["micros"], r["event_id"])):
            if done:
                break
            seen, last = seen + 1, row["micros"]
            moment = max(until or 0, last // 1000 + self.keep_ms)
            if seen >= self.wanted:
                done = True
                yield Row(batch_id=key[0], ended=seen, micros=last)
            self._wait_until(moment, until)
            until = moment
        self.state.update((seen, done, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_batch_complete(events: DataFrame, wanted: int, delay: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """Each batch once, as soon as it has the wanted number of ended events, with the time of the last that it needed.

    Events may be late by the delay; those of a completed batch count no more until its mark goes, keep_ms after its completion. Needs the RocksDB
    state store (see with_rocksdb). An event that comes with another batch's counts when it is seen, not at its own time.
    """
    # The condition holds the time, else it would be moved below the watermark, which events of all kinds are to advance.
    is_ended = F.when(F.col("status").isin("finished", "failed"), F.col("ts")).isNotNull()
    ended = events.withWatermark("ts", delay).where(is_ended).select("batch_id", "ts", "event_id", F.unix_micros("ts").alias("micros"))
    found = ended.groupBy("batch_id").transformWithState(Completion(wanted, keep_ms), "batch_id long, ended long, micros long", "Append", "EventTime")
    return found.select("batch_id", "ended", F.timestamp_micros("micros").alias("completed_at"))


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers and typed state need; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.getAll.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def stream_wait_pairs(events: DataFrame, within: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Every start with each event of its job that came before it, no longer ago than within: a stream joined with itself.

    Both sides have a watermark, so a start is held until no earlier event can come any more, and an event until no start can reach back to it.
    Pairs come out as they are met; waits() makes waits of them.
    """
    marked = events.where("status in ('queued', 'started')").withWatermark("ts", delay)
    starts = marked.where("status = 'started'").select("event_id", "job_id", "ts")
    before = marked.select(F.col("job_id").alias("p_job"), F.col("event_id").alias("p_id"), F.col("status").alias("p_status"), F.col("ts").alias("p_ts"))
    earlier = (F.col("p_ts") < F.col("ts")) | ((F.col("p_ts") == F.col("ts")) & (F.col("p_id") < F.col("event_id")))
    bound = (F.col("p_ts") <= F.col("ts")) & (F.col("p_ts") >= F.col("ts") - F.expr(f"interval {within}"))
    return starts.join(before, (F.col("job_id") == F.col("p_job")) & bound & earlier).drop("p_job")


def waits(pairs: DataFrame) -> DataFrame:
    """Milliseconds from the previous queued event to each start, from all pairs of a table; as a stream, each start once, when the watermark has passed it."""
    last = pairs.groupBy("event_id", "job_id", "ts").agg(F.max_by(F.struct("p_status", "p_ts"), F.struct("p_ts", "p_id")).alias("p"))
    return last.where("p.p_status = 'queued'").select("event_id", "job_id", F.floor((F.unix_micros("ts") - F.unix_micros("p.p_ts")) / 1000).cast("long").alias("wait_ms"))


def drain(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and give its result as a table of this session."""
    with with_rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch under its number; a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _latest(s, d):
    return job_latest(T.jobs(s, d))


def _clock(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in cols})


NOW = "2024-01-20 00:00:00"
QUERIES = {
    "job_latest": lambda s, d: _clock(_latest(s, d), "started_at", "finished_at", "created_at"),
    "queue_status": lambda s, d: queue_status(_latest(s, d)),
    "stuck_jobs": lambda s, d: _clock(stuck_jobs(_latest(s, d), NOW), "created_at"),
    "newest_status": lambda s, d: newest_status(_latest(s, d)),
    "next_job": lambda s, d: next_job(T.jobs(s, d)),
    "queue_wait": lambda s, d: queue_wait(T.jobs(s, d)),
    "batch_complete": lambda s, d: _clock(batch_complete(T.jobs(s, d), 100), "completed_at"),
    "queue_window": lambda s, d: _clock(queue_window(T.jobs(s, d)), "window_start"),
    "queue_window_hourly": lambda s, d: _clock(queue_window(T.jobs(s, d), slide="1 hour"), "window_start"),
    "metric_clean": lambda s, d: metric_clean(T.metrics(s, d)),
}
_C = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
LATEST = """
lt as (select job_id, arg_max(status, (ts, event_id)) as status, min(ts) filter (status = 'started') as started_at, max(ts) filter (status in ('finished', 'failed')) as finished_at, min(ts) as created_at from jobs group by 1)
"""
ORACLE = {
    "job_latest": T.sql(f"select job_id, status, {_C.format('started_at')} as started_at, {_C.format('finished_at')} as finished_at, {_C.format('created_at')} as created_at from lt", T.JOBS, LATEST),
    "queue_status": T.sql("""c as (select count(*)::bigint as total, count(*) filter (status = 'finished')::bigint as completed, count(*) filter (status = 'failed')::bigint as failed, count(*) filter (status = 'started')::bigint as in_progress, count(*) filter (status = 'queued')::bigint as pending,
      avg(case status when 'finished' then coalesce((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 15) when 'failed' then 15 end) as m from lt)
      select * exclude m, case when pending = 0 then 0 when completed + failed > 0 then m * pending else pending * 20.0 end::double as remaining_seconds from c""", T.JOBS, LATEST),
    "stuck_jobs": T.sql(f"select job_id, {_C.format('created_at')} as created_at from lt where status = 'queued' and timestamp '{NOW}' - created_at > interval 2 minutes", T.JOBS, LATEST),
    "newest_status": T.sql("select status, count(*)::bigint as n from (select status from lt order by created_at desc, job_id limit 10) group by 1", T.JOBS, LATEST),
    "next_job": T.sql("select batch_id, event_id, job_id from (select *, row_number() over (partition by batch_id order by value desc, ts, event_id) as n from jobs where status = 'queued') where n = 1", T.JOBS),
    "queue_wait": T.sql("b as (select *, lag(status) over w as s, lag(ts) over w as t from jobs where status in ('queued', 'started') window w as (partition by job_id order by ts, event_id)) select event_id, job_id, ((epoch_us(ts) - epoch_us(t)) // 1000)::bigint as wait_ms from b where status = 'started' and s = 'queued'", T.JOBS),
    "batch_complete": T.sql(f"select batch_id, {_C.format('ts')} as completed_at from (select *, row_number() over (partition by batch_id order by ts, event_id) as n from jobs where status in ('finished', 'failed')) where n = 100", T.JOBS),
    "queue_window": T.sql(f"""w as (select *, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') - to_hours(6 * k) as ws from jobs, (values (0), (1), (2), (3)) t(k))
      select {_C.format('ws')} as window_start, count(*)::bigint as n, {", ".join(f"count(*) filter (status = '{k}')::bigint as {k}" for k in ("queued", "started", "finished", "failed"))} from w group by ws""", T.JOBS),
    "queue_window_hourly": T.sql(f"""w as (select *, date_trunc('hour', ts) - to_hours(k) as ws from jobs, range(24) h(k))
      select {_C.format('ws')} as window_start, count(*)::bigint as n, {", ".join(f"count(*) filter (status = '{k}')::bigint as {k}" for k in ("queued", "started", "finished", "failed"))} from w group by ws""", T.JOBS),
    "metric_clean": T.sql("select nullif(trim(doc_class), '') as doc_class, lower(nullif(trim(status), '')) as status, processing_ms from metrics", T.METRICS),
}
