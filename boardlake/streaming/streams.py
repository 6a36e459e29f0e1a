"""Streams over landed files: telemetry windows, lifecycle sessions and gaps in writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardlake.functions.dates import within_window
from boardlake.operators import lifecycle
from boardlake.registry import query
from boardlake.sources.folders import shared_folder
from boardlake.sources.postings import NOW


def telemetry(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests and failures of each source in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), F.col("event_type").alias("source")).agg(
        F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("failed")
    ).select(F.unix_timestamp("window.start").alias("start"), "source", "n", "failed")


def sightings(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Lifecycle by silence: a posting's sightings form a session until the gap passes without one."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col("user_id").alias("posting_id")).agg(F.count("*").alias("n")).select(
        "posting_id", F.unix_timestamp("session_window.start").alias("listed"), F.unix_timestamp("session_window.end").alias("delisted"), "n"
    )


def replay(spark: SparkSession, path: str, transform, keys: list[str] | None) -> DataFrame:
    """Run a stream over the files that are there, to its end. Each batch adds the groups that it changed, named by keys, and of
    each group the last state is read; old state goes as the watermark passes. Without keys (sessions, whose bounds change) each
    batch writes its whole result, and the last one is read."""
    schema = spark.read.parquet(path).schema
    folder, batches = shared_folder(spark), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batches.append(number)

    # a pattern, so that one file and a folder of files are both read
    source = spark.readStream.schema(schema).parquet(path.replace(".parquet", "[.]parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    mode = "update" if keys else "complete"
    run = transform(source).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if not keys:
        return spark.read.parquet(f"{folder}/rows/batch={batches[-1]}")
    told = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    values = [c for c in told.columns if c not in (*keys, "batch")]
    return told.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, *[f"v.{c}" for c in values])


@query("SELECT floor(epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS start, event_type AS source, count(*) AS n, count(*) FILTER (value < 5) AS failed FROM events GROUP BY 1, 2")
def st_telemetry(spark, sf_dir) -> DataFrame:
    return replay(spark, f"{sf_dir}/events.parquet", telemetry, ["start", "source"])


@query(
    """WITH e AS (SELECT user_id AS posting_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY posting_id ORDER BY ts) AS session FROM e)
SELECT posting_id, floor(epoch(min(ts)))::BIGINT AS listed, floor(epoch(max(ts) + INTERVAL 12 HOUR))::BIGINT AS delisted, count(*) AS n FROM s GROUP BY posting_id, session"""
)
def st_lifecycle(spark, sf_dir) -> DataFrame:
    return replay(spark, f"{sf_dir}/events.parquet", sightings, None)


def timeouts(events: DataFrame, length: str = "10 minutes", every: str = "5 minutes", late: str = "2 hours") -> DataFrame:
    """Failures of each source in the last minutes, in sliding windows."""
    return events.filter("value < 5").withWatermark("ts", late).groupBy(F.window("ts", length, every), F.col("event_type").alias("source")).agg(
        F.count("*").alias("n")
    ).select(F.unix_timestamp("window.start").alias("start"), "source", "n")


@query(
    """WITH s AS (SELECT event_type AS source, floor(epoch(time_bucket(INTERVAL 5 MINUTE, ts)))::BIGINT AS start FROM events WHERE value < 5)
SELECT start - back AS start, source, count(*) AS n FROM s, (VALUES (0), (300)) b(back) GROUP BY 1, 2"""
)
def st_timeouts(spark, sf_dir) -> DataFrame:
    return replay(spark, f"{sf_dir}/events.parquet", timeouts, ["start", "source"])


STALL, EPISODE = 7_200, 21_600


def write_gaps(events: DataFrame) -> DataFrame:
    """source, stalled_from, recovered_at and alerts (one as a stall begins, one more for each episode that it lasts) of gaps of two
    hours or more between a source's writes. Only the first and last write of each hour are put in order."""
    hours = events.groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", "ts").alias("hour")).agg(
        F.unix_timestamp(F.min("ts")).alias("recovered_at"), F.unix_timestamp(F.max("ts")).alias("last")
    )
    gaps = hours.withColumn("stalled_from", F.lag("last").over(Window.partitionBy("source").orderBy("hour")))  # the hours of a source
    long = gaps.filter(F.col("recovered_at") - F.col("stalled_from") >= STALL)
    return long.select("source", "stalled_from", "recovered_at", (1 + F.floor((F.col("recovered_at") - F.col("stalled_from") - STALL) / EPISODE)).alias("alerts"))


@query(
    """WITH w AS (SELECT event_type AS source, floor(epoch(ts))::BIGINT AS t, lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)
SELECT source, before AS stalled_from, t AS recovered_at, 1 + (t - before - 7200) // 21600 AS alerts FROM w WHERE t - before >= 7200"""
)
def st_write_liveness(spark, sf_dir) -> DataFrame:
    return write_gaps(spark.read.parquet(f"{sf_dir}/events.parquet"))


def dropped(events: DataFrame, now: int, hours: int = 24, late: str = "2 hours") -> DataFrame:
    """Postings kept and dropped by the date gate in tumbling hours; the gate itself has no state."""
    gated = events.withColumn("_in", within_window(F.col("posting_date"), now, hours))
    return gated.withWatermark("ts", late).groupBy(F.window("ts", "1 hour")).agg(
        F.count_if("_in").alias("kept"), F.count_if(~F.col("_in")).alias("dropped")
    ).select(F.unix_timestamp("window.start").alias("start"), "kept", "dropped")


_SNAPSHOT = (
    f"{lifecycle.KEY} string, position_name string, location string, job_description string, pay_min double, pay_max double,"
    " first_seen_epoch bigint, last_seen_epoch bigint, hidden boolean, hidden_reason string, hidden_at_epoch bigint"
)


def upsert_stream(incoming: DataFrame, folder: str, now: int) -> DataFrame:
    """Merge each batch of a stream into a snapshot of postings; the last snapshot.

    A batch writes a snapshot of its own from the one before it, so a batch that is run again
    after a failure gives the same. An older snapshot is no longer needed once its successor is there.
    """
    spark, last = incoming.sparkSession, []

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(_SNAPSHOT).parquet(f"{folder}/snapshot-{number - 1}") if number else spark.createDataFrame([], _SNAPSHOT)
        lifecycle.upsert(before, batch, now).write.mode("overwrite").parquet(f"{folder}/snapshot-{number}")
        last.append(number)

    run = incoming.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(_SNAPSHOT).parquet(f"{folder}/snapshot-{last[-1]}")


@query(
    """SELECT floor(epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS start, count(*) FILTER (user_id % 3 <> 2) AS kept,
count(*) FILTER (user_id % 3 = 2) AS dropped FROM events GROUP BY 1"""
)
def st_classify(spark, sf_dir) -> DataFrame:
    date = F.element_at(F.array(F.lit("today"), F.lit("yesterday"), F.lit("9 days ago")), (F.col("user_id") % 3).cast("int") + 1)
    return replay(spark, f"{sf_dir}/events.parquet", lambda events: dropped(events.withColumn("posting_date", date), NOW), ["start"])


@query(
    """SELECT 'https://example.com/job/' || user_id AS job_posting_url, arg_max(event_type, event_id) AS position_name, 1706659200 AS first_seen_epoch,
1706659200 AS last_seen_epoch FROM events GROUP BY user_id"""
)
def st_upsert(spark, sf_dir) -> DataFrame:
    """Sightings merged by URL, the last of a batch winning; every file that has landed is a batch."""
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path.replace(".parquet", "[.]parquet"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = source.select(
        F.concat(F.lit("https://example.com/job/"), F.col("user_id").cast("string")).alias(lifecycle.KEY), F.col("event_type").alias("position_name"),
        none("location", "string"), none("job_description", "string"), none("pay_min", "double"), none("pay_max", "double"), F.col("event_id").alias("batch_order"),
    )
    return upsert_stream(rows, shared_folder(spark), NOW).select(lifecycle.KEY, "position_name", "first_seen_epoch", "last_seen_epoch")


@query(
    """WITH h AS (SELECT floor(epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS start, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT start, n, sum(n) OVER (ORDER BY start)::BIGINT AS done, sum(n) OVER ()::BIGINT AS total FROM h)
SELECT start, n, done, round(100.0 * done / total, 4)::DOUBLE AS percent, round(n / 60.0, 4)::DOUBLE AS per_minute FROM r"""
)
def st_progress(spark, sf_dir) -> DataFrame:
    """Completed targets by hour, their running number, share and speed. Only counts of hours come together."""
    hours = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("start")).agg(F.count("*").alias("n"))
    done = F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hours.select(
        "start", "n", done.alias("done"), F.round(done * 100.0 / total, 4).cast("double").alias("percent"), F.round(F.col("n") / 60.0, 4).cast("double").alias("per_minute")
    )
