"""Trace events as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import shared_folder
from ..operators.versions import Files


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of Parquet files as they appear. path is a file or a folder of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name.replace('.parquet', '[.]parquet')}").withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event of a run once, within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def rates(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by type and window; late ones beyond the watermark are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events of each user in sessions that a gap ends."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def run_available(df: DataFrame, mode: str = "complete") -> DataFrame:
    """What a streaming query gives for the data there is, written to the shared folder; for tests and batch replay.

    Each batch has a folder of its own, so one that runs twice leaves the same rows; in complete mode the last one holds all.
    """
    path = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)

    df.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return df.sparkSession.createDataFrame([], df.schema)
    wanted = done[-1:] if mode == "complete" else sorted(set(done))
    return df.sparkSession.read.schema(df.schema).parquet(*(f"{path}/batch={n}" for n in wanted))


def tail_once(spark: SparkSession, path: str) -> DataFrame:
    return run_available(rates(read(spark, path)))


#: What is kept of a run: its last number and its newest time.
RUNS = "run_id long, last long, newest timestamp"
#: Batches from one list of all runs to the next; those between list their own.
WHOLE = 10


def sequenced(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events of a batch (run_id, event_id, event_type, ts) with the next numbers of their runs, from 1, without gaps, after those that runs (run_id, last, newest) were given before.

    A run's events are in order of time, then id. An event that comes after later ones of its run were numbered is late: it gets the
    next number like any other, since the log is append-only, and says so. What is known of a run goes before its events in their one shuffle; a long run is sorted, not held.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    new = events.select("run_id", "event_id", "event_type", "ts", none("long", "last"), none("timestamp", "newest"))
    rows = new.unionByName(runs, allowMissingColumns=True)
    order = Window.partitionBy("run_id").orderBy(F.asc_nulls_first(F.col("last").isNull()), F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    before, newest = F.first("last").over(order), F.first("newest").over(order)
    placed = rows.withColumn("_place", F.row_number().over(order)).withColumn("_before", before).withColumn("_newest", newest).where("last IS NULL")
    sequence = F.when(F.col("_before").isNull(), F.col("_place")).otherwise(F.col("_before") + F.col("_place") - 1)
    return placed.select("run_id", sequence.cast("long").alias("sequence"), "event_id", "event_type", "ts", F.coalesce(F.col("ts") < F.col("_newest"), F.lit(False)).alias("late"))


def _numbered(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """run_id, last and newest of the runs in batches before this one; batches are numbered without gaps."""
    if number == 0:
        return spark.range(0).selectExpr("id AS run_id", "id AS last", "timestamp_micros(id) AS newest")
    whole = number // WHOLE * WHOLE - 1
    listed = spark.read.schema(f"{RUNS}, batch int").parquet(folder).where((F.col("batch") >= whole) & (F.col("batch") < number))
    return listed.groupBy("run_id").agg(F.max("last").alias("last"), F.max("newest").alias("newest"))


def append(events: DataFrame, log: str, state: str, files: int | None = None) -> None:
    """Number the events that a stream has now and append them to a log folder; a later call with the same state goes on where this one ended.

    state: folder of the stream's checkpoint and, below runs, of two numbers a run. A batch that runs twice after a failure reads what those before it left and rewrites its
    own folders, so that no event is in the log twice.
    """
    folder = f"{state}/runs"

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        runs = _numbered(spark, folder, number)
        sequenced(batch, runs).write.mode("overwrite").parquet(f"{log}/batch={number}")
        made = spark.read.parquet(f"{log}/batch={number}").select("run_id", F.col("sequence").alias("last"), F.col("ts").alias("newest"))
        listed = made.unionByName(runs) if number % WHOLE == WHOLE - 1 else made
        listed.groupBy("run_id").agg(F.max("last").alias("last"), F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if number and number % WHOLE == 0:  # the batch before it listed all runs and is done
            files = Files(spark, folder)
            for old in range(max(0, number - 1 - WHOLE), number - 1):
                files.delete(f"{folder}/batch={old}")

    events.select("run_id", "event_id", "event_type", "ts").writeStream.foreachBatch(save).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def tail(log: DataFrame, after: DataFrame, terminal: tuple[str, ...]) -> DataFrame:
    """What readers that have seen each run up to a number (after: run_id, sequence) get next, in order of sequence: up to the first terminal event, with it.

    A run that after doesn't name is read from its start. A reader whose last number is at or behind a terminal event gets nothing.
    """
    end = log.where(F.col("event_type").isin(*terminal)).groupBy("run_id").agg(F.min("sequence").alias("end"))
    seen = after.select("run_id", F.col("sequence").alias("seen"))
    open_ = log.join(seen, "run_id", "left").join(end, "run_id", "left")
    wanted = (F.col("sequence") > F.coalesce("seen", F.lit(0))) & (F.col("end").isNull() | (F.col("sequence") <= F.col("end")))
    return open_.where(wanted).select(*log.columns)
