"""Jobs: their state from events, what a client is shown, and progress; each works on a table and, where said, on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marlgate import schemas

#: Event types that a progress channel passes on, and those that end it.
SHOWN = ["progress", "completed", "error", "cancelled"]
FINAL = ["completed", "error", "cancelled"]


def latest_state(events: DataFrame) -> DataFrame:
    """The last status, page and progress of each task, by time and event_id; works on streams in update mode.

    The last write wins, whatever state came before it.
    """
    at = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return events.groupBy("task_id").agg(last("status"), last("current_page"), last("total_pages"), last("progress"), F.max("ts").alias("last_update"))


def job_status(state: DataFrame) -> DataFrame:
    """What a status request shows: progress while processing, the place of the result once completed, an error if failed."""
    status = F.col("status")
    return state.select(
        "task_id", "status",
        F.when(status == "processing", F.col("progress")).alias("progress"),
        F.when(status == "processing", F.col("current_page")).alias("current_page"),
        F.when(status == "completed", F.concat(F.lit("/result/"), "task_id")).alias("result_url"),
        F.when(status == "failed", F.lit("failed")).alias("error"),
    )


def result_access(requests: DataFrame, state: DataFrame, results: DataFrame) -> DataFrame:
    """HTTP-like code for each requested task_id: 404 unknown, 400 not completed, 404 without a result, else 200."""
    known = state.select("task_id", "status")
    found = results.select("task_id").distinct().withColumn("has_result", F.lit(True))
    joined = requests.join(known, "task_id", "left").join(found, "task_id", "left")
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "completed", 400).when(F.col("has_result").isNull(), 404).otherwise(200)
    return joined.select("task_id", code.alias("code"))


def _shown(events: DataFrame) -> DataFrame:
    percent = F.when(F.col("total_pages") > 0, F.col("current_page") / F.col("total_pages") * 100).otherwise(F.lit(0.0))
    shown = events.where(F.col("type").isin(SHOWN))
    return shown.select("task_id", "event_id", "ts", "type", percent.alias("percent"), F.col("type").isin(FINAL).alias("is_final"))


def progress_channel(events: DataFrame) -> DataFrame:
    """The events that are passed on to a client, with the percentage done: those of a task up to the first that ends it."""
    at = F.struct("ts", "event_id")
    end = F.min(F.when(F.col("is_final"), at)).over(W.partitionBy("task_id"))
    return _shown(events).withColumn("_end", end).where(F.col("_end").isNull() | (at <= F.col("_end"))).drop("_end")


def _until(held, micros: int, ttl: int) -> None:
    """A state's end in event time: ``ttl`` seconds after its last event."""
    held.setTimeoutTimestamp(max(micros // 1000 + ttl * 1000, held.getCurrentWatermarkMs() + 1))


def progress_stream(events: DataFrame, ttl: int = 3600, late: str = "1 hour") -> DataFrame:
    """``progress_channel`` of a stream: in the order in which events come, a task is closed by the first that ends it.

    What is known of a task goes ``ttl`` seconds of event time after its last event.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, held):
        import pandas as pd

        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        closed = held.exists and held.get[0]
        ends = rows["is_final"].to_numpy().nonzero()[0]
        held.update((bool(closed or len(ends)),))
        _until(held, rows["ts"].iloc[-1].value // 1000, ttl)
        yield rows.iloc[: 0 if closed else ends[0] + 1 if len(ends) else len(rows)]

    schema = "task_id bigint, event_id bigint, ts timestamp, type string, percent double, is_final boolean"
    rows = _shown(events.withWatermark("ts", late)).groupBy("task_id")
    return rows.applyInPandasWithState(step, schema, "closed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def progress_of_pages(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress of running analyses, from their page results (task_id, ...) as they come; ``totals`` has task_id and total_pages.

    A task's current_page is the number of its pages so far; on a stream in update mode a row is sent on whenever that grows.
    """
    done = pages.groupBy("task_id").agg(F.count("*").cast("int").alias("current_page")).join(totals.select("task_id", "total_pages"), "task_id", "left")
    percent = F.when(F.col("total_pages") > 0, F.col("current_page") / F.col("total_pages") * 100).otherwise(F.lit(0.0))
    return done.withColumn("progress", percent)


def watch_pages(pages: DataFrame, totals: DataFrame, checkpoint: str, on_progress: Callable[[DataFrame, int], None] | None = None, on_pages: Callable[[DataFrame, int], None] | None = None) -> list[StreamingQuery]:
    """Calls hooks while page results come in: ``on_pages`` with the new ones, ``on_progress`` with the tasks whose count grew."""
    out = []
    if on_pages is not None:
        out.append(pages.writeStream.option("checkpointLocation", f"{checkpoint}/pages").foreachBatch(on_pages).start())
    if on_progress is not None:
        out.append(progress_of_pages(pages, totals).writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/progress").foreachBatch(on_progress).start())
    return out


def publish(events: DataFrame, path: str) -> None:
    """Appends events to the folder that ``event_stream`` reads."""
    wanted = [f.name for f in schema_of(schemas.JOB_EVENTS)]
    events.select(*(F.col(c) if c in events.columns else F.lit(None).alias(c) for c in wanted)).to(schema_of(schemas.JOB_EVENTS)).write.mode("append").parquet(path)


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def with_snapshot(state: DataFrame, channel: DataFrame) -> DataFrame:
    """A client's view: the state as it is first, then events; ``place`` puts the snapshot before them."""
    first = state.select("task_id", F.lit(-1).cast("bigint").alias("event_id"), F.col("last_update").alias("ts"), F.lit("snapshot").alias("type"), F.coalesce("progress", F.lit(0.0)).alias("percent"), F.col("status").isin("completed", "failed", "cancelled").alias("is_final"))
    return first.withColumn("place", F.lit(0)).unionByName(channel.withColumn("place", F.lit(1)))


def pages_per_second(events: DataFrame) -> DataFrame:
    """Speed of each task between its first and its last event."""
    out = events.groupBy("task_id").agg(F.max("current_page").alias("pages"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("micros"))
    return out.select("task_id", "pages", F.when(F.col("micros") > 0, F.col("pages") / (F.col("micros") / 1e6)).otherwise(F.lit(0.0)).alias("pages_per_second"))


def event_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.JOB_EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def watch_states(events: DataFrame, checkpoint: str, upsert: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Keeps each task's state; ``upsert`` gets the changed rows of each micro-batch."""
    return latest_state(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert).start()


def append_results(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes page results as they come."""
    return pages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def event_rate(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An extension: events of each task and time window, with late ones up to ``late`` counted."""
    return events.withWatermark("ts", late).groupBy("task_id", F.window("ts", window)).agg(F.count("*").alias("events")).select("task_id", F.col("window.start").alias("start"), "events")


def expire(state: DataFrame, now, seconds: int = 3600) -> DataFrame:
    """States that were changed in the last ``seconds``."""
    return state.where(F.unix_micros("last_update") >= F.unix_micros(F.lit(now)) - seconds * 1_000_000)


def run_tagged(spark: SparkSession, task_id: int, action: Callable[[], object]) -> object:
    """Runs an action whose Spark jobs ``cancel`` can stop from another thread."""
    tag = f"task-{task_id}"
    spark.addTag(tag)
    try:
        return action()
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, task_id: int) -> DataFrame:
    """Stops the jobs of a task, and returns the event that says so (event_id and pages are left open)."""
    spark.interruptTag(f"task-{task_id}")
    row = spark.range(1).select(F.lit(task_id).cast("bigint").alias("task_id"), F.current_timestamp().alias("ts"), F.lit("cancelled").alias("type"), F.lit("cancelled").alias("status"))
    return row


def submitted(files: DataFrame) -> DataFrame:
    """A pending event for each accepted file, with a new task id as text and a file name that is safe in a path."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[^A-Za-z0-9_.-]+", "_")
    return files.select(F.uuid().alias("task_id"), name.alias("filename"), F.current_timestamp().alias("ts"), F.lit("submitted").alias("type"), F.lit("pending").alias("status"))


def guarded_states(events: DataFrame, ttl: int = 3600, late: str = "1 hour") -> DataFrame:
    """A stream's states with transitions guarded: a task that has ended stays as it ended, and earlier events change nothing.

    Columns task_id, status and event_id of the event that set it.  A task's state goes ``ttl`` seconds of event time after that.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, held):
        import pandas as pd

        if held.hasTimedOut:
            held.remove()
            return
        status, at, event = held.get if held.exists else (None, -1, -1)
        for batch in batches:
            for row in batch.sort_values(["ts", "event_id"]).itertuples():
                later = (row.ts.value, row.event_id) > (at, event)
                if later and status not in ("completed", "failed", "cancelled"):
                    status, at, event = row.status, row.ts.value, int(row.event_id)
        held.update((status, at, event))
        _until(held, at // 1000, ttl)
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "event_id": [event]})

    rows = events.withWatermark("ts", late).where("status is not null").groupBy("task_id")
    return rows.applyInPandasWithState(step, "task_id bigint, status string, event_id bigint", "status string, at bigint, event_id bigint", "update", GroupStateTimeout.EventTimeTimeout)
