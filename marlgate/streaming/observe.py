"""Progress events of an analysis while it runs, from what Spark says of its tasks."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.sources.binary import as_uri
from marlgate.streaming.jobs import publish, run_tagged


class TaskShare:
    """The share of done tasks among those of a tag's jobs so far.  It does not fall: new jobs hold it until they are as far."""

    def __init__(self, spark: SparkSession, tag: str):
        self.context, self.tag, self.share = spark.sparkContext, tag, 0.0

    def __call__(self) -> float:
        tracker = self.context._jsc.sc().statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.get().stageIds() if info.isDefined() else []:
                found = tracker.getStageInfo(stage)
                if found.isDefined():
                    done, total = done + found.get().numCompletedTasks(), total + found.get().numTasks()
        self.share = max(self.share, done / total if total else 0.0)
        return self.share


def _tell(path: str, task_id: int, event_id: int, kind: str, status: str | None, page: int, pages: int) -> None:
    """Adds one event to the folder that ``publish`` fills: as a file of its own, so that no task has to wait for a free core."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    now = dt.datetime.now(dt.UTC)
    kinds = {"event_id": pa.int64(), "task_id": pa.int64(), "ts": pa.timestamp("us", "UTC"), "type": pa.string(), "status": pa.string(), "current_page": pa.int32(), "total_pages": pa.int32(), "progress": pa.float64()}
    values = (event_id, task_id, now, kind, status, page, pages, page / pages * 100 if pages else 0.0)
    fs, root = FileSystem.from_uri(as_uri(path))
    fs.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    pq.write_table(pa.table({n: pa.array([v], t) for v, (n, t) in zip(values, kinds.items(), strict=True)}), f"{root}/.{name}", filesystem=fs)
    fs.move(f"{root}/.{name}", f"{root}/part-{name}.parquet")


def observed(spark: SparkSession, task_id: int, action: Callable[[], DataFrame], total_pages: int, path: str, every: float = 0.5, share: Callable[[], float] | None = None) -> DataFrame:
    """Runs ``action``, and publishes events of it to ``path`` while it does.

    ``action`` writes the results of an analysis and returns them: a row for each page, with page_index.  First comes an event that the
    task is processing; then progress, in pages that stand for the share of Spark tasks done, whenever it has grown, and short of all
    pages; then an event for each page and one for the whole.  If the action fails, the last event says so, and the error goes on.
    Its Spark jobs bear the task's tag, so ``cancel`` stops them.

    Events are numbered in the order in which they are published, pages within theirs by index.
    """
    tag = f"observed-{task_id}-{uuid.uuid4().hex}"  # a session's own tags are known to the tracker by other names
    share = share or TaskShare(spark, tag)
    state = {"event": 0, "page": 0}
    stop = threading.Event()

    def tell(kind: str, status: str | None, page: int) -> None:
        _tell(path, task_id, state["event"], kind, status, page, total_pages)
        state["event"] += 1

    def watch() -> None:
        while not stop.wait(every):
            page = min(int(share() * total_pages), total_pages - 1)
            if page > state["page"]:
                state["page"] = page
                tell("progress", "processing", page)

    tell("progress", "processing", 0)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    spark.sparkContext.addJobTag(tag)
    try:
        result = run_tagged(spark, task_id, action)
    except Exception:
        stop.set()
        watcher.join()
        tell("error", "failed", state["page"])
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)
        stop.set()
        watcher.join()
    pages = result.select("page_index").distinct()
    first = state["event"]
    rows = pages.select(
        (F.lit(first).cast("bigint") + F.col("page_index")).alias("event_id"), F.lit(task_id).cast("bigint").alias("task_id"), F.current_timestamp().alias("ts"),
        F.lit("page_completed").alias("type"), F.col("page_index").cast("int").alias("current_page"), F.lit(total_pages).alias("total_pages"),
    )
    publish(rows, path)
    state["event"] = first + (pages.agg(F.max("page_index")).first()[0] or 0) + 1
    tell("completed", "completed", total_pages)
    return result
