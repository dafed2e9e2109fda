"""What lasts on streams: client views, expiring states, totals as pages finish, and the progress of a running analysis."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from marlgate import schemas
from marlgate.streaming import channels, jobs, observe

T0 = dt.datetime(2024, 1, 1)


def events(spark, *rows):
    made = [(i, t, T0 + dt.timedelta(seconds=s), kind, status, page, 10, None if page is None else page * 10.0) for i, t, s, kind, status, page in rows]
    return spark.createDataFrame(made, schemas.JOB_EVENTS)


EARLY = [
    (1, 1, 0, "submitted", "pending", None), (2, 1, 5, "progress", "processing", 3), (3, 2, 1, "completed", "completed", 10), (4, 3, 6, "progress", "processing", 1), (5, 6, 7, "submitted", "pending", None),
]
LATER = [
    (6, 1, 20, "progress", "processing", 4), (7, 1, 21, "page_completed", None, 4), (8, 1, 22, "completed", "completed", 10), (9, 1, 23, "progress", "processing", 5), (10, 2, 24, "progress", "processing", 1),
    (11, 4, 25, "submitted", "pending", None), (12, 4, 26, "progress", "processing", 2), (13, 5, 27, "error", "failed", 1),
]


def run(stream, mode, log, collect):
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(log)).foreachBatch(collect).start()
    query.processAllAvailable()
    return query


def test_late_client_gets_the_state_and_then_later_events_only(spark, tmp_path):
    """A table and a stream agree, though the stream begins with events that the state was made of."""
    joined = T0 + dt.timedelta(seconds=10)
    clients = spark.createDataFrame([(t, t, joined) for t in (1, 2, 3, 4, 5, 6)], "client_id bigint, task_id bigint, joined timestamp")
    every = events(spark, *EARLY, *LATER)
    want = channels.client_view(every, clients).drop("client_id")
    shown = {t: [(r["place"], r["type"], r["event_id"]) for r in sorted((r for r in want.collect() if r["task_id"] == t), key=lambda r: (r["place"], r["event_id"] or 0))] for t in range(1, 7)}
    assert shown[1] == [(0, "snapshot", None), (1, "progress", 6), (1, "completed", 8)]
    assert shown[2] == [(0, "snapshot", None)] and shown[3] == [(0, "snapshot", None)]  # ended; silent
    assert shown[4] == [(1, "progress", 12)] and shown[5] == [(1, "error", 13)]  # no event when the client joined
    folder = tmp_path / "events"
    got = []
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    channels.use_rocksdb(spark)
    try:
        jobs.publish(events(spark, *EARLY), str(folder))
        stream = channels.client_stream(jobs.event_stream(spark, str(folder)), events(spark, *EARLY), late="0 seconds")
        query = run(stream, "append", tmp_path / "log", lambda rows, batch: got.extend((batch, r) for r in rows.collect()))
        for rows in (LATER[:4], LATER[4:]):
            jobs.publish(events(spark, *rows), str(folder))
            query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    columns = want.columns
    assert sorted(repr(tuple(r[c] for c in columns)) for _, r in got) == sorted(repr(tuple(r)) for r in want.collect())
    first = {}
    for k, (_, r) in enumerate(got):
        first.setdefault(r["task_id"], (k, r["place"]))
    assert all(first[t][1] == 0 for t in (1, 2, 3, 6))


def test_states_fall_after_an_hour_of_event_time(spark, tmp_path):
    hour = 3600
    parts = [
        [(1, 1, 0, "progress", "processing", 3), (2, 2, 10, "progress", "processing", 1)],
        [(3, 2, hour - 5, "completed", "completed", 10)],
        [(4, 3, hour + 30, "submitted", "pending", None)],  # task 1's last event is over an hour ago, task 2's is not
        [(5, 1, hour + 40, "page_completed", None, 5)],  # a new state, without the old one's status
    ]
    rows, sizes = [], []
    query = None
    for k, part in enumerate(parts):
        jobs.publish(events(spark, *part), str(tmp_path / "events"))
        if query is None:
            query = run(channels.live_states(jobs.event_stream(spark, str(tmp_path / "events"))), "update", tmp_path / "log", lambda changed, batch: rows.extend(changed.collect()))
        query.processAllAvailable()
        time.sleep(1)
        query.processAllAvailable()  # the watermark moves after the batch
        sizes.append((k, query.lastProgress["stateOperators"][0]["numRowsTotal"]))
    query.stop()
    assert [n for _, n in sizes] == [2, 2, 2, 3]
    assert [(r["task_id"], r["status"], r["current_page"]) for r in rows if r["expired"]] == [(1, "processing", 3)]
    last = {r["task_id"]: r for r in rows}
    table = {r["task_id"]: r for r in channels.expired_states(events(spark, *(x for p in parts for x in p))).collect()}
    for t in (1, 2, 3):
        assert [last[t][c] for c in ("status", "current_page", "progress", "last_update", "expired")] == [table[t][c] for c in ("status", "current_page", "progress", "last_update", "expired")]
    assert last[1]["status"] is None and last[2]["status"] == "completed"


@pytest.mark.parametrize("operator", [jobs.progress_stream, jobs.guarded_states])
def test_streams_drop_the_state_of_old_tasks(spark, tmp_path, operator):
    query, out = None, []
    for k in range(4):
        jobs.publish(events(spark, (k, k, k * 4000, "progress", "processing", k)), str(tmp_path / "events"))
        if query is None:
            query = run(operator(jobs.event_stream(spark, str(tmp_path / "events")), late="0 seconds"), "append" if operator is jobs.progress_stream else "update", tmp_path / "log", lambda rows, batch: out.extend(rows.collect()))
        query.processAllAvailable()
        time.sleep(1)
        query.processAllAvailable()
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    assert sorted(r["task_id"] for r in out) == [0, 1, 2, 3] and held == 1


def test_progress_stream_equals_the_channel(spark, tmp_path):
    every = events(spark, *EARLY, *LATER)
    jobs.publish(every.repartition(1), str(tmp_path / "events"))
    out = []
    run(jobs.progress_stream(jobs.event_stream(spark, str(tmp_path / "events"))), "append", tmp_path / "log", lambda rows, batch: out.extend(rows.collect())).stop()
    assert sorted(map(tuple, out)) == sorted(map(tuple, jobs.progress_channel(every).select("task_id", "event_id", "ts", "type", "percent", "is_final").collect()))


def test_totals_as_pages_finish(spark, tmp_path):
    schema = "doc_id bigint, page_index int, error string, n_figures bigint, n_refs bigint, n_texts bigint, arrived int"
    parts = [[(1, 2, None, 5, 1, 9, 0), (1, 0, None, 1, 2, 3, 1), (2, 0, "failed", 9, 9, 9, 2)], [(1, 2, None, 5, 1, 9, 3), (1, 70, None, 1, 1, 1, 4), (2, 1, None, 2, 0, 4, 5)]]
    out, query = [], None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        if query is None:
            pages = spark.readStream.schema(schema).parquet(str(tmp_path / "pages"))
            query = run(channels.running_totals_stream(pages, ["arrived"]), "append", tmp_path / "log", lambda rows, batch: out.extend(map(tuple, rows.collect())))
        query.processAllAvailable()
    query.stop()
    one, two = ([r[1:] for r in out if r[0] == d] for d in (1, 2))
    assert one == [(2, 1, 5, 1, 9), (0, 2, 6, 3, 12), (70, 3, 7, 4, 13)]
    assert two == [(0, 1, 0, 0, 0), (1, 2, 2, 0, 4)]


def test_hooks_for_pages_and_progress(spark, tmp_path):
    totals = spark.createDataFrame([(1, 4), (2, 0)], "task_id bigint, total_pages int")
    schema = "task_id bigint, page_index int"
    spark.createDataFrame([(1, 0), (1, 1), (2, 0)], schema).write.parquet(str(tmp_path / "pages"))
    seen, progress = [], {}
    queries = jobs.watch_pages(
        spark.readStream.schema(schema).parquet(str(tmp_path / "pages")), totals, str(tmp_path / "log"),
        lambda rows, batch: progress.update({r["task_id"]: r["progress"] for r in rows.collect()}), lambda rows, batch: seen.extend(map(tuple, rows.collect())),
    )
    for q in queries:
        q.processAllAvailable()
    assert sorted(seen) == [(1, 0), (1, 1), (2, 0)] and progress == {1: 50.0, 2: 0.0}
    spark.createDataFrame([(1, 2), (1, 3)], schema).write.mode("append").parquet(str(tmp_path / "pages"))
    for q in queries:
        q.processAllAvailable()
        q.stop()
    assert progress[1] == 100.0 and len(seen) == 5


def test_published_events_have_all_columns(spark, tmp_path):
    jobs.publish(jobs.cancel(spark, 8), str(tmp_path))
    jobs.publish(events(spark, *EARLY), str(tmp_path))
    got = spark.read.schema(schemas.JOB_EVENTS).parquet(str(tmp_path))
    assert got.count() == 6 and got.where("task_id = 8").first()["type"] == "cancelled"


def test_running_analysis_leaves_rising_progress_and_page_events(spark, tmp_path):
    def action():
        rows = spark.range(0, 40, 1, 40).select(F.col("id").cast("int").alias("page_index")).repartition(40, "page_index")

        def slow(batches):
            time.sleep(0.15)
            yield from batches

        rows.mapInArrow(slow, "page_index int").write.parquet(str(tmp_path / "result"))
        return spark.read.parquet(str(tmp_path / "result"))

    result = observe.observed(spark, 7, action, 40, str(tmp_path / "events"), every=0.3)
    assert result.count() == 40
    got = spark.read.schema(schemas.JOB_EVENTS).parquet(str(tmp_path / "events")).orderBy("event_id").collect()
    progress = [r["current_page"] for r in got if r["type"] == "progress"]
    assert progress[0] == 0 and progress == sorted(set(progress)) and len(progress) > 2 and progress[-1] < 40
    assert [r["current_page"] for r in got if r["type"] == "page_completed"] == list(range(40))
    assert (got[-1]["type"], got[-1]["status"], got[-1]["progress"]) == ("completed", "completed", 100.0)
    assert len({r["event_id"] for r in got}) == len(got) and [r["ts"] for r in got if r["type"] != "page_completed"] == sorted(r["ts"] for r in got if r["type"] != "page_completed")


def test_failing_analysis_says_so(spark, tmp_path):
    def action():
        raise ValueError("no such file")

    with pytest.raises(ValueError, match="no such file"):
        observe.observed(spark, 8, action, 5, str(tmp_path), every=0.1, share=lambda: 0.5)
    state = jobs.latest_state(spark.read.schema(schemas.JOB_EVENTS).parquet(str(tmp_path))).first()
    assert state["status"] == "failed"
