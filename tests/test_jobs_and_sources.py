import datetime as dt

import pytest

from marlgate import schemas
from marlgate.sources import files, fixtures
from marlgate.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(i, t, T0 + dt.timedelta(seconds=s), kind, status, page, 10, None if page is None else page * 10.0) for i, t, s, kind, status, page in rows], schemas.JOB_EVENTS)


@pytest.fixture(scope="module")
def some(spark):
    return events(
        spark, (1, 1, 0, "submitted", "pending", None), (2, 1, 5, "progress", "processing", 3), (3, 1, 5, "page_completed", None, 4), (4, 2, 1, "completed", "completed", 10),
        (5, 2, 2, "cancelled", "cancelled", None), (6, 3, 1, "error", "failed", 1),
    )


def test_last_write_wins_for_each_field(some):
    got = {r["task_id"]: r for r in jobs.latest_state(some).collect()}
    assert [got[k]["status"] for k in (1, 2, 3)] == ["processing", "cancelled", "failed"] and got[1]["current_page"] == 4
    shown = {r["task_id"]: r for r in jobs.job_status(jobs.latest_state(some)).collect()}
    assert shown[1]["progress"] == 40.0 and shown[2]["result_url"] is None and shown[3]["error"] == "failed"


def test_channel_ends_on_cancelled(some):
    channel = jobs.progress_channel(some)
    assert sorted((r["event_id"], r["is_final"]) for r in channel.collect()) == [(2, False), (4, True), (6, True)]  # nothing follows the end
    view = jobs.with_snapshot(jobs.latest_state(some), channel).where("task_id = 1").orderBy("place", "event_id").collect()
    assert [r["type"] for r in view] == ["snapshot", "progress"]


def test_access_speed_and_expiry(spark, some):
    asked = spark.createDataFrame([(1,), (2,), (9,)], "task_id bigint")
    state = jobs.latest_state(some)
    codes = {r[0]: r[1] for r in jobs.result_access(asked, state, asked).collect()}
    assert codes == {1: 400, 2: 400, 9: 404}
    speed = {r["task_id"]: r["pages_per_second"] for r in jobs.pages_per_second(some).collect()}
    assert speed == {1: 0.8, 2: 10.0, 3: 0.0}
    assert jobs.expire(state, T0 + dt.timedelta(seconds=3604)).count() == 1


@pytest.mark.parametrize("guarded", [False, True])
def test_stream_equals_table(spark, some, tmp_path, guarded):
    some.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = jobs.event_stream(spark, str(tmp_path / "events"), 1)
    seen = {}

    def upsert(changed, batch):
        seen.update({r["task_id"]: r["status"] for r in changed.collect()})

    if guarded:
        query = jobs.guarded_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).foreachBatch(upsert).start()
    else:
        query = jobs.watch_states(stream, str(tmp_path / "log"), upsert)
    query.processAllAvailable()
    query.stop()
    assert seen[1] == "processing" and seen[3] == "failed" and seen[2] in ("cancelled", "completed")


def test_page_results_append(spark, some, tmp_path):
    some.write.parquet(str(tmp_path / "events"))
    query = jobs.append_results(jobs.event_stream(spark, str(tmp_path / "events")), str(tmp_path / "out"), str(tmp_path / "log"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_files(spark, tmp_path):
    for name, size in (("a.pdf", 3), ("b.PDF", 4), ("c.png", 3), ("d.pdf.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = files.accepted(files.scan_files(spark, str(tmp_path)))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.pdf", "b.PDF"]

    def reader(content):
        if len(content) > 3:
            raise ValueError("broken")
        return 25, True, {"Title": "t"}

    infos = files.document_info(found, reader).orderBy("path").collect()
    assert [(r["total_pages"], r["encrypted"], r["metadata"], r["error"]) for r in infos] == [(25, True, {"Title": "t"}, None), (0, False, {}, "broken")]
    assert files.not_encrypted(files.document_info(found, reader)).count() == 1

    def render(content, first, last, dpi):
        for k in range(first, last + 1):
            yield k - 1, b"img", 10, 20

    pages = files.page_images(found, 2, 4, render=render)
    assert sorted({r["page_index"] for r in pages.collect()}) == [1, 2, 3] and pages.count() == 6


def test_chunks_clamping_and_detectors(spark):
    infos = spark.createDataFrame([(1, 25), (2, 0), (3, 10)], "doc_id bigint, total_pages int")
    assert [tuple(r)[1:4] for r in files.page_chunks(infos).where("doc_id = 1").orderBy("chunk_id").collect()] == [(0, 1, 10), (1, 11, 20), (2, 21, 25)]
    assert files.page_chunks(infos).where("doc_id = 2").count() == 0
    boxes = spark.createDataFrame([(1, -3.0, 2.0, 50.0, 9.0, 40, 30), (2, 50.0, 2.0, 60.0, 9.0, 40, 30)], "i int, x0 double, y0 double, x1 double, y1 double, width int, height int")
    assert [(r["i"], r["x0"], r["x1"]) for r in files.clamp_boxes(boxes).collect()] == [(1, 0, 40)]

    def detector(image):
        import pandas as pd

        if image == b"bad":
            raise RuntimeError
        return pd.DataFrame({"label": ["text", "image"]})

    pages = spark.createDataFrame([(1, 0, b"ok"), (1, 1, b"bad")], "doc_id bigint, page_index int, image binary")
    assert [tuple(r) for r in files.detect(pages, detector, "label string").collect()] == [(1, 0, "text", 0, None), (1, 0, "image", 1, None), (1, 1, None, None, "RuntimeError")]
    state = spark.createDataFrame([(1, 0, "success", None), (1, 1, "success", None)], "doc_id bigint, page_index int, status string, error string")
    assert sorted(tuple(r) for r in files.failed_pages(state, files.detect(pages, detector, "label string")).collect()) == [(1, 0, "success", None), (1, 1, "error", "RuntimeError")]


def test_fixture_is_deterministic(spark, data):
    texts = fixtures.fixture_texts(spark, data)
    assert texts.count() == spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert fixtures.fixture_pages(texts).groupBy("status").count().count() == 3


def test_submit_and_cancel(spark):
    rows = spark.createDataFrame([("/a/my file(1).pdf",)], "path string")
    event = jobs.submitted(rows).first()
    assert event["filename"] == "my_file_1_.pdf" and event["status"] == "pending" and len(event["task_id"]) == 36
    assert jobs.run_tagged(spark, 5, lambda: spark.range(3).count()) == 3
    assert jobs.cancel(spark, 5).first()["status"] == "cancelled"
