"""Drawn overlays, files as a sink, ranges of pages over tasks, the page store, and a model's batches."""

import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlgate.operators import models
from marlgate.sources import binary, files, overlays, results

PRIMITIVES = "doc_id bigint, page_index int, kind int, place bigint, x0 int, y0 int, x1 int, y1 int, label string, color string"
IMAGES = "doc_id bigint, page_index int, image binary, width int, height int"


def pixels_of(image):
    """The picture in a PNG file without filters."""
    width, height = struct.unpack(">II", image[16:24])
    at = image.index(b"IDAT")
    raw = zlib.decompress(image[at + 4 : at + 4 + struct.unpack(">I", image[at - 4 : at])[0]])
    return np.frombuffer(raw, np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)


def test_overlays_are_drawn_page_by_page(spark, tmp_path):
    images = spark.createDataFrame([(1, 0, None, 60, 40), (1, 1, None, 20, 10), (2, 0, None, 0, 0)], IMAGES)
    boxes = [
        (1, 0, 0, 0, 5, 5, 30, 20, "text", "0,255,0"), (1, 0, 2, 0, 20, 10, 100, 200, "REF", "0,0,255"), (1, 0, 1, 0, -50, -50, -1, -1, "off", "0,255,0"), (1, 0, 1, 1, 9, 9, 3, 3, "inside out", "0,255,0"),
        (7, 3, 0, 0, 1, 1, 2, 2, "no image", "0,255,0"),
    ]
    drawn = overlays.draw_overlays(images, spark.createDataFrame(boxes, PRIMITIVES), overlays.painter(legend=False))
    rows = {(r["doc_id"], r["page_index"]): r for r in drawn.collect()}
    assert {k: r["drawn"] for k, r in rows.items()} == {(1, 0): 2, (1, 1): 0, (2, 0): 0, (7, 3): None}
    assert rows[7, 3]["error"] == "no image of the page"
    page = pixels_of(rows[1, 0]["image"])
    assert page.shape == (40, 60, 3)
    assert page[5, 7].tolist() == [0, 255, 0] and page[12, 5].tolist() == [0, 255, 0] and page[7, 7].tolist() == [255, 255, 255]
    assert page[10, 25].tolist() == [255, 0, 0] and page[39, 21].tolist() == [255, 0, 0] and page[39, 40].tolist() == [255, 255, 255]  # cut at the edge
    overlays.write_overlays(drawn, f"{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out/1")) == ["page_1.png", "page_2.png"] and not os.path.exists(f"{tmp_path}/out/7")
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/out").select("path", *overlays.png_size(F.col("content"))).collect()
    assert {(r["path"][-12:], r["width"], r["height"]) for r in sizes} == {("1/page_1.png", 60, 40), ("1/page_2.png", 20, 10), ("2/page_1.png", 1, 1)}


def test_painter_scales_the_page_and_adds_the_legend():
    def decode(raw):
        return np.arange(16 * 16 * 3, dtype=np.uint8).reshape(16, 16, 3) if raw == b"ok" else 1 / 0

    paint = overlays.painter(decode, scale=2.0)
    none = pd.DataFrame(columns=["kind", "place", "x0", "y0", "x1", "y1", "color"])
    made, drawn = paint(b"ok", 300, 250, none)
    page = pixels_of(made)
    assert page.shape == (500, 600, 3) and drawn == 0
    assert page[101, 101].tolist() == [0, 255, 0] and page[141, 101].tolist() == [255, 0, 255] and page[30, 200].tolist() == [255, 255, 255]  # text, title, the legend's ground
    assert page[450, 10].tolist() == decode(b"ok")[14, 0].tolist()
    assert pixels_of(paint(b"ok", 16, 300, none)[0]).shape == (600, 32, 3)  # too narrow for the legend
    with pytest.raises(ZeroDivisionError):
        paint(b"broken", 16, 300, none)


def test_a_page_that_cannot_be_drawn_is_an_error_row(spark):
    def fail(image, width, height, primitives):
        raise RuntimeError("no ink")

    got = overlays.draw_overlays(spark.createDataFrame([(1, 0, b"x", 5, 5)], IMAGES), spark.createDataFrame([], PRIMITIVES), fail).first()
    assert got["error"] == "no ink" and got["image"] is None


def test_files_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.bin", b"one"), ("a/c.bin", b""), (None, b"x"), ("d.bin", None), ("e.bin", b"\0" * 70_000)], "name string, content binary")
    binary.write_files(rows, str(tmp_path))
    binary.write_files(rows, f"file://{tmp_path}")  # again: the same files
    found = sorted(os.path.join(d, f)[len(str(tmp_path)) + 1 :] for d, _, names in os.walk(tmp_path) for f in names)
    assert found == ["_SUCCESS", "a/b.bin", "a/c.bin", "e.bin"]
    assert binary.read_bytes(f"file:{tmp_path}/a/b.bin") == b"one" and binary.read_bytes(f"{tmp_path}/e.bin") == b"\0" * 70_000


def test_a_large_file_is_rendered_by_many_tasks(spark, tmp_path):
    (tmp_path / "large.pdf").write_bytes(b"L")
    (tmp_path / "small.pdf").write_bytes(b"S")
    (tmp_path / "bad.pdf").write_bytes(b"B")
    infos = spark.createDataFrame([(f"file:{tmp_path}/{n}.pdf", k) for n, k in (("large", 800), ("small", 3), ("bad", 12), ("gone", 1))], "path string, total_pages int")

    def render(content, first, last, dpi):
        from pyspark import TaskContext

        for k in range(first, last + 1):
            if content == b"B" and k > 2:
                raise ValueError("damaged")
            yield k - 1, content, TaskContext.get().partitionId(), dpi

    ranges = files.page_ranges(infos)
    assert ranges.where("path like '%large.pdf'").count() == 80
    rows = files.range_images(ranges, render=render).collect()
    large = [r for r in rows if r["path"].endswith("large.pdf")]
    assert sorted(r["page_index"] for r in large) == list(range(800)) and {r["image"] for r in large} == {b"L"}
    assert len({r["width"] for r in large}) == 4  # all partitions
    assert sorted(r["page_index"] for r in rows if "small" in r["path"]) == [0, 1, 2]
    assert sorted((r["page_index"], r["error"]) for r in rows if "bad.pdf" in r["path"]) == [(0, None), (1, None), (2, "damaged"), (10, "damaged")]
    gone = [r for r in rows if "gone" in r["path"]]
    assert len(gone) == 1 and gone[0]["image"] is None and gone[0]["error"]
    plan = files.range_images(ranges, render=render)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in plan and "binary" not in plan.split("Exchange")[-1]  # contents are not shuffled
    by_file = files.page_images(spark.createDataFrame([("p", bytearray(b"B"))], "path string, content binary"), 1, 5, render=render).collect()
    assert [(r["page_index"], r["error"]) for r in by_file] == [(0, None), (1, None), (None, "damaged")]


def test_page_store_keeps_the_latest_and_is_compacted(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no page results"):
        results.read_pages(spark, path)
    want = {}
    for v in range(1, 51):
        rows = [(d, v % 5, f"v{v}") for d in range(v % 7)]
        want |= {(d, p): t for d, p, t in rows}
        results.upsert_pages(spark.createDataFrame(rows, "doc_id bigint, page_index int, note string"), path, v, buckets=4)
    held = lambda frame: {(r["doc_id"], r["page_index"]): r["note"] for r in frame.collect()}
    before = results.read_pages(spark, path)
    assert held(before) == want
    assert results.compact_pages(spark, path, upto=40, buckets=4) == 40
    results.upsert_pages(spark.createDataFrame([(0, 0, 51)], "doc_id bigint, page_index int, extra int"), path, 51, buckets=4)  # written meanwhile, with a new column
    assert results.compact_pages(spark, path, buckets=4) == 51
    after = results.read_pages(spark, path)
    assert held(after) == want | {(0, 0): None} and after.where("extra = 51").count() == 1
    assert held(before) == want  # who planned before the compaction still reads
    assert results.vacuum_pages(spark, path) == 0  # too early
    assert results.vacuum_pages(spark, path, older_than=0) == 52
    parts = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(parts) <= 4 and held(results.read_pages(spark, path)) == want | {(0, 0): None}
    assert results.compact_pages(spark, path) == 51  # nothing to do
    with pytest.raises(ValueError, match="closed"):
        results.upsert_pages(spark.createDataFrame([(0, 0, "late")], "doc_id bigint, page_index int, note string"), path, 50)


def test_a_version_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path)
    for note in ("first try", "second try"):
        results.upsert_pages(spark.createDataFrame([(1, 0, note)], "doc_id bigint, page_index int, note string"), path, 1)
    assert [r["note"] for r in results.read_pages(spark, path).collect()] == ["second try"]


def test_model_gets_batches_of_32_across_arrow_batches(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        def score(segments):
            import uuid

            from pyspark import TaskContext

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{TaskContext.get().partitionId()} {len(segments)}")
            return pd.DataFrame({"probability": [len(s.split()) / 1000 for s in segments], "guess": [float(s.split()[0]) for s in segments]})

        return score

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = spark.range(0, 250, 1, 3).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), (F.col("id") % 300).cast("int"))).alias("segment"))
        got = sorted(map(tuple, models.score_segments(rows, load).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [(r[0], r[3]) for r in got] == [(k, float(k)) for k in range(250)]
    assert all(r[2] == min(128, k + 1) / 1000 and r[1].count(" ") == k for k, r in enumerate(got))  # rows keep their whole text
    sizes = {}
    for name in os.listdir(folder):
        part, n = open(f"{folder}/{name}").read().split()
        sizes.setdefault(int(part), []).append(int(n))
    assert {p: sorted(n, reverse=True) for p, n in sizes.items()} == {0: [32, 32, 19], 1: [32, 32, 19], 2: [32, 32, 20]}


@pytest.mark.parametrize("sizes", [[], [1], [32], [33], [5, 90, 0, 1, 64], [31, 1, 31, 2]])
def test_rebatched_frames(sizes):
    frames, at = [], 0
    for n in sizes:
        frames.append(pd.DataFrame({"x": range(at, at + n)}))
        at += n
    out = list(models.rebatched(iter(frames), 32))
    assert [x for f in out for x in f["x"]] == list(range(at))
    assert all(len(f) == 32 for f in out[:-1]) and all(0 < len(f) <= 32 for f in out) and all(f.index[0] == 0 for f in out)


@pytest.mark.parametrize(("text", "most", "want"), [("a b c", 2, "a b"), ("a b", 2, "a b"), ("", 3, ""), ("x.y!", 3, "x.y"), ("  a  b  ", 1, "  a"), ("그림 3 참조", 2, "그림 3")])
def test_clip(text, most, want):
    assert models.clip(text, most) == want
