"""What lies by document stays there, and Python slots do not pay for each page."""

import re

import pandas as pd
import pytest

from marlgate.operators import mapping, reports
from marlgate.plans import queries
from marlgate.plans.analysis import stored_fixture
from marlgate.sources import files, overlays, results
from marlgate.storage import clear, cut, parts_for


def _exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def merged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nested_results_move_texts_alone(spark, data, merged):
    """Of stored mentions, figures and elements none is moved."""
    a = stored_fixture(spark, data)
    assert _exchanges(a.raw) == 0 and _exchanges(a.display()) == 0
    assert _exchanges(a.registry) == 0


def test_partitions_grow_with_the_input(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(spark, 0) == own and parts_for(spark, 10_000 * own, each=1_000) == 10 * own


def test_bucketed_cut_keeps_rows_and_is_cleared(spark):
    rows = spark.range(100).selectExpr("id % 7 AS doc_id", "id")
    kept = cut(rows, "rows", "doc_id", 5)
    assert sorted(kept.collect()) == sorted(rows.collect()) and _exchanges(kept.groupBy("doc_id").count()) == 0
    clear(spark)
    assert not spark.catalog.listTables(pattern="marlgate_cut_*")


def test_pages_share_frames():
    """Rows of many pages are sent on at once."""
    rows = files._Rows(["doc_id", "v"])
    for doc in range(3):
        rows.add(2, doc_id=doc, v=[1.5, None])
    assert rows.take().values.tolist() == [[d, v] for d in range(3) for v in (1.5, None)] and not rows.columns[0]


PAGES = "doc_id bigint, page_index int, image binary, width int, height int"


def _boxes(image):
    if image == b"bad":
        raise ValueError("unreadable")
    n = float(image)
    return {"x0": [n, 90.5, -3.0], "y0": [0.0, 1.0, -3.0], "x1": [n + 5.7, 500.0, -1.0], "y1": [9.0, 20.0, 7.0], "score": [0.5, 0.25, 0.125]}


def _pages(spark):
    return spark.createDataFrame([(1, 0, b"1", 100, 10), (1, 1, b"bad", 100, 10), (2, 0, b"7", 100, 10)], PAGES)


def test_detection_and_recognition_in_one_pass_equal_the_two_steps(spark):
    schema = "x0 double, y0 double, x1 double, y1 double, score double"
    read = (lambda image, box: box, lambda box: [(",".join(map(str, box)), 0.9)])
    found = files.detect(_pages(spark), _boxes, schema)
    two = files.recognise(_pages(spark), found.where("error is null").drop("error"), *read)
    two = two.unionByName(found.where("error is not null").select("doc_id", "page_index", "error"), allowMissingColumns=True)
    one = files.detect_and_recognise(_pages(spark), _boxes, *read)
    assert one.schema == two.schema and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and one.count() == 5
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    frames = files.detect(_pages(spark), lambda image: pd.DataFrame(_boxes(image)), schema)
    assert sorted(map(repr, frames.collect())) == sorted(map(repr, found.collect()))


def test_many_pages_are_drawn_by_one_call(spark):
    boxes = [(d, p, 1, 0, 1, 1, 3, 3, "a", "0,255,0") for d in range(20) for p in range(2)]
    primitives = spark.createDataFrame(boxes, "doc_id bigint, page_index int, kind int, place bigint, x0 int, y0 int, x1 int, y1 int, label string, color string")
    images = spark.range(25).selectExpr("id AS doc_id", "0 AS page_index", "CAST(NULL AS BINARY) AS image", "8 AS width", "8 AS height")
    drawn = overlays.draw_overlays(images, primitives, overlays.painter(legend=False))
    assert "CoGroup" not in drawn._jdf.queryExecution().executedPlan().toString()
    got = {(r["doc_id"], r["page_index"]): (r["drawn"], r["error"]) for r in drawn.collect()}
    assert got == {(d, p): (None, "no image of the page") if p else (int(d < 20), None) for d in range(25) for p in range(2) if d < 20 or not p}


def test_result_files_are_compressed(spark, data, tmp_path):
    shown = stored_fixture(spark, data).display()
    results.write_display(shown, str(tmp_path / "out"), buckets=2)
    written = [f for f in (tmp_path / "out").rglob("part-*")]
    assert written and all(f.name.endswith(".json.gz") for f in written)
    assert results.read_display(spark, str(tmp_path / "out")).count() == shown.count()
    assert queries.result_files(spark, data).count() == shown.count()


def test_parts_of_nested_results_need_no_mentions(spark, data):
    """Chapters and pages are made without mentions, figures or the registry, and are those of the whole document."""
    a = stored_fixture(spark, data)
    some = a.display(only=("chapters", "full_text"))
    assert not {"stored_mapped", "stored_figures", "entries", "mapped"} & set(a.__dict__)
    pages = "transform(pages, p -> struct(p.page_index, p.chapter, p.section, p.full_text, p.size)) AS pages"
    got, want = (sorted(map(repr, df.selectExpr("doc_id", "chapters", pages).collect())) for df in (some, a.display()))
    assert got == want and len(got) > 1


def test_counts_look_up_numbers_of_pages(spark, data, merged):
    """Types of elements are counted without lookups, mentions of figures by page and number, where they lie and unsorted: what is moved are entries."""
    a = stored_fixture(spark, data)
    counted = reports.layout_type_counts(a.bare_elements)
    assert not {"carried", "entries", "stored_figures"} & set(a.__dict__)
    assert sorted(counted.collect()) == sorted(reports.layout_type_counts(a.elements).collect())
    assert _exchanges(a.mapped_numbers) <= 2 and "SortMergeJoin" not in a.mapped_numbers._jdf.queryExecution().executedPlan().toString()
    assert sorted(mapping.reference_counts(a.mapped_numbers).collect()) == sorted(mapping.reference_counts(a.mapped).collect())


def test_listed_files_are_those_that_spark_finds(spark, tmp_path):
    """Tasks list folders and read files themselves, so neither names nor contents go through the driver or the JVM."""
    for name in ("top.pdf", "a/one.PDF", "a/deep/two.pdf", "b/.draft", "_log/three.pdf", "b/_SUCCESS", "b/empty.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else name.encode())
    listed, found = files.list_files(spark, f"file:{tmp_path}/"), files.scan_files(spark, str(tmp_path))
    short = lambda df: sorted((r["path"].split(":")[-1].lstrip("/"), r["length"], r["modificationTime"].replace(microsecond=0)) for r in df.select("path", "length", "modificationTime").collect())
    # Spark's reader passes over empty files, which are documents that cannot be read
    assert short(listed.where("length > 0")) == short(found) and len(short(listed)) == 4

    def info(content):
        return len(content) // len(content), False, {"Title": bytes(content).decode()}

    got, want = (sorted((r["total_pages"], str(r["metadata"]), r["error"]) for r in files.document_info(df, info).collect()) for df in (listed, found))
    assert sorted(r for r in got if r[2] is None) == want and len(want) == 3 and sum(e is not None for _, _, e in got) == 1


def test_small_images_share_frames():
    frames = list(files._frames(("p", k, b"x" * (1 if k < 2500 else 5_000_000), 1, 1, None) for k in range(2502)))
    assert [len(f) for f in frames] == [1000, 1000, 501, 1]
