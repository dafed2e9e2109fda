"""The display transform on one hand-written document: two pages, one figure, two mentions."""

import json

import pytest

from marlgate import schemas
from marlgate.operators import display, mapping
from marlgate.sources import results

BOX = "x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def tables(spark):
    lines = ["Chapter 1: Tides", "This is the first paragraph.", "As shown in Figure 1.", "1.1 Background", "More text about Figure 2.", "The end."]
    scores = [0.98, 0.95, 0.96, 0.97, 0.94, 0.95]
    texts = [(1, i // 3, i % 3, f"text_{i % 3}", t, 100.0, 100.0 * (i % 3 + 1), 500.0, 100.0 * (i % 3 + 1) + 30, c) for i, (t, c) in enumerate(zip(lines, scores, strict=True))]
    texts += [(1, 1, 3, "text_3", "", 0.0, 0.0, 1.0, 1.0, 0.5), (1, 1, 4, "text_4", "no box", None, None, None, None, 0.5)]
    figures = [(1, 0, 0, "ch1_fig1", 1, 1, None, "Figure 1: Overview", None, 100.0, 500.0, 400.0, 700.0, 0.9)]
    refs = [(1, 0, 0, "Figure 1", [150.0, 300.0, 200.0, 330.0], 1, "ch1_fig1", 0.9), (1, 1, 0, "Figure 2", [150.0, 200.0, 200.0, 230.0], 2, None, 0.0), (1, 1, 1, "", [1.0, 1.0, 2.0, 2.0], 1, "ch1_fig1", 0.5)]
    return {
        "pages": spark.createDataFrame([(1, 0, "success", None, None, None), (1, 1, "success", None, 600, 800), (1, 2, "error", "bad", None, None), (1, 3, None, "lost", None, None)], schemas.PAGES),
        "texts": spark.createDataFrame(texts, f"doc_id bigint, page_index int, text_idx bigint, text_id string, text string, {BOX}, confidence double"),
        "figures": spark.createDataFrame(figures, f"doc_id bigint, page_index int, fig_idx bigint, figure_id string, figure_number bigint, chapter int, section string, caption string, caption_bbox array<double>, {BOX}, score double"),
        "mapped": spark.createDataFrame(refs, "doc_id bigint, page_index int, ref_idx bigint, text string, bbox array<double>, figure_number bigint, mapped_figure_id string, mapping_confidence double"),
        "structure": spark.createDataFrame([(1, 0, 1, None), (1, 1, 1, "1.1")], "doc_id bigint, page_index int, chapter int, section string"),
        "chapters": spark.createDataFrame([(1, 1, "Tides", 0, 3, ["1.1", "1.2"])], "doc_id bigint, chapter int, title string, start_page int, end_page int, sections array<string>"),
        "documents": spark.createDataFrame([(1, "Notes on a Harbour", 10, 45.2), (2, None, 0, None)], "doc_id bigint, title string, total_pages int, processing_time double"),
    }


@pytest.fixture(scope="module")
def shown(tables):
    t = tables
    elements = display.layout_elements(t["pages"], t["texts"], t["figures"], t["mapped"])
    listed = display.display_figures(t["pages"], t["figures"], mapping.reference_counts(t["mapped"]))
    return display.to_display(t["documents"], t["pages"], t["structure"], t["chapters"], listed, elements, t["texts"])


def test_document(shown):
    doc = shown.where("doc_id = 1").first()
    assert doc["title"] == "Notes on a Harbour"
    assert [tuple(c) for c in doc["chapters"]] == [("Tides", 1, 0, 3, ["1.1", "1.2"])]
    assert [[e["type"] for e in p["layouts"]] for p in doc["pages"]] == [["text", "text", "text", "figure", "figure_reference"], ["text", "text", "text", "figure_reference"], []]
    assert [(p["page_index"], p["chapter"], p["section"]) for p in doc["pages"]] == [(0, "1", None), (1, "1", "1.1"), (3, None, None)]
    assert doc["pages"][1]["full_text"] == "1.1 Background More text about Figure 2. The end." and tuple(doc["pages"][1]["size"]) == (600, 800)
    assert [e["confidence"] for e in doc["pages"][0]["layouts"][:3]] == [0.98, 0.95, 0.96]
    figure = doc["figures"][0]
    assert (figure["figure_id"], tuple(figure["dimensions"]), figure["confidence_score"], figure["figure_type"], figure["reference_count"], figure["is_referenced"]) == ("ch1_fig1", (300.0, 200.0, 60000.0), None, None, 2, True)
    refs = [e for p in doc["pages"] for e in p["layouts"] if e["type"] == "figure_reference"]
    assert [(r["referenced_figure_id"], r["confidence"]) for r in refs] == [("ch1_fig1", 0.9), (None, 0.0)]
    assert tuple(doc["metadata"]) == (10, 45.2, 1)


def test_document_without_pages(shown):
    doc = shown.where("doc_id = 2").first()
    assert (doc["chapters"], doc["pages"], doc["figures"]) == ([], [], []) and doc["metadata"]["total_figures"] == 0


def test_json_has_each_types_own_fields(shown):
    doc = json.loads(display.display_json(shown.where("doc_id = 1")).first()["json"])
    first = doc["pages"][0]["layouts"]
    assert list(first[0]) == ["type", *display.TYPE_FIELDS["text"]] and list(first[3]) == ["type", *display.TYPE_FIELDS["figure"]]
    assert doc["pages"][0]["size"] is None and doc["figures"][0]["figure_type"] is None


def test_round_trip(spark, shown, tmp_path):
    results.write_display(shown, str(tmp_path / "out"))
    back = results.read_display(spark, str(tmp_path / "out"))
    assert {r["doc_id"]: r["title"] for r in back.collect()} == {1: "Notes on a Harbour", 2: None}
    assert len(list(results.iterate_json(shown))) == 2


def test_nothing_in_nothing_out(tables):
    t = {k: v.limit(0) for k, v in tables.items()}
    assert display.layout_elements(t["pages"], t["texts"], t["figures"], t["mapped"]).count() == 0


def test_raw_file_to_display(spark, tmp_path):
    """A result file with missing keys, read by its schema and transformed."""
    from marlgate.operators import raw

    text = {"text": "As shown in Figure 1.", "bbox": [0, 0, 10, 5], "confidence": 0.9}
    page = {"page_index": 0, "status": "success", "chapter_info": {"chapter": 1}, "recognized_texts": [text], "figure_layouts": [{"figure_id": "ch1_fig1", "figure_number": 1, "bbox": [0, 10, 30, 30]}, {"bbox": []}]}
    page["figure_references"] = [{"text": "Figure 1", "bbox": [1, 1, 2, 2], "figure_number": 1, "mapped_figure_id": "ch1_fig1", "mapping_confidence": 0.9}]
    bad = {"page_index": 1, "status": "error", "error": "lost"}
    doc = {"doc_id": 7, "status": "success", "pdf_info": {"title": "T"}, "total_pages": 2, "pages": [page, bad], "document_structure": {"chapters": [{"chapter": 1, "start_page": 0, "end_page": 1, "sections": []}]}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=2))
    got = raw.display_of_raw(spark.read.schema(raw.RAW).json(str(tmp_path), multiLine=True)).first()
    assert got["title"] == "T" and [e["type"] for e in got["pages"][0]["layouts"]] == ["text", "figure", "figure_reference"] and len(got["pages"]) == 1
    assert [(f["figure_id"], f["reference_count"]) for f in got["figures"]] == [("ch1_fig1", 1)]


def test_analysis_to_raw_and_back(spark):
    from marlgate import schemas as S
    from marlgate.operators import raw
    from marlgate.plans.analysis import Analysis

    pages = spark.createDataFrame([(1, 0, "success", None, 600, 800), (1, 1, "error", "x", None, None)], S.PAGES)
    texts = spark.createDataFrame([(1, 0, 0, "text_0", "Chapter 2: Start", 0.0, 10.0, 90.0, 30.0, None, 0.9, 0.9), (1, 0, 1, "text_1", "Figure 3. Name", 0.0, 310.0, 100.0, 330.0, None, 0.9, 0.9)], S.TEXTS)
    layouts = spark.createDataFrame([(1, 0, 0, "image", 0.0, 100.0, 100.0, 300.0, 0.8, 1)], S.LAYOUTS)
    a = Analysis(pages, layouts, texts)
    doc = a.raw.first()
    assert doc["pages"][0]["figure_layouts"][0]["figure_id"] == "ch2_fig3" and doc["pages"][1]["layouts"] == [] and doc["summary"]["error_pages"] == 1
    assert {r["mapped_figure_id"] for r in doc["pages"][0]["figure_references"]} == {"ch2_fig3"}
    shown = raw.display_of_raw(a.raw).first()
    assert shown["figures"][0]["reference_count"] == len(doc["pages"][0]["figure_references"])
    assert Analysis(pages, layouts, texts, exclude_captions=True).refs.count() == 0


def test_plans_read_no_more_than_they_need(spark, data):
    """Mentions do without the structure of pages; resolving them moves them by page and by number, and nothing is stored for it."""
    import re

    from marlgate.plans.analysis import stored_fixture

    a = stored_fixture(spark, data)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = plan(a.refs)
    assert "carried" not in a.__dict__ and "entries" not in a.__dict__ and len(re.findall("FileScan|Scan parquet", scan)) == 1 and len(re.findall(r"Exchange hashpartitioning", scan)) == 1
    assert "Join" not in scan and "Python" not in scan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mapped = plan(a.mapped)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "stored_mapped" not in a.__dict__ and "stored_figures" not in a.__dict__
    # texts, carried and entries twice; mentions by page (window, context) and by number, carried by page, answers by number
    assert len(re.findall("Scan parquet", mapped)) == 4 and len(re.findall(r"Exchange hashpartitioning", mapped)) <= 4 and "Cartesian" not in mapped


def test_figures_with_texts_equal_the_two_lookups(spark, data):
    from marlgate.operators import captions
    from marlgate.plans.analysis import stored_fixture

    a = stored_fixture(spark, data)
    both = {(r["doc_id"], r["page_index"], r["fig_idx"]): r for r in captions.with_texts(a.figures, a.texts).collect()}
    best = {(r["doc_id"], r["page_index"], r["fig_idx"]): r for r in a.captions.collect()}
    below = {(r["doc_id"], r["page_index"], r["fig_idx"]): r for r in a.below.collect()}
    assert len(both) == a.figures.count() and set(best) | set(below) <= set(both)
    for key, r in both.items():
        assert [r[c] for c in ("caption", "figure_number", "caption_bbox")] == ([best[key][c] for c in ("caption", "figure_number", "caption_bbox")] if key in best else [None] * 3)
        assert r["loose_number"] == (below[key]["figure_number"] if key in below else None)
