"""Hand-made tables, one for each rule that is easy to get wrong."""

import pytest

from marlgate import schemas
from marlgate.operators import captions, layout, mapping, models, overlay, references, reports, structure

TEXT = "doc_id bigint, page_index int, text_idx bigint, text_id string, text string, x0 double, y0 double, x1 double, y1 double"


def texts(spark, *rows):
    """(doc, page, idx, text, box)"""
    return spark.createDataFrame([(d, p, i, f"text_{i}", t, *map(float, b)) for d, p, i, t, b in rows], TEXT)


def layouts(spark, *rows):
    return spark.createDataFrame([(d, p, i, label, *map(float, b), 0.9, 1) for d, p, i, label, b in rows], schemas.LAYOUTS)


def pages(spark, *rows):
    return spark.createDataFrame([(d, p, s, e, None, None) for d, p, s, e in rows], schemas.PAGES)


def test_figure_ids_count_figures_only(spark):
    found = layout.figure_layouts(layouts(spark, (1, 0, 0, "text", (0, 0, 1, 1)), (1, 0, 1, "Image", (0, 0, 1, 1)), (1, 0, 2, "CHART", (0, 0, 1, 1)))).collect()
    assert sorted(r["figure_id"] for r in found) == ["fig_0_0", "fig_0_1"]


def test_heading_tests(spark):
    rows = [(1, 0, 0, "a", (0, 199, 9, 229)), (1, 0, 1, "b", (0, 200, 9, 230)), (1, 0, 2, "c", (0, 205, 9, 235)), (1, 0, 3, "d", (0, 600, 9, 630))]
    found = {r["text"]: r for r in structure.heading_tests(texts(spark, *rows)).collect()}
    assert found["a"]["at_top"] and not found["b"]["at_top"]
    assert found["d"]["is_isolated"] and not found["c"]["is_isolated"]
    assert not any(r["is_tall"] for r in found.values())


def test_height_must_exceed_the_limit(spark):
    found = structure.heading_tests(texts(spark, (1, 0, 0, "a", (0, 300, 9, 310)), (1, 0, 1, "b", (0, 300, 9, 330)))).collect()
    assert {r["text"]: r["is_tall"] for r in found} == {"a": False, "b": False}  # 30 is 1.5 times the mean of 20


def test_fill_forward_keeps_the_pair(spark):
    rows = [(1, 0, 1, None), (1, 1, None, "1.1"), (1, 2, 2, "2.1"), (1, 3, 0, None), (2, 0, None, None)]
    got = structure.carry_forward(spark.createDataFrame(rows, "doc_id bigint, page_index int, chapter int, section string")).collect()
    assert {(r[0], r[1]): (r["carried_chapter"], r["carried_section"]) for r in got} == {(1, 0): (1, None), (1, 1): (1, None), (1, 2): (2, "2.1"), (1, 3): (0, None), (2, 0): (None, None)}


def test_structure_needs_a_heading_for_chapters_and_a_title_box_for_sections(spark):
    t = texts(spark, (1, 0, 0, "Chapter 2: Start", (10, 50, 90, 60)), (1, 0, 1, "2.1 Scope", (10, 400, 90, 420)), (1, 0, 2, "2.2 Loose", (10, 440, 90, 460)), (1, 0, 3, "Chapter 9", (10, 441, 90, 461)))
    box = layouts(spark, (1, 0, 0, "Title", (13, 398, 90, 420)))
    row = structure.page_structure(pages(spark, (1, 0, "success", None), (1, 1, "success", None)), t, box).orderBy("page_index").collect()
    assert tuple(row[0])[2:] == (2, "2.1", None, "Start", "en") and tuple(row[1])[2:] == (None,) * 5


def test_caption_ties_and_threshold(spark):
    figure = layout.figure_layouts(layouts(spark, (1, 0, 0, "image", (100, 100, 500, 300))))
    t = texts(spark, (1, 0, 0, "Figure 3. Above", (100, 60, 500, 90)), (1, 0, 1, "Figure 4. Below", (100, 310, 500, 340)), (1, 0, 2, "Figure 5", (100, 300, 500, 320)), (1, 0, 3, "Figure 6", (900, 310, 990, 340)))
    row = captions.best_captions(figure, t).collect()
    assert [(r["figure_number"], r["title"]) for r in row] == [(3, "Above")]


def test_nearest_below_is_chosen_before_its_number_is_read(spark):
    figure = layout.figure_layouts(layouts(spark, (1, 0, 0, "image", (100, 100, 500, 300)), (1, 1, 0, "image", (100, 100, 500, 300))))
    t = texts(spark, (1, 0, 0, "Figure 3", (100, 330, 500, 345)), (1, 0, 1, "prose", (100, 310, 500, 325)), (1, 1, 0, "so Figure 8", (100, 310, 500, 325)))
    assert {r["page_index"]: r["figure_number"] for r in captions.captions_below(figure, t).collect()} == {0: None, 1: 8}


FIGS = "doc_id bigint, page_index int, fig_idx bigint, figure_id string, figure_number int, chapter int, section string, caption string, x0 double, y0 double, x1 double, y1 double"
CARRIED = "doc_id bigint, page_index int, carried_chapter int, carried_section string"


def _registry(spark, figs, carried):
    f = spark.createDataFrame([(d, p, i, f"id{p}_{i}", n, None, None, c, 0.0, 0.0, 1.0, 1.0) for d, p, i, n, c in figs], FIGS)
    return mapping.figure_registry(f, spark.createDataFrame([(d, p, c, None) for d, p, c in carried], CARRIED))


def test_upsert_keeps_first_place_and_last_value(spark):
    got = _registry(spark, [(1, 0, 0, 1, "a"), (1, 0, 1, 2, "b"), (1, 1, 0, 1, "c"), (1, 1, 1, None, "d"), (1, 1, 2, 0, "e")], [(1, 0, 1), (1, 1, 1)])
    assert [(r["registry_key"], r["ord"], r["caption"]) for r in got.orderBy("ord").collect()] == [("ch1_fig1", 0, "c"), ("ch1_fig2", 1, "b")]


def test_chapter_zero_has_no_key_and_no_summary(spark):
    registry = _registry(spark, [(1, 0, 0, 4, "a")], [(1, 0, 0)])
    assert [r["registry_key"] for r in registry.collect()] == ["fig_4"]
    carried = spark.createDataFrame([(1, 0, 0, None)], CARRIED)
    assert reports.chapter_summary(carried, registry).count() == 0


def test_lookup_tiers_and_confidence(spark):
    registry = _registry(spark, [(1, 0, 0, 1, "c"), (1, 4, 0, 7, None), (2, 0, 0, 9, "x")], [(1, 0, 1), (1, 4, None), (2, 0, None)])
    refs = spark.createDataFrame([(1, 3, 0, 1), (1, 3, 1, 7), (1, 3, 2, 2), (1, 3, 3, 0), (1, 3, 4, None), (1, 3, 5, 50), (2, 3, 0, 9)], "doc_id bigint, page_index int, ref_idx bigint, figure_number bigint")
    carried = spark.createDataFrame([(1, 3, 1, None), (2, 3, None, None)], CARRIED)
    got = {(r["doc_id"], r["ref_idx"]): r for r in mapping.map_references(refs, registry, carried).collect()}
    assert [got[1, k]["tier"] for k in range(6)] == ["chapter", "global", "positional", "zero", "zero", "unmapped"]
    assert round(got[1, 0]["mapping_confidence"], 6) == 0.94 and got[1, 3]["mapping_confidence"] is None and got[1, 5]["mapping_confidence"] == 0
    assert round(got[2, 0]["mapping_confidence"], 6) == 0.64


def test_error_pages_in_summaries(spark):
    counts = spark.createDataFrame([(1, 0, "success", None, 2, 1, 3, 4), (1, 1, "error", "x", 5, 5, 5, 5), (1, 2, None, "y", 0, 0, 0, 0)], "doc_id bigint, page_index int, status string, error string, n_layouts bigint, n_figures bigint, n_texts bigint, n_refs bigint")
    documents = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    got = {r["doc_id"]: r for r in reports.document_summary(counts, documents).collect()}
    assert (got[1]["total_layouts"], got[1]["error_pages"], round(got[1]["success_rate"], 3)) == (2, 1, 66.667)
    assert (got[2]["total_pages"], got[2]["success_rate"]) == (0, 0)
    totals = reports.running_totals(counts).orderBy("page_index").collect()
    assert [r["so_far_texts"] for r in totals] == [3, 3, 3]


def test_dedupe_and_empty_input(spark):
    t = texts(spark, (1, 0, 0, "As shown in Figure 1", (0, 0, 9, 9)))
    assert references.scan_references(t).count() == 3 and references.scan_references(t, dedupe=True).count() == 1
    assert references.scan_references(t.limit(0)).count() == 0


def _merge(rules, model):
    out = [dict(r, best=r["c"], how="rule_based") for r in rules]
    for m in model:
        for r in out:
            if r["t"] == m["t"] and r["n"] == m["n"] and abs(r["s"] - m["s"]) < 20:
                if m["c"] > r["best"]:
                    r["best"], r["how"] = m["c"], "hybrid"
                break
        else:
            out.append(dict(m, best=m["c"] * 0.9, how="model"))
    return sorted((r["t"], r["n"] or -1, r["s"], round(r["best"], 6), r["how"]) for r in out)


def test_merge_equals_a_sequential_merge(spark):
    import random

    rng = random.Random(3)
    row = lambda i, c: {"i": i, "t": f"t{rng.randint(0, 2)}", "n": rng.choice([1, 2, None]), "s": rng.randint(0, 90), "c": c}
    rules, model = [row(i, 0.95) for i in range(8)], [row(i, round(rng.random(), 3)) for i in range(40)]
    make = lambda rows: spark.createDataFrame([(1, 0, r["t"], r["i"], r["n"], r["s"], r["c"]) for r in rows], "doc_id bigint, page_index int, text_id string, ref_idx bigint, figure_number bigint, start_pos int, confidence double")
    got = references.merge_rule_and_model(make(rules), make(model)).collect()
    assert sorted((r["text_id"], r["figure_number"] or -1, r["start_pos"], round(r["final_confidence"], 6), r["method"]) for r in got) == _merge(rules, model)


def test_page_ranges(spark):
    p = pages(spark, *((1, k, "success", None) for k in range(5)))
    assert sorted(r["page_index"] for r in reports.page_range(p, 2, 3).collect()) == [1, 2]
    with pytest.raises(ValueError):
        reports.page_range(p, 0, 3)


def test_overlay(spark):
    t = texts(spark, (1, 0, 0, "a text that is longer than that", (0.9, 1, 2, 3)))
    mapped = spark.createDataFrame([(1, 0, 0, "Figure 1", [1.0, 2.0, 3.0, 4.0], "fig_1"), (1, 0, 1, "Figure 2", [1.0, 2.0, 3.0, 4.0], None)], "doc_id bigint, page_index int, ref_idx bigint, text string, bbox array<double>, mapped_figure_id string")
    rows = overlay.overlay_primitives(layouts(spark, (1, 0, 0, "Odd", (0, 0, 1, 1))), t, mapped).orderBy("kind", "place").collect()
    assert [(r["label"], r["color"]) for r in rows] == [("Odd (0.90)", "255,255,255"), ("a text that is longe...", "0,255,0"), ("REF: Figure 1 -> fig_1", "0,255,0"), ("REF: Figure 2", "0,0,255")]
    pages = spark.createDataFrame([(1, 0, 600, 800), (1, 1, 259, 800), (1, 2, 260, 209), (1, 3, None, 800)], "doc_id bigint, page_index int, width int, height int")
    lines = overlay.page_legends(pages).orderBy("place").collect()
    assert len(lines) == 8 and {r["page_index"] for r in lines} == {0} and (lines[0]["x"], lines[0]["y"], lines[7]["y"]) == (350, 50, 190)


def test_model_slot(spark):
    import pandas as pd

    rows = models.segments(texts(spark, (1, 0, 0, "See Figure 4 here. No mention at all. Look at that one", (0, 0, 9, 9))))

    def load():
        return lambda s: pd.DataFrame({"probability": [0.9 if "mention" not in x else 0.1 for x in s], "guess": [6.0] * len(s)})

    got = models.model_references(models.score_segments(rows, load)).orderBy("ref_idx").collect()
    assert [(r["figure_number"], r["start_pos"]) for r in got] == [(4, 4), (6, 38)]


def test_full_text_skips_empty_rows(spark):
    t = texts(spark, (1, 0, 1, "b ", (0, 0, 1, 1)), (1, 0, 0, " a", (0, 0, 1, 1)), (1, 0, 2, "", (0, 0, 1, 1)))
    assert [r["full_text"] for r in reports.page_full_text(t).collect()] == ["a b"]
    rate = reports.mapping_rate(spark.createDataFrame([(1, "f"), (1, None)], "doc_id bigint, mapped_figure_id string"), ["doc_id"]).first()
    assert (rate["mapped_refs"], rate["unmapped_refs"], rate["mapping_rate"]) == (1, 1, 50.0)
