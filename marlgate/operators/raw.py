"""Raw results: one nested row a document with all that was found, and back to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgate.functions.geometry import box_array, normalize_box

PAGE = ["doc_id", "page_index"]
_FIGURE = "STRUCT<figure_id: STRING, figure_number: BIGINT, bbox: ARRAY<DOUBLE>, chapter: INT, section: STRING, caption: STRING, caption_bbox: ARRAY<DOUBLE>, label: STRING, score: DOUBLE, confidence: DOUBLE>"
_REFERENCE = "STRUCT<text: STRING, text_id: STRING, figure_number: BIGINT, bbox: ARRAY<DOUBLE>, start_pos: INT, end_pos: INT, context: STRING, confidence: DOUBLE, method: STRING, chapter: INT, section: STRING, mapped_figure_id: STRING, mapping_confidence: DOUBLE>"
_PAGE = (
    "STRUCT<page_index: INT, status: STRING, error: STRING, chapter_info: STRUCT<chapter: INT, section: STRING, subsection: STRING, title: STRING, language: STRING>,"
    " layouts: ARRAY<STRUCT<label: STRING, bbox: ARRAY<DOUBLE>, score: DOUBLE>>,"
    f" figure_layouts: ARRAY<{_FIGURE}>, recognized_texts: ARRAY<STRUCT<text_id: STRING, text: STRING, bbox: ARRAY<DOUBLE>, score: DOUBLE, confidence: DOUBLE>>,"
    f" figure_references: ARRAY<{_REFERENCE}>, size: STRUCT<width: INT, height: INT>>"
)
RAW = (
    "doc_id BIGINT, status STRING, pdf_info STRUCT<title: STRING, total_pages: INT>, total_pages INT,"
    f" pages ARRAY<{_PAGE}>,"
    " document_structure STRUCT<chapters: ARRAY<STRUCT<chapter: INT, title: STRING, start_page: INT, end_page: INT, sections: ARRAY<STRING>, figure_count: BIGINT>>>,"
    " summary STRUCT<total_layouts: BIGINT, total_figures: BIGINT, total_texts: BIGINT, total_figure_references: BIGINT, error_pages: BIGINT, success_rate: DOUBLE>, processing_time DOUBLE"
)


def _nested(rows: DataFrame, place: str, name: str, *fields: Column | str) -> DataFrame:
    """The rows of a page as an array in the order of ``place``."""
    item = F.struct(F.col(place).alias("_place"), F.struct(*fields).alias("v"))
    sorted_ = F.array_sort(F.collect_list(item), lambda a, b: F.signum(a["_place"] - b["_place"]).cast("int"))
    return rows.groupBy(*PAGE).agg(F.transform(sorted_, lambda x: x["v"]).alias(name))


def _field(rows: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)


def to_raw(pages: DataFrame, layouts: DataFrame, texts: DataFrame, figures: DataFrame, mapped: DataFrame, structure: DataFrame, chapters: DataFrame, summary: DataFrame) -> DataFrame:
    """One row a document in the schema RAW."""
    box = box_array().alias("bbox")
    parts = [
        _nested(layouts, "layout_idx", "layouts", "label", box, "score"),
        _nested(figures, "fig_idx", "figure_layouts", "figure_id", F.col("figure_number").cast("bigint").alias("figure_number"), box, "chapter", "section", "caption", "caption_bbox", "label", "score", _field(figures, "confidence", "double")),
        _nested(texts, "text_idx", "recognized_texts", "text_id", "text", box, _field(texts, "score", "double"), _field(texts, "confidence", "double")),
        _nested(mapped, "ref_idx", "figure_references", "text", "text_id", "figure_number", "bbox", "start_pos", "end_pos", "context", "confidence", "method", _field(mapped, "chapter", "int"), _field(mapped, "section", "string"), "mapped_figure_id", "mapping_confidence"),
    ]
    info = structure.select(*PAGE, F.struct("chapter", "section", "subsection", "title", "language").alias("chapter_info"))
    out = pages.join(info.hint("shuffle_hash"), PAGE, "left")
    for part in parts:
        out = out.join(part.hint("merge"), PAGE, "left")
    arrays = [F.coalesce(c, F.array().cast(p.schema[c].dataType)).alias(c) for p, c in zip(parts, ("layouts", "figure_layouts", "recognized_texts", "figure_references"), strict=True)]
    size = F.when(F.col("width").isNotNull(), F.struct("width", "height")).alias("size")
    page = F.struct("page_index", "status", "error", "chapter_info", *arrays, size)
    by_page = out.groupBy("doc_id").agg(F.collect_list(page).alias("pages"))
    by_page = by_page.withColumn("pages", F.array_sort("pages", lambda a, b: a["page_index"] - b["page_index"]))
    chapter = F.struct("chapter", _field(chapters, "title", "string"), "start_page", "end_page", "sections", "figure_count")
    by_chapter = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(chapter), lambda a, b: a["chapter"] - b["chapter"]).alias("chapters"))
    totals = summary.select("doc_id", F.struct("total_layouts", "total_figures", "total_texts", F.col("total_refs").alias("total_figure_references"), "error_pages", "success_rate").alias("summary"))
    joined = by_page.join(by_chapter.hint("shuffle_hash"), "doc_id", "left").join(totals.hint("shuffle_hash"), "doc_id", "left")  # documents are not sorted for it
    n = F.size("pages")
    return joined.select(
        "doc_id", F.lit("success").alias("status"), F.struct(F.lit(None).cast("string").alias("title"), n.alias("total_pages")).alias("pdf_info"), n.alias("total_pages"), "pages",
        F.struct(F.coalesce("chapters", F.array().cast(by_chapter.schema["chapters"].dataType)).alias("chapters")).alias("document_structure"), "summary", F.lit(None).cast("double").alias("processing_time"),
    )


def from_raw(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables of raw documents: what ``display`` takes, by the names of its parameters."""
    pages = raw.select("doc_id", F.explode("pages").alias("p"))
    box = lambda: [F.get("b", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]

    def items(name: str, place: str) -> DataFrame:
        rows = pages.select("doc_id", F.col("p.page_index").alias("page_index"), F.posexplode(f"p.{name}").alias(place, "v"))
        return rows.withColumn(place, F.col(place).cast("bigint")).withColumn("b", normalize_box(F.col("v.bbox"), F.lit(None).cast("array<array<double>>")))

    figures = items("figure_layouts", "fig_idx")
    default = F.concat(F.lit("fig_"), "page_index", F.lit("_"), "fig_idx")
    named = F.coalesce("v.figure_id", default).alias("figure_id")
    return {
        "documents": raw.select("doc_id", "pdf_info.title", "total_pages", "processing_time"),
        "pages": pages.select("doc_id", "p.page_index", "p.status", "p.error", "p.size.width", "p.size.height"),
        "structure": pages.select("doc_id", "p.page_index", "p.chapter_info.chapter", "p.chapter_info.section"),
        "chapters": raw.select("doc_id", F.explode("document_structure.chapters").alias("c")).select("doc_id", "c.*"),
        "texts": items("recognized_texts", "text_idx").select(*PAGE, "text_idx", "v.text_id", "v.text", "v.score", "v.confidence", *box()),
        "figures": figures.select(*PAGE, "fig_idx", named, "v.figure_number", "v.chapter", "v.section", "v.caption", "v.caption_bbox", "v.label", F.col("v.confidence").alias("score"), *box()),
        "mapped": items("figure_references", "ref_idx").select(*PAGE, "ref_idx", "v.text", "v.bbox", "v.figure_number", "v.mapped_figure_id", "v.mapping_confidence"),
    }


def display_of_raw(raw: DataFrame) -> DataFrame:
    """Display documents of raw ones."""
    from marlgate.operators import display, mapping

    t = from_raw(raw)
    elements = display.layout_elements(t["pages"], t["texts"], t["figures"], t["mapped"], structure=t["structure"])
    shown = t["mapped"].join(display.shown_pages(t["pages"]).select(*PAGE).hint("shuffle_hash"), PAGE, "left_semi")
    figures = display.display_figures(t["pages"], t["figures"], mapping.reference_counts(shown), score_as_confidence=True)
    return display.to_display(t["documents"], t["pages"], t["structure"], t["chapters"], figures, elements, t["texts"])
