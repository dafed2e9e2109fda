"""Display documents: elements of pages, the figure list, and the nested result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgate.functions.geometry import box_array, dimensions
from marlgate.operators.mapping import mention_box
from marlgate.operators.reports import page_full_text

PAGE = ["doc_id", "page_index"]
#: Fields of each element type, in output order.
TYPE_FIELDS = {
    "text": ["bounding_box", "text", "confidence"],
    "figure": ["figure_id", "bounding_box", "figure_caption", "related_chapter", "related_section", "figure_number"],
    "figure_reference": ["referenced_figure_id", "bounding_box", "reference_text", "figure_number", "confidence"],
}
_FIELDS = {
    "type": "string", "bounding_box": "array<double>", "text": "string", "confidence": "double", "figure_id": "string", "figure_caption": "string",
    "related_chapter": "int", "related_section": "string", "figure_number": "bigint", "referenced_figure_id": "string", "reference_text": "string",
}


def _element(kind: int, place: str, name: str, **values: Column) -> list[Column]:
    fields = [(F.lit(name) if f == "type" else values.get(f, F.lit(None))).cast(t).alias(f) for f, t in _FIELDS.items()]
    return [*(F.col(c) for c in PAGE), F.lit(kind).alias("kind_ord"), F.col(place).cast("bigint").alias("place"), *fields]


def shown_pages(pages: DataFrame) -> DataFrame:
    """Pages that are shown: all but those with status error, also those with an error and no status."""
    return pages.where(~F.col("status").eqNullSafe("error"))


def layout_elements(pages: DataFrame, texts: DataFrame, figures: DataFrame, mapped: DataFrame, score_as_confidence: bool = False, structure: DataFrame | None = None) -> DataFrame:
    """One row an element: the texts of a page, then its figures, then its mentions; those without box or text are left out.

    Texts have no confidence unless ``texts`` has that column or ``score_as_confidence`` is set.  A figure without a chapter (or
    with chapter 0) or without a section takes its page's from ``structure``.
    """
    ok = shown_pages(pages).select(*PAGE)
    confidence = F.col("confidence") if "confidence" in texts.columns else F.col("score") if score_as_confidence else F.lit(None)
    a = texts.withColumn("_box", box_array()).where("_box is not null and text <> ''")
    a = a.select(*_element(0, "text_idx", "text", bounding_box=F.col("_box"), text=F.col("text"), confidence=confidence))
    b = figures.withColumn("_box", box_array()).where("_box is not null")
    if structure is not None:
        own = structure.select(*PAGE, F.nullif("chapter", F.lit(0)).alias("_chapter"), "section").withColumnRenamed("section", "_section")
        b = b.join(own.hint("shuffle_hash"), PAGE, "left").withColumn("chapter", F.coalesce(F.nullif("chapter", F.lit(0)), "_chapter"))
        b = b.withColumn("section", F.coalesce(F.nullif("section", F.lit("")), "_section"))
    b = b.select(
        *_element(1, "fig_idx", "figure", bounding_box=F.col("_box"), figure_id=F.col("figure_id"), figure_caption=F.col("caption"), related_chapter=F.col("chapter"), related_section=F.col("section"), figure_number=F.col("figure_number"))
    )
    c = mapped.where("size(bbox) >= 4 and text <> ''")
    c = c.select(
        *_element(2, "ref_idx", "figure_reference", bounding_box=F.slice("bbox", 1, 4), referenced_figure_id=F.col("mapped_figure_id"), reference_text=F.col("text"), figure_number=F.col("figure_number"), confidence=F.col("mapping_confidence"))
    )
    return a.unionByName(b).unionByName(c).join(ok.hint("shuffle_hash"), PAGE, "left_semi")  # elements are not sorted for it


def bare_elements(pages: DataFrame, texts: DataFrame, figures: DataFrame, refs: DataFrame) -> DataFrame:
    """The rows of ``layout_elements`` without what captions, structure and lookups say of them, which are not worked out."""
    none = lambda kind: F.lit(None).cast(kind)
    figures = figures.withColumns({"caption": none("string"), "chapter": none("int"), "section": none("string"), "figure_number": none("bigint")})
    mentions = refs.withColumns({"bbox": mention_box(refs), "mapped_figure_id": none("string"), "mapping_confidence": none("double")})
    return layout_elements(pages, texts, figures, mentions)


def display_figures(pages: DataFrame, figures: DataFrame, counts: DataFrame, score_as_confidence: bool = False) -> DataFrame:
    """The figure list of a document: the last figure of each id, at the place of the first, with its mentions counted."""
    ok = shown_pages(pages).select(*PAGE)
    boxed = figures.withColumn("bounding_box", box_array()).where("bounding_box is not null").join(ok.hint("shuffle_hash"), PAGE, "left_semi")
    score = F.col("score") if score_as_confidence else F.lit(None).cast("double")
    place = F.struct("page_index", "fig_idx")
    value = F.struct(
        "figure_number", "bounding_box", "page_index", "chapter", "section", "caption", "caption_bbox", dimensions().alias("dimensions"),
        score.alias("confidence_score"), F.lit(None).cast("string").alias("figure_type"),
    )
    last = boxed.groupBy("doc_id", "figure_id").agg(F.max_by(value, place).alias("v"), F.min(place).alias("first"))
    named = counts.withColumnRenamed("mapped_figure_id", "figure_id")
    out = last.join(named.hint("shuffle_hash"), ["doc_id", "figure_id"], "left")
    count = F.coalesce("reference_count", F.lit(0)).cast("bigint")
    return out.select("doc_id", "figure_id", "v.*", count.alias("reference_count"), (count > 0).alias("is_referenced"), "first")


def to_display(documents: DataFrame, pages: DataFrame, structure: DataFrame, chapters: DataFrame | None, figure_list: DataFrame | None, elements: DataFrame | None, texts: DataFrame | None) -> DataFrame:
    """One nested row a document: title, chapters, pages, figures, metadata.

    ``documents`` has doc_id, title, total_pages and processing_time; ``pages`` may have width and height; ``chapters`` may have a
    title.  Every array is sorted by its place before it is nested.

    What is None is not made: chapters, figures (with the metadata, which count them), layouts of pages, full_text of pages.
    """
    by_page = pages_of(pages, structure, elements, texts)
    parts = {"pages": by_page}
    if chapters is not None:
        title = F.col("title") if "title" in chapters.columns else F.concat(F.lit("Chapter "), "chapter")
        chapter = F.struct(title.alias("title"), F.col("chapter").alias("chapter_number"), "start_page", "end_page", "sections")
        by_chapter = chapters.groupBy("doc_id").agg(F.collect_list(chapter).alias("chapters"))
        parts = {"chapters": by_chapter.withColumn("chapters", F.array_sort("chapters", lambda a, b: a["chapter_number"] - b["chapter_number"])), **parts}
    if figure_list is not None:
        figure = F.struct(*(c for c in figure_list.columns if c not in ("doc_id", "first")))
        by_figure = figure_list.groupBy("doc_id").agg(F.collect_list(F.struct("first", figure.alias("v"))).alias("figures"))
        place = lambda x: x["first"]["page_index"].cast("bigint") * 1_000_000 + x["first"]["fig_idx"]
        parts["figures"] = by_figure.withColumn("figures", F.transform(F.array_sort("figures", lambda a, b: F.signum(place(a) - place(b)).cast("int")), lambda x: x["v"]))
    out = documents
    for part in parts.values():
        out = out.join(part.hint("merge"), "doc_id", "left")  # arrays are many times their estimate, so no broadcast
    columns = [F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c) for c, df in parts.items()]
    if figure_list is not None:
        figures = F.coalesce(F.size("figures"), F.lit(0))
        columns.append(F.struct("total_pages", "processing_time", F.greatest(figures, F.lit(0)).alias("total_figures")).alias("metadata"))
    return out.select("doc_id", "title", *columns)


def pages_of(pages: DataFrame, structure: DataFrame, elements: DataFrame | None, texts: DataFrame | None) -> DataFrame:
    """The pages of each document in order, as ``to_display`` nests them."""
    fields = list(_FIELDS)
    shown = shown_pages(pages).join(structure.select(*PAGE, "chapter", "section").hint("shuffle_hash"), PAGE, "left")
    page = ["page_index", F.when(F.col("chapter") != 0, F.col("chapter").cast("string")).alias("chapter"), "section"]
    if elements is not None:
        # kinds are nested one by one, so that each stays with its page; none is sorted with the others
        kinds = [f"_{k}" for k in range(3)]
        for k, name in enumerate(kinds):
            one = F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("e"))))
            nested = elements.where(F.col("kind_ord") == k).groupBy(*PAGE).agg(F.transform(one, lambda x: x["e"]).alias(name))
            shown = shown.join(nested.hint("merge"), PAGE, "left")
        none = F.array().cast(nested.schema[name].dataType)
        shown = shown.withColumn("layouts", F.concat(*(F.coalesce(n, none) for n in kinds))).drop(*kinds)
        page.append("layouts")
    if texts is not None:
        shown = shown.join(page_full_text(texts).hint("merge"), PAGE, "left")
        page.append(F.coalesce("full_text", F.lit("")).alias("full_text"))
    page.append(F.when(F.col("width").isNotNull(), F.struct("width", "height")).alias("size"))
    by_page = shown.groupBy("doc_id").agg(F.collect_list(F.struct("page_index", F.struct(*page).alias("v"))).alias("pages"))
    return by_page.withColumn("pages", F.transform(F.array_sort("pages", lambda a, b: a["page_index"] - b["page_index"]), lambda x: x["v"]))


def display_json(display: DataFrame) -> DataFrame:
    """doc_id and the document as JSON, with the fields of each element's own type and explicit nulls."""
    options = {"ignoreNullFields": "false"}

    def element(x: Column) -> Column:
        out = F.lit(None)
        for name, fields in TYPE_FIELDS.items():
            out = F.when(x["type"] == name, F.to_json(F.struct(x["type"].alias("type"), *(x[f].alias(f) for f in fields)), options)).otherwise(out)
        return out

    def page(p: Column) -> Column:
        head = F.to_json(F.struct(*(p[c].alias(c) for c in ("page_index", "chapter", "section", "full_text", "size"))), options)
        layouts = F.concat(F.lit('"layouts":['), F.array_join(F.transform(p["layouts"], element), ","), F.lit("]"))
        return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), layouts, F.lit("}"))

    rest = F.to_json(F.struct("title", "chapters", "figures", "metadata"), options)
    pages = F.concat(F.lit('"pages":['), F.array_join(F.transform("pages", page), ","), F.lit("]}"))
    return display.select("doc_id", F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(","), pages).alias("json"))
