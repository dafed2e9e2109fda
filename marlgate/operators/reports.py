"""Summaries of documents, chapters, pages and mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_index"]


def page_counts(pages: DataFrame, layouts: DataFrame, figures: DataFrame, texts: DataFrame, refs: DataFrame) -> DataFrame:
    """Pages with status and n_layouts, n_figures, n_texts, n_refs: counted in one aggregation over all rows."""
    kinds = {"n_layouts": layouts, "n_figures": figures, "n_texts": texts, "n_refs": refs}
    rows = reduce(DataFrame.unionByName, (df.select(*PAGE, F.lit(k).alias("_kind")) for k, df in enumerate(kinds.values())))
    counts = rows.groupBy(*PAGE).agg(*(F.count_if(F.col("_kind") == k).alias(n) for k, n in enumerate(kinds)))
    return pages.join(counts.hint("shuffle_hash"), PAGE, "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in kinds})


def document_summary(counts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Totals over pages that are no error pages; a page with an error but no status is not counted as one."""
    ok = ~F.col("status").eqNullSafe("error")
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(f"total_{c[2:]}")
    out = counts.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), total("n_layouts"), total("n_figures"), total("n_texts"), total("n_refs"), F.count_if(~ok).alias("error_pages")
    )
    if documents is not None:
        out = documents.select("doc_id").join(out, "doc_id", "left").na.fill(0)
    rate = F.when(F.col("total_pages") > 0, (F.col("total_pages") - F.col("error_pages")) / F.col("total_pages") * 100).otherwise(F.lit(0.0))
    return out.withColumn("success_rate", rate)


def chapter_spans(carried: DataFrame) -> DataFrame:
    """First and last page and sorted sections of each carried chapter; chapter 0 is none."""
    chapters = carried.where("carried_chapter <> 0").groupBy("doc_id", F.col("carried_chapter").alias("chapter"))
    return chapters.agg(F.min("page_index").alias("start_page"), F.max("page_index").alias("end_page"), F.sort_array(F.collect_set("carried_section")).alias("sections"))


def chapter_summary(carried: DataFrame, registry: DataFrame) -> DataFrame:
    """``chapter_spans`` with the registered figures of each."""
    figures = registry.groupBy("doc_id", "chapter").agg(F.count("*").alias("figure_count"))
    return chapter_spans(carried).join(figures.hint("shuffle_hash"), ["doc_id", "chapter"], "left").withColumn("figure_count", F.coalesce("figure_count", F.lit(0)).cast("bigint"))


def page_full_text(texts: DataFrame) -> DataFrame:
    """The texts of a page in order, joined by blanks and stripped; texts without a box or content do not count."""
    shown = texts.where("text <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    lines = F.array_sort(F.collect_list(F.struct("text_idx", "text")))
    joined = shown.groupBy(*PAGE).agg(F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias("full_text"))
    return joined.withColumn("full_text", F.regexp_replace("full_text", r"(?U)^\s+|\s+$", ""))


def mapping_rate(mapped: DataFrame, keys: list[str]) -> DataFrame:
    is_mapped = F.coalesce(F.col("mapped_figure_id") != "", F.lit(False))
    out = mapped.groupBy(*keys).agg(F.count("*").alias("total_refs"), F.count_if(is_mapped).alias("mapped_refs"), F.count_if(~is_mapped).alias("unmapped_refs"))
    return out.withColumn("mapping_rate", F.when(F.col("total_refs") > 0, F.col("mapped_refs") / F.col("total_refs") * 100).otherwise(F.lit(0.0)))


def layout_type_counts(elements: DataFrame) -> DataFrame:
    """Text, figure and figure_reference elements of each document."""
    counts = [F.count_if(F.col("type") == t).alias(f"{t}s") for t in ("text", "figure", "figure_reference")]
    return elements.groupBy("doc_id").agg(*counts)


def page_lookup(pages: DataFrame, page_index: int) -> DataFrame:
    return pages.where(F.col("page_index") == page_index)


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages by their number from 1, both ends included."""
    if first < 1 or last < first:
        raise ValueError(f"not a range of pages: {first}-{last}")
    return pages.where(F.col("page_index").between(first - 1, last - 1))


def page_at(pages: DataFrame, number: int) -> DataFrame:
    """The page of each document at a place in its list of pages, from 1, whatever its own index; none if the list is shorter."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page_index"))
    return pages.withColumn("_place", place).where(F.col("_place") == number).drop("_place")


def check_bounds(requests: DataFrame) -> DataFrame:
    """Adds to requests (page from 1, total_pages) an error where there is no such page, else null."""
    within = F.coalesce(F.col("page").between(1, F.col("total_pages")), F.lit(False))
    return requests.withColumn("error", F.when(~within, F.format_string("no page %s: the document has pages 1 to %s", "page", F.coalesce("total_pages", F.lit(0)))))


def last_lines(log: DataFrame, lines: int = 8) -> DataFrame:
    """The last lines of each task's log (task_id, event_id), oldest first by ``place`` from 0."""
    back = W.partitionBy("task_id").orderBy(F.desc("event_id"))
    kept = log.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= lines)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("task_id").orderBy("event_id")) - 1).drop("_back")


def running_totals(counts: DataFrame) -> DataFrame:
    """Figures, references and texts of a document up to each page; pages with an error add nothing."""
    until = W.partitionBy("doc_id").orderBy("page_index").rowsBetween(W.unboundedPreceding, 0)
    ok = F.col("error").isNull()
    add = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0)).over(until).alias(f"so_far_{c[2:]}")
    return counts.select(*PAGE, add("n_figures"), add("n_refs"), add("n_texts"))


def report(text: DataFrame, lines: int = 5, width: int = 50) -> DataFrame:
    """The first few pages of each document, texts cut short: what a verbose report shows."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("page_index"))
    return text.withColumn("_rank", rank).where(F.col("_rank") <= lines).drop("_rank").withColumn("full_text", F.substring("full_text", 1, width))
