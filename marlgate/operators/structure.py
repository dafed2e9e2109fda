"""Page structure: headings, chapter and section of a page, and what later pages inherit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlgate.functions.geometry import inside
from marlgate.functions.patterns import fallback_chapter, match_chapter, match_section, may_be_heading, strip
from marlgate.operators.layout import TITLE_MARGIN, texts_in_titles, title_regions

PAGE = ["doc_id", "page_index"]
TEXT = [*PAGE, "text_idx"]


def heading_tests(texts: DataFrame, top: float = 200.0, taller: float = 1.5) -> DataFrame:
    """Adds at_top, is_tall (against the page's mean height), is_isolated and is_heading (any of them).

    A text is isolated if no other one of its page has its vertical centre within half this one's height: neither of its neighbours
    in order of centres has, as others are farther.  So a page is sorted once, and nothing is joined.
    """
    height, centre = F.col("y1") - F.col("y0"), (F.col("y0") + F.col("y1")) / 2
    by_centre = W.partitionBy(*PAGE).orderBy("_centre")
    out = texts.withColumn("_centre", centre)
    out = out.withColumns({"_mean": F.avg(height).over(W.partitionBy(*PAGE)), "_above": F.lag("_centre").over(by_centre), "_below": F.lead("_centre").over(by_centre)})
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col("_centre")) < height / 2, F.lit(False))
    boxed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    out = out.withColumns({"at_top": F.coalesce(F.col("y0") < top, F.lit(False)), "is_tall": F.coalesce(height > F.col("_mean") * taller, F.lit(False)), "is_isolated": boxed & ~near("_above") & ~near("_below")})
    return out.withColumn("is_heading", F.col("at_top") | F.col("is_tall") | F.col("is_isolated")).drop("_centre", "_mean", "_above", "_below")


def page_structure(pages: DataFrame, texts: DataFrame, layouts: DataFrame) -> DataFrame:
    """chapter, title, language, section and subsection of each page.

    The last chapter heading of a page counts.  Section headings count in title boxes only, and a chapter heading is not looked at
    as a section.  Both are aggregates over the page's texts.

    Texts go to their pages without content but what their patterns say, and only those that match one meet title boxes.
    """
    content = strip(F.col("text"))
    likely = may_be_heading(content)
    boxes = ("x0", "y0", "x1", "y1")
    slim = texts.select(*TEXT, *boxes, F.when(likely, match_chapter(content)).alias("c"), F.when(likely, match_section(content)).alias("s"))
    judged = heading_tests(slim).where("c is not null or s is not null").select(*PAGE, "text_idx", "is_heading", "c", "s", *(F.col(b).alias(f"i_{b}") for b in boxes))
    titles = title_regions(layouts).select(F.col("doc_id").alias("_d"), F.col("page_index").alias("_p"), *(F.col(b).alias(f"o_{b}") for b in boxes))
    # a text in several boxes is there several times, which the aggregates do not mind; title boxes are hashed where their page lies, never sent through the driver
    boxed = judged.join(titles.hint("shuffle_hash"), (F.col("doc_id") == F.col("_d")) & (F.col("page_index") == F.col("_p")) & inside("i_", "o_", TITLE_MARGIN), "left")
    is_title = F.col("_d").isNotNull()
    is_chapter = F.col("c").isNotNull() & (is_title | F.col("is_heading"))
    is_section = F.col("s").isNotNull() & is_title & ~is_chapter
    found = boxed.groupBy(*PAGE).agg(
        F.max_by("c", F.when(is_chapter, F.col("text_idx"))).alias("c"),
        F.max_by("s", F.when(is_section, F.col("text_idx"))).alias("s"),
    )
    out = pages.select(*PAGE).join(found, PAGE, "left")
    return out.select(*PAGE, F.col("c.chapter").alias("chapter"), F.col("s.section").alias("section"), F.col("s.subsection").alias("subsection"), F.col("c.title").alias("title"), F.col("c.language").alias("language"))


def fallback_structure(pages: DataFrame, texts: DataFrame, layouts: DataFrame) -> DataFrame:
    """chapter and section for pages without structure: the first text in an exact title box with a chapter pattern in it."""
    inside = texts_in_titles(texts, layouts, margin=0.0, any_case=False).withColumn("f", fallback_chapter(F.col("text"))).where("f is not null")
    first = inside.groupBy(*PAGE).agg(F.min_by("f", "text_idx").alias("f"))
    return pages.select(*PAGE).join(first, PAGE).select(*PAGE, F.col("f.chapter").alias("chapter"), F.col("f.section").alias("section"))


def carry_forward(structure: DataFrame) -> DataFrame:
    """Adds carried_chapter and carried_section: those of the last page up to this one that has a chapter, as a pair."""
    pair = F.when(F.col("chapter").isNotNull(), F.struct("chapter", "section"))
    until = W.partitionBy("doc_id").orderBy("page_index").rowsBetween(W.unboundedPreceding, 0)
    carried = structure.withColumn("_pair", F.last(pair, ignorenulls=True).over(until))
    return carried.withColumn("carried_chapter", F.col("_pair.chapter")).withColumn("carried_section", F.col("_pair.section")).drop("_pair")
