"""Layout boxes: figure, text and title classes, and texts in title boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlgate.functions.geometry import inside

# Labels of each class, in lower case.
FIGURE_LABELS = ["image", "figure_title", "chart", "chart_title", "header_image", "footer_image"]
TEXT_LABELS = ["text", "paragraph_title", "abstract", "content", "reference", "doc_title", "footnote", "header", "aside_text"]
TITLE_LABELS = ["title", "paragraph_title", "header"]
# Fixed value: how far a text may reach over the edge of its title box.
TITLE_MARGIN = 5.0


def figure_layouts(layouts: DataFrame) -> DataFrame:
    """Figure-class boxes with fig_idx, their place among those of the page, and the figure_id that follows from it."""
    place = F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy("layout_idx")) - 1
    found = layouts.where(F.lower("label").isin(FIGURE_LABELS)).withColumn("fig_idx", place.cast("bigint"))
    return found.withColumn("figure_id", F.concat(F.lit("fig_"), F.col("page_index"), F.lit("_"), F.col("fig_idx")))


def text_regions(layouts: DataFrame) -> DataFrame:
    return layouts.where(F.lower("label").isin(TEXT_LABELS))


def title_regions(layouts: DataFrame, any_case: bool = True) -> DataFrame:
    label = F.lower("label") if any_case else F.col("label")
    return layouts.where(label.isin(TITLE_LABELS))


def texts_in_titles(texts: DataFrame, layouts: DataFrame, margin: float = TITLE_MARGIN, any_case: bool = True) -> DataFrame:
    """The texts inside a title box of their page: a semi-join on the page with the containment as its condition."""
    titles = title_regions(layouts, any_case).select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), *(F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")))
    inner = texts.select("*", *(F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")))
    same_page = (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p"))
    return inner.join(titles, same_page & inside("i_", "o_", margin), "left_semi").select(texts.columns)
