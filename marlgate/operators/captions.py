"""Captions: the best text near a figure, the nearest one below it, and the figure ids that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlgate.functions.geometry import box_array, caption_score, horizontal_overlap
from marlgate.functions.patterns import loose_caption_number, match_caption, strip

FIGURE = ["doc_id", "page_index", "fig_idx"]
_BOX = ("x0", "y0", "x1", "y1")


def _on_page(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs of a figure and a text of its page, boxes as f_* and t_*."""
    left = figures.select(*FIGURE, *(F.col(c).alias(f"f_{c}") for c in _BOX))
    right = texts.select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), "text_idx", "text", *(F.col(c).alias(f"t_{c}") for c in _BOX))
    return left.join(right.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p"))).drop("d", "p")


def best_captions(figures: DataFrame, texts: DataFrame, least: float = 0.5) -> DataFrame:
    """For each figure the caption-like text with the best score above ``least``; of equal scores the first text's."""
    captions = texts.withColumn("text", strip(F.col("text"))).withColumn("m", match_caption(F.col("text"))).where("m is not null").drop("m")
    scored = _on_page(figures, captions).withColumn("score", caption_score("f_", "t_")).where(F.col("score") > least)
    # a text that fits several patterns has the same score for each: the first one counts
    best = F.row_number().over(W.partitionBy(*FIGURE).orderBy(F.desc("score"), "text_idx"))
    top = scored.withColumn("_rank", best).where("_rank = 1").withColumn("m", match_caption(F.col("text")))
    return top.select(*FIGURE, "text_idx", F.col("text").alias("caption"), F.col("m.number").alias("figure_number"), F.col("m.title").alias("title"), box_array("t_").alias("caption_bbox"), "score")


def captions_below(figures: DataFrame, texts: DataFrame, reach: float = 50.0, overlap: float = 0.5) -> DataFrame:
    """For each figure the nearest text below it, and its figure number: null if that text, whatever follows it, has none."""
    pairs = _on_page(figures, texts).withColumn("distance", F.col("t_y0") - F.col("f_y1"))
    near = pairs.where((F.col("distance") > 0) & (F.col("distance") < reach) & (horizontal_overlap("f_", "t_") > overlap))
    first = F.row_number().over(W.partitionBy(*FIGURE).orderBy("distance", "text_idx"))
    return near.withColumn("_rank", first).where("_rank = 1").select(*FIGURE, "text_idx", "text", "distance", loose_caption_number(F.col("text")).alias("figure_number"))


def with_texts(figures: DataFrame, texts: DataFrame, least: float = 0.5, reach: float = 50.0, overlap: float = 0.5) -> DataFrame:
    """Figures with what ``best_captions`` and ``captions_below`` say of them: caption, figure_number, caption_bbox and loose_number.

    Figures meet the texts of their page once, and both choices are aggregates of that: all stays in the page's partition.
    """
    stripped = strip(F.col("text"))
    heads = texts.withColumn("_m", match_caption(stripped)).withColumn("_caption", F.when(F.col("_m").isNotNull(), stripped))
    right = heads.select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), "text_idx", "text", "_m", "_caption", *(F.col(c).alias(f"t_{c}") for c in _BOX))
    left = figures.select(*FIGURE, F.struct(*(c for c in figures.columns if c not in FIGURE)).alias("_own"), *(F.col(c).alias(f"f_{c}") for c in _BOX))
    score, distance = F.when(F.col("_m").isNotNull(), caption_score("f_", "t_")), F.col("t_y0") - F.col("f_y1")
    near = (distance > 0) & (distance < reach) & (horizontal_overlap("f_", "t_") > overlap)
    # only texts that can be chosen are joined: few for each figure
    fits = F.coalesce(score > least, F.lit(False)) | F.coalesce(near, F.lit(False))
    # figures lie by page already; to send all texts to all tasks would cost more than to move them once
    pairs = left.join(right.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("page_index") == F.col("p")) & fits, "left")
    best = F.max_by(F.struct("_caption", F.col("_m.number").alias("number"), box_array("t_").alias("bbox")), F.when(score > least, F.struct(score, -F.col("text_idx"))))
    below = F.min_by("text", F.when(near, F.struct(distance, "text_idx")))
    found = pairs.groupBy(*FIGURE).agg(F.any_value("_own").alias("_own"), best.alias("_best"), below.alias("_below"))
    kept = [F.col(c) if c in FIGURE else F.col(f"_own.{c}").alias(c) for c in figures.columns]
    return found.select(*kept, F.col("_best._caption").alias("caption"), F.col("_best.number").alias("figure_number"), F.col("_best.bbox").alias("caption_bbox"), loose_caption_number(F.col("_below")).alias("loose_number"))


def name_figures(figures: DataFrame, captions: DataFrame | None, structure: DataFrame) -> DataFrame:
    """Figures with caption, number, the page's own chapter and section, and an id by chapter and number where there is a number.

    Figures that ``with_texts`` made have captions already.
    """
    own = structure.select("doc_id", "page_index", "chapter", "section")
    out = figures if captions is None else figures.join(captions.select(*FIGURE, "caption", "figure_number", "caption_bbox").hint("shuffle_hash"), FIGURE, "left")
    # a stored table of pages takes a byte or two a row as a file, and a hundred times as much in memory: by the files' size it would be broadcast
    out = out.join(own.hint("shuffle_hash"), ["doc_id", "page_index"], "left")
    numbered = F.coalesce(F.col("figure_number") != 0, F.lit(False))
    in_chapter = F.coalesce(F.col("chapter") != 0, F.lit(False))
    name = F.when(numbered & in_chapter, F.concat(F.lit("ch"), "chapter", F.lit("_fig"), "figure_number")).when(numbered, F.concat(F.lit("fig_"), "figure_number"))
    return out.withColumn("figure_id", F.coalesce(name, F.col("figure_id")))
