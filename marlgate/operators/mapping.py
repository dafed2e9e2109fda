"""From mentions to figures: the registry of a document, three lookups in turn, and a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlgate.functions.geometry import box_array

_ENTRY = ["figure_id", "figure_number", "chapter", "section", "page_index", "bbox", "caption"]


def figure_registry(figures: DataFrame, carried: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """One row for each key of a document: the last figure with it, at the place (ord) of the first.

    Keys are by carried chapter and number, or by number alone where there is no chapter.  Figures without a number take that
    of the text below them (``below``, or their own loose_number); those without either are not registered.
    """
    chapters = carried.select("doc_id", "page_index", "carried_chapter", "carried_section")
    rows = figures.drop("chapter", "section").join(chapters.hint("shuffle_hash"), ["doc_id", "page_index"], "left")
    number = F.nullif(F.col("figure_number"), F.lit(0))
    if below is not None:
        loose = below.select("doc_id", "page_index", "fig_idx", F.col("figure_number").alias("_loose"))
        rows = rows.join(loose.hint("shuffle_hash"), ["doc_id", "page_index", "fig_idx"], "left")
        number = F.coalesce(number, F.nullif(F.col("_loose"), F.lit(0)))
    elif "loose_number" in figures.columns:
        number = F.coalesce(number, F.nullif(F.col("loose_number"), F.lit(0)))
    rows = rows.withColumn("figure_number", number).where("figure_number is not null")
    has_chapter = F.coalesce(F.col("carried_chapter") != 0, F.lit(False))
    plain = F.concat(F.lit("fig_"), "figure_number")
    key = F.when(has_chapter, F.concat(F.lit("ch"), "carried_chapter", F.lit("_"), F.concat(F.lit("fig"), "figure_number"))).otherwise(plain)
    place = F.struct("page_index", "fig_idx")
    value = F.struct("figure_id", "figure_number", F.col("carried_chapter").alias("chapter"), F.col("carried_section").alias("section"), "page_index", box_array().alias("bbox"), "caption")
    grouped = rows.withColumn("registry_key", key).groupBy("doc_id", "registry_key").agg(F.max_by(value, place).alias("v"), F.min(place).alias("first"))
    ord_ = F.row_number().over(W.partitionBy("doc_id").orderBy("first")) - 1
    return grouped.select("doc_id", "registry_key", ord_.cast("bigint").alias("ord"), *(F.col(f"v.{c}").alias(c) for c in _ENTRY))


def ranked(registry: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds in_chapter and by_number (whether an entry is the one for its document, chapter and number, or number alone) and n.

    For a chapter and number the entry with that key counts, for a number alone the one without a chapter in its key, else the
    first; n is the place of an entry by chapter (none counts as 0) and page, from 1.  All windows lie within a document, so one
    exchange serves them, and none where the registry lies in ``parts`` by document.
    """
    keyed = F.col("registry_key") == F.concat(F.lit("ch"), "chapter", F.lit("_fig"), "figure_number")
    plain = F.col("registry_key") == F.concat(F.lit("fig_"), "figure_number")
    first = lambda keys, order: F.row_number().over(W.partitionBy("doc_id", *keys).orderBy(*order)) == 1
    parts = parts or int(registry.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return registry.repartition(parts, "doc_id").select(
        "*",
        (F.col("chapter").isNotNull() & first(["chapter", "figure_number"], [F.desc(keyed), "ord"])).alias("in_chapter"),
        first(["figure_number"], [F.desc(plain), "ord"]).alias("by_number"),
        F.row_number().over(W.partitionBy("doc_id").orderBy(F.coalesce("chapter", F.lit(0)), "page_index", "ord")).alias("n"),
    )


def by_chapter(entries: DataFrame) -> DataFrame:
    """Of ranked entries, the one for each document, chapter and number."""
    return entries.where("in_chapter")


def by_number(entries: DataFrame) -> DataFrame:
    """Of ranked entries, the one for each document and number."""
    return entries.where("by_number")


def answers(entries: DataFrame) -> DataFrame:
    """What ranked entries say to a number of a document: _d, _n, _chapters (of each chapter its entry), _global and _positional."""
    entry, none = F.struct(*_ENTRY), F.lit(None).cast(entries.select(F.struct(*_ENTRY).alias("e")).schema["e"].dataType)
    of_chapter = F.when(F.col("in_chapter"), F.struct("chapter", entry.alias("entry")))
    numbered = entries.where("in_chapter or by_number").select("doc_id", F.col("figure_number").cast("bigint").alias("_n"), of_chapter.alias("a"), F.when(F.col("by_number"), entry).alias("b"), none.alias("c"))
    placed = entries.select("doc_id", F.col("n").cast("bigint").alias("_n"), F.lit(None).cast(numbered.schema["a"].dataType).alias("a"), none.alias("b"), entry.alias("c"))
    one = lambda c: F.any_value(c, F.lit(True))  # noqa: E731  there is one at most
    return numbered.unionByName(placed).groupBy(F.col("doc_id").alias("_d"), "_n").agg(F.collect_list("a").alias("_chapters"), one("b").alias("_global"), one("c").alias("_positional"))


def mapping_confidence(own: Column, page: Column, figure: Column) -> Column:
    """From 0.5: more for the same chapter and for a caption, less for each page between."""
    both = own.eqNullSafe(figure["chapter"])
    away = F.abs(page - figure["page_index"])
    score = F.lit(0.5) + F.when(both & own.isNotNull(), 0.3).otherwise(0.0) + F.when(F.coalesce(figure["caption"] != "", F.lit(False)), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - away * F.when(both, 0.02).otherwise(0.05)))


def map_references(refs: DataFrame, entries: DataFrame, carried: DataFrame) -> DataFrame:
    """Adds tier (chapter, global, positional, unmapped or zero), the mapped figure's columns and mapping_confidence.

    ``entries`` is the registry, ranked already or not.  The three lookups are one equi-join on document and number: its other side has a
    row for each of these, with the entries of the few chapters that have the number.  So mentions are moved once, and never multiplied.
    Mentions get the chapter and section of their own page too, unless they have them.
    """
    context = [c for c in ("chapter", "section") if c in carried.columns and c not in refs.columns]
    chapters = carried.select("doc_id", "page_index", F.col("carried_chapter").alias("_own"), *context)
    known = answers(entries if "in_chapter" in entries.columns else ranked(entries))
    # pages and entries are few beside mentions, which so are not sorted
    out = refs.join(chapters.hint("shuffle_hash"), ["doc_id", "page_index"], "left")
    out = out.join(known.hint("shuffle_hash"), (F.col("doc_id") == F.col("_d")) & (F.col("figure_number") == F.col("_n")), "left")
    own = F.get(F.filter("_chapters", lambda x: x["chapter"] == F.col("_own")), F.lit(0))["entry"]
    out = out.withColumn("_f1", own).withColumnsRenamed({"_global": "_f2", "_positional": "_f3"})
    asked = F.coalesce(F.col("figure_number") != 0, F.lit(False))
    figure = F.when(asked, F.coalesce("_f1", "_f2", "_f3"))
    tier = F.when(~asked, "zero").when(F.col("_f1").isNotNull(), "chapter").when(F.col("_f2").isNotNull(), "global").when(F.col("_f3").isNotNull(), "positional").otherwise("unmapped")
    confidence = F.when(figure.isNotNull(), mapping_confidence(F.col("_own"), F.col("page_index"), figure)).when(asked, F.lit(0.0))
    extra = [
        tier.alias("tier"), figure["figure_id"].alias("mapped_figure_id"), figure["bbox"].alias("mapped_figure_bbox"), figure["page_index"].alias("mapped_figure_page"),
        figure["chapter"].alias("mapped_chapter"), confidence.alias("mapping_confidence"),
    ]
    kept = [mention_box(refs) if c == "bbox" else F.col(c) for c in [*refs.columns, *context]]
    return out.select(*kept, *extra)


def mention_box(refs: DataFrame) -> Column:
    """The box of a mention, or that of its text where it has none."""
    own = F.coalesce(F.when(F.size("bbox") > 0, F.col("bbox")), F.col("original_bbox")) if "original_bbox" in refs.columns else F.col("bbox")
    return own.alias("bbox")


def numbers_of_pages(refs: DataFrame) -> DataFrame:
    """The numbers that a page mentions, and how often: all that a lookup depends on, and fewer rows than mentions."""
    return refs.groupBy("doc_id", "page_index", "figure_number").agg(F.count("*").alias("mentions"))


def reference_counts(mapped: DataFrame) -> DataFrame:
    """Mentions of each figure, from mapped mentions or mapped ``numbers_of_pages``."""
    count = F.coalesce(F.sum("mentions"), F.lit(0)) if "mentions" in mapped.columns else F.count("*")
    return mapped.where("mapped_figure_id <> ''").groupBy("doc_id", "mapped_figure_id").agg(count.alias("reference_count"))
