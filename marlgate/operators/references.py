"""Figure mentions in texts, by rules, by a model, or by both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlgate.functions.geometry import box_array, word_box
from marlgate.functions.patterns import context, marked_mentions, mention_number, mention_parts, mention_pieces, mention_start, mention_text

_ORDER = ["text_idx", "rule", "start_pos", "part"]


def scan_references(texts: DataFrame, rules: list[int] | None = None, dedupe: bool = False) -> DataFrame:
    """A row for each mention: rules overlap, and all their rows are kept unless ``dedupe`` is set.

    Columns: doc_id, page_index, ref_idx, text_idx, text_id, rule, part, text, start_pos, end_pos, figure_number, bbox, original_bbox,
    full_text, context, confidence, method.
    """
    found = texts.withColumn("_hit", F.explode(marked_mentions(F.col("text"), rules)))
    found = found.select("*", F.posexplode(mention_pieces(F.col("_hit"))).alias("_k", "_piece")).where("_k > 0")
    found = found.withColumns({"_start": mention_start(F.col("_hit"), F.col("_piece"), F.col("_k")), "_mention": mention_text(F.col("_piece"))})
    found = found.withColumn("_part", F.explode(mention_parts(F.col("_hit.rule"))))
    start, end = F.col("_start"), F.col("_start") + F.length("_mention")
    out = found.select(
        "doc_id", "page_index", "text_idx", "text_id", F.col("_hit.rule").alias("rule"), F.col("_part").alias("part"), F.col("_mention").alias("mention"),
        start.alias("start_pos"), end.alias("end_pos"), mention_number(F.col("_mention"), F.col("_part")).alias("figure_number"),
        word_box(F.col("text"), start, end).alias("bbox"), box_array().alias("original_bbox"),
        F.col("text").alias("full_text"), context(F.col("text"), start, end).alias("context"),
        F.lit(0.95).alias("confidence"), F.lit("rule_based").alias("method"),
    ).withColumnRenamed("mention", "text")
    if dedupe:
        same = W.partitionBy("doc_id", "page_index", "text_idx", "figure_number").orderBy(F.desc(F.col("end_pos") - F.col("start_pos")), "rule", "start_pos")
        out = out.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    place = F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy(*_ORDER)) - 1
    return out.withColumn("ref_idx", place.cast("bigint"))


def with_page_context(refs: DataFrame, structure: DataFrame) -> DataFrame:
    """Adds to mentions the chapter and section of their own page: not what the page inherits."""
    return refs.join(structure.select("doc_id", "page_index", "chapter", "section"), ["doc_id", "page_index"], "left")


def merge_rule_and_model(rule: DataFrame, model: DataFrame, near: int = 20) -> DataFrame:
    """Rule mentions with the model's, of which those near a rule mention of the same number only raise its confidence.

    Both have doc_id, page_index, text_id, ref_idx, figure_number, start_pos and confidence.  A model mention belongs to the first
    rule mention that it is near to.  One that is near to none stands for itself, unless an earlier model mention that does is
    near: that depends on which earlier ones were kept, so it is a fold over the few model mentions of one text and number.
    Null numbers match null numbers.
    """
    key = ["doc_id", "page_index", "text_id"]
    rules = rule.select(*key, F.col("ref_idx").alias("r_idx"), F.col("figure_number").alias("r_number"), F.col("start_pos").alias("r_start"))
    pairs = model.select(*(F.col(k).alias(f"m_{k}") for k in key), F.col("ref_idx").alias("m_idx"), F.col("figure_number").alias("m_number"), F.col("start_pos").alias("m_start"), F.col("confidence").alias("m_conf"))
    on = (F.abs(F.col("r_start") - F.col("m_start")) < near) & F.col("r_number").eqNullSafe(F.col("m_number"))
    for k in key:
        on = on & (F.col(k) == F.col(f"m_{k}"))
    joined = pairs.join(rules, on, "left")
    first = joined.groupBy(*(f"m_{k}" for k in key), "m_idx", "m_number", "m_start", "m_conf").agg(F.min("r_idx").alias("r_idx"))
    raised = first.where("r_idx is not null").groupBy("m_doc_id", "m_page_index", "r_idx").agg(F.max("m_conf").alias("raised"))
    one = rule.join(raised, (rule["doc_id"] == raised["m_doc_id"]) & (rule["page_index"] == raised["m_page_index"]) & (rule["ref_idx"] == raised["r_idx"]), "left")
    higher = F.col("raised") > F.col("confidence")
    one = one.select(
        *key, F.lit(0).alias("origin"), "ref_idx", "figure_number", "start_pos", "confidence",
        F.when(higher, F.col("raised")).otherwise(F.col("confidence")).alias("final_confidence"),
        F.when(higher, F.lit("hybrid")).otherwise(F.lit("rule_based")).alias("method"),
    )
    alone = first.where("r_idx is null")
    entries = F.array_sort(F.collect_list(F.struct(F.col("m_idx").alias("i"), F.col("m_start").alias("s"), F.col("m_conf").alias("c"), F.col("m_conf").alias("best"))))
    empty = F.array().cast("array<struct<i: bigint, s: int, c: double, best: double>>")

    def fold(kept, x):
        hit = F.exists(kept, lambda y: F.abs(y["s"] - x["s"]) < near)
        # the first kept one that is near takes the higher confidence
        at = F.array_min(F.transform(F.filter(kept, lambda y: F.abs(y["s"] - x["s"]) < near), lambda y: y["i"]))
        raise_ = F.transform(kept, lambda y: F.when((y["i"] == at) & (x["c"] > y["best"]), F.struct(y["i"].alias("i"), y["s"].alias("s"), y["c"].alias("c"), x["c"].alias("best"))).otherwise(y))
        new = F.struct(x["i"].alias("i"), x["s"].cast("int").alias("s"), x["c"].alias("c"), (x["c"] * 0.9).alias("best"))
        return F.when(hit, raise_).otherwise(F.concat(kept, F.array(new)))

    grouped = alone.groupBy(*(f"m_{k}" for k in key), "m_number").agg(entries.alias("e"))
    kept = grouped.withColumn("k", F.explode(F.aggregate("e", empty, fold)))
    raised_alone = F.col("k.best") > F.col("k.c") * 0.9
    two = kept.select(
        *(F.col(f"m_{k}").alias(k) for k in key), F.lit(1).alias("origin"), F.col("k.i").alias("ref_idx"), F.col("m_number").alias("figure_number"), F.col("k.s").alias("start_pos"),
        F.col("k.c").alias("confidence"), F.col("k.best").alias("final_confidence"), F.when(raised_alone, F.lit("hybrid")).otherwise(F.lit("model")).alias("method"),
    )
    return one.unionByName(two)


def by_confidence(merged: DataFrame) -> DataFrame:
    """Adds place: the order by falling confidence within a page, rule mentions and earlier ones first."""
    order = W.partitionBy("doc_id", "page_index").orderBy(F.desc("final_confidence"), "origin", "ref_idx")
    return merged.withColumn("place", F.row_number().over(order) - 1)
