"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Within a source, documents stand in order of size.  Each adds its expected copies (target / source size) to a running sum that
starts at the source's random offset, and is taken once for each integer the sum crosses.  The running sum of a document is its
rank times a constant, so only ranks are needed.  They are found without a global sort in one task: sizes are range-partitioned
by (source, size, id), which splits a hot source, counted by partition, and numbered within each partition.

The targets come from as many small aggregations over the source table as there are rounds of resharing.

Edge cases: a null or empty text has size 0, and what its source takes of it is 0 words.  Documents without a source are a
source of their own, the last.  Null and repeated ids are allowed: equal rows take ranks in any order, which gives the same
rows.  If all sizes are 0 all targets are 0.  An empty table gives an empty table.  ``mix_documents`` hands on all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlgate.llm.scratch import cut, shielded

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"


def _ranked(frame: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds rank (from 1) within ``group`` by ``order``.

    The range partition of a row is written with it, as ranges may be drawn otherwise when the plan runs again.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(frame.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), name)
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = counts.withColumnsRenamed({c: f"_k_{c}" for c in [*group, "_part"]})
    match = F.col("_part") == F.col("_k__part")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = placed.withColumn("_row", F.row_number().over(W.partitionBy(*group, "_part").orderBy(*keys[len(group) :])))
    joined = inside.join(renamed, match)
    return joined.withColumn("rank", F.col("_row") + F.col("_before")).select(*frame.columns, "rank")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): water-filling with a ceiling of ``MOST_COPIES`` times the size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = _ranked(totals, ["_one"], [F.col("source").asc_nulls_last()], "sources").drop("_one")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS)).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")), "weights")
    cap = MOST_COPIES * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        # a source stays at its ceiling once it has reached it, as the level only rises
        at_cap = F.col("weight") * F.lit(level) > cap
        found = table.agg(F.count_if(at_cap), F.sum(F.when(at_cap, cap)), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if found[0] == capped or not found[2]:
            break
        capped, level = found[0], (total - (found[1] or 0)) / found[2]
    target = F.when(at_cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def document_sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("bigint")
    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), size.alias("size"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key``, size, source_size, target, copies and taken (copies times size) of every row of ``docs``."""
    sizes = cut(document_sizes(docs, key, text, source), "sizes")
    targets = source_targets(sizes).withColumnRenamed("source", "_source")
    ranked = _ranked(sizes, ["source"], ["size", "id"], "placed")
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a multiple of 2^-16 below 1, so that adding it to a whole number of copies is exact
    drawn = F.md5(F.concat(F.lit(SEED), F.coalesce("source", F.lit("")))).substr(1, 4)
    offset = F.conv(drawn, 16, 10).cast("double") / 65536
    copies = F.floor(F.col("rank") * share + offset) - F.floor((F.col("rank") - 1) * share + offset)
    out = joined.withColumn("copies", F.least(F.lit(MOST_COPIES), copies).cast("bigint"))
    return out.select(F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a document with c copies is there c times.

    Documents are told apart by ``key``; rows that share one get the copies of the first of them, and rows without one get one.
    """
    copies = mix(docs, key, text, source).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min("copies").alias("_copies"))
    own, names = shielded(docs)
    joined = own.join(copies, F.col(f"_in{names.index(key)}") == F.col("_id"), "left")
    times = F.coalesce("_copies", F.lit(1)).cast("int")
    return joined.select(*own.columns, F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy").toDF(*names)
