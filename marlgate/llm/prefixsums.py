"""Running values within groups of any size, without a group in one task.

Rows are dealt by ranges of (group, order), which splits a large group.  Running values are worked out within each range, and the
totals of the ranges before it are added: a table with a row for each group and range, small beside the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlgate.llm.scratch import cut

_KINDS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def running(frame: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, Column]], name: str) -> DataFrame:
    """``frame`` with a running value, the row's own included, for each of ``values``: name to (sum or xor, bigint column).

    ``group`` has no nulls; (group, order) tells rows apart, or those that it does not may come in any order.  The range of a row
    is written with it, as ranges may be drawn otherwise when the plan runs again.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = frame.withColumns({f"_of_{n}": c for n, (_, c) in values.items()})
    keys = [*group, *order]
    placed = cut(own.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), name)
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "_part").agg(*(_KINDS[k][0](f"_of_{n}").alias(f"_of_{n}") for n, (k, _) in values.items()))
    earlier = [F.coalesce(_KINDS[k][0](f"_of_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n, (k, _) in values.items()]
    totals = totals.select(*(F.col(c).alias(f"_key_{c}") for c in (*group, "_part")), *earlier)
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = placed.withColumns({f"_in_{n}": _KINDS[k][0](f"_of_{n}").over(inside) for n, (k, _) in values.items()})
    match = F.col("_part") == F.col("_key__part")
    for c in group:
        match = match & (F.col(c) == F.col(f"_key_{c}"))
    joined = run.join(totals, match)
    return joined.select(*frame.columns, *(_KINDS[k][1](F.col(f"_in_{n}"), F.col(f"_before_{n}")).alias(n) for n, (k, _) in values.items()))
