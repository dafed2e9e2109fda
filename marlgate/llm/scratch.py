"""Intermediate tables, and column names out of the way."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marlgate.storage import clear, cut, shared_dir

__all__ = ["clear", "cut", "shared_dir", "shielded"]


def shielded(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named _in0, _in1 ..., which no helper column clashes with, and its own names in that order."""
    return df.toDF(*(f"_in{k}" for k in range(len(df.columns)))), df.columns
