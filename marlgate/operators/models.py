"""The slot for a text classifier, and a trainer for it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgate.functions.patterns import first_mention, number_or_guess, text_segments
from marlgate.shipping import map_in_pandas

#: Segments to (probability of a figure mention, guess of its number or None).
Scorer = Callable[[pd.Series], pd.DataFrame]


def segments(texts: DataFrame, longest: int = 100) -> DataFrame:
    """A row for each segment of a text: seg_idx, start_pos, end_pos and segment."""
    found = texts.select("doc_id", "page_index", "text_idx", "text_id", F.posexplode(text_segments(F.col("text"), longest)).alias("seg_idx", "_s"))
    return found.select("doc_id", "page_index", "text_idx", "text_id", "seg_idx", F.col("_s.start_pos").alias("start_pos"), F.col("_s.end_pos").alias("end_pos"), F.col("_s.text").alias("segment"))


#: Words and single signs: what a token is at least, if no tokenizer says otherwise.
TOKEN = re.compile(r"\w+|[^\w\s]")
# Segments that a model is given at once, and the tokens that it reads of each.
BATCH, MOST_TOKENS = 32, 128


def clip(text: str, most: int = MOST_TOKENS) -> str:
    """The text up to its ``most``-th token."""
    ends = [m.end() for m, _ in zip(TOKEN.finditer(text), range(most + 1), strict=False)]
    return text[: ends[most - 1]] if len(ends) > most else text


def rebatched(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``size``, across the borders of the frames that come in; the last may be smaller."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        at = 0
        while n + len(batch) - at >= size:
            held.append(batch.iloc[at : at + size - n])
            at += size - n
            yield pd.concat(held, ignore_index=True) if held[1:] else held[0].reset_index(drop=True)
            held, n = [], 0
        if at < len(batch):
            held.append(batch.iloc[at:])
            n += len(batch) - at
    if held:
        yield pd.concat(held, ignore_index=True)


def score_segments(rows: DataFrame, load: Callable[[], Scorer], size: int = BATCH, most: int = MOST_TOKENS, cut: Callable[[str, int], str] = clip) -> DataFrame:
    """Adds probability and guess.  ``load`` is called once a task, so that a model is read once for all its batches.

    The scorer gets ``size`` segments at a time, but for the last ones of a task, each cut to ``most`` tokens by ``cut``.  Memory for a
    model's batch so does not depend on the sizes in which rows reach Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in rebatched(batches, size):
            found = scorer(batch["segment"].map(lambda s: None if s is None else cut(s, most)))
            yield batch.assign(probability=found["probability"].to_numpy(), guess=found["guess"].to_numpy())

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", probability double, guess double"
    return rows.transform(map_in_pandas, run, schema)


def model_references(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mentions that a model finds: in segments above ``threshold``, where a rule or the model's guess gives a number."""
    likely = scored.where(F.col("probability") > threshold).withColumn("_m", first_mention(F.col("segment")))
    out = likely.withColumn("figure_number", number_or_guess(F.col("segment"), F.col("guess"))).where("figure_number is not null")
    start = F.col("start_pos") + F.col("_m.start_pos")
    return out.select("doc_id", "page_index", "text_id", F.col("seg_idx").cast("bigint").alias("ref_idx"), "figure_number", start.alias("start_pos"), (F.col("start_pos") + F.col("_m.end_pos")).alias("end_pos"), F.col("_m.reference_text").alias("text"), F.col("probability").alias("confidence"))


def train_classifier(training: DataFrame, buckets: int = 1 << 12) -> PipelineModel:
    """A classifier of (text, label) on hashed words."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern="\\W+")
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=buckets)
    return Pipeline(stages=[words, hashed, LogisticRegression(maxIter=20, regParam=0.01)]).fit(training)


def accuracy(predicted: DataFrame) -> DataFrame:
    right: Column = (F.col("prediction") == F.col("label")).cast("double")
    return predicted.agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))
