"""From raw documents to tokens: each stage reads what the one before it wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.  All but the last return the columns of ``documents``, and hand on others, whatever their names.
An empty table goes through all stages; repeated rows are judged each by itself, and near-dedup leaves those that share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlgate.llm.bpe import encode_documents
from marlgate.llm.mixing import mix_documents
from marlgate.llm.neardup import drop_near_duplicates
from marlgate.llm.quality import keep_good
from marlgate.llm.queries import tokenizer_path
from marlgate.llm.scratch import cut
from marlgate.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence rules reject go, null and empty texts among them."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    The least doc_id stays; rows without an id, and with empty texts, all stay.
    """
    return drop_near_duplicates(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows the text where it changed.  Null and empty texts stay as they are."""
    return redact_secrets(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: empty texts have no words, so it takes none of them."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and decoded text, a row for each copy in the mix."""
    return encode_documents(docs, tokenizer_path(), digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The near-dedup, secret scan and encoding stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, with a table written after each but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
