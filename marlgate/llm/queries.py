"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.storage import own_dir

#: The id that ends each document in the token files.
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and decoded text, of every document."""
    from marlgate.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the divergence rules for every document."""
    from marlgate.llm.quality import BASE, judge

    found = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", *BASE, "base_failed", "kept")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice of every document."""
    from marlgate.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that two documents share."""
    from marlgate.llm.repeats import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, scored."""
    from marlgate.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix to the weights 5, 2, 1 takes of every document."""
    from marlgate.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# The rules that the query states, and hosts of advertising and gambling in the synthetic pages.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_HOSTS = [f"{name}.example.{end}" for name in BLOCKED_NAMES for end in ("com", "net", "org")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    from marlgate.llm.urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network trained on those that are not held out."""
    from marlgate.llm.langid import fit, predict_languages

    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit(docs))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted-sampling fingerprints of every document and its edited text."""
    from marlgate.llm.fingerprint import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates over four-word shingles, similarity 0.8 or more."""
    from marlgate.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    from marlgate.llm.prefixtrie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations")).drop("place", "end")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector, with their errors, and a digest of the codebooks."""
    from marlgate.llm.vectorcodes import compress, digest

    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold: where each document starts, how many ids it has, and their checksum."""
    from marlgate.llm.tokenfile import encode_library, in_order, read_tokens, write_tokens

    path = f"{own_dir(spark)}/{uuid.uuid4().hex}/tokens"
    write_tokens(encode_library(in_order(table(spark, sf_dir, "documents")), tokenizer_path(), end_id=END_ID), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_licenses": op2_licenses,
        "op3_repeats": op3_repeats,
        "op4_secrets": op4_secrets,
        "op5_mixing": op5_mixing,
        "op6_urls": op6_urls,
        "op7_language": op7_language,
        "op8_fingerprints": op8_fingerprints,
        "op9_minhash": op9_minhash,
        "op10_bpe": op10_bpe,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_vector_codes": op12_vector_codes,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    from marlgate.llm import oracles

    return {
        "op1_quality": oracles.quality(),
        "op5_mixing": oracles.mixing(),
        "op6_urls": oracles.urls(URL_RULES, BLOCKED_HOSTS),
        "op11_prefix_trie": oracles.prefix_trie(),
        "op12_vector_codes": oracles.vector_codes(),
    }
