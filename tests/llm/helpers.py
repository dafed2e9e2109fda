"""Tables with every awkward case."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in full], DOCS)


AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "xx", "a"), (4, "one", "en", "b"), (4, "one", "en", "b"), (None, "no id here", "de", None), (5, "wörter und 漢字 \U0001f600 ß", "de", "b"),
    (6, "lang " * 40_000, "en", "c"), (7, "x" * 100_000, None, "c"), (8, "a\x00b\x1cc\u2028d", "fr", "c"),
]


def clashing(df):
    """``df`` with more columns, named like those that operators make up for themselves."""
    from pyspark.sql import functions as F

    names = ["id", "t", "_text", "_words", "_in0", "_in1", "size", "rank", "_part", "n_words", "kept_", "_texts", "_pieces", "_copies", "_id", "shingles", "k"]
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
