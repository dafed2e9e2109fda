"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histogram of character classes, and that of the common words of its language, are compared with the reference of
its language by the Jensen-Shannon distance (base 2, 0 to 1).  References of four languages come with the module (``REFERENCES``, or
a caller's), so the verdict of such a document does not depend on others.  Any other language is compared with the documents of the
table in that language, by character classes only: with the median of each share over those that pass the base rules, so that neither
long documents nor junk in less than half of them carries it off.  Two guards hold the comparison back where a histogram says little:
under ``MIN_CHARS`` code points or ``MIN_WORDS`` words a document is judged by the base rules alone.  The language is taken as given.

Edge cases: a null or empty text has no words and fails the base rules.  A null language has no reference: the base rules judge.
Repeated rows and repeated ids are each judged by themselves; a null id stays null.  An empty table gives an empty table.  The
filter hands on all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgate.llm.scratch import cut, shielded

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MIN_CHARS = 80, 500
#: So many other languages' references (a few numbers each) are sent to all tasks; more are joined.
MOST_SENT = 10_000
#: Distances beyond these reject.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.24, 0.36
#: Steps in which shares are counted for medians.
STEPS = 4096
# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with by at be this or an from not have they".split(),
    "fr": "de la le et les des en un une du que qui est dans pour par au sur il elle ne pas plus se ce".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er sie".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
# Reference shares of character classes (in the order of CLASSES, then the rest) and of common words (in the order of
# COMMON_WORDS, then all other words): means over the documents of the synthetic corpus at scale 0.1 that are labelled good, pass the
# base rules, are long enough to be compared, and whose crc32(doc_id) is even: 961 (en), 223 (fr), 240 (de) and 136 (es).
REFERENCES = {
    "en": (
        [0.79431, 0.01421, 0.00075, 0.16665, 0.02404, 0.0, 0.00002, 0.00002],
        [0.06374, 0.03704, 0.02656, 0.02016, 0.01445, 0.01584, 0.01169, 0.01031, 0.00976, 0.0085, 0.008, 0.00746, 0.00491, 0.00617, 0.00678, 0.00582, 0.00454, 0.00546, 0.00549, 0.00258, 0.00392, 0.00414, 0.0, 0.0, 0.0, 0.71668],
    ),
    "fr": (
        [0.70728, 0.01069, 0.00191, 0.16621, 0.02425, 0.0, 0.00009, 0.08957],
        [0.06223, 0.03753, 0.02611, 0.0208, 0.01688, 0.01408, 0.01292, 0.01096, 0.00797, 0.0093, 0.00777, 0.00569, 0.00736, 0.00614, 0.00745, 0.0051, 0.00521, 0.005, 0.0, 0.00226, 0.0, 0.00485, 0.0, 0.0, 0.0, 0.72439],
    ),
    "de": (
        [0.77233, 0.01254, 0.00065, 0.1545, 0.02194, 0.0, 0.00003, 0.03802],
        [0.06283, 0.03694, 0.0262, 0.02068, 0.01623, 0.01357, 0.01102, 0.0106, 0.00862, 0.0083, 0.00797, 0.00759, 0.00696, 0.00577, 0.00593, 0.00554, 0.00538, 0.00494, 0.00508, 0.00417, 0.00013, 0.0, 0.00001, 0.0038, 0.0, 0.72174],
    ),
    "es": (
        [0.72202, 0.01302, 0.00095, 0.16175, 0.0243, 0.0, 0.00002, 0.07795],
        [0.06173, 0.03619, 0.02648, 0.01982, 0.01656, 0.01329, 0.00011, 0.01185, 0.00969, 0.00911, 0.00984, 0.0084, 0.00755, 0.00759, 0.00574, 0.0051, 0.00516, 0.00498, 0.00517, 0.00482, 0.0041, 0.0, 0.0, 0.0, 0.0, 0.72674],
    ),
}
# Character classes, as patterns that Java and RE2 read alike; what is in none of them is the last class.
CLASSES = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "space": "[\\x20\\x09-\\x0D]+",
    "stop": "[.,;:!?'\"()-]+",
    "bar": "[|]+",
    "sign": "[#*$%&<>@=+/_~^`{}\\[\\]\\\\]+",
}


def base_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, then _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    keep = docs.columns if keep is None else keep
    kept = [F.col(f"`{c}`") for c in keep]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.select(*kept, t.alias("_text"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"))
    starts = F.greatest(F.size("_words") - 4, F.lit(0))
    windows = F.arrays_zip(*(F.slice("_words", k + 1, starts).alias(f"w{k}") for k in range(5)))
    two = one.select(*kept, "_text", "_words", "_lines", F.transform(windows, lambda x: F.xxhash64(x)).alias("_windows"))
    # most texts repeat no window and need no more; in the others windows are sorted by their hash, with their positions
    order = F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    three = two.select(*kept, "_text", "_words", "_lines", F.when(repeats, F.sort_array(order)).alias("_sorted"))
    same = F.filter("_sorted", lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get("_sorted", k + 1)["h"]).eqNullSafe(True))
    four = three.select(*kept, "_text", "_words", "_lines", F.sort_array(F.transform(same, lambda x: x["i"])).alias("_at"))
    gaps = F.transform("_at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_at", k + 1) - p, F.lit(5))))
    return four.select(
        *kept,
        "_text",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def _by_language(lang: Column, values: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(lang == name, value).otherwise(out)
    return out


def histograms(frame: DataFrame, lang: str) -> DataFrame:
    """Adds _classes (counts by character class) and _common (counts of the language's common words); drops _text."""
    others = [c for c in frame.columns if c != "_text"]
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    words = F.filter(F.split(F.lower("_text"), "[^\\p{L}]+", -1), lambda x: x.isin(listed))
    one = frame.withColumns({"_length": F.length("_text"), "_found": words})
    # classes have no character in common, so each is looked for in what those before it left, which soon is little
    for k, p in enumerate(CLASSES.values()):
        one = one.withColumn("_left", F.regexp_replace("_text" if k == 0 else "_left", p, "")).withColumn(f"_left{k}", F.length("_left"))
    sizes = [F.col("_length"), *(F.col(f"_left{k}") for k in range(len(CLASSES)))]
    counts = [a - b for a, b in zip(sizes, sizes[1:])]
    one = one.select(*(F.col(f"`{c}`") for c in others), "_length", F.array(*counts).alias("_known"), "_found")
    lists = _by_language(F.col(f"`{lang}`"), {k: F.array(*map(F.lit, v)) for k, v in COMMON_WORDS.items()}, F.array().cast("array<string>"))
    found = F.transform(lists, lambda w: F.size("_found") - F.size(F.array_remove("_found", w)))
    rest = F.col("_length") - F.aggregate("_known", F.lit(0), lambda a, x: a + x)
    return one.select(*(F.col(f"`{c}`") for c in others), F.concat("_known", F.array(rest)).alias("_classes"), found.alias("_common"))


def _distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance between ``counts`` / ``total`` and an array of shares of the same length."""
    shares = F.transform(counts, lambda x: x / total)

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    parts = F.zip_with(shares, reference, lambda p, q: half(p, q) + half(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2))


def _total(counts: Column | str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def medians(features: DataFrame, lang: Column) -> DataFrame:
    """_g, _class_shares and _word_shares: medians of each entry's shares over a language's documents that pass the base rules.

    Only documents long enough to be compared count.  Shares are counted in steps of 1 / ``STEPS``: at most so many rows for each
    language and entry, whatever the input.
    """
    size = len(CLASSES) + 1

    def steps(counts: str, enough: Column) -> Column:
        return F.transform(counts, lambda x: F.when(enough, F.round(STEPS * x / _total(counts)).cast("int")))

    parts = F.concat(steps("_classes", _total("_classes") >= MIN_CHARS), steps("_common", F.col("n_words") >= MIN_WORDS))
    pairs = features.where(~_failed() & lang.isNotNull()).select(lang.alias("_g"), F.posexplode(parts).alias("i", "v")).where("v is not null")
    counts = pairs.groupBy("_g", "i", "v").agg(F.count("*").alias("n"))
    entry = Window.partitionBy("_g", "i")
    below = counts.withColumn("below", F.sum("n").over(entry.orderBy("v"))).withColumn("all", F.sum("n").over(entry))
    values = below.where(2 * F.col("below") >= F.col("all")).groupBy("_g", "i").agg(F.min("v").cast("bigint").alias("v"))
    rows = values.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_entries"))

    def part(of_class: bool) -> Column:
        chosen = F.transform(F.filter("_entries", lambda x: (x["i"] < size) == of_class), lambda x: x["v"])
        return F.transform(chosen, lambda v: v / F.greatest(F.lit(1), _total(chosen)))

    return rows.select("_g", part(True).alias("_class_shares"), part(False).alias("_word_shares"))


def _features(own: DataFrame, text: str, lang: str, held: list[str]) -> DataFrame:
    """The written counts of each document: base features, character classes, and common words with all others last."""
    features = histograms(base_features(own, text, held), lang)
    rest = F.col("n_words") - F.least("n_words", _total("_common"))
    return cut(features.withColumn("_common", F.concat("_common", F.array(rest.cast("int")))), "features")


def fit_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """References for the languages of ``COMMON_WORDS`` from documents of one's own: medians, as for other languages."""
    own = docs.where(F.col(f"`{lang}`").isin(*COMMON_WORDS)).select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("g"))
    rows = medians(_features(own, "t", "g", ["g"]), F.col("g")).collect()  # a row for each listed language
    return {r["_g"]: (r["_class_shares"], r["_word_shares"]) for r in rows if r["_class_shares"] and r["_word_shares"]}


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", references: dict[str, tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """``keep`` columns, the base features, base_failed, class_distance, word_distance and kept.

    ``references`` has shares of classes and of common words for languages of ``COMMON_WORDS`` (default: ``REFERENCES``).  Texts are
    read once; what is written in between are counts.
    """
    references = REFERENCES if references is None else references
    keep = docs.columns if keep is None else keep
    own, names = shielded(docs)
    inner = {c: f"_in{names.index(c)}" for c in [*keep, lang, text]}
    held = list(dict.fromkeys(inner[c] for c in [*keep, lang]))
    features = _features(own, inner[text], inner[lang], held)
    of = F.col(inner[lang])
    listed = F.coalesce(of.isin(*references), F.lit(False))
    # a row for each other language: sent to all tasks where these are few, else joined, as there may be any number of them
    others = cut(medians(features.where(~listed), of).drop("_word_shares"), "medians")
    few = others.limit(MOST_SENT + 1).count() <= MOST_SENT
    features = features.join(F.broadcast(others) if few else others, of == F.col("_g"), "left")
    shares = lambda k: _by_language(of, {name: F.array(*map(F.lit, r[k])) for name, r in references.items()}, F.lit(None).cast("array<double>"))
    classes, words = F.when(listed, shares(0)).otherwise(F.col("_class_shares")), shares(1)
    chars = _total("_classes")
    by_class = F.when((chars >= MIN_CHARS) & classes.isNotNull(), _distance(F.col("_classes"), chars, classes))
    by_word = F.when((F.col("n_words") >= MIN_WORDS) & words.isNotNull(), _distance(F.col("_common"), _total("_common"), words))
    out = features.select(*(F.col(inner[c]) for c in keep), *BASE, by_class.alias("class_distance"), by_word.alias("word_distance"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    out = out.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & ~far)
    return out.toDF(*keep, *out.columns[len(keep) :])


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", references: dict[str, tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    own, _ = shielded(judge(docs, text=text, lang=lang, references=references))  # the document's columns come first, the verdict last
    return own.where(F.col(own.columns[-1])).select(*own.columns[: len(docs.columns)]).toDF(*docs.columns)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
