"""Text patterns: figure mentions with offsets, captions, chapter and section headings, segments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode case folding and classes, and only a line feed ends a line: how the patterns are meant.
FLAGS = "(?iuUd)"
_NUM = r"(\d+(?:\.\d+)?)"
# The eight rules for figure mentions, in order.
REFERENCE_RULES = [
    rf"(?:as\s+shown\s+in\s+)?Fig(?:ure)?\.?\s*{_NUM}",
    rf"(?:see\s+)?Figure\s*{_NUM}",
    rf"(?:in\s+)?fig(?:ure)?\.?\s*{_NUM}",
    rf"\(Fig(?:ure)?\.?\s*{_NUM}\)",
    rf"Figures?\s*{_NUM}\s*(?:and|,|through|to|-)\s*{_NUM}",
    rf"그림\s*{_NUM}",
    rf"도표\s*{_NUM}",
    rf"\[그림\s*{_NUM}\]",
]
TWO_NUMBERS = {5}
_TITLE = r"(?:\s*[:\.]?\s*(.*))?"
# Captions, at the start of a text.
CAPTIONS = [rf"Fig(?:ure)?\.?\s*(\d+){_TITLE}", rf"Figure\s*(\d+){_TITLE}", rf"그림\s*(\d+){_TITLE}", rf"图\s*(\d+){_TITLE}"]
#: What a caption can start with: the first letters of the patterns.
CAPTION_LETTERS = ["F", "f", "그", "图"]
# A figure number anywhere in the text below a figure.
LOOSE_CAPTIONS = [r"Fig(?:ure)?\.?\s*(\d+)", r"그림\s*(\d+)", r"Figure\s*(\d+)"]
# Chapter headings with their language, and section headings, at the start of a text.
CHAPTERS = [(rf"Chapter\s+(\d+){_TITLE}", "en"), (rf"제\s*(\d+)\s*장{_TITLE}", "ko"), (rf"第\s*(\d+)\s*章{_TITLE}", "zh")]
SECTIONS = [r"(\d+)\.(\d+)(?:\.(\d+))?\s*(.*)", r"Section\s+(\d+)(?:\.(\d+))?\s*(.*)", r"§\s*(\d+)(?:\.(\d+))?\s*(.*)"]
# Chapter numbers anywhere in a heading, for pages without structure.
FALLBACK_CHAPTERS = [r"Chapter\s+(\d+)", r"제\s*(\d+)\s*장", r"Section\s+(\d+(?:\.\d+)*)", r"(\d+(?:\.\d+)*)\s+\w+"]

_FULL_WIDTH = "０１２３４５６７８９"


def to_int(text: Column, kind: str = "bigint") -> Column:
    """A number, full-width digits included; null if it is none or too large."""
    return F.translate(text, _FULL_WIDTH, "0123456789").try_cast(kind)


def figure_number(group: Column) -> Column:
    """The whole part of a captured number."""
    return to_int(F.split(group, "\\.")[0])


def strip(text: Column) -> Column:
    """Without white space at either end; a text that begins and ends with visible ASCII is not searched for it."""
    visible = lambda c: F.ascii(c).between(33, 126)
    bare = visible(text) & visible(F.substring(text, -1, 1))
    return F.when(bare, text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def _group(text: Column, pattern: str, k: int) -> Column:
    """Group ``k`` of a match at the start; null for no match or an empty group."""
    return F.nullif(F.regexp_extract(text, f"^{FLAGS}(?:{pattern})", k), F.lit(""))


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"^{FLAGS}(?:{pattern})")


def _groups(text: Column, patterns: list[str]) -> Column:
    """Array of the pattern's number and its groups 1 to 4, for the first pattern that matches at the start; null for none.

    Extracting each group once keeps the generated code small.
    """
    found = []
    for k, pattern in enumerate(patterns):
        n = re.compile(pattern).groups
        found.append(F.when(_matches(text, pattern), F.array(F.lit(str(k)), *(_group(text, pattern, g) if g <= n else F.lit(None).cast("string") for g in range(1, 5)))))
    return F.coalesce(*found)


def _let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), build(v))), F.lit(0))


def match_chapter(text: Column) -> Column:
    """Struct of chapter, title and language for a heading like ``Chapter 3: Title``; null for other texts."""
    languages = F.array(*(F.lit(language) for _, language in CHAPTERS))
    return _let(
        _groups(text, [p for p, _ in CHAPTERS]),
        lambda g: F.struct(to_int(g[1], "int").alias("chapter"), strip(g[2]).alias("title"), F.get(languages, g[0].cast("int")).alias("language")),
    )


def match_section(text: Column) -> Column:
    """Struct of section, subsection and title; for ``Section 3.1 Name`` the name is the subsection too."""
    return _let(
        _groups(text, SECTIONS),
        lambda g: F.struct(
            F.when(g[2].isNotNull(), F.concat(g[1], F.lit("."), g[2])).otherwise(g[1]).alias("section"),
            g[3].alias("subsection"),
            strip(F.when(g[0] == "0", g[4]).otherwise(g[3])).alias("title"),
        ),
    )


def may_be_heading(text: Column) -> Column:
    """A cheap test that every stripped text with a chapter or section pattern passes."""
    return text.rlike(f"^{FLAGS}(?:chapter|section|[제第§\\d])")


def match_caption(text: Column) -> Column:
    """Struct of number and title for a text that starts like a caption; null for other texts."""
    may = F.substring(text, 1, 1).isin(CAPTION_LETTERS)
    return _let(F.when(may, _groups(text, CAPTIONS)), lambda g: F.struct(to_int(g[1], "int").alias("number"), strip(g[2]).alias("title")))


def loose_caption_number(text: Column) -> Column:
    """The first figure number anywhere in a text."""
    return F.coalesce(*(to_int(F.nullif(F.regexp_extract(text, FLAGS + p, 1), F.lit("")), "int") for p in LOOSE_CAPTIONS))


def fallback_chapter(text: Column) -> Column:
    """Struct of chapter and section from ``a.b.c`` or ``a``, by the first pattern found anywhere."""
    number = F.coalesce(*(F.nullif(F.regexp_extract(text, FLAGS + p, 1), F.lit("")) for p in FALLBACK_CHAPTERS))
    parts = F.split(number, "\\.")
    rest = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "."))
    return F.when(number.isNotNull(), F.struct(to_int(parts[0], "int").alias("chapter"), rest.alias("section")))


def running_sums(values: Column) -> Column:
    """The sums of the first 1, 2, 3 ... of an array of whole numbers.

    Each pass adds the sum that ends a power of two earlier, so an array of n takes as many passes as n has binary digits.
    """

    def build(v: Column) -> Column:
        steps = F.slice(F.array(*(F.lit(1 << k) for k in range(31))), F.lit(1), F.ceil(F.log2(F.size(v))).cast("int"))
        sums = F.aggregate(steps, v, lambda sums, s: F.transform(sums, lambda x, i: F.when(i < s, x).otherwise(x + F.get(sums, i - s))))
        return F.when(F.size(v) > 1, sums).otherwise(v)

    return _let(values, build)


def split_at(text: Column, pattern: str) -> Column:
    """Array of (piece, mark, end): the text up to a match, the match (null after the last one), and where that ends, in code points.

    There is no built-in that finds matches with positions: they follow from a running sum of the lengths.  The text is searched
    twice, however many matches it has.
    """

    def build(v: Column) -> Column:
        sizes = F.zip_with(v["pieces"], v["marks"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
        return F.arrays_zip(v["pieces"].alias("piece"), v["marks"].alias("mark"), running_sums(sizes).alias("end"))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("marks"))
    return _let(F.when(text.isNotNull(), both), build)


_MENTION = "rule int, text string, start_pos int, end_pos int, part int, figure_number bigint"


def find_mentions(text: Column, rule: int) -> Column:
    """Array of (rule, text, start_pos, end_pos, part, figure_number) for one rule, 1 to 8; positions in code points from 0."""
    pattern = FLAGS + REFERENCE_RULES[rule - 1]

    def rows(matches: Column, part: int) -> Column:
        return F.transform(
            matches,
            lambda z: F.struct(
                F.lit(rule).alias("rule"),
                z["mark"].alias("text"),
                (z["end"] - F.length(z["mark"])).alias("start_pos"),
                z["end"].alias("end_pos"),
                F.lit(part).alias("part"),
                # a match holds all that its groups depend on
                figure_number(F.regexp_extract(z["mark"], pattern, part)).alias("figure_number"),
            ),
        )

    found = F.filter(split_at(text, pattern), lambda z: z["mark"].isNotNull())
    found = _let(found, lambda v: F.concat(rows(v, 1), rows(v, 2))) if rule in TWO_NUMBERS else rows(found, 1)
    none = F.array().cast(f"array<struct<{_MENTION.replace(' ', ':').replace(',:', ',')}>>")
    return F.when(text.rlike(pattern), found).when(text.isNotNull(), none)


def may_mention(text: Column) -> Column:
    """A cheap test that every text with a mention passes."""
    return text.rlike("(?iu)fig|그림|도표")


def all_mentions(text: Column, rules: list[int] | None = None) -> Column:
    """The mentions that any rule finds.  Rules overlap, and nothing is removed."""
    found = [find_mentions(text, r) for r in rules or range(1, len(REFERENCE_RULES) + 1)]
    return F.when(may_mention(text), F.flatten(F.array(*found)))


#: Around matches in marked texts; and up to how many characters a text is marked.
_OPEN, _CLOSE, _SHORT = "\u0001", "\u0002", 2000


def marked_mentions(text: Column, rules: list[int] | None = None) -> Column:
    """Array of (rule, marked, found) for the rules that find something: a step before ``mention_pieces``.

    In a short text matches are put between marks, and positions follow from what stands before them, without a function that is
    called for each element.  A long text would be copied for each of its mentions: ``found`` has its (piece, start) at once.
    """
    short = (F.length(text) <= _SHORT) & (F.instr(text, _OPEN) == 0) & (F.instr(text, _CLOSE) == 0)
    head = F.array(F.struct(F.lit("").alias("piece"), F.lit(0).alias("start")))
    hits = []
    for r in rules or range(1, len(REFERENCE_RULES) + 1):
        pattern = FLAGS + REFERENCE_RULES[r - 1]
        ones = F.filter(find_mentions(text, r), lambda z: z["part"] == 1)
        long = F.concat(head, F.transform(ones, lambda z: F.struct(z["text"].alias("piece"), z["start_pos"].alias("start"))))
        hit = F.struct(F.lit(r).alias("rule"), F.when(short, F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}")).alias("marked"), F.when(~short, long).alias("found"))
        hits.append(F.when(text.rlike(pattern), hit))
    return F.when(may_mention(text), F.array_compact(F.array(*hits)))


def mention_pieces(hit: Column) -> Column:
    """Array of (piece, start) of one of ``marked_mentions``: the first stands before all matches, the others begin with one."""
    pieces = F.split(hit["marked"], _OPEN)
    return F.coalesce(hit["found"], F.arrays_zip(pieces.alias("piece"), F.array().cast("array<int>").alias("start")))


def mention_start(hit: Column, piece: Column, k: Column) -> Column:
    """Where the ``k``-th mention begins, in code points from 0."""
    return F.coalesce(piece["start"], F.length(F.call_function("substring_index", hit["marked"], F.lit(_OPEN), k)) - 2 * (k - 1))


def mention_text(piece: Column) -> Column:
    return F.substring_index(piece["piece"], _CLOSE, 1)


def mention_parts(rule: Column) -> Column:
    """The numbers that a rule's mentions have, from 1."""
    return F.when(rule.isin(*TWO_NUMBERS), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))


def mention_number(mention: Column, part: Column) -> Column:
    """The number of a part: all digits of a mention are in its numbers."""
    return figure_number(F.get(F.regexp_extract_all(mention, F.lit(FLAGS + _NUM), F.lit(1)), part - 1))


def context(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    first = F.greatest(F.lit(0), start - window)
    return F.substring(text, first + 1, F.least(F.length(text), end + window) - first)


def first_mention(text: Column) -> Column:
    """Struct of reference_text, start_pos and end_pos by the first rule that finds one, else the whole stripped text."""
    found = F.lit(None)
    for rule in range(len(REFERENCE_RULES), 0, -1):
        mentions = find_mentions(text, rule)
        one = F.get(mentions, F.lit(0))
        found = F.when(F.size(mentions) > 0, F.struct(one["text"].alias("reference_text"), one["start_pos"].alias("start_pos"), one["end_pos"].alias("end_pos"))).otherwise(found)
    return F.coalesce(found, F.struct(strip(text).alias("reference_text"), F.lit(0).alias("start_pos"), F.length(text).alias("end_pos")))


def mention_with_surroundings(text: Column, window: int = 10) -> Column:
    """The first mention with some characters on either side, stripped; the whole stripped text if there is none."""
    found = first_mention(text)
    return strip(context(text, found["start_pos"], found["end_pos"], window))


def number_or_guess(text: Column, guess: Column) -> Column:
    """The first number that a rule finds in the text, else a model's guess rounded half to even, if positive."""
    rules = [figure_number(F.nullif(F.regexp_extract(text, FLAGS + p, 1), F.lit(""))) for p in REFERENCE_RULES]
    return F.coalesce(*rules, F.when(guess > 0, F.bround(guess).cast("bigint")))


def text_segments(text: Column, longest: int = 100) -> Column:
    """Array of (start_pos, end_pos, text): sentences, and windows over those that are longer than ``longest``."""

    def windows(z: Column) -> Column:
        piece, n = z["piece"], F.length(z["piece"])
        start = z["end"] - F.coalesce(F.length(z["mark"]), F.lit(0)) - n
        at = F.when(n > longest, F.sequence(F.lit(0), n - 1, F.lit(longest // 2))).otherwise(F.array(F.lit(0)))
        return F.transform(at, lambda i: F.struct((start + i).alias("start_pos"), (start + F.least(i + longest, n)).alias("end_pos"), F.substring(piece, i + 1, F.lit(longest)).alias("text")))

    full = F.filter(split_at(text, "(?U)[.!?]\\s+"), lambda z: z["piece"].rlike("(?U)\\S"))
    return F.flatten(F.transform(full, windows))
