import random
import re
from collections import Counter

from marlgate.llm.quality import COMMON_WORDS, base_features, fit_references, judge, keep_good
from tests.llm.helpers import AWKWARD, clashing, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rows = [*AWKWARD, (20, "a b c d e f a b c d e"), (21, "x y\nx y\n\n \nx y z"), (22, "a a a a a a a"), (23, "#|<a> $%&*"), (24, "1 2 3 4 5 1 2 3 4 5 9 1 2 3 4 5")]
    found = base_features(docs(spark, rows), keep=["doc_id", "text"]).collect()
    for r in found:
        assert tuple(r)[-5:] == expected(r["text"]), r["doc_id"]


def test_verdicts(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = judge(table, ["doc_id"]).collect()
    assert len(rows) == table.count()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    good = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


def test_junk_is_rejected_and_prose_kept(spark):
    prose = "the cat of the house is in the garden and it was with that dog as they are on a wall by the sea " * 1
    texts = [(i, " ".join(f"{prose}{i}w{k}" for k in range(12)), "en", "a") for i in range(8)]
    junk = [(100, " ".join(f"ab{k}### cd{k}$$$ ef{k}%%%" for k in range(60)), "en", "a"), (101, "short", "en", "a")]
    kept = {r["doc_id"]: r["kept"] for r in judge(docs(spark, [*texts, *junk]), ["doc_id"]).collect()}
    assert not kept[100] and not kept[101]


def test_filter_keeps_columns(spark):
    df = clashing(docs(spark, AWKWARD))
    out = keep_good(df)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    assert keep_good(df.limit(0)).count() == 0


def prose(letters, seed, listed=()):
    """120 words that are drawn from a seed, every other one of them a listed one."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(120)]
    return " ".join(rng.choice(listed) if listed and k % 2 else w for k, w in enumerate(words)) + "."


def test_other_scripts_have_their_own_reference(spark):
    english = [(i, prose("abcdefghilmnoprstuvw", i, COMMON_WORDS["en"]), "en", "a") for i in range(60)]
    others = [(100 + i, prose(letters, i), lang, None) for i in range(4) for lang, letters in (("ru", "абвгдеиклмнопрстуя"), ("el", "αβγδεικλμνοπρστυ"))]
    table = docs(spark, [*english, *others])
    made = fit_references(table)  # the language of these texts is made up
    rows = judge(table, ["doc_id"], references=made).collect()
    assert len(rows) == 68 and all(r["kept"] for r in rows)
    assert all(r["class_distance"] < 0.1 and r["word_distance"] is None for r in rows if r["doc_id"] >= 100)
    assert keep_good(table, references=made).count() == 68


def test_junk_does_not_carry_references_off(spark):
    clean = [(i, prose("abcdefghilmnoprstuvw", i, COMMON_WORDS["en"]), "en", "a") for i in range(60)]
    junk = [(100 + i, prose("0123456789#|$%&<>", i), "en", "junk") for i in range(30)]
    table = docs(spark, [*clean, *junk, (200, " ".join(prose("0123456789#|$%&<>", i) for i in range(300, 400)), "en", "log")])
    assert {r["doc_id"] for r in keep_good(table, references=fit_references(table)).collect()} == set(range(60))


def test_verdicts_do_not_depend_on_other_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    of = lambda df: {r["doc_id"]: (r["kept"], r["class_distance"], r["word_distance"]) for r in judge(df, ["doc_id"]).collect()}
    all_, short = of(table), of(table.where("length(text) < 2000"))
    assert short and all(all_[k] == v for k, v in short.items())
