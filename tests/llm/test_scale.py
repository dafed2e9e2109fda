"""Hot groups, long lists, many languages, and the pipeline's stages on awkward rows."""

import random
import string

from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from marlgate.llm import langid, neardup, secrets, urlfilter
from marlgate.llm.queries import BLOCKED_HOSTS, URL_RULES
from tests.llm.helpers import clashing


def test_block_pairs_of_a_hot_cluster_are_dealt_over_tasks(spark):
    rows = spark.range(40).select("id", F.floor(F.col("id") / 100).alias("cluster"), F.col("id").alias("c"), F.sequence(F.col("id"), F.col("id") + 99).alias("shingles"))
    found = neardup._links_in_clusters(rows, 80)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert any(all(c in x for c in ("cluster", "left", "right")) for x in exchanges)
    # sets of 100 that overlap in 89 or more are alike: ids up to 11 apart
    nodes = {frozenset((r["lo"], r["hi"])) for r in found.collect()}
    assert nodes and all(max(n) - min(n) <= 11 for n in nodes)


def test_lists_of_a_million_hosts(spark, data, monkeypatch):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    judged = lambda hosts: sorted(map(tuple, urlfilter.judge_urls(pages, URL_RULES, hosts).collect()))
    small = judged(BLOCKED_HOSTS)
    assert any(r[4] == "block" for r in small)
    assert judged([*(f"h{i}.spam.example" for i in range(1_000_000)), *BLOCKED_HOSTS]) == small
    monkeypatch.setattr(urlfilter, "MOST_BYTES", 100)  # now the list is joined
    assert judged(BLOCKED_HOSTS) == small
    assert judged(spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")) == small


def test_every_language_is_learned(spark):
    rows = [(i, (chr(97 + i % 70 % 26) * 3 + " " + chr(97 + i % 70 // 26 * 3) * 5) * 9, f"l{i % 70}") for i in range(70 * 9)]
    assert len(langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).languages) == 70


def test_secrets_of_kinds_and_look_alikes(spark):
    rng = random.Random(5)
    letters, digits, upper = string.ascii_letters, string.digits, string.ascii_uppercase
    draw = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    mixed, hexa = letters + digits, "0123456789abcdef"
    kinds = [
        lambda: f"the key AKIA{draw(upper + digits, 16)} was used", lambda: f"see ghp_{draw(mixed, 36)} here", lambda: f"bot xoxb-{draw(digits, 12)}-{draw(digits, 12)}-{draw(mixed, 24)}",
        lambda: f'password = "{draw(mixed, 12)}"', lambda: f"postgres://app:{draw(mixed, 14)}@db.internal:5432/x", lambda: f'client_secret = "{draw(letters, 32)}"', lambda: f"token = {draw(hexa, 40)}", lambda: f"rk_live_{draw(mixed, 24)}",
    ]
    others = [
        lambda: f"commit {draw(hexa, 40)}", lambda: f"sha256: {draw(hexa, 64)}", lambda: "password: please choose one", lambda: "token = get_token()", lambda: "the secret: nothing is known about it",
        lambda: f"data:image/png;base64,{draw(mixed + '+/', 200)}",
    ]
    rows = [(k, f"some words before\n{make()}\nand after.") for k, make in enumerate([*kinds, *others]) for _ in range(20)]
    out = secrets.redact_secrets(spark.createDataFrame(rows, "k int, text string"), path=None).withColumn("hit", F.col("text").contains(secrets.MASK).cast("int"))
    hits = {r["k"]: r["n"] for r in out.groupBy("k").agg(F.sum("hit").alias("n")).collect()}
    assert sum(hits[k] for k in range(len(kinds))) >= 0.9 * 20 * len(kinds)
    assert sum(hits[k] for k in range(len(kinds), len(hits))) <= 0.05 * 20 * len(others)


def test_stages_on_awkward_and_empty_tables(spark, data):
    text = "password = Xk29fj3kd93kfK " + " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "en", "s", len(text)), (None, None, None, None, None), (1, "", "de", "s", 0), (2, text + " more", "en", None, 5)]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("_before", F.lit("x")))
    for name, stage in STAGES[:4]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, data)
            assert out.columns == docs.columns, name
            assert table is docs or out.count() == 0
    masked = STAGES[2][1](spark, docs, data).where("doc_id = 1 and text <> ''").first()
    assert secrets.MASK in masked["text"] and masked["n_chars"] == len(masked["text"])
