"""Fingerprints, repeated passages, word hashes, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from marlgate.llm.fingerprint import compare_with_edits, edited, fingerprint_documents, fingerprints
from marlgate.llm.queries import op8_fingerprints
from marlgate.llm.repeats import repeated_passages
from marlgate.llm.wordhash import flat, hash_words
from tests.llm.helpers import AWKWARD, clashing, docs


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    rng, errors = random.Random(3), []
    for _ in range(300):
        words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(120)]
        a, b = " ".join(words), " ".join(w if rng.random() < rng.random() else f"x{rng.randint(0, 50)}" for w in words)
        x, y = fingerprints([a, b])
        errors.append((x == y).mean() - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.07


def test_edits_equal_plain_python(spark, data):
    texts = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in op8_fingerprints(spark, data).collect()}
    assert len(got) == len(texts)
    for i, (d, t) in enumerate(texts):
        follower = texts[(i + 1) % len(texts)][1]
        e = edited(t, follower)
        assert got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        if i % 9 == 0:
            x, y, z = fingerprints([t, e, follower])
            assert got[d]["near_edited"] == (x == y).mean() and got[d]["near_next"] == (x == z).mean()
            assert got[d]["fingerprint"] == x.astype(">u2").tobytes().hex()


def test_fingerprints_of_awkward_rows(spark):
    df = clashing(docs(spark, AWKWARD))
    got = compare_with_edits(df).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in got}
    assert set(by_id[1]["fingerprint"]) == {"0"} and by_id[2]["near_next"] == 1 and by_id[1]["n_chars"] == 0
    one = compare_with_edits(docs(spark, [(5, "a b c d e f")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 4}) == 1
    assert compare_with_edits(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprint_documents(df).collect()}[5] == by_id[5]["fingerprint"]


def brute_passages(texts):
    where = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            where[k] = d if where.get(k, d) == d else -1
    out = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - 49):
            if where[tuple(w[i : i + 50])] == -1:
                out[d].update(range(i, i + 50))
    return dict(out)


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["other_id"] != r["doc_id"]
        out[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return dict(out)


def test_passages_equal_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"].split() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    from marlgate.llm.queries import op3_repeats

    assert covered(op3_repeats(spark, data).collect()) == brute_passages(texts)


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passage, short = [word() for _ in range(50)], [word() for _ in range(49)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 80))] + (passage if i % 2 else short) + [word() for _ in range(30)])) for i in range(40)]
    got = repeated_passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {i for i in range(40) if i % 2}
    assert covered(got) == brute_passages({d: t.split() for d, t in rows})


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_passages_of_texts_that_repeat_themselves_over_borders_of_ranges(spark, parts):
    """Runs of one document's equal suffixes are split by many ranges, and a part of a run needs what stands beyond the rest of it."""
    rng = random.Random(parts)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, other = ([word() for _ in range(70)] for _ in range(2))
    rows = [(1, passage * 40 + [word()] + other), (2, [word(), *passage, word()]), (3, other * 9 + passage[:55]), (4, [word() for _ in range(300)]), (5, other[10:68])]
    rows += [(10 + k, [word() for _ in range(5)] + passage[k % 15 : 55 + k % 15] + [word()]) for k in range(20)]
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = covered(repeated_passages(docs(spark, [(d, " ".join(w)) for d, w in rows])).collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == brute_passages(dict(rows))


def test_passages_of_awkward_rows(spark):
    text = " ".join(f"x{k}" for k in range(60))
    df = clashing(docs(spark, [*AWKWARD, (70, text), (71, "y " + text), (72, text + " " + text[:5]), (None, text)]))
    assert {r["doc_id"] for r in repeated_passages(df).collect()} == {70, 71, 72}
    assert repeated_passages(df.limit(0)).count() == 0
    alone = docs(spark, [(80, text + " " + text), (80, text)])
    assert repeated_passages(alone).count() == 0


@pytest.mark.parametrize("block", [7, 10**6])
def test_word_hashes(monkeypatch, block):
    from marlgate.llm import wordhash

    monkeypatch.setattr(wordhash, "BLOCK_BYTES", block)
    texts = ["a bc a", None, "", "  x\ty\n", "é" * 30 + " bc", "a"]
    hashes, rows, starts, ends = hash_words(*flat(pa.array(texts, pa.string())))
    assert rows.tolist() == [0, 0, 0, 3, 3, 4, 4, 5]
    assert hashes[0] == hashes[2] == hashes[7] and hashes[1] == hashes[6] and len(set(hashes.tolist())) == 5
    assert (ends - starts).tolist() == [1, 2, 1, 1, 1, 60, 2, 1]


def test_pipeline_stages(spark, data):
    """Each stage against plain Python on the smallest documents."""
    from marlgate.llm.quality import judge
    from tests.llm.test_neardup import brute

    table = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "BPE encoding and decoding"]
    one = stages["quality rules"](spark, table, data).cache()
    kept = {r["doc_id"] for r in judge(table, ["doc_id"]).where("kept").collect()}
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == table.columns
    two = stages["MinHash near-dedup"](spark, one, data).cache()
    groups = brute([(r["doc_id"], r["text"]) for r in one.orderBy("doc_id").collect()], 5)
    assert {r["doc_id"] for r in two.collect()} == {d for d, (_, c) in groups.items() if d == c} and two.columns == table.columns
    three = stages["secret scans"](spark, two, data).cache()
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (two, three))
    changed = {d for d in before if before[d]["text"] != after[d]["text"]}
    assert changed == {d for d in before if 'token = "' in before[d]["text"]} and three.columns == table.columns
    assert all(after[d]["n_chars"] == len(after[d]["text"]) for d in changed)
    four = stages["mixing sources to target weights"](spark, three, data).cache()
    copies = Counter(r["doc_id"] for r in four.collect())
    assert set(copies) <= set(after) and max(copies.values()) <= 3 and four.columns == table.columns
    five = stages["BPE encoding and decoding"](spark, four, data).collect()
    assert Counter(r["doc_id"] for r in five) == copies


def test_pipeline_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(rows[0].asDict())
