import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlgate.llm.components import components
from marlgate.llm.neardup import DISTANCE, _bucket_spans, drop_near_duplicates, near_duplicates, signature
from marlgate.llm.queries import op9_minhash
from tests.llm.helpers import AWKWARD, clashing, docs

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, size, percent=80):
    """{row number: (set size, component)} by comparing all texts that share a shingle."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def made(n=60, seed=5):
    rng, rows = random.Random(seed), []
    base = [f"w{rng.randint(0, 400)}" for _ in range(220)]
    for i in range(n):
        words = list(base) if i % 3 else [f"v{rng.randint(0, 90)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else "\n".join(words)))
    return rows + [(n + i, t) for i, (_, t) in enumerate(rows[:10])]


@pytest.mark.parametrize("size", [4, 5])
def test_groups_equal_brute_force(spark, size):
    rows = made()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), size).collect()}
    assert got == brute(rows, size)


def test_blocks_of_a_bucket_and_a_cluster_lose_no_link(spark, monkeypatch):
    from marlgate.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 600)
    rng, rows = random.Random(6), []
    base = [f"w{k}" for k in range(300)]
    for i in range(40):  # between them there are links, near misses, and chains
        words = list(base)
        for p in rng.sample(range(300), rng.randint(2, 16)):
            words[p] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), 4).collect()}
    assert got == brute(rows, 4) and len({c for _, c in got.values()}) > 1


def test_query_equals_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = op9_minhash(spark, data).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_awkward_rows(spark):
    df = clashing(docs(spark, AWKWARD))
    got = near_duplicates(df, 4).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and by_id[1]["component_id"] == 1
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    out = drop_near_duplicates(df, 4)
    assert out.columns == df.columns and out.count() == len(AWKWARD)
    assert near_duplicates(df.limit(0), 4).count() == 0


def test_similar_sets_stay_within_the_signature_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        common, own = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
        a, b = np.unique(np.concatenate([common, own[:50]])), np.unique(np.concatenate([common, own[50:]]))  # similarity 0.8
        assert int((signature(a).view("<u2") != signature(b).view("<u2")).sum()) <= DISTANCE


def test_bucket_spans_connect_what_is_near():
    sig = np.arange(5 * 64, dtype=np.uint16).reshape(5, 64)
    sig[1, 5:] = sig[0, 5:]
    sig[4, :50] = sig[1, :50]
    ids, c = np.array([50, 10, 20, 30, 40]), np.array([1, 2, 3, 4, 5])
    assert sorted(map(tuple, _bucket_spans(ids, c, sig, block=2).tolist())) == [(10, 50), (40, 50)]
    assert len(_bucket_spans(ids, np.ones(5, int), sig)) == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (7, 7), (4, 1), (20, 19), (19, 18), (18, 17), (17, 16)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "lo bigint, hi bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 16: 16, 17: 16, 18: 16, 19: 16, 20: 16}
    assert components(spark.createDataFrame([], "lo bigint, hi bigint")).count() == 0
