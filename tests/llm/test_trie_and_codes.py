"""The conversation trie and vector codes against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlgate.llm.prefixsums import running
from marlgate.llm.prefixtrie import conversation_trie
from marlgate.llm.vectorcodes import NearestEntry, assign, compress, decode_vectors, digest

TURNS = "conv_id bigint, turn bigint, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def told(turn):
    return hashlib.md5(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()


def brute_trie(rows):
    """A row for each node, by its sequence of turns."""
    own = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            own[c].append((k is not None, k or 0, told(turn), turn))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, kids = defaultdict(set), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        own_saving = (len(who) - 1) * (len(node[-1][1]) if node else 0)
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += own_saving
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def check_trie(spark, rows):
    found = conversation_trie(spark.createDataFrame(rows, TURNS).withColumns({n: F.lit(7) for n in ("place", "digest", "_part", "h1", "length", "rank")}))
    got = found.collect()
    assert sorted(repr(tuple(r[c] for c in NODE)) for r in got) == brute_trie(rows)
    assert sorted(r["place"] for r in got) == list(range(1, len(got) + 1))
    return {(r["conv_id"], r["depth"]): r for r in got}


def test_trie_of_few_words(spark):
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["u", "a", None]), rng.choice(["", "x", "yy", "\U0001f600z", None])) for c in range(120) for k in range(rng.randint(1, 4))]
    at = check_trie(spark, rows)
    assert at[0, 0]["end"] == len(at)


def test_trie_edge_cases(spark):
    rows = [
        (None, 0, "u", "lost"), (150, None, "u", "null turn first"), (150, 0, "u", "x"), (150, 0, "u", "x"), (150, 0, "a", "tie"), (151, 0, None, None), (152, 0, "u", ""),
        (7, 3, "u", "late"), (7, -1, "u", "early"), (100, 0, "u", "s" * 20_000), (101, 0, "u", "s" * 20_000), *((500 + c, 0, "a:", "b") for c in range(4)), (600, 0, "a", ":b"),
    ]
    check_trie(spark, rows)
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie(empty).collect() == []


def test_trie_of_one_deep_and_many_equal_conversations(spark):
    rows = [(3, k, "u", f"turn {k % 7}") for k in range(900)]
    rows += [(1000 + c, k, "u", f"turn {k % 7}") for c in range(100) for k in range(c % 9 + 5)]
    rows += [(2000 + c, 0, "u", "the same") for c in range(300)]
    check_trie(spark, rows)


def test_running_values_of_one_large_group(spark):
    frame = spark.range(5000).select(F.when(F.col("id") % 3 == 2, 1).otherwise(0).alias("g"), F.col("id").alias("k"))
    got = running(frame, ["g"], ["k"], {"n": ("sum", F.lit(1).cast("bigint")), "x": ("xor", F.col("k"))}, "t").orderBy("g", "k").collect()
    seen = defaultdict(lambda: (0, 0))
    for r in got:
        n, x = seen[r["g"]]
        seen[r["g"]] = (n + 1, x ^ r["k"])
        assert (r["n"], r["x"]) == seen[r["g"]]


# Vector codes


def brute_codes(rows):
    kept = [(i, v, label) for i, v, label in rows if v and None not in v and all(map(math.isfinite, v)) and max(map(abs, v)) < 1 << 18 and len(v) % 16 == 0]
    ints = sorted(((i is None, i or 0, [math.floor(256 * x) for x in v]), i, label) for i, v, label in kept)
    size = len(ints[0][0][2])
    ints = [(v[2], i, label) for v, i, label in ints if len(v[2]) == size]
    w = size // 16
    books = [[v[p * w : (p + 1) * w] for v, *_ in ints[:64]] for p in range(16)]

    def nearest(v):
        out = []
        for p in range(16):
            x = v[p * w : (p + 1) * w]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])))
        return out

    for _ in range(2):
        sums = defaultdict(list)
        for v, *_ in ints:
            for p, (_, e) in enumerate(nearest(v)):
                sums[p, e].append(v[p * w : (p + 1) * w])
        for (p, e), xs in sums.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    coded = [(i, bytes(e for _, e in n).hex(), sum(d for d, _ in n), label) for v, i, label in ints for n in [nearest(v)]]
    total = defaultdict(int)
    for _, _, e, label in coded:
        total[label] += e
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(repr((i, c, e, total[label])) for i, c, e, label in coded), hashlib.sha256(flat.encode()).hexdigest()


def vectors(n, width, seed=1, grain=None):
    rng = random.Random(seed)
    draw = (lambda: rng.randint(-2, 2) / 256) if grain else (lambda: rng.gauss(0, 0.2))
    return [(k * 3, [draw() for _ in range(width)], rng.choice([None, 0, 1])) for k in range(n)]


@pytest.mark.parametrize(("n", "width", "grain"), [(300, 64, None), (200, 32, True), (40, 16, None), (150, 16, True), (90, 80, None)])
def test_codes_equal_brute_force(spark, n, width, grain):
    rows = vectors(n, width, n, grain)
    rows += [(1, None, 0), (2, [], 0), (4, [None] * width, 1), (5, [float("nan")] * width, 1), (7, [float("inf")] + [0.0] * (width - 1), 1), (None, [0.5] * width, None), (8, [0.1] * 7, 0), (9, [0.1] * 2 * width, 0), (10, [1e30] + [0.0] * (width - 1), 0)]
    rows += rows[:2]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "code", "error", "_kept0", "part", "n")})
    found, books = compress(frame.repartition(5))
    codes, told_books = brute_codes(rows)
    assert sorted(repr((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in found.collect()) == codes
    assert digest(books) == told_books
    back = decode_vectors(found, books).first()
    assert len(back["v"]) == width


def test_no_vectors(spark):
    found, books = compress(spark.createDataFrame([(1, None, 0)], "vec_id bigint, embedding array<float>, label int"))
    assert found.columns == ["vec_id", "label", "code", "error", "label_error"] and found.collect() == [] and books is None


@pytest.mark.parametrize("width", [2, 3, 4, 7, 16])
def test_bounds_lose_no_nearest_entry_and_spare_most_distances(width):
    rng = np.random.default_rng(width)
    for scale in (3, 60, 1 << 20):
        entries, x = rng.integers(-scale, scale + 1, (64, width)), rng.integers(-scale, scale + 1, (500, width))
        entries[10] = entries[40]
        find = NearestEntry(entries)
        best, least = find(x)
        exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (best == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
        assert find.checked < 0.6 * exact.size


def test_assign_takes_the_lower_of_equal_entries():
    codes, errors = assign(np.array([[5] * 16, [0] * 16]), np.zeros((16, 3, 1), np.int64))
    assert not codes.any() and errors.tolist() == [[25] * 16, [0] * 16]
