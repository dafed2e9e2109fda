import math
from collections import Counter, defaultdict

import pyarrow as pa

from marlgate.llm.mixing import MOST_COPIES, mix, mix_documents
from marlgate.llm.queries import op5_mixing
from marlgate.llm.urlfilter import DigestArray, judge_urls, parts
from tests.llm.helpers import AWKWARD, clashing, docs


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def test_targets_and_taken(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows, again = op5_mixing(spark, data).collect(), op5_mixing(spark, data).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == table.count()
    source = {r["doc_id"]: r["source"] for r in table.collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r["taken"] <= MOST_COPIES * r["size"]
    want = targets(sizes)
    for r in rows:
        assert math.isclose(r["target"], want[source[r["doc_id"]]], rel_tol=1e-12, abs_tol=1e-9)
        assert r["source_size"] == sizes[source[r["doc_id"]]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_order_by_size_keeps_large_sources_near_their_target(spark):
    rows = [(i, "w " * (1 + i * i % 97), "en", f"s{i % 2 * (i % 5)}") for i in range(3000)]
    got = mix(docs(spark, rows)).collect()
    source, sums = {r[0]: r[3] for r in rows}, defaultdict(lambda: [0, 0.0])
    for r in got:
        sums[source[r["doc_id"]]][0] += r["taken"]
        sums[source[r["doc_id"]]][1] = r["target"]
    assert all(abs(a - b) <= 100 for a, b in sums.values())


def test_awkward_mix(spark):
    df = clashing(docs(spark, AWKWARD))
    got = mix(df).collect()
    assert len(got) == len(AWKWARD) and {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    out = mix_documents(df)
    assert out.columns == df.columns and out.count() >= 1
    assert mix(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0
    nothing = mix(docs(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [r["taken"] for r in nothing] == [0, 0] and [r["target"] for r in nothing] == [0.0, 0.0]


URLS = [
    ("http://a.example.org/es/1", "block", "example.org/es/"), ("https://EXAMPLE.org/en/12?x", "block", "example.org/en/1"), ("https://x.org/fr", "allow", "org/"), ("http://b.com/fr/", "allow", "com/fr/"),
    ("http://www.free-bets.example.com/fr/1", "allow", "com/fr/"), ("http://www.free-bets.example.com/en/1", "block", None), ("http://notexample.org", "allow", None), ("http://com/de/", "block", "com/de/"),
    ("nothing", "allow", None), (None, "allow", None), ("", "allow", None), ("http://x.com:80/de/", "allow", None), ("a://b://c.com/de/x#y", "allow", None), ("http://example.org#/es/", "allow", None), ("x://y.org/\n/z", "allow", "org/"),
]


def test_urls(spark):
    from marlgate.llm.queries import BLOCKED_HOSTS, URL_RULES

    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)], "page_id bigint, url string")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in judge_urls(df, URL_RULES, BLOCKED_HOSTS).collect()}
    assert got == {i: (v, r) for i, (_, v, r) in enumerate(URLS)}
    assert judge_urls(df.limit(0), URL_RULES, BLOCKED_HOSTS).count() == 0
    assert {r["verdict"] for r in judge_urls(df, {}, []).collect()} == {"allow"}


def test_parts():
    hosts, paths = parts(pa.array(["HTTP://A.b/C/d?e#f", "x", None, "://", "q://?a", "s://h#/p"]))
    assert hosts == ["a.b", "", "", "", "", "h"] and paths == ["/C/d", "", "", "", "", ""]


def test_collisions_are_confirmed(tmp_path):
    same = lambda text: 7  # noqa: E731  every digest collides
    path = DigestArray.write({"a": 1, "b": 2}, str(tmp_path), same)
    assert DigestArray.open(path).find(["b", "c", "a"], same).tolist() == [2, -1, 1]
    assert DigestArray.open(DigestArray.write({}, str(tmp_path))).find(["a"]).tolist() == [-1]


def test_list_over_the_bound_is_dealt_into_shards(spark, monkeypatch):
    from marlgate.llm import urlfilter

    monkeypatch.setattr(urlfilter, "MOST_BYTES", 3)
    pages = spark.createDataFrame([(1, "http://a.bad.org/x"), (2, "http://good.org/"), (None, None)], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in judge_urls(pages, {"long.org/": "block"}, ["bad.org"]).collect()} == {1: "block", 2: "allow", None: "allow"}


def test_shards_judge_like_one_list(spark, monkeypatch, tmp_path):
    """A list from a file, and awkward pages: very long, null and repeated ones, other columns."""
    from marlgate.llm import urlfilter
    from tests.llm.helpers import clashing

    listed = [f"bad{k}.example.{end}" for k in range(300) for end in ("org", "net")]
    (tmp_path / "list.txt").write_text("# blocked\n" + "\n".join(h.upper() if k % 7 == 0 else f" {h} # why" for k, h in enumerate(listed)) + "\n\n")
    hosts = urlfilter.read_hosts(spark, str(tmp_path / "list.txt"))
    urls = [f"https://{'www.' * (k % 4)}{'bad' if k % 3 else 'good'}{k}.example.{'org' if k % 2 else 'net'}/p?{k}" for k in range(600)]
    urls += ["http://" + "a." * 5000 + "bad1.example.org/", "http://bad1.example.org/" + "x/" * 20_000, None, None, "http://bad1.example.org/allowed/", "https://notbad1.example.org/"]
    pages = clashing(spark.createDataFrame([(None if k % 100 == 7 else k, u) for k, u in enumerate(urls)] * 2, "page_id bigint, url string"))
    rules = {"example.org/allowed": "allow"}
    one = sorted(map(repr, judge_urls(pages, rules, hosts).collect()))
    monkeypatch.setattr(urlfilter, "MOST_BYTES", 100)
    monkeypatch.setattr(urlfilter, "SHARD_BYTES", 2000)
    assert sorted(map(repr, judge_urls(pages, rules, hosts).collect())) == one
    assert sum("'block'" in r for r in one) > 300 and len(one) == 2 * len(urls)
