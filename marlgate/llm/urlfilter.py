"""URL filters over a sorted digest array.

The listed strings (host and path rules, and blocked hosts) are kept in a file: their sorted 64-bit xxhash digests, and the
strings in the same order.  Workers map the digests into memory and look up whole batches of candidate strings by binary search.
A digest that is found is confirmed by comparing the stored string, so that a collision decides nothing.

A URL's candidates are its host and parent domains, each with the beginnings of its path in the lengths that occur in the list.
A list of blocked hosts beyond ``MOST_BYTES`` is dealt into shards by a hash, each a sorted digest array of its own that is probed with
the domains that fall to it: the same search, with no part of the list on the driver.

The longest rule that fits gives the verdict.  Without one, a URL is blocked if its host or a parent domain is on the list of
blocked hosts, and allowed otherwise.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed.  Repeated rows and null
ids are judged alike.  An empty list allows everything; a list may be of any size; an empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.shipping import map_in_arrow, ship

#: Bytes of list that are read by the driver and sent to every executor at most, those that an entry takes besides its text, and those
#: of a shard of a longer list, about.
MOST_BYTES, ENTRY_BYTES, SHARD_BYTES = 16 << 20, 29, 16 << 20


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class DigestArray:
    """A list of strings, probed by digest.  ``entries`` maps a string to a small integer."""

    def __init__(self, digests: np.ndarray, starts: np.ndarray, values: np.ndarray, text: np.ndarray):
        self.digests, self.starts, self.values, self.text = digests, starts, values, text

    @staticmethod
    def of(texts: list[bytes], value: int, hasher=digest) -> DigestArray:
        """A list in memory, all of one value."""
        digests = np.fromiter((hasher(t.decode()) for t in texts), np.uint64, len(texts))
        order = np.argsort(digests, kind="stable")
        texts = [texts[i] for i in order]
        starts = np.cumsum([0, *map(len, texts)]).astype(np.uint64)
        return DigestArray(digests[order], starts, np.full(len(texts), value, np.uint64), np.frombuffer(b"".join(texts), np.uint8))

    @staticmethod
    def write(entries: dict[str, int], folder: str, hasher=digest) -> str:
        """Writes the list to one file: a JSON line with the counts, then the arrays."""
        rows = sorted((hasher(k), k.encode(), v) for k, v in entries.items())
        starts = np.cumsum([0, *(len(k) for _, k, _ in rows)]).astype("<u8")
        head = json.dumps([len(rows), int(starts[-1])]).ljust(63) + "\n"
        handle, path = tempfile.mkstemp(".digests", "urls-", folder)
        with os.fdopen(handle, "wb") as f:
            f.write(head.encode())
            f.write(np.array([d for d, _, _ in rows], "<u8").tobytes() + starts.tobytes() + np.array([v for *_, v in rows], "<u8").tobytes())
            f.write(b"".join(k for _, k, _ in rows))
        return path

    @staticmethod
    def open(path: str) -> DigestArray:
        with open(path, "rb") as f:
            n, size = json.loads(f.read(64))
        at = lambda kind, skip, count: np.memmap(path, kind, "r", 64 + skip, (count,)) if count else np.zeros(0, kind)
        return DigestArray(at("<u8", 0, n), at("<u8", 8 * n, n + 1), at("<u8", 16 * n + 8, n), at("u1", 24 * n + 8, size))

    def find(self, texts: list[str], hasher=digest) -> np.ndarray:
        """The value of each text, or -1.  All entries with an equal digest are compared."""
        out = np.full(len(texts), -1, np.int64)
        probes = np.fromiter(map(hasher, texts), np.uint64, len(texts))
        left, right = np.searchsorted(self.digests, probes, "left"), np.searchsorted(self.digests, probes, "right")
        for i in np.flatnonzero(right > left):
            for k in range(left[i], right[i]):
                if self.text[self.starts[k] : self.starts[k + 1]].tobytes() == texts[i].encode():
                    out[i] = self.values[k]
        return out


@lru_cache(maxsize=4)
def _opened(path: str) -> DigestArray:
    return DigestArray.open(path)


#: Values of list entries.
ALLOW, BLOCK, BLOCKED_HOST = 0, 1, 2


def parts(urls: pa.Array) -> tuple[list[str], list[str]]:
    """Host and path of each URL."""
    found = pc.extract_regex(urls.cast(pa.string()).fill_null(""), r"(?s)^(?:.*?)://(?P<host>[^/?#]*)(?P<path>[^?#]*)")
    fill = lambda c: pc.fill_null(pc.struct_field(found, c), "").to_pylist()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return [h.translate(lower) for h in fill("host")], fill("path")


def _domains(host: str, lengths: Iterable[int]) -> Iterator[str]:
    """The host and its parent domains, longest first, of those lengths that the list has."""
    n = len(host)
    for size in lengths:
        if size == n or size < n and host[n - size - 1] == ".":
            yield host[n - size :]


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """A list of hosts from text files, one a line; what follows ``#`` does not count."""
    host = F.lower(F.trim(F.split("value", "#")[0]))
    return spark.read.text(path).select(host.alias("host")).where("host <> ''")


def _by_shards(judged: DataFrame, hosts: DataFrame, size: int) -> DataFrame:
    """Blocks what no rule decides and whose host or parent domain is listed, for lists of any size (``size`` bytes)."""
    spark, names = judged.sparkSession, judged.columns
    shards = max(-(-size // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    labels = F.split("host", "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")
    open_hosts = judged.where("rule is null and host <> ''").select("host").distinct()
    tried = open_hosts.select("host", F.explode(domains).alias("domain")).select(shard("domain"), "host", "domain")
    listed = hosts.select(F.col("host").alias("bad")).distinct().select(shard("bad"), "bad")

    def probe(asked: pa.Table, known: pa.Table) -> pa.Table:
        texts = asked.column("domain").to_pylist()
        found = DigestArray.of([t.encode() for t in known.column("bad").to_pylist()], BLOCKED_HOST).find(texts) >= 0
        return pa.table({"_hit": asked.column("host").combine_chunks().filter(pa.array(found, pa.bool_()))})

    ship(spark)
    hit = tried.groupBy("shard").cogroup(listed.groupBy("shard")).applyInArrow(probe, "_hit string").distinct()
    joined = judged.join(hit, (F.col("host") == F.col("_hit")) & F.col("rule").isNull(), "left")
    return joined.withColumn("verdict", F.when(F.col("_hit").isNotNull(), "block").otherwise(F.col("verdict"))).select(*(F.col(f"`{c}`") for c in names))


def judge_urls(pages: DataFrame, rules: dict[str, str], blocked_hosts: Iterable[str] | DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict.  ``rules`` maps ``host/path`` to ``allow`` or ``block``.

    ``blocked_hosts`` is a list, or a table with the column host.  One that takes more than ``MOST_BYTES`` as a digest array is not
    sent to executors, but dealt into shards.
    """
    spark = pages.sparkSession
    if isinstance(blocked_hosts, DataFrame):
        hosts = blocked_hosts.select("host").where("host <> ''")
        size = hosts.agg(F.coalesce(F.sum(F.octet_length("host") + ENTRY_BYTES), F.lit(0))).first()[0]
        blocked_hosts = [r["host"] for r in hosts.collect()] if size <= MOST_BYTES else None
    else:
        blocked_hosts = list(blocked_hosts)
        size = sum(len(h.encode()) + ENTRY_BYTES for h in blocked_hosts)
        if size > MOST_BYTES:
            hosts, blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string"), None
    if blocked_hosts is None:
        return _by_shards(judge_urls(pages, rules, [], key, url), hosts, int(size))
    entries = {f"host:{h}": BLOCKED_HOST for h in blocked_hosts} | {f"rule:{r}": {"allow": ALLOW, "block": BLOCK}[v] for r, v in rules.items()}
    lengths = sorted({len(r) - r.index("/") for r in rules})
    sizes = sorted({len(h) for h in blocked_hosts} | {r.index("/") for r in rules}, reverse=True)
    folder = tempfile.mkdtemp(prefix="urls-")  # on the driver, which serves the file to executors as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    path = DigestArray.write(entries, folder)
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _opened(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = parts(batch.column(1))
            probes, owner = [], []
            for i, (host, rest) in enumerate(zip(hosts, paths, strict=True)):
                for domain in _domains(host, sizes):
                    probes += [f"rule:{domain}{rest[:n]}" for n in lengths if n <= len(rest)] + [f"host:{domain}"]
                owner += [i] * (len(probes) - len(owner))
            rule: list[str | None] = [None] * len(hosts)
            verdict, blocked = ["allow"] * len(hosts), set()
            values = listed.find(probes)
            for k in np.flatnonzero(values >= 0):
                i, text = owner[k], probes[k][5:]
                if values[k] == BLOCKED_HOST:
                    blocked.add(i)
                elif rule[i] is None or len(text) > len(rule[i]):
                    rule[i], verdict[i] = text, "block" if values[k] == BLOCK else "allow"
            for i in blocked:
                if rule[i] is None:
                    verdict[i] = "block"
            columns = [pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "host", "path", "rule", "verdict"])

    return pages.select(key, url).transform(map_in_arrow, run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
