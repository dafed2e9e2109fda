"""Document fingerprints by consistent weighted sampling.

A text is a set of terms (its words) weighted by how often they occur.  For each of 64 samples and each term, gamma and uniform
variables are drawn from the term's hash; the term with the least sampled value, together with its quantised weight, is the
sample.  Two texts agree in a sample with a probability equal to their generalised Jaccard similarity, the sum of the smaller
weights over the sum of the larger.  The fingerprint is 16 bits of a hash of each sample, in hexadecimal.

Neighbours in the order of ids are found without a global sort in one task: ids are cut into ranges, and the first document of a
range is also sent, as a copy, to the range before it.  So texts are shuffled once.

Edge cases: a null or empty text is empty and has the fingerprint of all zeros; two texts without words have likeness 1, and such
a text and another 0.  Null ids come last; rows with equal ids follow in the order of their texts.  A single document is its own
neighbour.  An empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgate.llm.wordhash import flat, hash_words, mix
from marlgate.shipping import map_in_arrow

SAMPLES = 64
#: Bytes of text whose terms are sampled together, and terms whose variables are drawn together.
CHUNK_BYTES, CHUNK_TERMS = 1_500_000, 4_096
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x51_7C_C1_B7_27_22_0A_95))
_U32 = np.float32(2.0**-32)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _variables(keyed: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each term and sample (the hash of both): r, ln c and b, where r and c are Gamma(2, 1) and b uniform."""
    one = mix(keyed)
    two = one * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15)
    two ^= two >> np.uint64(29)
    three = mix(two)
    high = lambda x: ((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * _U32
    low = lambda x: ((x & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * _U32
    r = -np.log(high(one) * low(one))
    log_c = np.log(-np.log(high(three) * low(three)))
    b = np.minimum(((two >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24), np.float32(1 - 2.0**-24))
    return r, log_c, b


def _packed(value: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Value and 16 bits of code in one integer, in the order of the values; code 0 is kept for texts without terms."""
    bits = value.view(np.uint32)
    ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
    return ordered << np.uint64(16) | np.maximum(coded >> np.uint64(48), np.uint64(1))


def sample_sets(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints (n x SAMPLES of 16 bits) of n weighted sets, given as entries sorted by row."""
    best = np.full((n, SAMPLES), _NONE)
    distinct, which = np.unique(terms, return_inverse=True)
    order = np.argsort(which, kind="stable")
    sorted_which = which[order]
    at = 0
    while at < len(order):
        # the entries of the next CHUNK_TERMS terms, but of a few times as many entries at most
        until = min(int(np.searchsorted(sorted_which, sorted_which[at] + CHUNK_TERMS)), at + 4 * CHUNK_TERMS)
        part = np.sort(order[at:until])
        base = sorted_which[at]
        keyed = distinct[base : sorted_which[until - 1] + 1, None] ^ _SEEDS
        r, log_c, b = _variables(keyed)
        # most terms occur once in a text: then the quantised weight is 0, and the sample depends on the term alone
        single = _packed(log_c - r * (1 - b), mix(keyed))
        own = which[part] - base
        values = single[own]
        more = np.flatnonzero(weights[part] > 1)
        if len(more):
            k = own[more]
            t = np.floor(np.log(weights[part[more]].astype(np.float32))[:, None] / r[k] + b[k])
            values[more] = _packed(log_c[k] - r[k] * (t - b[k] + 1), mix(keyed[k] + mix(t.astype(np.int64).view(np.uint64)) * (t != 0)))
        doc = rows[part]
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        reached = doc[heads]
        best[reached] = np.minimum(best[reached], np.minimum.reduceat(values, heads, axis=0))
        at = until
    return np.where(best == _NONE, np.uint64(0), best & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprints(texts: list[str]) -> np.ndarray:
    """The samples of each text; zeros for one without words."""
    data, offsets = flat(pa.array(texts, pa.large_string()))
    words, rows, _, _ = hash_words(data, offsets)
    order = np.lexsort((words, rows))
    words, rows = words[order], rows[order]
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    return sample_sets(rows[at], words[at], np.diff(np.append(at, len(words))), len(texts))


def as_text(samples: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in samples.astype(">u2")]


def likeness(a: str, b: str) -> float:
    """The share of samples in which two fingerprints agree."""
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and fingerprint of every row: a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(as_text(fingerprints(texts)), pa.string())], [key, "fingerprint"])
                at += len(texts)

    return docs.select(key, text).transform(map_in_arrow, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    texts, size = [], 0
    for x in column:
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def edited(text: str, follower: str) -> str:
    """``text`` with its last third replaced by the beginning of ``follower``."""
    k = len(text) // 3
    return text[: len(text) - k] + follower[:k]


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _described(held: list[tuple], follower: str) -> list[list]:
    """Columns for consecutive documents (key, text); the last is followed by ``follower``."""
    texts = [t for _, t in held]
    nexts = [*texts[1:], follower]
    changed = [edited(t, f) for t, f in zip(texts, nexts, strict=True)]
    samples = fingerprints([*texts, follower, *changed])
    n = len(texts)
    own, after, other = samples[:n], samples[1 : n + 1], samples[n + 1 :]
    return [
        [k for k, _ in held],
        [len(t) for t in texts],
        [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        as_text(own),
        as_text(other),
        (own == other).mean(axis=1).tolist(),
        (own == after).mean(axis=1).tolist(),
    ]


def _literal(values: list, kind: str) -> Column:
    """A constant array: one expression, however long the list is."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(key: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted bounds are above the key; one more than there are for null.

    Looked up in two steps, the first over evenly spaced ones of the bounds.
    """
    step = max(1, int(len(bounds) ** 0.5))
    top_down = bounds[::-1]
    above = lambda x: x > key
    coarse = F.size(F.filter(_literal(top_down[::step], kind), above))
    begin = F.greatest(coarse - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.slice(_literal(top_down, kind), begin + 1, F.lit(step)), above))
    return F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(begin + fine)


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited text that ends like the next document begins, and their likenesses.

    The next document is the one with the next lower ``key``; after the last comes the first.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    # ranges of ids of about equal size: as many bounds as there are partitions, in one small aggregation
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = docs.select(F.col(f"`{key}`").alias("k")).agg(F.percentile_approx("k", steps, 100 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    at = _range_of(F.col("k"), bounds, kind)
    heads = docs.select(F.col(f"`{key}`").alias("k")).withColumn("part", at).groupBy("part").agg(F.max("k").alias("head")).collect()  # a row a range
    found = sorted((r["part"], r["head"]) for r in heads)
    first: list = [None] * (len(bounds) + 2)
    before: list = [None] * (len(bounds) + 2)
    for i, (p, h) in enumerate(found):
        first[p], before[p] = h, found[i - 1][0]  # the range before; of the first, the last
    placed = own.withColumn("part", at)
    own_place = F.struct(F.col("part"), F.lit(False).alias("copy"))
    sent = F.array(own_place, F.struct(F.get(_literal(before, "int"), F.col("part")).alias("part"), F.lit(True).alias("copy")))
    is_head = F.get(_literal(first, kind), F.col("part")).eqNullSafe(F.col("k"))
    placed = placed.select("k", "t", F.explode(F.when(is_head, sent).otherwise(F.array(own_place))).alias("to")).select("k", "t", "to.part", "to.copy")
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    dealt = dealt.sortWithinPartitions("part", "copy", F.col("k").desc_nulls_last(), F.sha2("t", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple], follower: str) -> pa.RecordBatch:
            columns = _described(held, follower)
            kinds = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, *NAMES])

        held, size, part, key_type, skip = [], 0, None, None, False
        for batch in batches:
            key_type = batch.column(0).type
            for k, t, p, copy in zip(*(batch.column(i) for i in range(4)), strict=True):
                k, t, p, copy = k.as_py(), t.as_py(), p.as_py(), copy.as_py()
                if p != part:
                    part, skip = p, False
                if copy:
                    # the first copy is the first document of the next range; others have the same id
                    if held and not skip:
                        yield out(held, t)
                        held, size = [], 0
                    skip = True
                    continue
                if held and size >= CHUNK_BYTES:
                    yield out(held, t)
                    held, size = [], 0
                held.append((k, t))
                size += len(t)

    schema = f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("k", "t", "part", "copy").transform(map_in_arrow, run, schema)
