"""Near-duplicate documents: MinHash signatures, joined by a multi-index search over Hamming distance.

A signature has 64 positions of 16 bits.  It is split into 14 chunks of four or five positions.  Two signatures that differ in
at most 26 positions have, by the pigeonhole principle, a chunk with at most one difference; so for each chunk and each position
in it, a key is made of the chunk without that position.  All pairs under the distance threshold share one of those 64 keys.
A pair with similarity 0.8 exceeds the threshold with a probability below 1e-4, and one of 0.85 below 1e-6.

1. Texts become sets of shingle hashes; equal sets fall into one class (128-bit digest), whose least doc_id stands for it.
2. Each document is compared with one other, the least that shares a key with it: on signatures, then on whole sets.  Links
   found make up connected components.  That brings together nearly all of any large group at one comparison a member.
3. In buckets whose members are in different components even then, members within the signature distance make up clusters, and
   the sets of a cluster's members are compared in blocks of bounded size.  Only links that join components leave a block.
   The work there grows with the square of a cluster's size; what is written does not.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing.  A text shorter than a
shingle is one shingle.  A null doc_id gets the component of its text's class, or null if nothing else is in it; it is kept in
that case.  Rows that repeat a doc_id are each judged by their own text; where an id is the least of several classes of equal
texts, these classes count as linked, and ``drop_near_duplicates`` goes by the id alone.  An empty table gives an empty table; other columns
are not read here, and ``drop_near_duplicates`` hands them on unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgate.llm.components import components
from marlgate.llm.scratch import cut
from marlgate.llm.wordhash import blocks, flat, hash_words, mix, shingle_hashes
from marlgate.shipping import map_in_arrow, ship

POSITIONS, BITS = 64, 16
DISTANCE, CHUNKS = 26, 14
LONGS = POSITIONS * BITS // 64
#: Ids up to this many are sent to all executors (8 bytes each) to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_A = (mix(np.arange(POSITIONS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(POSITIONS, dtype=np.uint64) + np.uint64(999)) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 64 positions as 16 unsigned longs."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=least)
    return (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2").view("<u8")


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = flat(texts)
    for i, j in blocks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        words, rows, _, _ = hash_words(data[offsets[i] : offsets[j]], at, lower=True)
        ends = np.searchsorted(rows, np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(shingle_hashes(words[ends[k] : ends[k + 1]], size))


def sketches(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, n_shingles, d0, d1, s0..s15): set size, digest and signature of every document; nulls for an empty set."""
    names = ["id", "n_shingles", "d0", "d1", *(f"s{k}" for k in range(LONGS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, rows = [], []
            for found in shingle_sets(batch.column(1), size):
                counts.append(len(found))
                if len(found):
                    digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<u8")
                    rows.append(np.concatenate([digest, signature(found)]))
                else:
                    rows.append(np.zeros(2 + LONGS, np.uint64))
            table = np.array(rows, np.uint64).reshape(-1, 2 + LONGS).view(np.int64)
            none = np.array(counts, np.int64) == 0
            columns = [pa.array(table[:, k], mask=none) for k in range(2 + LONGS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), *columns], names)

    return docs.select(key, text).transform(map_in_arrow, run, ", ".join(f"{n} bigint" for n in names))


def _chunks(positions: int = POSITIONS, chunks: int = CHUNKS) -> list[range]:
    cuts = [round(positions * k / chunks) for k in range(chunks + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def index_keys() -> list[Column]:
    """For each chunk and each position left out of it, a hash of the chunk's other positions."""
    assert DISTANCE // CHUNKS == 1, "one error is enumerated"
    out, lanes = [], 64 // BITS
    for chunk in _chunks():
        for left_out in chunk:
            masks: dict[int, int] = {}
            for p in chunk:
                if p != left_out:
                    masks[p // lanes] = masks.get(p // lanes, 0) | 0xFFFF << BITS * (p % lanes)
            signed = {k: m - (1 << 64) if m >> 63 else m for k, m in masks.items()}
            out.append(F.xxhash64(F.lit(left_out), *(F.col(f"s{k}").bitwiseAND(F.lit(m)) for k, m in signed.items())))
    return out


def _differing(a: str, b: str, positions: range) -> Column:
    """In how many of some positions two signatures differ; a and b are the prefixes of their column names."""
    lanes, masks = 64 // BITS, {}
    for p in positions:
        masks[p // lanes] = masks.get(p // lanes, 0) | 1 << BITS * (p % lanes)

    def count(k: int, mask: int) -> Column:
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        for step in (8, 4, 2, 1):  # the lowest bit of each position becomes 1 if any of its bits is
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.bit_count(x.bitwiseAND(F.lit(mask)))

    return reduce(lambda x, y: x + y, (count(k, m) for k, m in masks.items()))


def distance(a: str, b: str) -> Column:
    return _differing(a, b, range(POSITIONS))


#: Members of a bucket, or of each block of it, that are compared in one piece.
BLOCK_MEMBERS = 1024


def _in_block_pairs(rows: DataFrame) -> DataFrame:
    """Deals rows into ``blocks`` by a hash of the id; a row goes to each pair (left, right) of its own block and another."""
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("left", F.least("b", "o")).withColumn("right", F.greatest("b", "o"))


def _near_spans(rows: DataFrame) -> DataFrame:
    """For (k, id, c, blocks, signature): edges (lo, hi) that connect, in each bucket k, what is connected by pairs within the
    distance whose components c differ.  The pairs themselves are looked at in blocks and never become rows; each pair of a large
    bucket's blocks is a piece of its own, which may be in another task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = ["k", "left", "right"]
    shown = _in_block_pairs(rows).select(*piece, "id", "c", *(f"s{x}" for x in range(LONGS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        batches = iter(batches)
        last = False
        while not last:
            batch = next(batches, None)
            last = batch is None
            tables = [x for x in (held, None if last else pa.Table.from_batches([batch])) if x is not None]
            if not tables:
                return
            table = pa.concat_tables(tables).combine_chunks()
            k = np.stack([table.column(x).to_numpy() for x in piece])
            if not k.shape[1]:
                continue
            starts = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
            done = len(table) if last else int(starts[-1])
            if done:
                ids, c = table.column("id").to_numpy(), table.column("c").to_numpy()
                sig = np.stack([table.column(f"s{x}").to_numpy() for x in range(LONGS)], axis=1).view(np.uint16)
                spans = [_bucket_spans(ids[i:j], c[i:j], sig[i:j]) for i, j in zip(starts, [*starts[1:], len(table)], strict=True) if j <= done]
                found = np.concatenate(spans)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["lo", "hi"])
            held = table.slice(done)

    return shown.repartition(parts, *piece).sortWithinPartitions(*piece).transform(map_in_arrow, run, "lo bigint, hi bigint").distinct()


def _bucket_spans(ids: np.ndarray, c: np.ndarray, sig: np.ndarray, block: int = 512) -> np.ndarray:
    """Edges from each member to the least member that it is connected with."""
    n = len(ids)
    label = np.arange(n)
    while True:
        before = label.copy()
        for i in range(0, n, block):
            for j in range(0, n, block):
                far = np.zeros((min(block, n - i), min(block, n - j)), np.uint8)
                for x in range(POSITIONS):
                    far += sig[i : i + block, None, x] != sig[None, j : j + block, x]
                close = (far <= DISTANCE) & (c[i : i + block, None] != c[None, j : j + block])
                reached = np.where(close, label[None, j : j + block], n).min(axis=1)
                np.minimum(label[i : i + block], reached, out=label[i : i + block])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    pairs = np.stack([ids[label[moved]], ids[moved]], axis=1)
    return np.sort(pairs, axis=1)


#: Shingles in a block of a cluster, about.
BLOCK_SHINGLES = 1_000_000


def _links_in_clusters(rows: DataFrame, percent: int) -> DataFrame:
    """For (id, cluster, c, shingles): links (lo, hi) between members of a cluster in different components c.

    A cluster is dealt into blocks by a hash of the id, and each pair of blocks is a group of bounded size of its own.  Groups are
    dealt to tasks by cluster and blocks: rows that lie together by cluster would count as dealt already, and all pairs of a hot
    cluster would land in one task.  Of many links between two components a group returns one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("cluster").agg(F.sum(F.size("shingles")).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    # written, so that the join with a hot cluster has exchanges of its own and can be split
    sizes = cut(sizes.select("cluster", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks")), "sizes")
    dealt = _in_block_pairs(rows.join(sizes, "cluster"))

    def run(table: pa.Table) -> pa.Table:
        ids, c, b = (table.column(x).to_numpy() for x in ("id", "c", "b"))
        lists = table.column("shingles").combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(offsets)
        order = np.argsort(values, kind="stable")
        sorted_values = values[order]
        owner = np.repeat(np.arange(len(ids)), size)[order]
        left, right = int(table.column("left")[0].as_py()), int(table.column("right")[0].as_py())
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        out = []
        for x in np.flatnonzero(b == left):
            own = values[offsets[x] : offsets[x + 1]]
            at, until = np.searchsorted(sorted_values, own, "left"), np.searchsorted(sorted_values, own, "right")
            count = until - at
            spread = np.repeat(at - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
            common = np.bincount(owner[spread], minlength=len(ids))
            alike = (100 * common >= percent * (size[x] + size - common)) & (c != c[x]) & (b == right)
            for y in np.flatnonzero(alike):
                p, q = find(int(c[x])), find(int(c[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append(sorted((int(ids[x]), int(ids[y]))))
        return pa.table({"lo": pa.array([o[0] for o in out], pa.int64()), "hi": pa.array([o[1] for o in out], pa.int64())})

    shown = dealt.select("cluster", "left", "right", "b", "id", "c", "shingles").repartition(parts, "cluster", "left", "right")
    ship(rows.sparkSession)
    return shown.groupBy("cluster", "left", "right").applyInArrow(run, "lo bigint, hi bigint")


def _shingles(docs: DataFrame, ids: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, shingles) of the documents named in ``ids``."""
    picked = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = 0, [], 0
            for found in shingle_sets(batch.column(1), size):
                rows.append(found.view(np.int64))
                held += len(found)
                if held > 500_000:
                    yield _sets(batch.column(0), at, rows)
                    at, rows, held = at + len(rows), [], 0
            if rows:
                yield _sets(batch.column(0), at, rows)

    return picked.join(ids, "id", "left_semi").transform(map_in_arrow, run, "id bigint, shingles array<bigint>")


def _confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of pairs (lo, hi), those within the signature distance whose whole sets are as similar as asked for.

    ``known`` has signature and set of each id.  The signatures are compared first, and only near ones go on to the sets.
    """
    sig = [f"s{k}" for k in range(LONGS)]
    left = known.select(F.col("id").alias("lo"), F.col("shingles").alias("x"), *(F.col(s).alias(f"a{k}") for k, s in enumerate(sig)))
    right = known.select(F.col("id").alias("hi"), F.col("shingles").alias("y"), *(F.col(s).alias(f"b{k}") for k, s in enumerate(sig)))
    joined = pairs.join(left, "lo").join(right, "hi").where(distance("a", "b") <= DISTANCE)
    both = joined.select("lo", "hi", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("lo", "hi").distinct()


def _sets(ids: pa.Array, at: int, rows: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
    return pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), lists], ["id", "shingles"])


def _named(rows: DataFrame, groups: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the component of an id column; an id without links is its own."""
    labels = groups.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    joined = rows.join(labels, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(name, F.coalesce("_component", column)).drop("_node", "_component")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``key``, n_shingles, component_id, kept.

    Links documents whose sets of lower-cased ``size``-word shingles have 100 * intersection >= ``percent`` * union.  The
    signature distance is set for ``percent`` from 80 up.
    """
    if percent < 80:
        raise ValueError("the signature distance guarantees similarities from 80 percent up")
    sketch = cut(sketches(docs, size, key, text), "sketches")
    sig = [f"s{k}" for k in range(LONGS)]
    nodes = sketch.where("n_shingles > 0").groupBy("d0", "d1", *sig).agg(F.min("id").alias("id")).where("id is not null")
    nodes = cut(nodes, "classes")
    keyed = nodes.select("id", F.explode(F.array(*index_keys())).alias("k"))
    buckets = cut(keyed.groupBy("k").agg(F.min("id").alias("lo"), F.count("*").alias("n")).where("n > 1").select("k", "lo"), "buckets")
    members = cut(keyed.join(buckets, "k"), "members")
    ids = cut(members.select("id").distinct(), "ids")
    known = cut(_shingles(docs, ids, size, key, text).join(nodes.select("id", *sig), "id"), "known")
    # each document with the least of all least members: one pair a document brings large groups together
    first = members.groupBy(F.col("id").alias("hi")).agg(F.min("lo").alias("lo")).where("lo < hi")
    links = cut(_confirmed(first, known, percent), "links")
    groups = components(links)
    # then, members of a bucket that are in different components by now
    named = _named(members, groups, "id", "c")
    mixed = named.groupBy("k").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 <> c1")
    mixed = cut(mixed.select("k", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks")), "mixed")
    rest = named.join(mixed, "k").join(nodes.select("id", *sig), "id").select("k", "id", "c", "blocks", *sig)
    near = cut(_near_spans(rest), "near")
    if not near.isEmpty():
        clusters = components(near).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
        apart = _named(clusters, groups, "id", "c").join(known.select("id", "shingles"), "id")
        groups = components(links.union(cut(_links_in_clusters(apart, percent), "links")))
    classes = nodes.select("d0", "d1", "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
    classes = cut(classes.groupBy("d0", "d1").agg(F.min(F.coalesce("component", "id")).alias("component_id")), "components")
    named = sketch.select("id", "n_shingles", "d0", "d1").join(classes, ["d0", "d1"], "left")
    own = F.coalesce("component_id", "id")
    return named.select(F.col("id").alias(key), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, own.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the least id; rows without an id stay."""
    found = near_duplicates(docs, size, percent, key, text).where("not kept").select(F.col(key)).distinct()
    return docs.join(found, key, "left_anti")
