"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept at minimiser positions only: of each 31 consecutive runs of 20 words, the start of the one with the least hash.
So every passage of 50 words has a kept suffix in it, at the same place in each copy.

1. Kept suffixes whose first 20 words start no suffix of another document are dropped.
2. The others get their context, the hashes of the 30 words before and after those 20, and are sorted twice: by what follows
   and by what precedes.  Ranges of the order are dealt to tasks, so one frequent passage is spread over many.
3. Each suffix is compared with its neighbours from other documents, and the match extended left and right by the contexts.
   Matches of 50 words and more are kept; suffixes at the ends of a range are compared in a last small step.
4. A document's matches that overlap or touch are joined.
5. The longest match to the right (left) of a suffix is with a neighbour in the first (second) order.  A match that is neither can
   still have 50 words in all.  So windows of 50 words around a kept suffix that are in no passage of some document yet are
   compared, by a hash of their words, among all suffixes that begin alike.  These are few, at the ends of passages; with them,
   the result is all words of all repeated windows.

Words are compared by 64-bit hashes within the first 20 and 32-bit hashes in the context.

Edge cases: a null text, or one under 50 words, has no passages.  Rows with a null id cannot be named and are left out.  Rows with
the same id are one document: what they share among themselves does not count.  An empty table gives an empty table.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlgate.llm.scratch import cut
from marlgate.llm.wordhash import blocks, flat, hash_words, mix, shingle_hashes
from marlgate.shipping import map_in_arrow

LEAST, SEED = 50, 20
CONTEXT = LEAST - SEED
#: Ids up to this many are sent to all executors (8 bytes each) to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions kept in a text, and the hash of the ``SEED`` words from each; the leftmost of equal hashes counts."""
    if len(words) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = shingle_hashes(words, SEED)
    windows = np.lib.stride_tricks.sliding_window_view(grams, CONTEXT + 1)
    kept = [np.unique(windows[i : i + 8192].argmin(axis=1) + np.arange(i, min(i + 8192, len(windows)))) for i in range(0, len(windows), 8192)]
    at = np.unique(np.concatenate(kept))
    return at, grams[at]


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    data, offsets = flat(column)
    for i, j in blocks(offsets):
        words, rows, _, _ = hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ends = np.searchsorted(rows, np.arange(j - i + 1))
        for k in range(j - i):
            yield words[ends[k] : ends[k + 1]]


def _suffixes(docs: DataFrame) -> DataFrame:
    """(id, pos, h) of all kept suffixes of (id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found, size = [], 0
            for i, words in zip(ids, _texts(batch.column(1)), strict=True):
                at, h = minimisers(words)
                if len(at):
                    found.append((np.full(len(at), i), at, h))
                    size += len(at)
                if size > 100_000:
                    yield _rows(found)
                    found, size = [], 0
            if found:
                yield _rows(found)

    return docs.transform(map_in_arrow, run, "id bigint, pos bigint, h bigint")


def _rows(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(h.view(np.int64))], ["id", "pos", "h"])


def _contexts(picked: DataFrame) -> DataFrame:
    """(h, id, pos, before, after) for (id, t, places): contexts as bytes, the words before from the nearest on."""
    names = ["h", "id", "pos", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for i, words, places in zip(batch.column(0), _texts(batch.column(1)), batch.column(2), strict=True):
                wanted = set(places.as_py())
                at, h = minimisers(words)
                short = (words >> np.uint64(32)).astype("<u4")
                for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                    if p in wanted:
                        values = (x, i.as_py(), p, short[max(0, p - CONTEXT) : p][::-1].tobytes(), short[p + SEED : p + LEAST].tobytes())
                        for column, v in zip(rows, values, strict=True):
                            column.append(v)
                if len(rows[0]) > 20_000:
                    yield _context_batch(rows, names)
                    rows = [[] for _ in names]
            if rows[0]:
                yield _context_batch(rows, names)

    return picked.transform(map_in_arrow, run, "h bigint, id bigint, pos bigint, before binary, after binary")


def _context_batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as a matrix of 32-bit hashes, padded, and the number of words of each."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), CONTEXT), np.uint32)
    for i, r in enumerate(rows):
        out[i, : len(r) // 4] = np.frombuffer(r, "<u4")
    return out, np.array([len(r) // 4 for r in rows], np.int64)


def _equal(m: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many leading words of contexts i and j are the same."""
    words, n = m
    same = words[i] == words[j]
    run = np.where(same.all(axis=1), CONTEXT, same.argmin(axis=1))
    return np.minimum(run, np.minimum(n[i], n[j]))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares sorted suffixes (h, id, pos, before, after) with the nearest ones of other documents on both sides.

    Yields matches (kind 0: id, from, to, other) and reaches (kind 2).  A run is what stands together of one document under one hash;
    the neighbours of the first and the last run of a range are in part in other ranges, so these are yielded too (kind 1, ``first`` the
    range, ``last`` 1 for the first run, 2 for the last, 3 for both), with the rows that other ranges need (kind 3, ``last`` 0 to 3: the
    first row, the first of the second run, the last of the last run but one, the last row).
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    waiting: list[pa.Table] = []
    skip, first, last = 0, True, False  # rows that are there as neighbours only
    batches = iter(batches)
    tail = None
    while not last:
        batch = next(batches, None)
        last = batch is None
        if not last:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            keys = [batch.column(c).to_numpy() for c in (0, 1)]
            goes_on = tail is not None and all((k == t).all() for k, t in zip(keys, tail, strict=True))
            tail = [k[-1] for k in keys]
            if goes_on:  # nothing can be compared before the run ends
                continue
        table = pa.concat_tables(waiting).combine_chunks() if waiting else None
        if table is None or not len(table):
            continue
        h, ids, pos = (table.column(c).to_numpy() for c in ("h", "id", "pos"))
        n = len(h)
        start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])]))
        run = np.searchsorted(start, np.arange(n), "right") - 1
        left, right = start[run] - 1, np.append(start[1:], n)[run]
        done = n if last else int(start[-1])  # the last run may go on in the next batch
        before, after = (_matrix(table.column(c).combine_chunks()) for c in ("before", "after"))
        rows: list[np.ndarray] = []
        far = np.zeros((2, n), np.int64)
        for other in (left, right):
            i = np.arange(skip, done)
            j = other[i]
            ok = (j >= 0) & (j < n)
            i, j = i[ok], j[ok]
            ok = h[i] == h[j]
            i, j = i[ok], j[ok]
            if len(i):
                back, on = _equal(before, i, j), _equal(after, i, j)
                far[0, i], far[1, i] = np.maximum(far[0, i], back), np.maximum(far[1, i], on)
                long = back + SEED + on >= LEAST
                i, j, back, on = i[long], j[long], back[long], on[long]
                rows.append(np.stack([ids[i], pos[i] - back, pos[i] + SEED + on, ids[j]]))
        if rows:
            yield _matches(np.concatenate(rows, axis=1))
        if done > skip and (some := skip + np.flatnonzero(far[:, skip:done].any(axis=0))).size:
            yield _reaches(h[some], ids[some], pos[some], far[:, some])
        edge = np.zeros(n, np.int64)
        if first and done:
            edge[run == 0] += 1
            yield _edges(table.slice(0, 1), 3, part, [0])
            if len(start) > 1:
                yield _edges(table.slice(int(start[1]), 1), 3, part, [1])
        if last:
            edge[run == run[-1]] += 2
            if start[-1] > 0:
                yield _edges(table.slice(int(start[-1]) - 1, 1), 3, part, [2])
            yield _edges(table.slice(n - 1, 1), 3, part, [3])
        if not first:
            edge[:skip] = 0
        if edge.any():
            yield _edges(table.filter(pa.array(edge > 0)), 1, part, edge[edge > 0])
        first = first and not done
        keep = max(0, done - 1) if done > 0 else 0
        skip = min(1, done) if done else skip
        waiting = [table.slice(keep)]


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of kind 3, four a range at most, the row of another run before each range (last = 1) and after it (last = 2)."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.concat_tables(tables).combine_chunks()
    part, slot, h, ids = (table.column(c).to_numpy() for c in ("first", "last", "h", "id"))
    at: dict[int, dict[int, int]] = {}
    for i in range(len(table)):
        at.setdefault(int(part[i]), {})[int(slot[i])] = i
    same = lambda i, j: h[i] == h[j] and ids[i] == ids[j]
    for side, order, edge, near, beyond in ((1, sorted(at), 0, 3, 2), (2, sorted(at, reverse=True), 3, 0, 1)):
        closest = other = None  # the row next to the border, and the next one of another run
        for p in order:
            own = at[p]
            found = closest if closest is None or not same(closest, own[edge]) else other
            if found is not None and h[found] == h[own[edge]]:
                yield _edges(table.slice(found, 1), 3, p, [side])
            if beyond in own:
                closest, other = own[near], own[beyond]
            else:
                closest, other = own[near], other if closest is not None and same(closest, own[near]) else closest


def _at_border(table: pa.Table) -> pa.Table:
    """Compares the edge runs of a range (kind 1) with the rows beyond its borders (kind 3)."""
    table = table.combine_chunks()
    kind, slot, h, ids, pos = (table.column(c).to_numpy() for c in ("kind", "last", "h", "id", "pos"))
    before, after = (_matrix(table.column(c).combine_chunks()) for c in ("before", "after"))
    out = []
    for side in (1, 2):
        for j in np.flatnonzero((kind == 3) & (slot == side)):
            i = np.flatnonzero((kind == 1) & ((slot & side) > 0) & (h == h[j]))
            back, on = (_equal(m, i, np.full(len(i), j)) for m in (before, after))
            if len(some := np.flatnonzero((back > 0) | (on > 0))):
                out.append(_reaches(h[i[some]], ids[i[some]], pos[i[some]], np.stack([back[some], on[some]])))
            long = back + SEED + on >= LEAST
            i, back, on = i[long], back[long], on[long]
            if len(i):
                out.append(_matches(np.stack([ids[i], pos[i] - back, pos[i] + SEED + on, np.full(len(i), ids[j])])))
    kinds = pa.schema([pa.field(c, t) for c, t in zip(_OUT, [pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.binary()], strict=True)])
    return pa.Table.from_batches([b.cast(kinds) for b in out], kinds)


def _reaches(h: np.ndarray, ids: np.ndarray, pos: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    """Kind 2: how many words before (first) and after (last) a suffix are the same at a neighbour, not always at the same one."""
    none = pa.nulls(len(h), pa.binary())
    columns = [pa.array(np.full(len(h), 2, np.int32)), pa.array(ids), pa.array(far[0]), pa.array(far[1]), pa.nulls(len(h), pa.int64()), pa.array(h), pa.array(pos), none, none]
    return pa.RecordBatch.from_arrays(columns, _OUT)


_OUT = ["kind", "id", "first", "last", "other", "h", "pos", "before", "after"]


def _matches(x: np.ndarray) -> pa.RecordBatch:
    n = x.shape[1]
    none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *(pa.array(r) for r in x), *none], _OUT)


def _edges(table: pa.Table, kind: int, part: int, marks: Iterable[int]) -> pa.RecordBatch:
    """Whole rows of a range, with its number as ``first`` and a mark as ``last``."""
    n = len(table)
    get = lambda c: table.column(c).combine_chunks()
    own = [pa.array(np.full(n, kind, np.int32)), get("id"), pa.array(np.full(n, part, np.int64)), pa.array(np.asarray(marks, np.int64)), pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays([*own, get("h"), get("pos"), get("before"), get("after")], _OUT)


_SCHEMA = "kind int, id bigint, first bigint, last bigint, other bigint, h bigint, pos bigint, before binary, after binary"


def _compared(suffixes: DataFrame, by: str) -> DataFrame:
    """Matches (kind 0) and reaches (kind 2) of suffixes and their neighbours in the order of h and one context.

    What a range needs of others are two rows, which follow from four rows of each range; its edge runs meet them range by range.
    """
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h", by, "id", "pos"]
    dealt = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = cut(dealt.transform(map_in_arrow, _neighbours, _SCHEMA), f"by_{by}")
    beyond = cut(found.where("kind = 3").repartition(1).transform(map_in_arrow, _borders, _SCHEMA), f"beyond_{by}")
    rims = found.where("kind = 1").join(beyond.select(F.col("first").alias("_part")).distinct(), F.col("first") == F.col("_part"), "left_semi")
    rest = rims.unionByName(beyond).groupBy("first").applyInArrow(_at_border, _SCHEMA)
    return found.where("kind = 0 or kind = 2").union(rest).select("kind", "id", "first", "last", "other", "h", "pos")


def _merged(spans: DataFrame) -> DataFrame:
    """(id, first, last, other) with the spans of a document that overlap or touch made one; other is the least."""
    order = W.partitionBy("id").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("n", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("id", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("other").alias("other")).drop("n")


def _open_windows(reaches: DataFrame, found: DataFrame) -> DataFrame:
    """(h, id, pos, open): which windows of 50 words around a kept suffix may repeat and are in no passage of the document so far.

    Bit k stands for the window that begins k words before the suffix.  It can only repeat if some suffix matches k words before,
    and some suffix the rest of the window after: the neighbours in the two orders tell how far that goes.
    """
    far = reaches.groupBy("h", "id", "pos").agg(F.max("first").alias("b"), F.max("last").alias("a")).where(f"a + b >= {CONTEXT}")
    passages = found.select(F.col("id").alias("_id"), "first", "last")
    within = (F.col("id") == F.col("_id")) & (F.col("first") <= F.col("pos")) & (F.col("last") >= F.col("pos") + SEED)
    rows = far.join(passages, within, "left")
    start = lambda k: F.col("pos") - k
    inside = lambda k: F.coalesce((F.col("first") <= start(k)) & (start(k) + LEAST <= F.col("last")), F.lit(False))
    bits = [F.when(~inside(k) & (F.col("b") >= k) & (F.col("a") >= CONTEXT - k), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(CONTEXT + 1)]
    mask = reduce(lambda x, y: x.bitwiseOR(y), bits).cast("bigint")
    return rows.groupBy("h", "id", "pos").agg(F.bit_and(mask).alias("open")).where("open <> 0")


def _windows(rows: DataFrame) -> DataFrame:
    """(key, id, first, open) for the windows around each suffix (h, id, pos, before, after) that its mask names.

    Open windows are all there.  Of the others, which are there to be found by open ones, those of the least and the greatest id of
    a key are enough in each batch.

    The key is a hash of the suffix's hash and of the words before and after that make up the window: windows at the same place
    around equal suffixes have equal keys if and only if their words are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ids, pos, mask, opened = (batch.column(c).to_numpy() for c in (0, 1, 2, 5, 6))
            before, after = (_matrix(batch.column(c)) for c in (3, 4))
            grown = [_grown(h.view(np.uint64), m) for m in (before[0], after[0])]
            for back in range(CONTEXT + 1):
                i = np.flatnonzero((mask >> back & 1 == 1) & (before[1] >= back) & (after[1] >= CONTEXT - back))
                if len(i):
                    key = mix(grown[0][back][i] * np.uint64(0x9FB21C651E98DF25) ^ mix(grown[1][CONTEXT - back][i] + np.uint64(back)))
                    own = opened[i] >> back & 1 == 1
                    order = np.lexsort((ids[i], key))
                    new = np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])
                    kept = own.copy()
                    kept[order[new[:-1] | new[1:]]] = True
                    i, key, own = i[kept], key[kept], own[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[i]), pa.array(pos[i] - back), pa.array(own)], ["key", "id", "first", "open"])

    shown = rows.select("h", "id", "pos", "before", "after", "mask", F.coalesce("open", F.lit(0)).cast("bigint").alias("open"))
    return shown.transform(map_in_arrow, run, "key bigint, id bigint, first bigint, open boolean")


def _grown(h: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Hashes of each h with none, one, two ... of the words of its context."""
    out = [mix(h)]
    for k in range(words.shape[1]):
        out.append(mix(out[-1] * np.uint64(0x9FB21C651E98DF25) + words[:, k].astype(np.uint64) + np.uint64(1)))
    return out


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, start_word, end_word (exclusive), n_words and other_id of every passage that another document has too.

    other_id is the least of the documents that a part of the passage was found in.
    """
    own = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).where("id is not null and t is not null")
    suffixes = cut(_suffixes(own), "suffixes")
    # written, so that the join below has exchanges of its own, of which a partition with a frequent passage can be split
    shared = cut(suffixes.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("h"), "shared")
    places = cut(suffixes.join(shared, "h").groupBy("id").agg(F.collect_list("pos").alias("places")), "places")
    ids = places.select("id")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = own.join(ids, "id", "left_semi").join(places, "id")
    context = cut(_contexts(picked.select("id", "t", "places")), "contexts")
    compared = cut(_compared(context, "after").union(_compared(context, "before")), "compared")
    matches = cut(_merged(compared.where("kind = 0").select("id", "first", "last", "other").distinct()), "matches")
    opened = cut(_open_windows(compared.where("kind = 2"), matches), "open")
    masks = cut(opened.groupBy("h").agg(F.bit_or("open").alias("mask")), "masks")
    windows = cut(_windows(context.join(opened.drop("h"), ["id", "pos"], "left").join(masks, "h")), "windows")
    common = windows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b")
    more = windows.where("open").join(cut(common, "common"), "key")
    more = more.select("id", "first", (F.col("first") + LEAST).alias("last"), F.when(F.col("a") == F.col("id"), F.col("b")).otherwise(F.col("a")).alias("other"))
    joined = _merged(matches.select("id", "first", "last", "other").union(more.distinct()))
    return joined.select(F.col("id").alias(key), F.col("first").alias("start_word"), F.col("last").alias("end_word"), (F.col("last") - F.col("first")).alias("n_words"), F.col("other").alias("other_id"))
