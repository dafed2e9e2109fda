"""Vector compression: a vector becomes one byte for each of its parts, the index of the nearest entry of that part's codebook.

All arithmetic is on integers, floor(256 x) of each component, so results do not depend on the order of additions.  The nearest
entry is found by lower bounds from coarse to fine.  Of a block of n components with sums X and Y and residual norms p and q
(what is left of a vector when its block mean is taken off), the squared distance is at least (X - Y)^2 / n + (p - q)^2.  First the
whole part is one block: entries whose bound is over the exact distance to the most promising entry are out.  Then the part is
halved again and again, with the sums of the bounds of its blocks, and what looks most promising by them.  Bounds are lowered by
more than their rounding error, so no nearest entry is lost; what survives gets exact integer distances, ties go to the lower index.

Codebooks are small (``ENTRIES`` times the dimension), whatever the number of vectors: they go to the tasks, and partial sums by
(part, entry, position) come back through an aggregation.

Edge cases: rows are dropped whose vector is null or holds null, NaN, infinite components or ones beyond ``MOST`` (whose squared
distances would leave 64 bits), whose length is not a multiple of ``PARTS``, and whose length differs from that of the kept row
with the least id.  Rows without an id count as the last ones when codebooks are started; rows that share one stand in order of
their components.  Fewer than ``ENTRIES`` rows make that many entries, equal entries stay, an unused entry stays as it is.  An
empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgate.llm.scratch import cut
from marlgate.shipping import map_in_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest component: 2^18 times 256, differences squared and summed over 64 components stay below 2^63.
MOST = 1 << 18
#: Rows whose bounds are worked out at once.
AT_ONCE = 4096


def _cuts(n: int) -> list[np.ndarray]:
    """Where blocks begin, from one block to blocks of one component."""
    out, size = [], n
    while size >= 1:
        out.append(np.arange(0, n, size))
        if size == 1:
            break
        size = -(-size // 2)
    return out


def _blocks(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, sums over root of the size, and residual norms of the blocks of each row."""
    sizes = np.diff(np.append(begins, x.shape[1])).astype(float)
    sums = np.add.reduceat(x, begins, axis=1).astype(float)
    squares = np.add.reduceat(x * x, begins, axis=1).astype(float)
    return sizes, sums / np.sqrt(sizes), np.sqrt(np.maximum(0.0, squares - sums * sums / sizes))


class NearestEntry:
    """Nearest entries of one codebook by conservative bounds.  ``checked`` counts the exact distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [(begins, *_blocks(entries, begins)[1:]) for begins in _cuts(entries.shape[1])[:-1]]
        self.checked = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        if x.shape[1] == 1:  # a part of one component is its own mean: its bound is the distance
            d = (x - self.entries[:, 0]) ** 2
            best = d.argmin(axis=1)
            return best, d[np.arange(len(x)), best]
        begins, means, norms = self.levels[0]
        _, own_means, own_norms = _blocks(x, begins)
        bound = (own_means - means[:, 0]) ** 2 + (own_norms - norms[:, 0]) ** 2
        guess = bound.argmin(axis=1)
        reach = ((x - self.entries[guess]) ** 2).sum(axis=1)
        # rounding: of squares of sums, and of roots of differences of squares, which lose half of the digits
        size = (x * x).sum(axis=1).astype(float) + float((self.entries * self.entries).sum(axis=1).max())
        slack = 1e-6 * size + 1e-3
        row, entry = np.nonzero(bound <= (reach + slack)[:, None])
        for begins, means, norms in self.levels[1:]:
            _, own_means, own_norms = _blocks(x, begins)
            finer = ((own_means[row] - means[entry]) ** 2 + (own_norms[row] - norms[entry]) ** 2).sum(axis=1)
            starts = np.searchsorted(row, np.arange(len(x)))  # every row has its nearest entry left
            hopeful = np.flatnonzero(finer == np.minimum.reduceat(finer, starts)[row])
            hopeful = hopeful[np.searchsorted(row[hopeful], np.arange(len(x)))]
            reach = np.minimum(reach, ((x - self.entries[entry[hopeful]]) ** 2).sum(axis=1))
            keep = finer <= (reach + slack)[row]
            row, entry = row[keep], entry[keep]
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        self.checked += len(exact)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(exact, starts)
        tied = exact == least[row]
        first = np.full(len(x), len(self.entries))
        np.minimum.at(first, row[tied], entry[tied])
        return first, least


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) indices and squared distances; ``books`` is (parts, entries, components)."""
    parts, _, width = books.shape
    nearest = [NearestEntry(b) for b in books]
    codes, errors = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
    for at in range(0, len(vectors), AT_ONCE):
        rows = slice(at, min(len(vectors), at + AT_ONCE))
        for p in range(parts):
            codes[rows, p], errors[rows, p] = nearest[p](vectors[rows, p * width : (p + 1) * width])
    return codes, errors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def integer_vectors(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """id, the columns ``keep`` as _kept0 ..., and v: the integer components of the rows that are not dropped, but for their length."""
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    own = frame.select(F.col(f"`{key}`").alias("id"), *(F.col(f"`{c}`").alias(f"_kept{k}") for k, c in enumerate(keep)), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return own.where(F.coalesce(whole & sound, F.lit(False))).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def _code(codes: np.ndarray) -> list[str]:
    return [bytes(row).hex() for row in codes.astype(np.uint8)]


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, components) from ``integer_vectors``: ``rounds`` times assigned and moved to the floor of the mean."""
    order: list[Column] = [F.col("id").asc_nulls_last(), F.col("v").asc()]
    first = vectors.select("id", "v").orderBy(*order).limit(entries).collect()  # a bounded start, not the data
    if not first:
        return None
    size = len(first[0]["v"])
    start = np.array([r["v"] for r in first if len(r["v"]) == size], np.int64)
    if len(start) < len(first):  # rows of other lengths are no rows of this table
        again = vectors.where(F.size("v") == size).select("id", "v").orderBy(*order).limit(entries).collect()
        start = np.array([r["v"] for r in again], np.int64)
    books = start.reshape(len(start), parts, size // parts).transpose(1, 0, 2).copy()
    rows = vectors.where(F.size("v") == size).select("v")
    for _ in range(rounds):
        sums = map_in_arrow(rows, _sums_with(books), "part int, entry int, place int, total bigint, n bigint")
        moved = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in moved.collect():  # as many as components of the codebooks
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def _sums_with(books: np.ndarray):
    """Partial sums by (part, entry, place) of a task's vectors."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * width)
            codes, _ = assign(vectors, books)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.broadcast_to(n[:, :, None] > 0, total.shape)
        part, entry, place = (x.astype(np.int32) for x in np.nonzero(used))
        counts = np.broadcast_to(n[:, :, None], total.shape)[used]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place), pa.array(total[used]), pa.array(counts)], ["part", "entry", "place", "total", "n"])

    return run


def encode_vectors(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vectors`` of the length of the codebooks with code (two hex digits a part) and error (squared distance) in place of v."""
    parts, _, width = books.shape
    fields = [f for f in vectors.schema.fields if f.name != "v"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", code string, error bigint"
    names = [*(f.name for f in fields), "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assign(_matrix(batch.column(len(fields)), parts * width), books)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(_code(codes), pa.string()), pa.array(errors.sum(axis=1))], names)

    own = vectors.where(F.size("v") == parts * width).select(*(f.name for f in fields), "v")
    return own.transform(map_in_arrow, run, schema)


def decode_vectors(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """``codes`` with v, the approximate components: those of the entries that a code names."""
    flat = F.lit(books.tolist())
    entry = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("v", F.transform(F.flatten(F.array(*(F.get(F.get(flat, p), entry(p)) for p in range(len(books))))), lambda x: x / SCALE))


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components in order of part, entry and place."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def compress(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """``key``, label, code, error and label_error (summed over equal labels, nulls together) of every kept row, and the codebooks."""
    vectors = integer_vectors(frame, key, vector, (label,))
    books = train(vectors)
    kind = frame.schema[label].dataType.simpleString()
    if books is None:
        none = vectors.select("id", F.col("_kept0").alias("label"), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"))
        return none.withColumnRenamed("id", key).where("false"), None
    coded = cut(encode_vectors(vectors, books), "codes")
    sums = coded.groupBy(F.col("_kept0").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("_kept0").eqNullSafe(F.col("_label"))).select(F.col("id").alias(key), F.col("_kept0").cast(kind).alias("label"), "code", "error", "label_error")
    return out, books
