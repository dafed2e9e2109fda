"""Language identification by a byte convolutional network in numpy.

Filters two, three and four bytes wide run over windows of 256 bytes of UTF-8; each filter's greatest value in a window, cut at
zero, goes into a softmax over the languages.  A text's windows cover all of it, and their probabilities are averaged, weighted
by length.  Applying the network needs no shuffle.  As bytes are few, a filter is a table of byte pairs that is looked up.

The network is trained on the driver with a bounded sample: ``PER_LANGUAGE`` documents of each language, or fewer where there are so
many languages that these would be more than ``MOST_LEARNED`` in all, picked by a hash of their id, with three windows each.  Were
there more languages than that, the ones with the most documents would be learned, one of each.  Only text and language of documents outside the held-out
third (crc32 of the id modulo 3 is 1) are used.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.  A null id is not held out and not learned from.
Short texts are padded; long ones have more windows.  Rows are judged one by one, so repeated rows agree.  Where there is nothing
to learn from, all is ``und``.  An empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgate.llm.scratch import cut
from marlgate.shipping import map_in_arrow

WINDOW, FILTERS, WIDTHS = 256, 16, (2, 3, 4)
PER_LANGUAGE, MOST_LEARNED, EPOCHS = 500, 100_000, 6
UNDETERMINED = "und"
#: Windows that are looked at together.
BATCH = 96


class ByteCnn:
    """The network: for each width and place a table of byte values by filters, then a dense layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.kernels = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.kernels, self.bias, self.dense, self.offset]

    def tables(self) -> list[np.ndarray]:
        """Tables over byte pairs: widths 2, 3 (first pair), 4 (first pair), 4 (second pair)."""
        two, three, four = self.kernels
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS))
        return [pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])]

    def maps(self, windows: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
        """For each width the filters' values, as (place, window, filter)."""
        b = np.ascontiguousarray(windows.T)
        pairs = b[:-1].astype(np.int32) * 256 + b[1:]
        two = tables[0].take(pairs, axis=0)
        three = tables[1].take(pairs[:-1], axis=0)
        three += self.kernels[1][2].take(b[2:], axis=0)
        four = tables[2].take(pairs[:-2], axis=0)
        four += tables[3].take(pairs[2:], axis=0)
        return [two, three, four]

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        pooled = np.concatenate([m.max(axis=0) for m in self.maps(windows, tables)], axis=1)
        logits = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> None:
        """Adam on cross-entropy, in batches of 64; a quarter of the windows are shortened so that short texts are known too."""
        rng, params = np.random.default_rng(seed), self.parameters()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), 64):
                rows = order[at : at + 64]
                x, y = windows[rows].copy(), labels[rows]
                for i in np.flatnonzero(rng.random(len(rows)) < 0.25):
                    x[i, int(rng.integers(12, 128)) :] = 0
                maps = self.maps(x, self.tables())
                places = [m.argmax(axis=0) for m in maps]
                pooled = np.concatenate([np.take_along_axis(m, p[None], axis=0)[0] for m, p in zip(maps, places, strict=True)], axis=1) + self.bias
                active = np.maximum(pooled, 0)
                logits = active @ self.dense + self.offset
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                g = e / e.sum(axis=1, keepdims=True)
                g[np.arange(len(y)), y] -= 1
                g /= len(y)
                back = (g @ self.dense.T) * (pooled > 0)
                grads = []
                for j, (w, p) in enumerate(zip(WIDTHS, places, strict=True)):
                    part, grad = back[:, j * FILTERS : (j + 1) * FILTERS], np.zeros_like(self.kernels[j])
                    for k in range(w):
                        np.add.at(grad[k], (np.take_along_axis(x, p + k, axis=1), np.arange(FILTERS)[None, :].repeat(len(x), 0)), part)
                    grads.append(grad)
                grads += [back.sum(axis=0), active.T @ g, g.sum(axis=0)]
                step += 1
                for p, m, v, d in zip(params, first, second, grads, strict=True):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded with zeros, and the first window of each text (n + 1 entries)."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((int(firsts[-1]), WINDOW), np.uint8)
    for t, at in zip(texts, firsts, strict=False):
        out[at : at + -(-len(t) // WINDOW)].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
    return out, firsts


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteCnn | None:
    """The network for the languages of ``docs``; None where there is nothing to learn from."""
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("t"), held_out(key).alias("out"))
    own = own.where("not out and id is not null and lang is not null and t is not null")
    # the documents of each language with the least hashes of their ids: about twice as many as wanted go on, then the least of them
    counts = cut(own.groupBy("lang").count(), "languages")
    n = counts.count()
    if n > MOST_LEARNED:
        counts = counts.orderBy(F.desc("count"), "lang").limit(MOST_LEARNED)
    each = max(1, min(PER_LANGUAGE, MOST_LEARNED // max(n, 1)))
    # at least forty are drawn, so that some language is left without one once in 10^17
    counts = counts.select(F.col("lang").alias("_lang"), (F.lit(2.0 * max(each, 20)) / F.col("count")).alias("share"))
    draw = F.abs(F.xxhash64("id") / F.lit(2.0**63))
    drawn = own.join(counts, F.col("lang") == F.col("_lang")).where(draw < F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "t"))
    begin = lambda k: F.lit(1) + F.floor(F.greatest(F.length("t") - WINDOW, F.lit(0)) * k / 2).cast("int")
    pieces = F.explode(F.array_distinct(F.array(*(F.substring("t", begin(k), F.lit(WINDOW)) for k in range(3)))))
    rows = drawn.withColumn("place", place).where(F.col("place") <= each).select("lang", "id", pieces.alias("piece")).collect()
    rows = sorted((r for r in rows if any(map(str.isalpha, r["piece"]))), key=lambda r: (r["lang"], str(r["id"]), r["piece"]))
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    model = ByteCnn(languages)
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        data = r["piece"].encode()[:WINDOW]
        x[i, : len(data)] = np.frombuffer(data, np.uint8)
    model.train(x, np.array([languages.index(r["lang"]) for r in rows]))
    return model


_held: tuple[bytes, list[np.ndarray]] = (b"", [])


def _tables_of(model: ByteCnn) -> list[np.ndarray]:
    """The pair tables, once a worker and model."""
    global _held
    name = b"".join(p.tobytes() for p in model.parameters())
    if _held[0] != name:
        _held = (name, model.tables())
    return _held[1]


def predict_languages(docs: DataFrame, model: ByteCnn | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, lang_pred and score of every row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables_of(model) if model else []
        for batch in batches:
            names, scores = [], []
            for t in batch.column(2):
                t = t.as_py()
                if not model or not t or not any(map(str.isalpha, t)):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    names.append(t.encode())
                    scores.append(-1.0)
            todo = [i for i, s in enumerate(scores) if s < 0]
            while todo:
                size, n = 0, 0
                while n < len(todo) and (not n or size + len(names[todo[n]]) < 1 << 20):
                    size += len(names[todo[n]])
                    n += 1
                part, todo = todo[:n], todo[n:]
                x, firsts = windows_of([names[i] for i in part])
                p = np.concatenate([model.probabilities(x[i : i + BATCH], tables) for i in range(0, len(x), BATCH)])
                p *= (x != 0).sum(axis=1)[:, None]
                total = np.add.reduceat(p, firsts[:-1], axis=0)
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
                best = total.argmax(axis=1)
                for i, b, s in zip(part, best, total.max(axis=1), strict=True):
                    names[i], scores[i] = model.languages[b], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [key, "held_out", "lang_pred", "score"])

    shown = docs.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), F.col(f"`{text}`"))
    return shown.transform(map_in_arrow, run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
