"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs (text between blank lines, whatever comment marks begin its lines) are read in windows of at most 16 words, each
beginning in the middle of the one before; so are single lines, for notices among other lines.  A window's hashed word n-grams (one
to three words) go into a multinomial logistic regression over licence families, ``unknown`` (a licence of no listed family) and
``none``.  A temperature, fitted on notices whose wording the regression has not seen, calibrates the probabilities.  A window whose
family is likely enough is compared with the family's templates, word by word and together with its neighbours: it counts as
confirmed if most of a template is in it (nearly all of a short one), and as nothing if hardly any is, or no word of the family's
name.  Findings of one family whose windows overlap are one; others stay, however many a paragraph or line has.

The examples are drawn from the templates by a seed: cut, reworded, and set among other words; sentences that speak of licences
otherwise are examples of ``none``.  Scanning is a map over rows without shuffle.

Edge cases: a null or empty text has no findings; a paragraph may be of any length.  Repeated rows and null ids are scanned alike.
An empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlgate.llm.notices import HELD_OUT_NO_NOTICES, HELD_OUT_OPENINGS, NAMED, NAMES, NO_NOTICES, OPENINGS, OTHER_NOTICES, TEMPLATES, composed
from marlgate.llm.wordhash import blocks, flat, hash_words, mix
from marlgate.shipping import map_in_arrow

BUCKETS, BLOCK = 1 << 16, 8
#: Probability of a finding; share of a template that confirms it, and share under which it is dropped.
LIKELY, CONFIRMED, SOME = 0.5, 0.6, 0.4
NONE, UNKNOWN = "none", "unknown"
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Words of a template from which on a large part of it confirms; a shorter one has to be there nearly whole.
LONG, NEARLY = 14, 0.75


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


def _ngrams(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the one to three words from each word on (n x 3), and which of them stay in the word's row."""
    n = len(words)
    out, ok = np.zeros((n, 3), np.int64), np.zeros((n, 3), bool)
    h = words
    for k in range(3):
        if n <= k:
            break
        if k:
            h = mix(h[: n - k] * np.uint64(0x9FB21C651E98DF25) + words[k:])
        out[: n - k, k] = (mix(h) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
        ok[: n - k, k] = rows[: n - k] == rows[k:]
    return out, ok


@dataclass
class Windows:
    """Windows over rows of text: sums of features need only two blocks each."""

    row: np.ndarray
    start: np.ndarray  # first byte
    end: np.ndarray


@dataclass
class LicenseModel:
    classes: list[str]
    weights: np.ndarray  # BUCKETS x classes
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Windows]:
        """Probabilities by window, for rows of text."""
        words, rows, starts, ends = hash_words(data, offsets, lower=True, space=_APART)
        if not len(words):
            return np.zeros((0, len(self.classes)), np.float32), Windows(*(np.zeros(0, np.int64) for _ in range(3)))
        buckets, ok = _ngrams(words, rows)
        sums = self.weights[buckets[:, 0]]
        for k in (1, 2):
            sums += self.weights[buckets[:, k]] * ok[:, k, None]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        lengths = np.diff(np.append(first, len(rows)))
        within = np.arange(len(rows)) - np.repeat(first, lengths)
        heads = np.flatnonzero(within % BLOCK == 0)
        total, count = np.add.reduceat(sums, heads, axis=0), np.add.reduceat(ok.sum(axis=1), heads)
        row, last = rows[heads], np.append(heads[1:], len(rows)) - 1
        # a window is a block and the next one of its row; a row's last block is a window only if it is its first
        paired = np.append(row[1:] == row[:-1], False)
        alone = ~paired & (np.concatenate([[True], row[1:] != row[:-1]]))
        use = np.flatnonzero(paired | alone)
        other = np.where(paired[use], use + 1, use)
        both = total[use] + total[other] * paired[use, None]
        n = count[use] + count[other] * paired[use]
        logits = both / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        return self.probabilities(logits), Windows(row[use], starts[heads[use]], ends[last[other]])


def examples(n: int = 12000, seed: int = 21, notices: dict[str, list[str]] | None = None, others: list[str] | None = None) -> list[tuple[str, str]]:
    """(text, class), drawn from notices (default: the templates), sentences that are none, and other words."""
    if notices is None:  # half of the examples from whole templates, half from short notices
        tails = {" ".join(opening.split()[-2:]) for opening in OPENINGS}  # so that more hangs on the name than on what leads to it
        short = composed([*OPENINGS, *sorted(tails - set(OPENINGS)), "under"])
        notices = {k: v * (len(short[k]) // len(v)) + short[k] for k, v in TEMPLATES.items()}
    others = NO_NOTICES if others is None else others
    rng, out = random.Random(seed), []
    pieces = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve les ent que ich sch ung cion men par los del der ein".split()
    word = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
    prose = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    families = list(notices)

    def amid(text: str) -> str:
        """A text somewhere in a window full of other words."""
        spare = max(0, 2 * BLOCK - len(tokens(text)))
        before = rng.randint(0, spare)
        return " ".join([*(word() for _ in range(before)), text, *(word() for _ in range(spare - before))])

    for i in range(n):
        kind = i % 3
        if kind == 0:
            family = rng.choice(families)
            words = rng.choice(notices[family]).split()
            if len(words) > 2 * BLOCK and rng.random() < 0.8:  # a window sees a part of a long notice
                at = rng.randint(0, len(words) - 2 * BLOCK)
                words = words[at : at + 2 * BLOCK]
            text = " ".join(words)
            if rng.random() < 0.3:
                words = [w for w in words if rng.random() > 0.08]
            out.append((rng.choice([" ".join(words), text, f"{prose(1, 6)} {' '.join(words)}", f"{text}. {prose(1, 8)}", amid(text), amid(text), amid(text), amid(text)]), family))
        elif kind == 1 and rng.random() < 0.3:
            text = rng.choice(OTHER_NOTICES).format(word().title())
            out.append((rng.choice([text, f"{text} {prose(1, 5)}", amid(text)]), UNKNOWN))
        else:
            sentence = rng.choice(others)
            out.append((rng.choice([prose(3, 30), prose(3, 30), f"{sentence} {prose(0, 8)}", f"{prose(0, 5)} {sentence}", amid(sentence)]), NONE))
    return out


def train(rows: list[tuple[str, str]] | None = None, unseen: list[tuple[str, str]] | None = None, epochs: int = 12, seed: int = 4) -> LicenseModel:
    """Adagrad on the examples; the temperature that suits others best (by default, notices with openings that are held out)."""
    rows = examples() if rows is None else rows
    classes = sorted({c for _, c in rows})
    if unseen is None:
        unseen = [r for r in examples(1500, 22, composed(HELD_OUT_OPENINGS[:3]), HELD_OUT_NO_NOTICES[::2]) if r[1] in classes]
    model = LicenseModel(classes, np.zeros((BUCKETS, len(classes)), np.float32), np.zeros(len(classes), np.float32))
    rng = np.random.default_rng(seed)
    found = []
    for text, c in [*rows, *unseen]:
        data = np.frombuffer(" ".join(text.split()[: 2 * BLOCK]).encode(), np.uint8)
        words, r, _, _ = hash_words(data, np.array([0, len(data)]), lower=True, space=_APART)
        b, ok = _ngrams(words, r)
        found.append((b[ok], classes.index(c)))
    full = np.array([len(b) > 0 for b, _ in found])
    learned, held = np.flatnonzero(full[: len(rows)]), len(rows) + np.flatnonzero(full[len(rows) :])
    squares, bias_squares = np.full(model.weights.shape, 1e-6, np.float32), np.full(len(classes), 1e-6, np.float32)

    def logits(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([found[i][0] for i in rows])
        sizes = np.array([len(found[i][0]) for i in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        scale = 1 / np.sqrt(np.maximum(sizes, 1))
        z = np.add.reduceat(model.weights[at], np.cumsum(sizes) - sizes, axis=0)
        return z * scale[:, None] + model.bias, at, owner, scale

    target = np.array([c for _, c in found])
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(learned), max(1, len(learned) // 128)):
            z, at, owner, scale = logits(batch)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(batch)), target[batch]] -= 1
            g /= len(batch)
            order = np.argsort(at, kind="stable")
            distinct, firsts = np.unique(at[order], return_index=True)
            grad = np.add.reduceat((g * scale[:, None])[owner[order]], firsts, axis=0).astype(np.float32)
            squares[distinct] += grad * grad
            model.weights[distinct] -= 0.3 * grad / np.sqrt(squares[distinct])
            bias_squares += g.sum(axis=0) ** 2
            model.bias -= 0.1 * g.sum(axis=0) / np.sqrt(bias_squares)
    z = logits(held)[0]

    def loss(t: float) -> float:
        p = LicenseModel(classes, model.weights, model.bias, t).probabilities(z)
        return float(-np.log(np.maximum(p[np.arange(len(held)), target[held]], 1e-9)).mean())

    model.temperature = min((0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    return model


_COMPARED = {k: v + composed(["licensed under", "under the terms of"])[k] for k, v in TEMPLATES.items()}
_WHOLE_NAMES = {k: [tokens(name.removeprefix("the ").removeprefix("a ")) for name in v] for k, v in NAMED.items()}


def compare(text: str, family: str) -> tuple[float, bool]:
    """The largest share of a template of the family whose words occur in ``text`` in the same order, and whether it confirms."""
    words, best, sure = tokens(text), 0.0, False
    if family in NAMES and not NAMES[family] & set(words):
        return 0.0, False
    for template in _COMPARED.get(family, OTHER_NOTICES):
        wanted = tokens(template.replace("{}", ""))
        same = sum(b.size for b in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks())
        share = same / len(wanted)
        best = max(best, share)
        sure = sure or share >= (1.0 if family == UNKNOWN else CONFIRMED if len(wanted) >= LONG else NEARLY)
    if best < SOME and any(f" {' '.join(name)} " in f" {' '.join(words)} " for name in _WHOLE_NAMES.get(family, [])):
        best = SOME  # a whole name after an opening of any wording is something, and confirms nothing
    return best, sure


# a line feed and what follows it as far as the next line has no letter or digit
_BLANK = re.compile(rb"\n(?:[^0-9A-Za-z\x80-\xff\n]*\n)+")


def _likely(model: LicenseModel, data: np.ndarray, breaks: np.ndarray) -> list[tuple[int, int, str, float, float, bool]]:
    """(first byte, last byte, family, probability, share, confirmed) of likely windows of the pieces between some breaks."""
    p, w = model.score(data, breaks)
    if not len(p):
        return []
    out, best = [], p.argmax(axis=1)
    for i in np.flatnonzero((best != model.classes.index(NONE)) & (p.max(axis=1) >= LIKELY)):
        family = model.classes[best[i]]
        first = i - 1 if i and w.row[i - 1] == w.row[i] else i
        last = i + 1 if i + 1 < len(w.row) and w.row[i + 1] == w.row[i] else i
        share, sure = compare(data[w.start[first] : w.end[last]].tobytes().decode("utf-8", "replace"), family)
        if share >= SOME:
            out.append((int(w.start[i]), int(w.end[i]), family, round(float(p[i].max()), 6), round(share, 6), sure))
    return out


def scan_text(model: LicenseModel, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, str, float, float, bool]]:
    """(row, byte offset of the window, family, probability, template share, confirmed), by row and place."""
    blanks = np.array([m.end() for m in _BLANK.finditer(data.tobytes())], np.int64)
    feeds = np.flatnonzero(data == 10) + 1
    found = set(_likely(model, data, np.unique(np.concatenate([offsets, blanks]))))
    found |= set(_likely(model, data, np.unique(np.concatenate([offsets, feeds]))))
    merged: dict[str, list[list]] = {}
    for f in sorted(found):
        row = int(np.searchsorted(offsets, f[0], "right")) - 1
        spans = merged.setdefault(f[2], [])
        if spans and spans[-1][0] == row and f[0] < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], f[1])
            spans[-1][2] = max(spans[-1][2], f, key=lambda x: (x[5], x[4], x[3]))
        else:
            spans.append([row, f[1], f])
    sure = [(row, end, f) for spans in merged.values() for row, end, f in spans]
    certain = sorted((row, f[0], end, f[2]) for row, end, f in sure if f[5] and f[2] != UNKNOWN)
    firsts = [c[:2] for c in certain]
    out = []
    for row, end, f in sure:
        k = bisect_right(firsts, (row, end))
        beside = any(r == row and a < end and b > f[0] and family != f[2] for r, a, b, family in certain[max(0, k - 8) : k])
        # in the place of a confirmed finding of a listed family, what is unconfirmed or of an unlisted one says nothing
        if not beside or f[5] and f[2] != UNKNOWN:
            out.append((row, int(f[0] - offsets[row]), *f[2:]))
    return sorted(out)


_default: list[LicenseModel] = []


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each finding: ``key``, at (byte offset in the text), family, probability, template_share and confirmed."""
    if model is None:
        if not _default:
            _default.append(train())
        model = _default[0]
    names = [key, "at", "family", "probability", "template_share", "confirmed"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in blocks(offsets):
                found = scan_text(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if found:
                    ids = batch.column(0).take(pa.array([i + f[0] for f in found]))
                    columns = [pa.array([f[k + 1] for f in found], kind) for k, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([ids, *columns], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(map_in_arrow, run, f"`{key}` {kind}, at bigint, family string, probability double, template_share double, confirmed boolean")
