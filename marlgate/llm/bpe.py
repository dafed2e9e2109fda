"""BPE encoding and decoding: depth-first traversal of the trie of distinct words.

The encoding of a prefix of a word, with one token taken off its end, is the encoding of a shorter prefix.  So one token a
prefix, its last, is enough: it is the one token ending there that can stand after the last token of the prefix before it.
Distinct words in sorted order are the trie in depth-first order: what two neighbours share is a path of nodes whose last
tokens are already on the stack, and each node is computed once.

Texts are split at white space first, and each distinct piece is normalised and pre-tokenised once by the rules of the
tokenizer file.  The merges themselves are applied here alone.

Edge cases: a null or empty text, or one of white space only, has no ids and decodes to the empty string.  Repeated rows are
encoded each for itself.  Other columns are not read.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from os.path import commonprefix
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlgate.shipping import map_in_arrow

_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: ASCII signs: neither letters, digits nor white space.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The tokenizer's own word pattern for lower-case ASCII without white space.
_ASCII_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Distinct white-space pieces and words that a worker keeps; beyond that it forgets them and starts anew.
KEEP_PIECES, KEEP_WORDS = 400_000, 400_000
_NEVER = 1 << 40


def _byte_letters() -> dict[str, str]:
    """Byte-level vocabularies write each byte as a printable character: letter -> the byte as a Latin-1 character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): chr(b) for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + i): chr(b) for i, b in enumerate(spare)}


class WordTrieBpe:
    """Encoder and decoder for one tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.letters = _byte_letters()
        self.to_bytes = str.maketrans(self.letters)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix) and token != suffix
            (self.final if ends else self.inner)[(token[: -len(suffix)] if ends else token).translate(self.to_bytes)] = i
        self.size = {i: len(t) for table in (self.inner, self.final) for t, i in table.items()}
        self.inner_reach, self.final_reach = self._reach(self.inner), self._reach(self.final)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, out = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            self.made.setdefault(out, (rank, a, b))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[bytes, str, int]] = {}
        self.pieces: dict[str, tuple[bytes, str, int]] = {}

    @staticmethod
    def _reach(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """The lengths that tokens with a given three-letter ending have, longest first; any token may be shorter than that."""
        lengths: dict[str, set[int]] = {"": {1, 2}}
        for token in table:
            if len(token) > 2:
                lengths.setdefault(token[-3:], {1, 2}).add(len(token))
        return {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while ``token`` is being made, each with the rank of the merge that takes it in."""
        out, taken = [], _NEVER
        while True:
            out.append((token, taken))
            if token not in self.made:
                return out[::-1]
            taken, a, b = self.made[token]
            token = b if right else a

    def can_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' text is just these two: no merge ever crosses the border between them."""
        known = self.pairs.get((a, b))
        if known is None:
            left, right = self._edge(a, True), self._edge(b, False)
            i = j = 0
            known = True
            while True:
                (x, x_taken), (y, y_taken) = left[i], right[j]
                rank = self.rank.get((x, y), _NEVER)
                if rank < x_taken and rank <= y_taken:
                    known = False
                    break
                if x_taken == y_taken == _NEVER:
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of distinct words (bytes as Latin-1 characters), sharing the work on common prefixes.

        At each node the candidates for the last token are the tokens that end there, in the lengths that the last three letters
        allow; the one that may follow the last token of the prefix before it is right.
        """
        out: dict[str, tuple[int, ...]] = {}
        last: list[int] = [-1]  # of the current path: the last token of the prefix of each length
        size, pairs, before = self.size, self.pairs, ""
        inner = (self.inner.get, self.inner_reach.get)
        final = (self.final.get, self.final_reach.get)
        for word in sorted(words):
            n = len(word)
            del last[min(len(commonprefix((before, word))), n - 1) + 1 :]
            for depth in range(len(last), n + 1):
                token_of, reach = inner if depth < n else final
                for length in reach(word[depth - 3 : depth] if depth > 2 else "", (2, 1)):
                    begin = depth - length
                    if begin >= 0 and (token := token_of(word[begin:depth])) is not None:
                        if not begin:
                            break
                        known = pairs.get((last[begin], token))
                        if known or known is None and self.can_follow(last[begin], token):
                            break
                else:
                    raise ValueError(f"no encoding of {word[:depth]!r}")
                last.append(token)
            token, at, ids = last.pop(), n, []
            while True:
                ids.append(token)
                at -= size[token]
                if not at:
                    break
                token = last[at]
            out[word] = tuple(ids[::-1])
            before = word
        return out

    def _split(self, piece: str) -> list[str | int]:
        """The words of a white-space piece as Latin-1 characters, and ids of special tokens."""
        if self.special_split and "<|" in piece and (parts := self.special_split.split(piece))[1:]:
            return [x for p in parts if p for x in ([self.special[p]] if p in self.special else self._split(p))]
        if piece.isascii():
            return _ASCII_WORD.findall(piece.lower())
        if max(piece) < "\u0250":  # Latin letters: normalised as they are, and a run of letters with signs after it is two words
            low = piece.lower()
            core = low.rstrip(_SIGNS)
            if core.isalpha():
                tail = low[len(core) :]
                word = core.encode().decode("latin-1")
                return [word, tail] if tail else [word]
        return [w.translate(self.to_bytes) for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(piece))]

    def _entry(self, ids: tuple[int, ...]) -> tuple[bytes, str, int]:
        """Ids as bytes, as decoded text, and their number."""
        return pack(f"<{len(ids)}I", *ids), " ".join([self.tokens[i] for i in ids]), len(ids)

    def learn(self, pieces: Iterable[str]) -> None:
        """Makes sure that these white-space pieces are known."""
        missing = {p for p in pieces if p not in self.pieces}
        if not missing:
            return
        if len(self.pieces) > KEEP_PIECES:
            self.pieces.clear()
            missing = set(pieces)
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        split = {p: self._split(p) for p in missing}
        known = self.words
        new = {w for words in split.values() for w in words if isinstance(w, str) and w not in known}
        for w, ids in self.encode_words(new).items():
            known[w] = self._entry(ids)
        for p, words in split.items():
            if len(words) == 1 and isinstance(words[0], str):
                self.pieces[p] = known[words[0]]
            else:
                parts = [known[w] if isinstance(w, str) else self._entry((w,)) for w in words]
                self.pieces[p] = (b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts]), sum([x[2] for x in parts]))

    def split_text(self, text: str) -> list[str]:
        return [p for p in _SPACE.split(text) if p] if _ODD_SPACE.search(text) else text.split()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            parts = self.split_text(text or "")
            self.learn(set(parts))
            out.append(b"".join([self.pieces[p][0] for p in parts]))
        return out

    def decode(self, ids: bytes) -> str:
        """What the library's decode makes of ids without a decoder: the tokens, joined by blanks."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_encoders: dict[str, WordTrieBpe] = {}


def encoder(path: str) -> WordTrieBpe:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = WordTrieBpe(path)
    return _encoders[path]


def _chunks(column: pa.Array, limit: int = 1_000_000) -> Iterator[list[str | None]]:
    texts, held = [], 0
    for x in column:
        texts.append(x.as_py())
        held += len(texts[-1] or "")
        if held >= limit:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Encodes and decodes ``docs[text]``.

    Returns ``key``, ``ids`` (array of int), ``decoded`` (string), or with ``digests`` ``key``, ``n_tokens``, ``ids_sha256``
    and ``decoded_sha256`` of those.  A map over rows: no shuffle, and memory is bounded by the longest text.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                parts = [bpe.split_text(t or "") for t in texts]
                rows = []
                bpe.learn({p for x in parts for p in x})
                known = bpe.pieces
                for x in parts:
                    found = [known[p] for p in x]
                    ids = b"".join([f[0] for f in found])
                    decoded = " ".join([f[1] for f in found if f[2]])
                    if digests:
                        rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        rows.append((np.frombuffer(ids, "<i4").tolist(), decoded))
                kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
                columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))]
                names = schema_names[1:]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *columns], [schema_names[0], *names])
                at += len(rows)

    schema_names = [key, *(["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    return docs.select(key, text).transform(map_in_arrow, run, schema)


def decode_ids(frame: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Decodes a column of ids; null gives the empty string.  Returns ``key`` and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "decoded"])

    return frame.select(key, ids).transform(map_in_arrow, run, f"`{key}` {frame.schema[key].dataType.simpleString()}, decoded string")
