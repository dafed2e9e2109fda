"""Token ids as binary files of patched frame-of-reference blocks, as a Spark data source.

A file holds the ids of consecutive documents, cut into blocks of ``BLOCK`` ids.  A block stores its least id, and each id less
that in as many bits as the ``PERCENTILE`` of them needs; those that need more are exceptions, stored whole in a list with their
places.  The file ends with an index: where each block starts, and the key and number of ids of each document, so any range of
ids is read by its own blocks alone (``TokenFile.slice``).

    documents = encode_library(docs, tokenizer_path(), end_id=2)
    write_tokens(documents, path)
    read_tokens(spark, path)          # doc_id, start, n_tokens, ids

``write_tokens`` orders documents by key over range partitions: each task writes one file and reports its name, and the driver's
commit writes the manifest of files in order, with the number of ids before each.  Files of failed or repeated tasks are not in
the manifest, and are deleted at commit.  A file is read by one task; nothing else passes through the driver.

Edge cases: a null or empty text has the end id alone.  Null keys come first.  Rows of one key stand in order of a hash of their
text, and equal rows are each written.  Other columns are not read.  An empty table gives a manifest without files, which reads
as an empty table.  Keys are integers.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from marlgate.llm.bpe import _ODD_SPACE, _SPACE, _byte_letters
from marlgate.shipping import map_in_arrow, ship
from marlgate.sources.binary import as_uri

MAGIC, BLOCK, PERCENTILE = b"MGPFOR1\n", 1024, 90
#: Blocks that are packed or unpacked at once.
AT_ONCE = 256
MANIFEST = "_manifest.json"
#: The least id, number of ids, width in bits, number of exceptions.
_HEAD = struct.Struct("<IHHI")
#: Numbers of ids, documents and blocks, and where the index starts.
_TAIL = struct.Struct("<QQQQ")


# Blocks


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, 64 k) values below 2^width as (rows, k width) 64-bit words."""
    rows, n = values.shape
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(rows, n // 64 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The opposite of ``_pack``."""
    rows, n = words.shape
    groups = np.ascontiguousarray(words.reshape(-1, width).T)
    out, mask = np.empty((64, groups.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        got = groups[word] >> np.uint64(shift)
        if shift + width > 64:
            got |= groups[word + 1] << np.uint64(64 - shift)
        out[j] = got & mask
    return np.ascontiguousarray(out.T).reshape(rows, n // width * 64)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Rows of as many ids each (under 2^16) as blocks."""
    rows, n = ids.shape
    least = ids.min(axis=1)
    rest = (ids - least[:, None]).astype(np.uint64)
    at = min(n - 1, n * percentile // 100)
    widths = np.array([int(x).bit_length() for x in np.partition(rest, at, axis=1)[:, at]])
    padded = np.zeros((rows, -(-n // 64) * 64), np.uint64)
    padded[:, :n] = rest
    out: list[bytes] = [b""] * rows
    for width in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == width)
        found = padded[mine]
        over = found >> np.uint64(width) != 0
        words = _pack(found & np.uint64((1 << width) - 1), width) if width else np.zeros((len(mine), 0), np.uint64)
        row, place = np.nonzero(over)
        ends = np.searchsorted(row, np.arange(len(mine) + 1))
        values, place = found[over].astype("<u4"), place.astype("<u2")
        for k, r in enumerate(mine.tolist()):
            a, b = ends[k], ends[k + 1]
            head = _HEAD.pack(int(least[r]), n, width, int(b - a))
            out[r] = b"".join((head, words[k].astype("<u8").tobytes(), place[a:b].tobytes(), values[a:b].tobytes()))
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks, one after the other."""
    heads = [_HEAD.unpack_from(b) for b in blocks]
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, (_, n, width, _) in enumerate(heads):
        kinds.setdefault((n, width), []).append(k)
    for (n, width), mine in kinds.items():
        count = -(-n // 64) * width
        if width:
            found = _unpack(np.stack([np.frombuffer(blocks[k], "<u8", count, _HEAD.size) for k in mine]).astype(np.uint64), width)[:, :n]
        else:
            found = np.zeros((len(mine), n), np.uint64)
        for values, k in zip(found, mine, strict=True):
            least, _, _, over = heads[k]
            if over:
                at = _HEAD.size + 8 * count
                values[np.frombuffer(blocks[k], "<u2", over, at)] = np.frombuffer(blocks[k], "<u4", over, at + 2 * over)
            out[k] = (values + np.uint64(least)).astype(np.uint32)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


# Files


class FileWriter:
    """Writes one file: ``add`` documents in order, then ``close``."""

    def __init__(self, stream, block: int = BLOCK, percentile: int = PERCENTILE):
        self.stream, self.block, self.percentile = stream, block, percentile
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.starts = [len(MAGIC)]
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        stream.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        found = np.frombuffer(ids, "<u4")
        self.keys.append(key)
        self.counts.append(len(found))
        self.held.append(found)
        self.n_held += len(found)
        self.n_ids += len(found)
        if self.n_held >= self.block * AT_ONCE:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for at in range(0, upto, self.block * AT_ONCE):
            part = ids[at : min(upto, at + self.block * AT_ONCE)]
            whole = len(part) // self.block * self.block
            blocks = encode_blocks(part[:whole].reshape(-1, self.block), self.percentile) if whole else []
            blocks += encode_blocks(part[whole:][None, :], self.percentile) if whole < len(part) else []
            for b in blocks:
                self.starts.append(self.starts[-1] + len(b))
            self.stream.write(b"".join(blocks))
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        self.stream.write(np.array(self.starts, "<u8").tobytes() + keys.tobytes() + null.tobytes() + np.array(self.counts, "<u8").tobytes())
        self.stream.write(_TAIL.pack(self.n_ids, len(keys), len(self.starts) - 1, self.starts[-1]) + MAGIC)
        self.stream.close()


class TokenFile:
    """Reads one file: its index at once, its blocks as they are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.n_ids, self.n_docs, self.n_blocks, index = _TAIL.unpack_from(tail := self._bytes(size - _TAIL.size - len(MAGIC), size))
        if tail[_TAIL.size :] != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        raw, n, d = self._bytes(index, size), self.n_blocks + 1, self.n_docs
        self.starts = np.frombuffer(raw, "<u8", n).astype(np.int64)
        null = np.frombuffer(raw, np.uint8, d, 8 * (n + d))
        self.keys = [None if x else k for k, x in zip(np.frombuffer(raw, "<i8", d, 8 * n).tolist(), null.tolist(), strict=True)]
        self.counts = np.frombuffer(raw, "<u8", d, 8 * (n + d) + d).astype(np.int64)
        self.block = _HEAD.unpack(self._bytes(len(MAGIC), len(MAGIC) + _HEAD.size))[1] if self.n_blocks else 1

    def _bytes(self, start: int, end: int) -> bytes:
        return self.file.read_at(int(end - start), int(start))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks from ``first`` up to, not with, ``last``."""
        edges = self.starts[first : last + 1]
        raw = self._bytes(edges[0], edges[-1])
        return decode_blocks([raw[a:b] for a, b in zip((edges[:-1] - edges[0]).tolist(), (edges[1:] - edges[0]).tolist(), strict=True)])

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end`` in the file, by the blocks that hold them."""
        start, end = max(0, start), min(end, self.n_ids)
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block, -(-end // self.block)
        return self.blocks(first, last)[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Key, place of the first id and the ids of each document, a few blocks at a time."""
        held, at, block = np.empty(0, np.uint32), 0, 0
        for key, count in zip(self.keys, self.counts.tolist(), strict=True):
            parts = [held]
            have = len(held)
            while have < count:
                upto = min(self.n_blocks, block + AT_ONCE)
                parts.append(self.blocks(block, upto))
                have, block = have + len(parts[-1]), upto
            held = np.concatenate(parts) if parts[1:] else held
            yield key, at, held[:count].astype("<u4").tobytes()
            held, at = held[count:], at + count


# The data source


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(as_uri(path))


def _manifest(path: str) -> list[dict]:
    from pyarrow.fs import FileType

    fs, root = _filesystem(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == FileType.NotFound:
        return []
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    """A file that a task wrote; no name if it had no documents."""

    name: str | None
    part: int
    docs: int
    ids: int
    size: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.block, self.percentile = int(options.get("block", BLOCK)), int(options.get("percentile", PERCENTILE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
        fs, root = _filesystem(self.path)
        made = None
        for batch in iterator:
            if made is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                made = FileWriter(fs.open_output_stream(f"{root}/{name}"), self.block, self.percentile)
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made.add(key, ids.as_buffer() or b"")
        if made is None:
            return Written(None, part, 0, 0, 0)
        made.close()
        return Written(name, part, len(made.keys), made.n_ids, fs.get_file_info(f"{root}/{name}").size)

    def commit(self, messages: list[Written | None]) -> None:
        """Files in order of their partitions, after those that were there; the manifest is put in place whole."""
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files = [] if self.overwrite else _manifest(self.path)
        base = sum(f["ids"] for f in files)
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part):
            files.append({"name": m.name, "docs": m.docs, "ids": m.ids, "size": m.size, "start": base})
            base += m.ids
        draft = f"{root}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(files).encode())
        fs.move(draft, f"{root}/{MANIFEST}")
        self._sweep({f["name"] for f in files})

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep({f["name"] for f in _manifest(self.path)})

    def _sweep(self, keep: set[str]) -> None:
        from pyarrow.fs import FileSelector

        fs, root = _filesystem(self.path)
        for info in fs.get_file_info(FileSelector(root, allow_not_found=True)):
            if info.base_name.endswith(".pfor") and info.base_name not in keep:
                fs.delete_file(info.path)


@dataclass
class FilePart(InputPartition):
    name: str
    start: int


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[FilePart]:
        return [FilePart(f["name"], f["start"]) for f in _manifest(self.path)] or [FilePart("", 0)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        if not partition.name:
            return
        fs, root = _filesystem(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            rows, held = [], 0
            for key, at, ids in TokenFile(f).documents():
                rows.append((key, partition.start + at, len(ids) // 4, ids))
                held += len(ids)
                if held >= 4_000_000 or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


class TokenSource(DataSource):
    """``format("pfor")``: options path, and for writing block and percentile."""

    @classmethod
    def name(cls) -> str:
        return "pfor"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark)
    spark.dataSource.register(TokenSource)


# Encoding by the library

_LETTERS = "a-zß-öø-įı-ſ"
#: Texts whose lower-case form keeps its length and which normalisation leaves alone.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]*")
#: The tokenizer's own word pattern for lower-case plain text without white space.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: White-space pieces and words that a worker keeps; the first ones stay, as frequent words come early.
KEEP = 500_000


class LibraryEncoder:
    """The library's ids of a text: distinct words go to its model once, pieces that are not plain to the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.from_bytes = str.maketrans({raw: letter for letter, raw in _byte_letters().items()})
        self.words: dict[str, bytes] = {}
        encoder = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                found = encoder.piece(piece)
                if len(self) < KEEP:
                    self[piece] = found
                return found

        self.pieces = Pieces()

    def piece(self, piece: str) -> bytes:
        """Ids of a text without white space."""
        if "<|" in piece or not _PLAIN.fullmatch(piece):
            ids = self.library.encode(piece, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        known, out = self.words, []
        for word in _WORD.findall(piece.lower()):
            found = known.get(word)
            if found is None:
                ids = [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.from_bytes))]
                found = struct.pack(f"<{len(ids)}I", *ids)
                if len(known) < KEEP:
                    known[word] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts: Iterable[str] = (text or "").split() if not text or not _ODD_SPACE.search(text) else filter(None, _SPACE.split(text))
        return b"".join(map(self.pieces.__getitem__, parts))


_encoders: dict[str, LibraryEncoder] = {}


def encode_library(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int | None = None) -> DataFrame:
    """``key`` and ``ids`` (binary: little-endian unsigned 32-bit integers) of each row, ``end_id`` after those of its text."""
    last = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = LibraryEncoder(path)
        encode = _encoders[path].encode
        for batch in batches:
            made, at, held = [], 0, 0
            for k, x in enumerate(batch.column(1)):
                made.append(encode(x.as_py()) + last)
                held += len(made[-1])
                if held >= 4_000_000 or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(made)), pa.array(made, pa.binary())], [key, "ids"])
                    made, at, held = [], k + 1, 0

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(map_in_arrow, run, f"`{key}` {kind}, ids binary")


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` in ascending order of ``key`` over range partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text))
    order = [F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))]
    return own.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def write_tokens(encoded: DataFrame, path: str, mode: str = "overwrite", block: int = BLOCK, percentile: int = PERCENTILE) -> None:
    """Writes (key, ids) rows, which are in order over their partitions, as token files."""
    register(encoded.sparkSession)
    encoded.write.format("pfor").mode(mode).option("block", block).option("percentile", percentile).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of each document."""
    register(spark)
    return spark.read.format("pfor").load(path)
