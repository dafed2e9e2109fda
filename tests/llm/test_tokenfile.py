"""Token files: exact round trips, and ids as the library has them."""

import io
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlgate.llm.queries import op13_token_files, tokenizer_path
from marlgate.llm.tokenfile import BLOCK, FileWriter, LibraryEncoder, TokenFile, decode_blocks, encode_blocks, encode_library, in_order, read_tokens, write_tokens
from tests.llm.helpers import AWKWARD, clashing, docs

PATH = tokenizer_path()
LIBRARY, OWN = Tokenizer.from_file(PATH), LibraryEncoder(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.integers(0, 100))
def test_any_block_comes_back(ids, percentile):
    assert decode_blocks(encode_blocks(np.array([ids, ids[::-1]], np.uint32), percentile)).tolist() == ids + ids[::-1]


def test_outliers_are_exceptions_and_do_not_widen_a_block():
    ids = np.full((1, BLOCK), 70, np.uint32)
    ids[0, ::3] = 71
    plain = len(encode_blocks(ids)[0])
    ids[0, [5, 900]] = [4_000_000_000, 80_000]
    block = encode_blocks(ids)[0]
    assert len(block) == plain + 2 * 6 and plain == 12 + BLOCK // 8
    assert (decode_blocks([block]) == ids[0]).all()


class Memory(io.BytesIO):
    """A file in memory that can be read by ranges."""

    def close(self):
        self.whole = self.getvalue()

    def size(self):
        return len(self.whole)

    def read_at(self, n, at):
        self.reads = [*getattr(self, "reads", []), n]
        return self.whole[at : at + n]


def test_file_of_documents_and_slices():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 49_408, n).astype("<u4") for n in [0, 1, 5, BLOCK, 3 * BLOCK + 1, 0, 700_000, 2]]
    file = Memory()
    out = FileWriter(file, percentile=80)
    for k, x in enumerate(parts):
        out.add(None if k == 2 else k, x.tobytes())
    out.close()
    made = TokenFile(file)
    at = 0
    for (key, start, ids), k, x in zip(made.documents(), range(8), parts, strict=True):
        assert (key, start, ids) == (None if k == 2 else k, at, x.tobytes())
        at += len(x)
    every = np.concatenate(parts)
    file.reads = []
    assert (made.slice(5000, 5100) == every[5000:5100]).all() and max(file.reads) < 20 * BLOCK
    assert (made.slice(at - 1, at + 50) == every[-1:]).all() and made.slice(9, 9).size == 0 and made.n_ids == at


def same(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aZ'sST tlLémÉßİı×ſ1²_-.<|>\ń", max_size=40))
def test_any_text_equals_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", "it's 'SAM we'LL", "<|endoftext|>x<|startoftext|>", "a\x1cb\x85c d", "ﬁ É é İ Σς ŉ", "Straße12½", "\U0001f600" * 9, "'" * 50, "q" * 3000])
def test_chosen_texts_equal_the_library(text):
    same(text)


def expected(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
    out, at = [], 0
    for d, t in sorted(rows, key=key):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def stored(spark, frame, path, **more):
    write_tokens(encode_library(in_order(frame), PATH, end_id=2), path, **more)
    return read_tokens(spark, path)


def test_awkward_table(spark, tmp_path):
    rows = stored(spark, clashing(docs(spark, AWKWARD)), str(tmp_path)).orderBy("start").collect()
    want = expected([(r[0], r[1]) for r in AWKWARD])
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows] == want


def test_empty_table_repeated_rows_and_appending(spark, tmp_path):
    path = f"file:{tmp_path}/t"  # as Spark writes local paths
    assert stored(spark, docs(spark, []), path).count() == 0
    same_rows = docs(spark, [(k % 2, "the same text") for k in range(500)])
    assert stored(spark, same_rows, path).count() == 500
    stored(spark, docs(spark, [(9, "one more")]), path, mode="append")
    rows = read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == 501 and rows[-1]["doc_id"] == 9 and rows[-1]["start"] == sum(r["n_tokens"] for r in rows[:-1])
    assert [r["doc_id"] for r in rows] == [0] * 250 + [1] * 250 + [9]


def test_files_of_failed_tasks_are_not_read_and_go(spark, tmp_path):
    path = str(tmp_path)
    assert stored(spark, docs(spark, [(1, "first")]), path).count() == 1
    (tmp_path / "part-000000-left.pfor").write_bytes(b"half a file")
    assert read_tokens(spark, path).count() == 1

    def fail(batches):
        for batch in batches:
            yield batch
            raise RuntimeError("lost")

    bad = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(b"\1\0\0\0").alias("ids")).mapInArrow(fail, "doc_id bigint, ids binary")
    with pytest.raises(Exception, match="lost"):
        write_tokens(bad, path, mode="append")
    assert read_tokens(spark, path).count() == 1
    assert stored(spark, docs(spark, [(2, "second")]), path).first()["doc_id"] == 2
    assert len([f for f in os.listdir(path) if f.endswith(".pfor")]) == 1


def test_query_over_all_documents(spark, data):
    texts = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_token_files(spark, data)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == expected(texts)


def test_encoded_batches_are_cut_by_size(spark):
    rows = encode_library(docs(spark, [(k, "word " * 400_000) for k in range(4)]).coalesce(1), PATH).select("doc_id", F.length("ids").alias("n")).collect()
    assert sorted(map(tuple, rows)) == [(k, 1_600_000) for k in range(4)]
