import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlgate.llm.bpe import WordTrieBpe, decode_ids, encode_documents
from marlgate.llm.queries import op10_bpe, tokenizer_path
from tests.llm.helpers import AWKWARD, clashing, docs

PATH = tokenizer_path()
LIBRARY, OWN = Tokenizer.from_file(PATH), WordTrieBpe(PATH)


def same(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == expected
    assert OWN.decode(got) == LIBRARY.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", "aaaaaaaaaaaaaaaaaaaaaaaaa", "it's we'll I'M", "<|endoftext|>x<|startoftext|>", "<|endoftext|", "a\x1cb\x85c d", "ﬁ É é İ Σς", "1234 5.6!!!...", "\U0001f600" * 9])
def test_chosen_texts_equal_the_library(text):
    same(text)


def test_long_random_words_equal_the_library():
    rng = random.Random(2)
    for _ in range(300):
        same("".join(rng.choice("etaoinshrdlcu") for _ in range(rng.randint(1, 60))))


def test_awkward_table(spark):
    rows = encode_documents(clashing(docs(spark, AWKWARD)), PATH, digests=True).collect()
    expected = []
    for d, t, *_ in AWKWARD:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        expected.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))


def test_round_trip_of_ids(spark):
    df = docs(spark, AWKWARD)
    encoded = encode_documents(df, PATH)
    back = {repr(r) for r in map(tuple, decode_ids(encoded.select("doc_id", "ids"), PATH).collect())}
    assert back == {repr((r["doc_id"], r["decoded"])) for r in encoded.collect()}
    assert encode_documents(df.limit(0), PATH).count() == 0


def test_query_over_all_documents(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = op10_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
