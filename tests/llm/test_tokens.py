import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import bytebpe, wordbpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("aA'stre 0 \n\t<|>é́ΣßéIİ", max_size=60)


@pytest.fixture(scope="module")
def word():
    t = Tokenizer.from_file(WORD)
    t.no_padding(), t.no_truncation()
    return t


@pytest.fixture(scope="module")
def byte():
    t = Tokenizer.from_file(BYTE)
    t.no_padding(), t.no_truncation()
    return t


def words_of(t, text):
    return len(t.encode(text, add_special_tokens=False).ids)


def check_counts(docs, t):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in wordbpe.token_counts(docs, WORD).collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        n = words_of(t, r.text or "")
        want.add((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    assert got == want


def check_round_trip(docs, t):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.round_trip(docs, BYTE).collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == want


def test_counts_of_all_documents(documents, word):
    check_counts(documents, word)


def test_round_trip_of_all_documents(documents, byte):
    check_round_trip(documents, byte)


def test_odd_rows(odd, none, word, byte):
    check_counts(odd, word)
    check_round_trip(odd, byte)
    assert wordbpe.token_counts(odd, WORD).count() == odd.count() == bytebpe.round_trip(odd, BYTE).count()
    assert wordbpe.token_counts(none, WORD).collect() == [] == bytebpe.round_trip(none, BYTE).collect()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_any_text_counts_as_the_library_has_it(text):
    t = Tokenizer.from_file(WORD) if not hasattr(test_any_text_counts_as_the_library_has_it, "t") else test_any_text_counts_as_the_library_has_it.t
    test_any_text_counts_as_the_library_has_it.t = t
    assert wordbpe.counter(WORD).totals([text], 4)[0] == [words_of(t, text)]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_any_text_encodes_as_the_library_has_it(text):
    t = Tokenizer.from_file(BYTE) if not hasattr(test_any_text_encodes_as_the_library_has_it, "t") else test_any_text_encodes_as_the_library_has_it.t
    test_any_text_encodes_as_the_library_has_it.t = t
    ids = bytebpe.codec(BYTE).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert bytebpe.codec(BYTE).decode(ids) == text


def test_prefix_counts_and_budgets(word):
    text = "don't prefixes, 123 tokenization of <|endoftext|>unbelievable words"
    found = wordbpe.counter(WORD)
    for part in found.parts(text):
        if part:
            assert found.prefixes(part) == [words_of(word, part[:i]) for i in range(1, len(part) + 1)]
    for budget in range(0, 20):
        n = found.within(text, budget)
        whole = found.prefixes(text)
        assert n == max((i for i, c in enumerate(whole, 1) if c <= budget), default=0)


def test_every_code_point_is_of_the_class_that_the_library_has(word):
    """Each between letters, twice before an accent, and twice after one."""
    found = wordbpe.counter(WORD)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a{0}b", "{0}{0}\u0307", "x\u0327{0}{0}"):
        texts = [form.format(c) for c in points]
        want = [len(e.ids) for e in word.encode_batch(texts, add_special_tokens=False)]
        got = found.totals(texts, 2048)[0]
        assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_long_words_by_scan_and_heap():
    codec = bytebpe.codec(BYTE)
    for data in (b"abcabcabd" * 40, b"a" * 500, "żółć".encode() * 60, bytes(range(256))):
        assert codec.short(data) == codec.long(data)


def test_columns(spark):
    df = spark.createDataFrame([("hello  world",), ("",), (None,)], "t string")
    rows = df.select(bytebpe.encode(F.col("t"), BYTE).alias("i"), wordbpe.prefix_counts(F.col("t"), WORD).alias("p")).collect()
    assert [len(r.i) for r in rows] == [3, 0, 0] and [len(r.p) for r in rows] == [12, 0, 0]
