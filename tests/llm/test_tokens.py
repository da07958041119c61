"""Byte-level BPE, token counts and token files against the public libraries."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import byte_bpe, token_counts, token_files
from lectern.llm.prefix_bpe import PrefixTable

TEXT = st.text(alphabet=st.sampled_from(list("ab  \n\t'stlld.e,!?09éß 今天ﬁ①Ａ　\xa0\x1c\x85́😀▁ΣσΟİ#*=-<>|/\x00\r")), max_size=40)
BPE = byte_bpe.ByteBPE()
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
COUNTS = token_counts.PieceCounts()
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
WORDS = token_files.WordIds()
TOKENIZER = Tokenizer.from_file(P.path(token_files.TOKENIZER))


def ids_of(text):
    packed = BPE.encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encodes_as_the_library(text):
    assert ids_of(text) == REFERENCE.encode_ordinary(text)
    assert BPE.decode(ids_of(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5), TEXT), max_size=4))
def test_edits_and_appends(text, edits):
    encoded = byte_bpe.EncodedText(BPE, text)
    for start, size, new in edits:
        start = min(start, len(encoded.text))
        encoded.replace(start, min(len(encoded.text), start + size), new)
        assert encoded.ids() == REFERENCE.encode_ordinary(encoded.text)
        encoded.append("'ll be")
        assert encoded.ids() == REFERENCE.encode_ordinary(encoded.text)


def test_edits_encode_little():
    encoded = byte_bpe.EncodedText(BPE, "some words in a row " * 2000)
    encoded.replace(20_000, 20_004, "other")
    assert encoded.encoded < 10
    assert encoded.ids() == REFERENCE.encode_ordinary(encoded.text)


def test_one_long_piece():
    text = "a" * 3000 + "b" * 3000
    assert ids_of(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=20), st.binary(max_size=8), st.integers(0, 20), st.integers(0, 20))
def test_prefix_table(text, more, start, stop):
    table = PrefixTable(BPE.vocabulary, text).append(more)
    fresh = PrefixTable(BPE.vocabulary, text + more)
    assert (table.last, table.count) == (fresh.last, fresh.count)
    start, stop = sorted((min(start, len(text)), min(stop, len(text))))
    edited = text[:start] + b"xy" + (text + more)[stop:]
    assert table.replace(start, stop, b"xy").last == PrefixTable(BPE.vocabulary, edited).last


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(0, 12))
def test_counts_as_the_library(text, limit):
    counts = [len(PIECES.encode(text[:i])) for i in range(len(text) + 1)]
    assert COUNTS.count(text) == counts[-1]
    assert COUNTS.prefix_counts(text) == counts
    assert COUNTS.fit(text, limit) == max(i for i, n in enumerate(counts) if n <= limit)


@settings(max_examples=400, deadline=None)
@given(TEXT | st.sampled_from(["a<|endoftext|>b", "<|startoftext|> x", "don't WE'LL İstanbul ǅ"]))
def test_word_ids_as_the_library(text):
    assert np.frombuffer(WORDS.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_op3_rows(odd_docs, no_docs):
    rows = byte_bpe.round_trip(odd_docs).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = REFERENCE.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.round_trip(no_docs).count() == 0


def test_op6_rows(odd_docs, no_docs):
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in token_counts.count_tokens(odd_docs).collect():
        n = len(PIECES.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
        if r.over_limit:
            assert len(PIECES.encode(texts[r.doc_id][: r.fit_chars])) <= 4096 < len(PIECES.encode(texts[r.doc_id][: r.fit_chars + 1]))
    assert token_counts.count_tokens(no_docs).count() == 0
    few = odd_docs.where("length(text) < 100")
    for r in token_counts.prefix_counts(few).collect():
        assert r.counts == [len(PIECES.encode(texts[r.doc_id][:i])) for i in range(len(texts[r.doc_id]) + 1)]


@pytest.fixture(scope="module")
def folder(spark, small_docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('files')}/ids"
    token_files.write(small_docs, path, 3)
    return path


def test_op5_files(spark, small_docs, folder):
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    rows, start = {r.doc_id: r for r in token_files.digests(spark, folder).collect()}, 0
    for doc_id in sorted(texts):
        ids = np.array([*TOKENIZER.encode(texts[doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(rows[doc_id]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: r.n_tokens for r in token_files.read(spark, folder).collect()} == {d: r.n_tokens for d, r in rows.items()}
    (one,) = token_files.read_one(spark, folder, 17)
    assert one.tolist()[:-1] == TOKENIZER.encode(texts[17], add_special_tokens=False).ids
    assert token_files.read_one(spark, folder, 10**9) == []


def test_op5_odd(spark, odd_docs, no_docs, tmp_path):
    token_files.write(odd_docs, f"file://{tmp_path}/odd", 4)
    rows = sorted(token_files.digests(spark, f"file://{tmp_path}/odd").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -3, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11, 12]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert rows[2].n_tokens == rows[3].n_tokens == 1
    token_files.write(no_docs, f"file://{tmp_path}/none", 2)
    assert token_files.digests(spark, f"file://{tmp_path}/none").count() == 0


def test_op5_one_doc_id_over_many_tasks(spark, tmp_path):
    """Rows that share a doc_id, or are equal in all, are dealt to several files, and starts still follow one another."""
    rows = [(None, f"nameless text number {i}") for i in range(300)] + [(5, "the same row again")] * 300 + [(6, "after them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/hot"
    token_files.write(docs, path, 8)
    found = sorted(token_files.digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 300 + [5] * 300 + [6]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(found, found[1:]))
    assert spark.read.parquet(f"{path}/segments").select("partition").distinct().count() >= 5
    assert len(token_files.read_one(spark, path, 5)) == 300


def test_op5_small_sample(spark, tmp_path):
    """Too few documents to train on still share a dictionary: their ids, as they are."""
    docs = spark.createDataFrame([(i, "a few words that come again " * 5 + str(i)) for i in range(20)], "doc_id long, text string")
    path = f"file://{tmp_path}/few"
    token_files.write(docs, path)
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    assert 0 < len(raw) <= token_files.DICTIONARY_BYTES
    (one,) = token_files.read_one(spark, path, 3)
    assert one.tolist()[:-1] == TOKENIZER.encode("a few words that come again " * 5 + "3", add_special_tokens=False).ids
