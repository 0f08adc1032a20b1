"""Byte-level BPE and token files against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import byte_bpe, queries, token_files

from .conftest import ODD, SMALL

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def ids_of(text):
    return np.frombuffer(byte_bpe.encoder(RANKS, P.PATTERN).encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(list("abehtin .,'s!\n\t 0129éß漢🙂\x00\x1c\x85") + ["the", "ing", "  "]), max_size=40))
def test_encoding_of_any_text(reference, parts):
    text = "".join(parts)
    assert ids_of(text) == reference.encode_ordinary(text)


def test_transducer_starts_anew_and_flushes(reference):
    small = byte_bpe.Encoder(byte_bpe.load_ranks(RANKS), P.PATTERN, max_states=50, max_pieces=5)
    for text in ["a" * 20000, "abcabd" * 4000, "ofthblethin the and ing " * 50, *(t for t in ODD if t)]:
        assert np.frombuffer(small.encode(text), np.int32).tolist() == reference.encode_ordinary(text)


def test_plain_merging_is_the_definition():
    v = byte_bpe.Vocabulary(byte_bpe.load_ranks(RANKS))
    e = byte_bpe.encoder(RANKS, P.PATTERN)
    for word in (b"thandering", b"ofthblethin", "éeauxmenttre".encode(), b"zzzzzzz"):
        assert [v.bytes_of[i] for i in e.piece(word)] == v.merge(word)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_utf8_stream_equals_decoding_at_once(data, step):
    stream = byte_bpe.Utf8Stream()
    out = "".join(stream.feed(data[i:i + step]) for i in range(0, len(data), step)) + stream.end()
    assert out == data.decode("utf-8", "replace")


def test_encode_and_decode_odd_rows(spark, odd_docs, no_docs, reference):
    done = byte_bpe.decode(byte_bpe.encode(odd_docs, RANKS, P.PATTERN), RANKS)
    rows = done.select("text", "ids", "decoded", "score").collect()
    assert len(rows) == odd_docs.count() and "score" in done.columns
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(no_docs, RANKS, P.PATTERN), RANKS)).count() == 0


def test_query_against_the_library(spark, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op2_byte_bpe(spark, SMALL).collect():
        ids = reference.encode_ordinary(texts.pop(r.doc_id))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(reference.decode_bytes(ids)).hexdigest()
    assert not texts


def expected_files(texts):
    tool = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for text in texts:
        ids = tool.encode(text, add_special_tokens=False).ids + [1]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = queries.op3_token_files(spark, SMALL).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == expected_files(t for _, t in docs)


def test_spelt_out_added_tokens(spark, tmp_path):
    texts = ["a <|endoftext|> b", "A<|endoftext|>B", "a <|ENDOFTEXT|> b", "<|startoftext|>", "漢 <|endoftext|>. É", "<|endoftext|>\n<|endoftext|>", "plain <| text |>", "<|endoftext|"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "added")
    token_files.write(token_files.encode_sorted(frame, WORDS), path)
    got = token_files.catalogue(spark, path).orderBy("start").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == expected_files(texts)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_with_odd_rows(spark, odd_docs, no_docs, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_files.write(token_files.encode_sorted(odd_docs, WORDS), path, encoding=encoding)
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    got = token_files.catalogue(spark, path).orderBy("start").collect()
    assert [r.key for r in got] == [d for d, _ in rows]
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == expected_files(t for _, t in rows)
    assert [r.key for r in token_files.read(spark, path, 3, 5, ["key"]).orderBy("key").collect()] == [3, 4, 5]
    plan = token_files.read(spark, path, 3, 5, ["key", "n_tokens"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key,3)" in plan and "tokens:array" not in plan.split("ReadSchema")[-1]
    empty = str(tmp_path / f"{encoding}-empty")
    token_files.write(token_files.encode_sorted(no_docs, WORDS), empty, encoding=encoding)
    assert token_files.catalogue(spark, empty).count() == 0


def test_page_indexes_are_written(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_files.write(token_files.encode_sorted(spark.read.parquet(f"{SMALL}/documents.parquet"), WORDS), path, row_group_bytes=1 << 16)
    files = list((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    column = meta.row_group(0).column(0)
    assert column.has_offset_index and column.has_column_index


def test_a_forgetful_encoder_gives_the_same_ids():
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tool = byte_bpe.Encoder(byte_bpe.load_ranks(path), public_tokenizers.PATTERN)
    texts = ["unforgettable zyxwvut qqqq", "", "Größe 中文 \U0001f600", "ab" * 90]
    first = [tool.encode(t) for t in texts]
    assert tool.words or tool.pieces
    tool.forget()
    assert not tool.words and not tool.pieces and not tool.moves and not tool.vocabulary._fits
    assert [tool.encode(t) for t in texts] == first
