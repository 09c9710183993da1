import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weftline.llm import byte_codec, queries

RANKS = byte_codec.load_ranks(queries.RANKS, public_tokenizers.PATTERN)
ALPHABET = "aabcdeinorst  \n\t　 'sltd0123(){};.\ré日\U0001f600\x1c"


@pytest.fixture(scope="module")
def codec():
    return byte_codec.ByteCodec(RANKS)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.rank, special_tokens={})


def numbers(packed):
    return np.frombuffer(packed, "<u4").tolist()


def odd_text(rng):
    return "".join(rng.choice(ALPHABET) if rng.random() < 0.9 else rng.choice("ab' ") * rng.randint(1, 30) for _ in range(rng.randint(0, 80)))


def test_encoding_equals_the_library(codec, library):
    rng = random.Random(11)
    texts = ["", " ", "'ll", "<|endoftext|>", "a\x00b", *[f"a{chr(c)}1 {chr(c)}{chr(c)}! {chr(c)}" for c in range(0, 0x110000, 211) if not 0xD800 <= c < 0xE000]]
    texts += [odd_text(rng) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert numbers(ids) == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_one_long_pre_token(codec, library):
    rng = random.Random(12)
    for text in ("x" * 5000, "".join(rng.choice("abcdeé") for _ in range(5000)), " " * 3000 + "y", "!?" * 2000):
        assert numbers(codec.encode_all([text])[0]) == library.encode_ordinary(text)


def test_stitched_chunks_equal_the_whole(codec):
    rng = random.Random(13)
    most = 0
    for _ in range(3000):
        text = odd_text(rng)
        spans = list(byte_codec.chunks(text, rng.randint(8, 20), rng.randint(0, 4)))
        pieces = codec.split_all([text[a:b] for a, b, _, _ in spans])
        parts = [byte_codec.encode_chunk(codec, p, a, to, since) for p, (a, _, to, since) in zip(pieces, spans, strict=True)]
        assert byte_codec.stitch(parts) == codec.encode_all([text])[0], text
        most = max(most, len(spans))
    assert most > 5


def test_a_stretch_without_spaces_is_in_few_chunks():
    text = "x" * 500_000 + " y" * 500 + " " * 200_000 + "z"
    spans = list(byte_codec.chunks(text, 1 << 12, 64))
    assert sum(b - a for a, b, _, _ in spans) < 2 * len(text)


def test_documents_long_and_short(spark, odd_documents, no_documents, library):
    rows = {r.doc_id: r for r in byte_codec.encode_digests(odd_documents, RANKS, chunk=1 << 12).collect()}
    whole = {r.doc_id: r for r in byte_codec.encode_documents(odd_documents, RANKS, chunk=1 << 12).collect()}
    for r in odd_documents.collect():
        ids = library.encode_ordinary(r.text or "")
        assert whole[r.doc_id].ids == ids and bytes(whole[r.doc_id].decoded) == (r.text or "").encode()
        assert rows[r.doc_id].n_tokens == len(ids)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_codec.encode_digests(no_documents, RANKS).count() == 0


def test_repeated_long_rows_stay(spark):
    text = "one two three " * 1000
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + "x"), (2, text + "y")], "doc_id long, text string")
    got = byte_codec.encode_digests(docs, RANKS, chunk=1 << 10)
    assert sorted((r.doc_id or 0, r["count"]) for r in got.groupBy("doc_id").count().collect()) == [(0, 1), (1, 2), (2, 2)]
    assert got.select("ids_sha256").distinct().count() == 3
