import hashlib
import random
import zlib

import numpy as np
import pytest

from weftline.llm import runs


def by_hand(words, shortest=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k + q < len(words):
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            end = k + q
            if end - start >= max(shortest, 2 * q) and not any(words[start : end - p] == words[start + p : end] for p in range(1, q)):
                out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words, found):
    dropped = {k for start, length, q in found for k in range(start + q, start + length)}
    return [w for k, w in enumerate(words) if k not in dropped]


def odd_words(rng):
    kinds, n, words = rng.choice([1, 2, 3, 4, 30]), rng.randint(0, 150), []
    while len(words) < n:
        if rng.random() < 0.3 and words:
            words += words[-rng.randint(1, min(len(words), 30)) :] * rng.randint(1, 6)
        else:
            words.append(b"w%d" % rng.randrange(kinds))
    return words


def test_all_runs_are_found():
    rng, total = random.Random(13), 0
    for _ in range(300):
        documents = [odd_words(rng) for _ in range(rng.randint(1, 8))]
        for words, (found, kept) in zip(documents, runs.describe(documents), strict=True):
            assert found == by_hand(words), words
            assert kept == b" ".join(without_repeats(words, found))
            total += len(found)
    assert total > 500


@pytest.mark.parametrize(("period", "length"), [(1, 12), (5, 12), (6, 12), (7, 14), (14, 28), (15, 30), (100, 200), (1000, 2001)])
def test_a_run_of_each_scale_at_any_place(period, length):
    for before in (0, 1, 2, 3, 5, 8, 13):
        unit = [b"%d" % k for k in range(period)]
        words = [b"x%d" % k for k in range(before)] + (unit * (length // period + 1))[:length] + [b"y"]
        assert runs.describe([words])[0][0] == [(before, length, period)]
        assert runs.describe([words[: before + length - 1]])[0][0] == []


def test_sums_are_exact():
    rng = np.random.default_rng(13)
    block, window = rng.integers(0, 1 << 20, (5, 8)), rng.integers(0, 1 << 20, (5, 23))
    window[2, 4:12] = block[2]
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y[k:], strict=False)) for k in range(16)] for x, y in zip(block, window, strict=True)]
    for p, generator in runs.PRIMES:
        assert runs.mismatches(block, window, p, generator).tolist() == [[v % p for v in row] for row in exact]
    assert exact[2][4] == 0


def test_long_texts_take_little_time():
    rng = random.Random(14)
    assert runs.describe([[b"long"] * 30_000])[0] == ([(0, 30_000, 1)], b"long")
    words = [b"%d" % rng.randrange(10**6) for _ in range(20_000)]
    assert runs.describe([words + words + words[:100]])[0][0] == [(0, 40_100, 20_000)]


def test_documents(spark, odd_documents, no_documents):
    rows = {r.doc_id: r for r in runs.run_digests(odd_documents).collect()}
    assert runs.run_digests(odd_documents).count() == odd_documents.count()
    for r in odd_documents.collect():
        words, got = runs.planted_words(r.doc_id, (r.text or "").encode().split()), rows[r.doc_id]
        if len(words) < 1000:
            found = by_hand(words)
            assert got.n_runs == len(found)
            assert got.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
            assert got.collapsed_sha256 == hashlib.sha256(b" ".join(without_repeats(words, found))).hexdigest()
    assert (rows[9].start, rows[9].length, rows[9].period, rows[9].exponent_milli) == (0, 30_000, 1, 30_000_000)
    assert rows[1].start is None and rows[1].exponent_milli is None
    assert runs.run_digests(no_documents).count() == 0


def test_every_tenth_document_is_made_periodic():
    doc_id = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    words = [b"%d" % k for k in range(100)]
    h = zlib.crc32(str(doc_id).encode())
    a, p = h // 10 % 100, 1 + (100 - h // 10 % 100) // (3 + h // 10 % 8)
    assert runs.planted_words(doc_id, words) == [words[k] if k < a else words[a + (k - a) % p] for k in range(100)]


def test_the_data_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    got = {r.doc_id: r for r in runs.run_digests(docs).collect()}
    for r in docs.collect():
        found = by_hand(runs.planted_words(r.doc_id, (r.text or "").encode().split()))
        assert got[r.doc_id].runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
