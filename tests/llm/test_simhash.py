import random

import pytest
import xxhash

from weftline.llm import components, simhash
from weftline.llm.components import connected_components
from weftline.llm.tables import cut_lineage


def by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    """Least id reachable, by comparing all pairs."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_equals_the_definition(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    rng = random.Random(1)
    for n in [*range(12), 40, 100]:
        text = " ".join(rng.choice(["A", "b", "Cé", "dd", " x"]) for _ in range(n)) + rng.choice(["", "\n", " \t"])
        assert simhash.fingerprint(text.encode()) == by_hand(text)


@pytest.mark.parametrize("bucket", [1, 3, 500])
def test_links_are_those_of_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    prints = set()
    for _ in range(25):
        start = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(start)
            for _ in range(rng.randint(0, 4)):
                start ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), bucket=bucket).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got


def test_a_crowded_segment_is_never_paired_with_itself(spark):
    """5,000 fingerprints with one segment value, 1,000 of them with one block too: all links, by every route."""
    rng = random.Random(9)
    prints = {(rng.getrandbits(32) << 32) | 77 for _ in range(4000)}
    near = [0]
    while len(near) < 1000:  # few bits of one block differ, so that blocks are crowded too
        near.append(rng.choice(near) ^ 1 << rng.randrange(11))
    prints |= {(x << 32) | 77 for x in near}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), bucket=100)
    got = {(r.a, r.b) for r in found.collect()}
    whole = set(signed)
    ball = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    to_signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {(a, b) for a in signed for f in ball if (b := to_signed((a ^ f) & (1 << 64) - 1)) in whole and a < b}
    assert got == want and len(want) > 1000


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(400, 600)] + [(7, 7)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]}


def test_rounds_end_with_stars(spark, monkeypatch):
    """A path of three nodes is a star after one round, and no other one follows."""
    written = []
    monkeypatch.setattr(components, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    got = {tuple(r) for r in connected_components(spark.createDataFrame([(2, 1), (2, 3)], "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)} and len(written) == 2


@pytest.mark.parametrize("seed", range(4))
def test_stars_are_told_from_other_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(5, 12), rng.randrange(3 + seed)) for _ in range(rng.randrange(1, 6))} | ({(9, 8)} if seed == 3 else set())
    uppers, lowers = [a for a, _ in edges], {b for _, b in edges}
    assert components._are_stars(spark.createDataFrame(list(edges), "a long, b long")) == (len(set(uppers)) == len(uppers) and not lowers & set(uppers))


def test_odd_rows(spark, odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert [got[i] for i in (1, 2, 3)] == [1, 1, 1]
    assert got[None] == got[7] == got[6] == 6
    assert simhash.near_duplicates(no_documents).count() == 0


def test_whole_texts_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(5)
    docs = {}
    for i in range(60):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([3, 30, 300]))]
        docs[2 * i] = " ".join(words)
        if i % 3 == 0:
            docs[2 * i + 1] = docs[2 * i] + " end"
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == components_by_hand({i: by_hand(t) for i, t in docs.items()})
