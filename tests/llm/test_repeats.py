import hashlib
import random

import pytest

from weftline.llm import repeats


def by_hand(docs):
    """(n_bytes, n_removed, n_spans, kept) by looking at all 50-byte strings."""
    least = {}
    texts = {i: (t or "").encode() for i, t in docs}
    for i in sorted(texts):
        for a in range(len(texts[i]) - 49):
            least.setdefault(texts[i][a : a + 50], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if least[t[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def corpus(seed, n=60):
    """Texts with shared passages, copies, periodic runs, edges and common lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(8, 80)) for _ in range(6)]
    line = prose(25)
    texts = []
    for _ in range(n):
        parts = [prose(rng.randint(0, 30)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.insert(rng.randint(0, len(parts)), p[a : rng.randint(a, len(p))])
        if rng.random() < 0.5:
            parts.append(line)
        if rng.random() < 0.2:
            parts.append(rng.choice(["ab", "x", "abc"]) * rng.randint(20, 80))
        texts.append("".join(parts))
        if rng.random() < 0.2:
            texts.append(texts[-1])
        if rng.random() < 0.2:
            texts.append(texts[-1][: rng.randint(0, len(texts[-1]))])
    rng.shuffle(texts)
    return list(enumerate(texts))


def found(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(frame, **options).collect()}


@pytest.mark.parametrize("seed,hot", [(1, 5000), (2, 5000), (3, 3), (4, 0)])
def test_removal_equals_all_strings(spark, seed, hot):
    docs = corpus(seed)
    got = found(spark, docs, hot=hot, buckets=5)
    assert got == by_hand(docs)
    assert sum(x[1] for x in got.values()) > 1000


@pytest.mark.parametrize("hot", [5000, 0])
def test_texts_that_share_half_of_their_hash_keep_their_own_stretches(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "OWNER_DIGITS", 1)  # 16 numbers for all texts
    docs = corpus(6)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert len({r.owner for r in repeats.text_owners(frame).collect()}) == len({t for _, t in docs})
    assert found(spark, docs, hot=hot, buckets=4) == by_hand(docs)


def listed(spark, docs):
    """(n_bytes, open_left, open_right, places) of each group."""
    rows = repeats.repeat_groups(spark.createDataFrame(docs, "doc_id long, text string"), buckets=3).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.group, (r.n_bytes, r.open_left, r.open_right, set()))[3].add((r.doc_id, r.start))
    assert sum(len(g[3]) for g in groups.values()) == len(rows)
    return list(groups.values())


@pytest.mark.parametrize("seed", [9, 10])
def test_groups_have_every_repeated_string_with_all_occurrences(spark, seed):
    docs = corpus(seed, 30)
    first = {}
    for i, t in docs:  # of equal texts the least id stands for all
        first.setdefault(t, i)
    texts = {i: t.encode() for t, i in first.items()}
    groups = listed(spark, docs)
    places = {}
    for i, t in texts.items():
        for a in range(len(t) - 49):
            places.setdefault(t[a : a + 50], set()).add((i, a))
    covered = set()
    for n, open_left, open_right, found in groups:
        strings = {texts[d][a : a + n] for d, a in found}
        assert len(strings) == 1 and n >= 50
        whole = next(iter(strings))
        # all occurrences of the group's bytes, and no byte more on a side that isn't open
        assert found == {(d, a) for d, t in texts.items() for a in range(len(t) - n + 1) if t[a : a + n] == whole}
        around = [{texts[d][max(0, a - 1) : a] or (d, a) for d, a in found}, {texts[d][a + n : a + n + 1] or (d, a) for d, a in found}]
        assert open_left or len(around[0]) > 1
        assert open_right or len(around[1]) > 1
        for k in range(n - 49):
            if len(places[whole[k : k + 50]]) == len(found):
                covered.add(whole[k : k + 50])
    assert covered == {x for x, p in places.items() if len({d for d, _ in p}) > 1}


def test_a_long_passage_is_one_group(spark):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(400)
    docs = [(n, prose(rng.randint(50, 90)) + f"{n}" + passage + f"{n}" + prose(rng.randint(50, 90))) for n in range(10)] + [(20, "x" + passage[:200])]
    groups = listed(spark, docs[:10])
    assert len(groups) == 1 and groups[0][0] == 400 and len(groups[0][3]) == 10 and not groups[0][1] and not groups[0][2]
    more = sorted((n, len(found)) for n, _, _, found in listed(spark, docs))
    assert (200, 11) in more and max(k for _, k in more) == 11


def test_owners_name_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (None, "")], "doc_id long, text string")
    owners = {r.doc_id: r.owner for r in repeats.text_owners(docs).collect()}
    assert owners[1] == owners[2] != owners[3] == owners[None]


def test_intervals_of_a_known_array():
    assert sorted(repeats.interval_scan([3, 1, 2, 2])) == sorted([(3, 0, 1), (2, 2, 4), (1, 0, 4)])
    assert repeats.interval_scan([]) == []
    assert repeats.interval_scan([0, 0]) == [(0, 0, 2)]


def test_odd_rows(spark, odd_documents, no_documents):
    rows = repeats.remove_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    got = {r.doc_id: r for r in rows}
    assert got[1].n_bytes == got[2].n_bytes == 0 and got[1].n_removed == 0
    assert got[6].n_removed == 0
    assert hashlib.sha256(got[9].kept).hexdigest() == hashlib.sha256(b"long " * 30_000).hexdigest()
    assert repeats.remove_repeats(no_documents).count() == 0


@pytest.mark.parametrize("hot", [5000, 0])
def test_two_texts_of_one_id_have_their_own_stretches(spark, hot):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = prose(120), prose(300)
    docs = [(1, passage + prose(40)), (2, prose(600) + passage), (2, other), (3, other[:90] + prose(50))]
    rows = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows)
    assert got == [(1, 160, 0, 0), (2, 300, 0, 0), (2, 720, 120, 1), (3, 140, 90, 1)]
