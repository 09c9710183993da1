import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import near_copies, simhash


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_hand(docs):
    """The least id of each group that pairs of similarity 0.8 connect, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similarities = []
    for a in docs:
        for b in docs:
            if a < b:
                alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                similarities.append(alike)
                if alike >= 0.8:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in docs}), similarities


def some_documents(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    line = [word() for _ in range(12)]
    docs, group = {}, [word() for _ in range(150)]
    for i in range(50):
        base = [word() for _ in range(rng.choice([3, 12, 60, 200]))] + (line if i % 2 else [])
        if i % 5 == 0:
            base = list(group)
        docs[10 * i] = " ".join(base)
        for k in range(rng.randint(0, 3)):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                near[rng.randrange(len(near))] = word()
            docs[10 * i + 1 + k] = " ".join(near + [word() for _ in range(rng.randrange(8))])
    return docs


def keep_all(rows, common):
    """The kept ids with another order of the tokens."""
    near_copies.COMMON, before = common, near_copies.COMMON
    try:
        return simhash.keep_one(rows)
    finally:
        near_copies.COMMON = before


@pytest.mark.parametrize("common", [2, 100])
def test_pairs_from_the_threshold_on_are_found(spark, common):
    docs = some_documents(common)
    kept, similarities = kept_by_hand(docs)
    assert sum(0.8 <= s < 0.95 for s in similarities) > 20 and sum(0.7 <= s < 0.8 for s in similarities) > 5
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_all(rows, common).collect()) == kept


def test_ties_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (None, text, "c"), (2, text.upper(), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string").selectExpr("*", "_text as _row", "_text as node", "_text as component")
    first = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert len(first) == 1 and first[0][0] == 1 and first[0][2] in "ab"
    assert [tuple(r) for r in simhash.keep_one(docs.orderBy("_text").repartition(3)).collect()] == first


def test_the_pipeline_drops_near_copies(spark):
    docs = some_documents(7)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()) == kept_by_hand(docs)[0]


def test_sketches_differ_in_no_more_bits_than_sets_do():
    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 500, 9000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
        for gone in (0, size // 10, size):
            b = np.unique(np.concatenate([a[gone:], rng.integers(-(2**63), 2**63 - 1, gone)]))
            differ = sum(int(x).bit_count() for x in (near_copies.sketch(a) ^ near_copies.sketch(b)).view(np.uint64))
            assert differ <= len(np.setxor1d(a, b)) and (gone or not differ)
            assert gone != 50 or differ > 80


def template_pages(n, unique):
    """Pages of one template with ``unique`` words of their own after 200 shared ones."""
    shared = [f"t{k}" for k in range(200)]
    return [" ".join(shared + [f"p{page}x{k}" for k in range(unique)]) for page in range(n)]


@pytest.mark.parametrize("unique", [26, 35, 60])
def test_pages_of_one_template_that_are_not_similar_bring_no_pairs(spark, unique):
    made = []
    for n in (100, 200, 400):
        docs = spark.createDataFrame(list(enumerate(template_pages(n, unique))), "doc_id long, text string")
        rows = near_copies._shared(docs, 0.8, 5, near_copies.COMMON, counted=0.0)
        made.append(near_copies.open_pairs(rows.select("token", "node", "size", "pos", F.col("node").alias("part")), 0.8).count())
    assert made == [0, 0, 0]


def test_open_pairs_hold_all_similar_ones(spark):
    docs = some_documents(5)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    shared = near_copies._shared(rows, 0.8, 5, 2)
    pairs = {tuple(r) for r in near_copies.open_pairs(shared.select("token", "node", "size", "pos", F.col("node").alias("part")), 0.8).collect()}
    nodes = {near_copies.node_of(t.encode().lower().split()): shingle_set(t) for t in docs.values()}
    alike = {(min(a, b), max(a, b)) for a in nodes for b in nodes if a != b and len(nodes[a] & nodes[b]) / len(nodes[a] | nodes[b]) >= 0.8}
    assert len(alike) > 20 and alike <= pairs


def test_template_pages_among_others(spark):
    """Templates that similar and dissimilar pages have, with copies of some, all in one table."""
    docs = dict(enumerate(template_pages(60, 26) + [x.replace("t", "s") for x in template_pages(40, 20)] + [x.replace("t", "r") for x in template_pages(40, 60)]))
    docs |= {1000 + k: docs[k] + " more" for k in (3, 70, 120)}
    kept, _ = kept_by_hand(docs)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(rows).collect()) == kept


def edited_copies(n, edits):
    """Copies of one text with ``edits`` words of their own each, far enough apart to change five shingles each."""
    rng, words = random.Random(n), [f"w{k}" for k in range(150)]
    copies = []
    for copy in range(n):
        mine = list(words)
        for place in rng.sample(range(2, 29), edits):
            mine[5 * place] = f"e{copy}x{place}"
        copies.append(" ".join(mine))
    return copies


def test_edited_copies_that_are_not_similar_bring_no_pairs(spark):
    """Each has so few shingles of its own that it meets every other at a common token."""
    made = []
    for n in (50, 100, 200):
        docs = spark.createDataFrame(list(enumerate(edited_copies(n, 3))), "doc_id long, text string")
        rows = near_copies._shared(docs, 0.8, 5, near_copies.COMMON, counted=0.0).select("token", "node", "size", "pos", F.col("node").alias("part"))
        assert near_copies.open_pairs(rows, 0.8).count() == n * (n - 1) // 2
        held = simhash._word_nodes(docs, 5).select("node", "sketch")
        made.append(near_copies.open_pairs(rows, 0.8, held).count())
    texts = edited_copies(200, 3)
    similar = sum(len(a & b) / len(a | b) >= 0.8 for k, a in enumerate(map(shingle_set, texts)) for b in map(shingle_set, texts[:k]))
    assert similar <= made[-1] < 100 and made[0] < 25 and made[1] < 50


def test_folded_sketches_rule_out_no_similar_pair(spark):
    docs = some_documents(5)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    shared = near_copies._shared(rows, 0.8, 5, 2).select("token", "node", "size", "pos", F.col("node").alias("part"))
    held = simhash._word_nodes(rows, 5).select("node", "sketch").dropDuplicates(["node"])
    pairs = {tuple(r) for r in near_copies.open_pairs(shared, 0.8, held).collect()}
    nodes = {near_copies.node_of(t.encode().lower().split()): shingle_set(t) for t in docs.values()}
    alike = {(min(a, b), max(a, b)) for a in nodes for b in nodes if a != b and len(nodes[a] & nodes[b]) / len(nodes[a] | nodes[b]) >= 0.8}
    assert len(alike) > 20 and alike <= pairs


def test_edited_copies_among_others(spark):
    docs = dict(enumerate(edited_copies(60, 1) + edited_copies(61, 2) + edited_copies(62, 3) + edited_copies(63, 4)))
    kept, _ = kept_by_hand(docs)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert 20 < len(kept) < len(docs) and sorted(r.doc_id for r in simhash.keep_one(rows).collect()) == kept
