"""Near copies by the Jaccard similarity of five-word shingles, all pairs of 0.8 or more.

The exact half of near-duplicate removal: fingerprints name the first candidates (see
``simhash.keep_one``), and what is similar with fingerprints that lie far apart is found here.

Texts with the same words (white space and ASCII case apart) are one node. The distinct
shingle hashes of all nodes are put in one order, those that many nodes have last. Two sets
of similarity ``similarity`` have one of their first ``size - ceil(similarity * size) + 1``
shingles in common, so only these are tokens that bring pairs together, and no pair is
missed. Of two sets the smaller one has it among still fewer, ``size - ceil(2 s / (1 + s) * size) + 1``
of them, and from their first common shingle on both must be long enough to hold what similar
sets have in common; what doesn't meet this is never paired, so pages of one template that
aren't similar bring no pairs together. Each node has a sketch of which of 2,048 bins hold an odd number of its shingles;
bins that differ are differing shingles at least, so sketches alone rule most pairs out, and
all others are compared over all their shingles. Edited copies of one text that are not similar
to each other have common tokens, so where all pairs are made, sketches folded to 512 bins are
compared where two nodes meet, and only pairs that these don't rule out become rows.

Of a token's nodes each is first compared with a leader, twice with another one. What is in
one component by then needs no more comparison, so a group of near copies isn't paired with
itself; all pairs of a token that lie in different components are then compared.

Defined results: null and blank texts are one node; a text of fewer than five words has one
shingle; repeats of a shingle count once; a null doc_id counts as larger than all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.components import stars
from weftline.llm.tables import cut_lineage, release_memory, release_shuffles, text_bytes

#: Nodes with a token beyond which it goes to the end of the order; any order is exact.
COMMON = 16
#: Tokens that go to the end at most (8 bytes each, sent to tasks).
COMMON_AT_ONCE = 1 << 20
LEADERS = 2
#: Bits of a sketch, that is 256 bytes.
SKETCH = 1 << 11
#: Longs of a folded sketch.
FOLDED = 8
#: Pairs whose shingles a task looks at together.
PAIRS = 64
#: Nodes a task remembers, so as to tell a repeated text's tokens once.
REMEMBERED = 1 << 16
#: Texts to compare up to which their hashes are sent to the documents, so that those aren't shuffled.
SENT = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_of(words: list[bytes]) -> int:
    """The number of the texts with these words, as a signed long."""
    h = xxhash.xxh64_intdigest(b" ".join(words), 1)
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(words: list[bytes], words_each: int = 5) -> np.ndarray:
    """A hash of each run of ``words_each`` words (or of all, if there are fewer)."""
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - words_each + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words_each, len(words))):
        h = _mixed(h + each[k : k + n] + np.uint64(1))
    return h


def shingles(words: list[bytes], words_each: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    return np.unique(shingle_hashes(words, words_each).view(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    """A bit for each bin, set if an odd number of the distinct hashes are in it, as longs.

    Two sets differ in at least as many elements as their sketches do in bits.
    """
    odd = np.bincount(h & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def tokens_of(h: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles, one of which every similar set has among its own first ones."""
    return h[: len(h) - ceil(similarity * len(h) - 1e-9) + 1]


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _tokens(docs: DataFrame, similarity: float, words_each: int, late: np.ndarray) -> DataFrame:
    """(token, node, size, pos): the tokens of each node and their places in its set; ``late`` ones come last in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, places, nodes, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
            for text in text_bytes(batch.column(0)):
                words = text.lower().split()
                node = node_of(words)
                if not words or node in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(node)
                h = shingles(words, words_each)
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                    h = np.concatenate([h[~last], h[last]])
                tokens.append(tokens_of(h, similarity))
                places.append(np.arange(len(tokens[-1])))
                nodes.append(node)
                sizes.append(len(h))
            n = [len(x) for x in tokens[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(nodes, np.int64), n)), pa.array(np.repeat(np.array(sizes, np.int64), n)), pa.array(np.concatenate(places))], ["token", "node", "size", "pos"])
        release_memory()

    return docs.select("text").mapInArrow(run, "token long, node long, size long, pos long")


def _common_tokens(tokens: DataFrame, common: int) -> np.ndarray:
    """The tokens that more than ``common`` nodes have: they go to the end of the order.

    Any order is exact; one that has frequent tokens last brings fewer pairs together. (A
    node that several tasks meet counts several times, which only sends more to the end.)
    """
    often = tokens.groupBy("token").count().where(F.col("count") > common).orderBy(F.desc("count"), "token").limit(COMMON_AT_ONCE)
    return np.sort(often.select("token").toArrow().column(0).to_numpy())


def _shared(docs: DataFrame, similarity: float, words_each: int, common: int, counted: float | None = None) -> DataFrame:
    """(token, node, size, pos) of the tokens that several nodes have, one of them among its first ones, in an order with the common ones last.

    Common ones are looked for among the tokens for the similarity ``counted``: among all shingles for 0.
    """
    late = _common_tokens(_tokens(docs, similarity if counted is None else counted, words_each, np.zeros(0, np.int64)), common)
    rows = _tokens(docs, similarity, words_each, late).repartition("token").distinct()
    of_token = Window.partitionBy("token")
    return rows.withColumn("n", F.count("*").over(of_token)).withColumn("first", F.max(_is_first(similarity)).over(of_token)).where("n > 1 and first").drop("n", "first")


def _texts_of(docs: DataFrame, held: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text of each of the nodes."""
    want = cut_lineage(held.select("node", F.col("text_hash").alias("_hash")).join(nodes, "node", "left_semi").select("_hash"))
    texts = docs.select("text", text_hash().alias("_hash")).join(F.broadcast(want) if want.count() <= SENT else want, "_hash", "left_semi")
    return texts.dropDuplicates(["_hash"]).select("text")


def _sets(docs: DataFrame, held: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """(node, its shingles in order as bytes) of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.lower().split() for x in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, words), pa.int64()), pa.array([shingles(w, words_each).tobytes() for w in words], pa.binary())], ["node", "shingles"])

    return _texts_of(docs, held, nodes).mapInArrow(run, "node long, shingles binary")


def _overlap(similarity: float) -> Column:
    """The shingles that two similar sets of ``size_a`` and ``size_b`` have in common at least."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-9)


def _is_first(similarity: float) -> Column:
    """Whether a token is among those, one of which a similar set of the same size or larger has among its own tokens."""
    return F.col("pos") <= F.col("size") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("size") - 1e-9)


def _most_apart(similarity: float) -> Column:
    """The shingles that two similar sets of ``size_a`` and ``size_b`` differ in at most."""
    return F.col("size_a") + F.col("size_b") - 2 * _overlap(similarity)


def _folded(name: str) -> list[Column]:
    """The sketch of fewer bins, each odd if an odd number of those that fall on it are, in columns ``name`` 0, 1, ..."""
    longs = SKETCH // 64
    return [reduce(Column.bitwiseXOR, [F.get("sketch", F.lit(j)) for j in range(k, longs, FOLDED)]).alias(f"{name}{k}") for k in range(FOLDED)]


def open_pairs(rows: DataFrame, similarity: float, held: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that may be similar, of ``rows`` (token, node, size, pos, part).

    With ``held``, which has the sketch of each node, pairs that are too far apart by it don't leave the join.

    The smaller one's (of equal ones, the lesser's) first tokens meet the tokens of the other. Similar
    sets meet at their first common token, from which on both are at least as long as what they have in common.
    """
    smaller = rows.where(_is_first(similarity)).select("token", F.col("node").alias("other"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"), F.col("part").alias("other_part"))
    larger = rows.withColumnRenamed("size", "size_a")
    order = (F.col("size_b") < F.col("size_a")) | (F.col("size_b") == F.col("size_a")) & (F.col("other") < F.col("node"))
    long_enough = F.least(F.col("size_a") - F.col("pos"), F.col("size_b") - F.col("pos_b")) >= _overlap(similarity)
    near = order & (F.col("size_b") >= similarity * F.col("size_a") - 1e-9) & long_enough & (F.col("part") != F.col("other_part"))
    if held is not None:
        larger = larger.join(held.select("node", *_folded("x")), "node")
        smaller = smaller.join(held.select(F.col("node").alias("other"), *_folded("y")), "other")
        near &= reduce(Column.__add__, [F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(FOLDED)]) <= _most_apart(similarity)
    return larger.join(smaller, "token").where(near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _alike(pairs: DataFrame, docs: DataFrame, held: DataFrame, similarity: float, words_each: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar; ``held`` has the size, the sketch and the hash of one text of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PAIRS):
                part, keep = batch.slice(k, PAIRS), []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    both = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                    keep.append(both >= similarity * ((len(x) + len(y)) // 8 - both) - 1e-9)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_both = lambda df, of: df.join(of.toDF("a", *[f"{c}_a" for c in of.columns[1:]]), "a").join(of.toDF("b", *[f"{c}_b" for c in of.columns[1:]]), "b")
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    may = cut_lineage(with_both(pairs, held.select("node", "size", "sketch")).where(differ <= _most_apart(similarity)).select("a", "b"))
    sets = _sets(docs, held, may.select(F.explode(F.array("a", "b")).alias("node")), words_each)
    return with_both(may, cut_lineage(sets)).select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long")


def _lead(rows: DataFrame, candidates: DataFrame | None, found: DataFrame | None, alike: Callable[[DataFrame], DataFrame], similarity: float, at_once: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of tokens that several parts have, links that connect what has been found, their stars): each node of a token compared with the token's leaders, ``at_once`` of them a round."""
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    near = (F.col("part") != F.col("other_part")) & (F.least("size", "other_size") >= similarity * F.greatest("size", "other_size") - 1e-9)
    for first in range(0, LEADERS, at_once):
        leads = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("part").alias("other_part"))) for k in range(first, min(LEADERS, first + at_once))]
        others = rows.groupBy("token").agg(F.array(*leads).alias("l")).select("token", F.inline("l")).drop("h")
        pairs = rows.join(others, "token").where(near).select(*pair)
        if candidates is not None and not first:
            pairs = pairs.unionByName(candidates)
        new = alike(pairs.distinct())
        release_shuffles(rows.sparkSession)
        parts = stars(new if found is None else found.unionByName(new))
        found = parts.toDF("a", "b")  # connects what the links did, in fewer rows
        now = _in_parts(rows, parts)
        # of tokens with two nodes all pairs have been compared
        open_ = now.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("token")
        rows = cut_lineage(now.join(open_, "token", "left_semi"))
        del now, open_, pairs, others  # with them goes what was shuffled for them
        release_shuffles(rows.sparkSession)
        if rows.isEmpty():
            break
    return rows, found, parts


def _in_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.select("token", "node", "size", "pos").join(parts.select("node", F.col("component").alias("part")), "node", "left").select("token", "node", "size", "pos", F.coalesce("part", "node").alias("part"))


def links(docs: DataFrame, marked: DataFrame, candidates: DataFrame, similarity: float = 0.8, words_each: int = 5) -> DataFrame:
    """Pairs (a, b) of nodes that similar pairs connect, enough of them to connect all that those do.

    ``marked`` has the node, text_hash and sketch of each document. The similar ones among the pairs
    (a, b) of ``candidates`` are taken first.

    Tokens that few nodes have bring few pairs. The nodes of the others that are still in
    several parts, mostly pages of one template, are taken again by themselves, in an order
    by the counts of all their shingles, so that their own words come first: a similar pair
    that meets first at a common token in the first order has both its nodes among them.
    """
    held = cut_lineage(marked.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min("text_hash").alias("text_hash")))
    alike = lambda pairs: cut_lineage(_alike(pairs, docs, held, similarity, words_each))
    rows = cut_lineage(_shared(docs, similarity, words_each, COMMON))
    rows, found, parts = _lead(rows.withColumn("part", F.col("node")), candidates, None, alike, similarity)
    if rows.isEmpty():
        return found
    hot = cut_lineage(rows.groupBy("token").count().where(F.col("count") > COMMON).select("token"))
    found = found.unionByName(alike(open_pairs(rows.join(hot, "token", "left_anti"), similarity)))
    crowded = cut_lineage(rows.join(hot, "token", "left_semi").select("node").distinct())
    if crowded.isEmpty():
        return found
    release_shuffles(docs.sparkSession)
    again = cut_lineage(_shared(_texts_of(docs, held, crowded), similarity, words_each, COMMON, counted=0.0))
    left, found, _ = _lead(cut_lineage(_in_parts(again, parts)), None, found, alike, similarity, at_once=LEADERS)
    return found if left.isEmpty() else found.unionByName(alike(open_pairs(left, similarity, held)))
