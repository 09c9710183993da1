"""SimHash near-duplicate detection with multi-index hashing.

A fingerprint takes the majority of the bits of the XXH64 (seed 42) of all three-word
shingles, repeats included. Equal fingerprints are one node. Two nodes link if they differ
in ``radius`` bits at most. A fingerprint is cut into segments; of two that link, some
segment differs in ``radius // segments`` bits at most, so each looks up the small Hamming
ball around each of its segments in a table keyed by segment value, and what it fetches is
verified over all 64 bits. A segment value that very many fingerprints share is looked up
together with blocks of the bits outside the segment, one of which must be equal; where
such a block is still crowded, each of its fingerprints looks up the whole ball around
itself. So no bucket is ever paired with itself.

Defined results: a null or blank text has the fingerprint 0 and links like any other; a
text of one or two words has one shingle; copies share their component; a null doc_id
counts as larger than all others, and a component of such rows alone has a null id;
other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import near_copies
from weftline.llm.components import stars
from weftline.llm.tables import cut_lineage, release_memory, text_bytes

BITS = 64
#: Shingles hashed before their bits are counted.
AT_ONCE = 1 << 16
#: Fingerprints with one segment value above which the other bits join the key.
BUCKET = 500


def fingerprint(text: bytes, words_each: int = 3, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - words_each + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for first in range(0, n, AT_ONCE):
        last = min(n, first + AT_ONCE)
        starts = [0, *ends[: last - 1]] if first == 0 else ends[first - 1 : last - 1]
        stops = ends[first + words_each - 1 : last + words_each - 1] if len(words) >= words_each else ends[-1:]
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, stops, strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of the text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


def _cut(value: Column, bits: int, parts: int) -> list[tuple[Column, int]]:
    """The lowest ``bits`` bits of a number cut into ``parts``, with their widths."""
    edges = [bits * s // parts for s in range(parts + 1)]
    return [(F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < BITS else -1)), b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _ball(width: int, radius: int) -> list[int]:
    """What to flip in a segment to reach all values within ``radius``, as signed longs."""
    flips = [sum(1 << k for k in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in flips]


def _outside(fp: Column, segments: int, parts: int) -> Column:
    """By segment: (block number, block value) of the bits outside it, cut into ``parts``."""
    each = []
    for s in range(segments):
        a, b = BITS * s // segments, BITS * (s + 1) // segments
        low = fp.bitwiseAND(F.lit((1 << a) - 1))
        rest = low if b == BITS else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b), a))
        each.append(F.array(*[F.struct(F.lit(k).alias("block"), value.alias("part")) for k, (value, _) in enumerate(_cut(rest, BITS - (b - a), parts))]))
    return F.get(F.array(*each), F.col("segment"))


def links(nodes: DataFrame, radius: int = 2, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in ``nodes`` that differ in 1 to ``radius`` bits."""
    fp = F.col("fingerprint")
    table = nodes.select(fp.alias("b"), F.posexplode(F.array(*[s for s, _ in _cut(fp, BITS, segments)])).alias("segment", "value"))
    balls = [F.array(*[s.bitwiseXOR(F.lit(flip).cast("long")) for flip in _ball(w, radius // segments)]) for s, w in _cut(fp, BITS, segments)]
    probes = nodes.select(fp.alias("a"), F.posexplode(F.array(*balls)).alias("segment", "values")).select("a", "segment", F.explode("values").alias("value"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    key, blocked = ["segment", "value"], ["segment", "value", "block", "part"]
    hot = _hot(table, key, bucket)
    if hot.isEmpty():
        return probes.join(table, key).where(near).select("a", "b").distinct()
    found = probes.join(hot, key, "left_anti").join(table, key).where(near).select("a", "b")
    # within the radius, of radius + 1 blocks of the bits outside the segment one is equal
    keyed = lambda df, c: df.join(hot, key, "left_semi").select("*", F.inline(_outside(F.col(c), segments, radius + 1)))
    mine, theirs = keyed(probes, "a"), keyed(table, "b")
    crowded = _hot(theirs, blocked, bucket)
    if crowded.isEmpty():
        return found.unionByName(mine.join(theirs, blocked).where(near).select("a", "b")).distinct()
    found = found.unionByName(mine.join(crowded, blocked, "left_anti").join(theirs, blocked).where(near).select("a", "b"))
    # what is left looks up the whole ball around itself: every row that comes back is a link
    left = mine.join(crowded, blocked, "left_semi").select("a").distinct()
    ball = left.select("a", F.explode(F.array(*[F.lit(x).cast("long") for x in _ball(BITS, radius)[1:]])).alias("flip")).select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("b"))
    return found.unionByName(ball.where("a < b").join(nodes.select(fp.alias("b")), "b").select("a", "b")).distinct()


def _hot(table: DataFrame, key: list[str], bucket: int) -> DataFrame:
    """The keys that more than ``bucket`` rows have."""
    return cut_lineage(table.groupBy(*key).count().where(F.col("count") > bucket).select(*key))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (long) and component_id (the least doc_id reachable) of each document."""
    marked = cut_lineage(fingerprints(docs))
    last = F.lit(2**63 - 1)
    nodes = cut_lineage(marked.groupBy("fingerprint").agg(F.min(F.coalesce("doc_id", last)).alias("least")))
    parts = cut_lineage(nodes.join(stars(links(nodes, radius)).withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")))
    ids = parts.groupBy("component").agg(F.nullif(F.min("least"), last).alias("component_id"))
    return marked.join(parts.join(ids, "component"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, words_each: int = 5, radius: int = 3) -> DataFrame:
    """One row of each group of ``docs`` that similar pairs connect, with all its columns: that of the least doc_id.

    Similar means a Jaccard similarity of the ``words_each``-word shingles of ``similarity``
    or more. Fingerprints within ``radius`` bits give the first candidates, and each pair is
    verified over its shingles; ``near_copies`` finds the similar pairs whose fingerprints
    lie further apart.

    Null ids count as larger than all others. Of several rows with the least id the one
    whose text has the least hash stays, then the one whose other columns have the least
    hash; one of rows that are equal in all. The input's column names are free.
    """
    marked = cut_lineage(_word_nodes(docs, words_each))
    prints = cut_lineage(marked.groupBy("fingerprint").agg(F.min("node").alias("lead")))
    named = marked.select("fingerprint", "node").distinct().join(prints, "fingerprint")
    # one link of each fingerprint: a group's links grow with its square, and what these don't connect is found by shingles
    pairs = links(prints.select("fingerprint"), radius).groupBy("b").agg(F.min("a").alias("a"))
    ends = pairs.join(prints.select(F.col("fingerprint").alias("a"), F.col("lead").alias("x")), "a").join(prints.select(F.col("fingerprint").alias("b"), F.col("lead").alias("y")), "b").select("x", "y")
    same = named.where("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    candidates = ends.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    parts = stars(near_copies.links(docs, marked, candidates, similarity, words_each))
    grouped = marked.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row_hash")).alias("f")).select("f.*")
    # the input's columns travel as one, so that no name of theirs can clash, and once: equal rows meet where they are joined
    key = ["none", "id", "t", "h"]
    keyed = lambda id_, t, h: [id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), t.alias("t"), h.alias("h")]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keyed(docs["doc_id"], near_copies.text_hash(), row_hash(docs)))
    return rows.join(first.select(*keyed(F.col("doc_id"), F.col("text_hash"), F.col("row_hash"))), key).dropDuplicates(key).select("row.*")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns but the text."""
    return F.xxhash64(*[F.to_json(F.struct(docs[c])) if "map" in docs.schema[c].dataType.simpleString() else docs[c] for c in docs.columns if c != "text"])


def _word_nodes(docs: DataFrame, words_each: int) -> DataFrame:
    """doc_id, node (texts with the same words), fingerprint, number and sketch of the shingles, a hash of the text and one of the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.lower().split() for x in text_bytes(batch.column(1))]
            nodes = pa.array(map(near_copies.node_of, words), pa.int64())
            prints, sizes, sketches = [], [], []
            for w in words:
                h = near_copies.shingle_hashes(w, words_each)
                prints.append(_majority(h))
                h = np.unique(h.view(np.int64))
                sizes.append(len(h))
                sketches.append(near_copies.sketch(h).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), nodes, pa.array(np.array(prints, np.uint64).view(np.int64)), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), _longs(sketches)],
                ["doc_id", "node", "fingerprint", "text_hash", "row_hash", "size", "sketch"],
            )
        release_memory()

    return docs.select("doc_id", "text", near_copies.text_hash().alias("text_hash"), row_hash(docs).alias("row_hash")).mapInArrow(run, "doc_id long, node long, fingerprint long, text_hash long, row_hash long, size long, sketch array<long>")


def _longs(rows: list[bytes]) -> pa.Array:
    """A list array of the longs in each row's bytes."""
    offsets = np.cumsum([0, *[len(x) // 8 for x in rows]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int64)))


def _majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), AT_ONCE):
        counts += np.unpackbits(h[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
