"""Benchmark decontamination with SimHash windows.

Texts become words (lower case; letters and digits of any script). For each length of a benchmark item, a
window of as many words slides over a document; its SimHash is looked up in the Hamming
blocks of the items of that length: with ``radius`` + 1 blocks, a fingerprint within the
radius has at least one block in common, so none is missed. What is fetched is checked
over all bits, and then by the weighted Jaccard similarity of the five-word shingles
themselves.

Most windows need no fingerprint: where too few shingles of a window occur in any item, no
item can reach the similarity, which running sums tell for all windows at once.

At the radius that a similarity of 0.8 takes (20 of 64 bits, blocks of three bits) nearly
all items of a length share some block with a window, so the blocks guarantee and the
running sums are what prunes; windows are looked up a few at a time, so that pairs in
memory stay bounded however many items have one length.

The items go to every task in blocks of bounded size, one pass over the documents a block.

Defined results: null and empty texts match nothing, on both sides; an item of fewer than
five words is one shingle and matches only itself; a document shorter than an item is one
window; equal items and repeated rows each have their matches; of the windows of one item
the most similar, then the first, is reported.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.tables import cut_lineage, texts

SHINGLE, BITS = 5, 64
#: UTF-8 bytes of items that tasks hold at once.
BLOCK_BYTES = 16 << 20
#: Characters cut into words at once.
PIECE = 1 << 20
FILTER_BITS = 22
#: Pairs of a window and an item that are looked at together, about.
PAIRS = 1 << 22
#: What isn't a letter or digit reads as a space: ASCII by its bytes, all else by pattern.
OTHER_MARKS = re.compile(r"[^\w\x00-\x7f]+")
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalnum():
            end += 1
        piece = text[at:end].lower()
        if not piece.isascii():
            piece = OTHER_MARKS.sub(" ", piece)
        yield piece.encode("utf-8", "replace").translate(WORD_BYTES).split()
        at = end


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word numbers; 0 where a word isn't in any item."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        h = _mixed(h + part.astype(np.uint64) + np.uint64(1))
        known &= part >= 0
    return np.where(known, h | np.uint64(1), np.uint64(0))


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 signed sums to fingerprints: a bit is set where its sum is positive."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """What each shingle adds to the sums; one with a word that no item has adds nothing."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.int8) * 2 - 1) * (hashes > 0)[:, None]


class Items:
    """A block of benchmark items, ready for matching."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        self.vocabulary: dict[bytes, int] = {}
        self.ids: dict[int, list[int]] = {}
        number = []
        for item, text in rows:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary)) for piece in words(text) for w in piece]
            if found:
                self.ids[len(number)] = found
                number.append(item)
        self.number = number
        edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
        self.cuts = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.lengths: dict[int, list[int]] = defaultdict(list)
        pairs: dict[int, list[np.ndarray]] = defaultdict(list)
        self.prints, self.bags = {}, {}
        for i, found in self.ids.items():
            size = min(SHINGLE, len(found))
            h = _shingles(np.array(found, np.int64), size)
            pairs[size].append(np.stack([h, np.full(len(h), len(found), np.uint64)]))
            self.lengths[len(found)].append(i)
            self.prints[i] = _fingerprints(_signs(h).sum(0, keepdims=True, dtype=np.int64))[0]
            self.bags[i] = self._bag(found, size)
        self.tables = {length: self._table(items) for length, items in self.lengths.items()}
        # by shingle size: a bit filter, the hashes in order, and for each the lengths of the items that have it
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in pairs.items():
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            known, first, n = np.unique(both[0], return_index=True, return_counts=True)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[known >> np.uint64(64 - FILTER_BITS)] = True
            self.known[size] = bits, known, np.stack([first, n]), both[1].astype(np.int64)

    def _table(self, items: list[int]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The items of one length, their fingerprints, and by block the values in order with the places they stand at."""
        prints = np.array([self.prints[i] for i in items], np.uint64)
        blocks = []
        for shift, mask in self.cuts:
            values = prints >> shift & mask
            order = np.argsort(values, kind="stable")
            blocks.append((values[order], order))
        return np.array(items), prints, blocks

    def _near(self, length: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) for all fingerprints within the radius of an item of ``length``."""
        items, theirs, blocks = self.tables[length]
        pairs = []
        for (shift, mask), (values, order) in zip(self.cuts, blocks, strict=True):
            mine = prints >> shift & mask
            low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            n = high - low
            window = np.repeat(np.arange(len(prints)), n)
            place = order[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low, n)]
            near = np.bitwise_count(prints[window] ^ theirs[place]) <= self.radius
            pairs.append(window[near] * len(items) + place[near])
        found = np.unique(np.concatenate(pairs))
        return list(zip((found // len(items)).tolist(), items[found % len(items)].tolist(), strict=True))

    @staticmethod
    def _bag(found: list[int], size: int) -> Counter:
        return Counter(zip(*[found[k:] for k in range(size)], strict=False))

    def _alike(self, bag: Counter, item: int) -> float:
        """Weighted Jaccard similarity of shingle bags."""
        other = self.bags[item]
        return (bag & other).total() / max(1, (bag | other).total())

    def _least_hits(self, length: int, size: int, shingles: int) -> int:
        """Shingles that a window has in common with an item of ``length``, at least, if it is similar enough."""
        t = self.similarity
        return max(1, int(np.ceil(t / (1 + t) * (shingles + length - size + 1) - 1e-9)))

    def matches(self, text: str) -> dict[int, tuple[float, int, int]]:
        """By item: the best similarity, and the first word and the length of its window."""
        get = self.vocabulary.get
        ids = [np.fromiter(map(get, piece, repeat(-1)), np.int64, len(piece)) for piece in words(text)]
        best: dict[int, tuple[float, int, int]] = {}
        if not ids:
            return best
        ids = np.concatenate(ids)
        for size, (bits, known, spans, lengths) in self.known.items():
            h = _shingles(ids, size)
            hit = np.flatnonzero(bits[h >> np.uint64(64 - FILTER_BITS)] & (h > 0))
            at = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
            same = known[at] == h[hit]
            if same.any():
                first, n = spans[:, at[same]]
                of = lengths[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)]
                where = np.repeat(hit[same], n)
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[order])) + 1
                for part in np.split(order, cuts):
                    self._in_windows(ids, h, where[part], int(of[part[0]]), size, best)
        return best

    def _in_windows(self, ids: np.ndarray, h: np.ndarray, hit: np.ndarray, length: int, size: int, best: dict) -> None:
        """Match the items of ``length``; ``hit``: where a shingle of one of them stands."""
        width = min(length, len(ids)) - size + 1  # shingles of a window
        least = self._least_hits(length, size, width)
        if len(hit) < least:
            return
        running = np.zeros(len(h) + 1, np.int64)
        running[hit + 1] = 1
        running = running.cumsum()
        starts = np.flatnonzero(running[width:] - running[:-width] >= least)
        if len(starts):
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):  # windows that may overlap
                step = max(1, min(4096, PAIRS // len(self.tables[length][0])))
                for k in range(0, len(group), step):
                    part = group[k : k + step]
                    first = int(part[0])
                    sums = np.zeros((int(part[-1]) + width - first + 1, BITS), np.int64)
                    np.cumsum(_signs(h[first : int(part[-1]) + width]), axis=0, out=sums[1:])
                    prints = _fingerprints(sums[part - first + width] - sums[part - first])
                    for w, i in self._near(length, prints):
                        start, n = int(part[w]), width + size - 1
                        alike = self._alike(self._bag(ids[start : start + n].tolist(), size), i)
                        if alike >= self.similarity and (i not in best or alike > best[i][0]):
                            best[i] = (alike, start, n)


def item_blocks(benchmark: DataFrame, similarity: float = 0.8, radius: int = 20, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of ``block_bytes`` of text at most (or one item), read one after another."""
    rows, size = [], 0
    for r in benchmark.where(F.length("text") > 0).select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        more = len(r["text"].encode())
        if rows and size + more > block_bytes:
            yield Items(rows, similarity, radius)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += more
    if rows:
        yield Items(rows, similarity, radius)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, window_start and window_words for each item that a document holds."""
    schema = "doc_id long, item_id long, similarity double, window_start long, window_words long"

    def one(items: Items) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for batch in batches:
                out = [(d, held.number[i], *found) for d, x in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for i, found in sorted(held.matches(x).items())]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "window_start", "window_words"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    found = None
    for items in item_blocks(benchmark, similarity, radius, block_bytes):
        found = one(items) if found is None else found.unionByName(one(items))
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Where the items fill several blocks, each block has stages of its own that name the
    texts it finds by 128 bits of hash, so that no worker holds more than one block.
    """

    def leaks(items: Items) -> Column:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        @F.pandas_udf("boolean")
        def found(column):
            return column.fillna("").map(lambda x: bool(sent.value.matches(x))).astype(bool)

        return found(F.col("text"))

    blocks = item_blocks(benchmark, similarity, radius, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.where(~leaks(first))
    key = F.struct(F.xxhash64("text").alias("x"), F.xxhash64("text", F.lit(1)).alias("y"))
    named = None
    for items in chain((first, second), blocks):
        one = cut_lineage(docs.where(leaks(items)).select(key.alias("k")).distinct())
        named = one if named is None else named.unionByName(one)
    # the rows travel as one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("k"))
    return rows.join(named.distinct(), "k", "left_anti").select("row.*")
