"""Encoding and decoding with a byte-level BPE vocabulary given as ranks.

A text is cut into chunks that overlap, and every chunk is split into pre-tokens and these
into ids on its own, wherever Spark puts it. Where a chunk begins inside a pre-token its
first boundaries are wrong, but they soon fall onto those of the chunk before: at the first
boundary inside the overlap that both have, the ids of the one are followed by those of the
other. From a common boundary on both split alike, as what follows in a text is all that
decides a pre-token, so the result is that of the whole text.

A pre-token never goes on from a character into white space, so every chunk has a boundary
there, and an overlap is made to hold such a place: where its ``overlap`` characters have
none (a stretch of text without spaces), it reaches to the next one. Boundaries whose
pre-token touches the chunk's end aren't trusted.

Texts of one chunk have nothing to stitch and stay where they were read; only the chunks of
longer ones are shuffled. Equal rows are encoded once and counted.

Defined results: a null text is empty, and an empty text has no ids; special tokens are
ordinary text; decoding gives the bytes of the ids one after another; rows that are repeated
come out as often as they went in; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.blobs import groups, portions
from weftline.llm.tables import release_memory, texts

#: Code points of a chunk and of what it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Pre-tokens whose ids a worker remembers, and the longest of them, which bound its memory.
REMEMBERED, LONGEST = 1 << 18, 40
#: Bytes of a pre-token up to which it is merged together with the others.
SHORT = 200
#: The end of a stretch without white space.
STRETCH_END = regex.compile(r"\S(?=\s)")


@dataclass(frozen=True)
class Ranks:
    """A vocabulary (the bytes of each id, in the order of merging) and the pattern of its pre-tokens; sent to the tasks, a megabyte at most."""

    tokens: tuple[bytes, ...]
    pattern: str


@lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str) -> Ranks:
    """Read a rank file (a token in base64 and its rank a line) on the driver."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must count up from 0 without gaps")
    if {bytes([b]) for b in range(256)} - {token for _, token in ranked}:
        raise ValueError("a byte has no token of its own")
    return Ranks(tuple(token for _, token in ranked), pattern)


class PairTable:
    """Which token two neighbouring tokens make: a hash table in arrays, asked for many pairs at once."""

    def __init__(self, rank: dict[bytes, int]):
        pairs = [(rank[token[:cut]], rank[token[cut:]], k) for token, k in rank.items() for cut in range(1, len(token)) if token[:cut] in rank and token[cut:] in rank]
        left, right, made = np.array(pairs or [(0, 0, 0)][:0], np.int64).reshape(-1, 3).T
        self.never = len(rank)
        self.bits = max(8, int(4 * len(pairs)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.never, np.int64)
        keys = left << 32 | right
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.made[slot[placed]] = made[placed]
            keys, made, slot = keys[~placed], made[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that the pairs make; ``never`` where they make none."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out, asked = np.full(len(keys), self.never, np.int64), np.arange(len(keys))
        while len(asked):
            there = self.keys[slot]
            found = there == keys
            out[asked[found]] = self.made[slot[found]]
            on = ~found & (there != -1)
            asked, keys, slot = asked[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class ByteCodec(dict):
    """Splits, encodes and decodes; as a dict, it holds the packed ids of the pre-tokens of the portion at hand and the short ones before."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.tokens = ranks.tokens
        self.rank = {token: k for k, token in enumerate(ranks.tokens)}
        self.makes = PairTable(self.rank)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(ranks.pattern).findall

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens that aren't tokens: of all neighbours that make a token those of the least rank merge first, then the leftmost; in all pre-tokens at once."""
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        never, done = self.makes.never, []
        made = np.full(len(ids), never, np.int64)
        inner = np.flatnonzero(of[1:] == of[:-1])
        made[inner] = self.makes(ids[inner], ids[inner + 1])
        while len(ids):
            least = np.minimum.reduceat(made << 32 | np.arange(len(ids)), np.flatnonzero(groups(of)))
            merge = least >> 32 < never
            at = (least & 0xFFFFFFFF)[merge]
            over = ~np.isin(of, of[at], kind="table")
            if over.any():
                done.append((of[over], ids[over]))
            ids[at] = (least >> 32)[merge]
            stay = ~over
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            ids, of, made = ids[stay], of[stay], made[stay]
            for left in (at, at[at > 0] - 1):
                made[left] = never
                left = left[left + 1 < len(ids)]
                left = left[of[left] == of[left + 1]]
                made[left] = self.makes(ids[left], ids[left + 1])
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        packed = ids[np.argsort(of, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(of, minlength=len(pieces)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merged_long(self, piece: bytes) -> bytes:
        """The same for one long pre-token, in time that grows little faster than it: pairs wait in a heap, parts are linked."""
        ids, n = self.of_byte[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        rank, tokens = self.rank.get, self.tokens
        joined = lambda x, y: rank(tokens[x] + tokens[y])
        after, before = list(range(1, n + 1)), list(range(-1, n))
        queue = [(made, k) for k in range(n - 1) if (made := joined(ids[k], ids[k + 1])) is not None]
        heapify(queue)
        while queue:
            made, k = heappop(queue)
            right = after[k]
            if ids[k] < 0 or right == n or joined(ids[k], ids[right]) != made:
                continue  # one of the two has merged with another since
            ids[k], ids[right] = made, -1
            after[k] = after[right]
            before[after[k]] = k
            for left in (k, before[k]):
                if left >= 0 and after[left] < n and (new := joined(ids[left], ids[after[left]])) is not None:
                    heappush(queue, (new, left))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Hold the ids of these pre-tokens; of earlier ones, those of a moderate number are kept."""
        for piece in [x for x in self.long if x not in pieces]:
            del self[piece]
        if len(self) > REMEMBERED:
            kept = {x: self[x] for x in pieces & self.keys()}
            self.clear()
            self.update(kept)
        new = list(pieces - self.keys())
        self.long = {x for x in pieces if len(x) > LONGEST}
        if not new:
            return
        raw = [x.encode() for x in new]
        self.update((x, self.rank[y].to_bytes(4, "little")) for x, y in zip(new, raw, strict=True) if y in self.rank)
        self.update((x, self._merged_long(y)) for x, y in zip(new, raw, strict=True) if len(y) > SHORT and x not in self)
        if rest := [(x, y) for x, y in zip(new, raw, strict=True) if x not in self]:
            self.update(zip([x for x, _ in rest], self._merged([y for _, y in rest]), strict=True))

    long: set[str] = set()

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text; their ids are held until the next call."""
        pieces = [self.split(x) for x in texts]
        self.learn(set().union(*pieces))
        return pieces

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian in four bytes each."""
        return [b"".join(map(self.__getitem__, x)) for x in self.split_all(texts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(maxsize=2)
def codec(ranks: Ranks) -> ByteCodec:
    """One codec a Python worker."""
    return ByteCodec(ranks)


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, shared_to, shared_from) of each chunk.

    Up to ``shared_to`` a chunk repeats what the one before has, from ``shared_from`` on the
    next one repeats it. The stretch that two share ends in a boundary of both, one character
    before the first one's end.
    """
    begin, shared_to = 0, 0
    while True:
        following = begin + chunk
        cut = STRETCH_END.search(text, following + overlap) if following < len(text) else None
        if cut is None:
            yield begin, len(text), shared_to, len(text)
            return
        following = max(following, cut.end() - chunk // 2)  # not many chunks within one long stretch
        yield begin, cut.end() + 1, shared_to, following
        begin, shared_to = following, cut.end()


def encode_chunk(encode: ByteCodec, pieces: list[str], begin: int, shared_to: int, shared_from: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The ids of a chunk of these pre-tokens, and its trusted boundaries in the shared stretches with the number of ids before each."""
    ids = list(map(encode.__getitem__, pieces))
    at = np.fromiter(accumulate(map(len, pieces), initial=begin), np.int64, len(pieces) + 1)
    n = np.fromiter(accumulate(map(len, ids), initial=0), np.int64, len(ids) + 1) // 4
    told = (at <= shared_to) | ((at >= shared_from) & (at < at[-1]))
    return b"".join(ids), at[told], n[told]


def stitch(parts: list[tuple[bytes, np.ndarray, np.ndarray]]) -> bytes:
    """The ids of a text from those of its chunks, in order; each is left for the next at their first common boundary."""
    out, first = [], 0
    for (ids, at, n), (_, next_at, next_n) in zip(parts, parts[1:], strict=False):
        common, mine, others = np.intersect1d(at, next_at, assume_unique=True, return_indices=True)
        if not len(common):
            raise ValueError("two chunks have no boundary in common")
        out.append(ids[4 * first : 4 * int(n[mine[0]])])
        first = int(next_n[others[0]])
    out.append(parts[-1][0][4 * first :])
    return b"".join(out)


Finish = Callable[[ByteCodec, list[bytes]], list[pa.Array]]
_CHUNK_SCHEMA = "doc_id long, hash string, begin long, shared_to long, shared_from long, chunk string"
_PART_SCHEMA = "doc_id long, hash string, begin long, copies long, ids binary, at binary, n binary"


def _encoded(docs: DataFrame, ranks: Ranks, finish: Finish, schema: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id and what ``finish`` makes of the packed ids of each document."""
    names = ["doc_id", *[field.split()[0] for field in schema.split(", ")]]
    schema = f"doc_id long, {schema}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks)
        for batch in portions(batches):
            got = finish(encode, encode.encode_all(texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *got], names)
        release_memory()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, digest, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                parts = list(chunks(text, chunk, overlap))
                begin, end, shared_to, shared_from = zip(*parts, strict=True)
                columns = [pa.array([doc_id.as_py()] * len(parts), pa.int64()), pa.array([digest.as_py()] * len(parts)), *[pa.array(x, pa.int64()) for x in (begin, shared_to, shared_from)], pa.array([text[a:b] for a, b in zip(begin, end, strict=True)])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "begin", "shared_to", "shared_from", "chunk"])

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks)
        for batch in portions(batches, 5):
            begin, shared_to, shared_from = (batch.column(c).to_pylist() for c in ("begin", "shared_to", "shared_from"))
            pieces = encode.split_all(texts(batch.column("chunk")))
            parts = [encode_chunk(encode, *x) for x in zip(pieces, begin, shared_to, shared_from, strict=True)]
            columns = [pa.array([f(x) for x in parts], pa.binary()) for f in (lambda x: x[0], lambda x: x[1].tobytes(), lambda x: x[2].tobytes())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "hash", "begin", "copies")] + columns, ["doc_id", "hash", "begin", "copies", "ids", "at", "n"])

    def join_parts(table: pa.Table) -> pa.Table:
        encode = codec(ranks)
        table = table.sort_by("begin")
        unpacked = lambda name: [np.frombuffer(x, np.int64) for x in table.column(name).to_pylist()]
        ids = stitch(list(zip(table.column("ids").to_pylist(), unpacked("at"), unpacked("n"), strict=True)))
        copies = table.column("copies")[0].as_py()
        return pa.Table.from_arrays([pa.array([table.column("doc_id")[0].as_py()] * copies, pa.int64()), *[pa.concat_arrays([x] * copies) for x in finish(encode, [ids])]], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~is_long).mapInArrow(whole, schema)
    cut_up = rows.where(is_long).select("doc_id", F.md5("text").alias("hash"), "text").mapInArrow(cut, _CHUNK_SCHEMA)
    # equal chunks of equal rows are one before they are shuffled
    spread = cut_up.groupBy("doc_id", "hash", "begin", "shared_to", "shared_from", "chunk").agg(F.count("*").alias("copies"))
    stitched = spread.mapInArrow(encode_parts, _PART_SCHEMA).groupBy("doc_id", "hash").applyInArrow(join_parts, schema)
    return short.unionByName(stitched)


def _ids_and_bytes(encode: ByteCodec, packed: list[bytes]) -> list[pa.Array]:
    ends = np.cumsum([0, *[len(x) // 4 for x in packed]], dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
    return [ids, pa.array([encode.decode(x) for x in packed], pa.binary())]


def _digests(encode: ByteCodec, packed: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([len(x) // 4 for x in packed], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
        pa.array([hashlib.sha256(encode.decode(x)).hexdigest() for x in packed], pa.string()),
    ]


def encode_documents(docs: DataFrame, ranks: Ranks, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids and the bytes they decode to, for each document."""
    return _encoded(docs, ranks, _ids_and_bytes, "ids array<int>, decoded binary", chunk, overlap)


def encode_digests(docs: DataFrame, ranks: Ranks, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what ``encode_documents`` returns, taken in the same task."""
    return _encoded(docs, ranks, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", chunk, overlap)
