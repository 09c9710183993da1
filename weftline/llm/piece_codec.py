"""Encoding and decoding with a merge-type (BPE) SentencePiece vocabulary.

The encoder never runs the merge loop. For a stretch of text it fills a table with, for
each prefix, the one token that ends the encoding of that prefix: an Aho-Corasick
automaton lists the vocabulary pieces that end at each position, and the piece that is
compatible with the last token of the prefix before it is the one. Two tokens are
compatible if merging their joined text leaves exactly those two; that is decided by
undoing merges around the seam. The ids are then read off the table backwards.

Texts are cut where no piece reaches across (before a space, around a line feed), so a
stretch is about a word, and each task keeps the stretches it has encoded.

Runs of spaces are pieces of one equal, lowest score, so they merge last and from the
left: what other merges leave of a run falls into pieces of the longest run length and a
short rest, whose pieces are tabulated.

Defined results: a null text is empty, and an empty text has the begin and end ids alone;
characters outside the vocabulary become byte pieces; a literal space symbol reads as a
space, as the library has it; decoding drops the one space that encoding put in front.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Stretches of text whose encoding a task remembers.
REMEMBERED = 400_000


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a vocabulary; it is sent to the tasks, a megabyte at most."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    special_ids: tuple[int, ...]
    begin_id: int
    end_id: int


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    """Read the vocabulary from a model file on the driver."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(processor.get_piece_size())
    of_byte = {processor.id_to_piece(i): i for i in ids if processor.is_byte(i)}
    return PieceModel(
        tuple(processor.id_to_piece(i) for i in ids),
        tuple(processor.get_score(i) for i in ids),
        tuple(of_byte[f"<0x{b:02X}>"] for b in range(256)),
        tuple(i for i in ids if processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)),
        processor.bos_id(),
        processor.eos_id(),
    )


class PieceCodec(dict):
    """Encodes and decodes; as a dict, it holds the ids of the stretches met so far."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        not_text = {*model.byte_ids, *model.special_ids}
        self.ids = {p: i for i, p in enumerate(model.pieces) if i not in not_text}
        runs = {len(p): i for p, i in self.ids.items() if p.strip(SPACE) == ""}
        if any(SPACE in p.lstrip(SPACE) or len(p) - len(p.lstrip(SPACE)) > 1 for p in self.ids if len(p) not in runs or p.strip(SPACE)):
            raise ValueError("a piece reaches across a space; this vocabulary can't be cut at spaces")
        self.runs = runs
        self.longest = max(runs)
        self.rests = [self._run(n) for n in range(2 * self.longest)]
        if any(self.rests[n + self.longest] != [runs[self.longest], *self.rests[n]] for n in range(self.longest)):
            raise ValueError("long runs of spaces must begin with the longest piece")
        words = {p: i for p, i in self.ids.items() if p.strip(SPACE) or len(p) == 1}
        ranked = sorted((i for p, i in words.items() if len(p) > 1), key=lambda i: -model.scores[i])
        if len({model.scores[i] for i in ranked}) < len(ranked):
            raise ValueError("two pieces have one score; their order of merging isn't defined")
        #: the order of merging; single characters are there from the start
        self.rank = {i: 0 for p, i in words.items() if len(p) == 1} | {i: n + 1 for n, i in enumerate(ranked)}
        self.words = words
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for i in ranked:
            self._split(i)
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in words.items():
            if len(p) == 1 or i in self.parts:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        out = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            out[i] = bytes([b])
        for i in model.special_ids:
            out[i] = b""
        self.out = out
        self.four = [i.to_bytes(4, "little") for i in range(len(model.pieces))]

    def _run(self, n: int) -> list[int]:
        """Ids of a short run of spaces: the best score merges first, then the leftmost."""
        sizes = [1] * n
        while pairs := [(-self.model.scores[self.runs[a + b]], k) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)) if a + b in self.runs]:
            k = min(pairs)[1]
            sizes[k : k + 2] = [sizes[k] + sizes[k + 1]]
        return [self.runs[x] for x in sizes]

    def _split(self, token: int) -> None:
        """Find the two tokens whose merge makes ``token``: the cut whose halves stay two."""
        text = self.model.pieces[token]
        for cut in range(1, len(text)):
            left, right = self.words.get(text[:cut]), self.words.get(text[cut:])
            if left is None or right is None or any(len(self.model.pieces[x]) > 1 and x not in self.parts for x in (left, right)):
                continue
            if max(self.rank[left], self.rank[right]) < self.rank[token] and self._stay(left, right):
                self.parts[token] = (left, right)
                self.joined[left, right] = token
                return

    def _merge(self, left: int, right: int) -> int | None:
        """The rank at which two neighbours merge, into a token that can be reached at all."""
        token = self.words.get(self.model.pieces[left] + self.model.pieces[right])
        return None if token is None else self.rank[token]

    def _stay(self, left: int, right: int) -> bool:
        """Whether no merge crosses the seam before both tokens are complete.

        Walk back in time: ``left`` and ``right`` are what touches the seam, and they do so
        until the later-made of the two is undone. While they touch, their own merge must
        not come up. Equal merges happen from the left, so one that made the left token
        comes before an equal merge at the seam, and that before one inside the right.
        """
        until: tuple[float, int] | None = None  # the time up to which left and right touch; none: to the end of these
        ends = max((self.rank[left], 0), (self.rank[right], 2))
        first = True
        while True:
            merge = self._merge(left, right)
            if merge is not None and not first and (merge, 1) < until:
                return False
            if merge is not None and first and (merge, 1) < ends:
                return False
            first = False
            made_left, made_right = (self.rank[left], 0), (self.rank[right], 2)
            if made_left[0] == 0 and made_right[0] == 0:
                return True
            if made_left > made_right:
                until = made_left
                left = self.parts[left][1]
            else:
                until = made_right
                right = self.parts[right][0]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the joined text of two tokens encodes to just those two; remembered."""
        if len(self.compatible) > 500_000:
            self.compatible.clear()
        fit = self.compatible[left << 20 | right] = self._merge(left, right) is None and self._stay(left, right)
        return fit

    def _word(self, text: str) -> list[int]:
        """Ids of a stretch with one space in front at most."""
        last = [-1] * len(text)  # by prefix: the token that ends it; -1 for a character outside the vocabulary
        start = list(range(len(text)))
        compatible, fits = self.compatible.get, self._fits
        for end, (length, token) in self.automaton.iter(text):
            if last[end] < 0:
                at = end - length
                if at < 0 or (before := last[at]) < 0 or (fit := compatible(before << 20 | token)) or fit is None and fits(before, token):
                    last[end] = token
                    start[end] = at + 1
        ids: list[int] = []
        end = len(text) - 1
        while end >= 0:
            if last[end] < 0:
                ids.extend(self.model.byte_ids[b] for b in reversed(text[end].encode()))
            else:
                ids.append(last[end])
            end = start[end] - 1
        return ids[::-1]

    def _stretch(self, text: str) -> list[int]:
        """Ids of a stretch: spaces, then what follows them."""
        word = text.lstrip(SPACE)
        spaces = len(text) - len(word)
        if not word:
            ids = []
        elif not spaces:
            return self._word(word)
        else:
            ids = self._word(SPACE + word)
            if ids[0] == self.ids[SPACE]:
                ids = ids[1:]
            else:
                spaces -= 1
        whole, rest = divmod(spaces, self.longest)
        return [self.runs[self.longest]] * whole + self.rests[rest] + ids

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[stretch] = b"".join([self.four[i] for i in self._stretch(stretch)])
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids of a text, little-endian in four bytes each, begin and end included."""
        got = map(self.__getitem__, STRETCH.findall(SPACE + text.replace(" ", SPACE))) if text else ()
        return b"".join((self.four[self.model.begin_id], *got, self.four[self.model.end_id]))

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of ids; the space in front is dropped, bytes that aren't UTF-8 become U+FFFD."""
        out = self.out
        joined = b"".join([out[i] for i in ids])
        joined = joined[1:] if joined[:1] == b" " else joined
        try:
            joined.decode()
        except UnicodeDecodeError:
            joined = joined.decode("utf-8", "replace").encode()
        return joined


#: Spaces and what follows them up to the next space or line feed; a line feed is never part of a longer piece.
STRETCH = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@lru_cache(maxsize=2)
def codec(model: PieceModel) -> PieceCodec:
    """One codec a Python worker."""
    return PieceCodec(model)


def encode_documents(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, ids (array of int, begin and end included) and decoded text of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(model)
        for batch in batches:
            # ids stay packed until Arrow has them; as Python numbers, a batch's would take ten times as much
            packed, decoded = [], []
            for text in batch.column(1):
                packed.append(encode(text.as_py() or ""))
                decoded.append(encode.decode(memoryview(packed[-1]).cast("I").tolist()))
            ends = np.cumsum([0, *[len(x) // 4 for x in packed]], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what ``encode_documents`` returns, taken in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(model)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(encode.decode(memoryview(ids).cast("I").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
