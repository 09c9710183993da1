"""Quality rules with n-gram perplexity.

A text in lower case is read as a sequence of pieces of three UTF-8 bytes, which begin anew at
each word with the space before it, so that a word has the same pieces wherever it stands. The model is a
modified Kneser-Ney model of the bigrams of pieces (n-grams of six bytes) for each
language, counted by Spark over all documents; nothing is folded or cut, so it grows with
what the documents have. It is a table of sorted arrays: a row has the codes of a range of
a language's bigrams beside their counts, or of a range of pieces beside what the formulas
need of them as first and as second ones, which the ranges of bigrams sum up for it. A bigram's
code is its six bytes, and the hash of the first five names its range, so that a piece that
very many bigrams begin with is spread over ranges. No task and no driver holds more than a range: a portion of
documents asks the ranges for its own distinct bigrams and pieces, each range looks them up
in its array, and the portion scores its documents with what comes back.

A document is scored by the others: its own counts are taken off the corpus's before the
formula is used, so that a word it made up is as unlikely as it would be elsewhere. Its
perplexity is by word: the sum over its pieces is divided by its number of words.

Each language has a band of perplexities around its median, its width a multiple of the
distance to the quartiles; documents above or below it are rejected. A text is judged by
its own language's model and band alone.

Defined results: a null text has no words; a text without a word has no perplexity and isn't kept;
a null lang is a language of its own, and any other string is one; a language that the
model doesn't know gives no perplexity; repeated rows are alike.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import blobs
from weftline.llm.tables import cut_lineage, texts

#: The base rule's characters.
SYMBOLS = frozenset(b"#*$%&|<>")
#: Bytes of a piece, and bits of its code.
PIECE, BITS = 3, 24
#: Bytes of text that a range of the model stands for, about.
BUCKET_BYTES = 64 << 20
#: Bits of a bigram's code that its range's name leaves out: bigrams that differ in them alone lie together.
TOGETHER = 8
#: Languages whose bands are sent to all tasks; with more of them, rows meet their bands by language.
MANY_LANGUAGES = 10_000
#: Ranges of pieces at most; every range of bigrams tells each of them what it knows.
PIECE_BUCKETS = 2000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text, and the code of each piece: a space and a word's bytes, three by three, the last ones filled up with spaces."""
    found = [x.lower().encode("utf-8", "replace") for x in texts_]
    raw = np.frombuffer(b" ".join(found), np.uint8)
    inner = np.flatnonzero((raw != 32) & ((raw < 9) | (raw > 13)))
    starts = np.flatnonzero(np.diff(inner, prepend=-2) > 1)  # of words, among the bytes that are in one
    size = np.diff(starts, append=len(inner))
    room = -(-(size + 1) // PIECE)
    at = PIECE * (np.cumsum(room) - room) + 1
    out = np.full(PIECE * int(room.sum()), 32, np.uint8)
    out[np.arange(len(inner)) + np.repeat(at - starts, size)] = raw[inner]
    ends = np.cumsum([len(x) + 1 for x in found], dtype=np.int64)
    doc = np.repeat(np.searchsorted(ends, inner[starts], "right"), room)
    x = out.reshape(-1, PIECE).astype(np.uint64)
    return doc, x[:, 0] << np.uint64(16) | x[:, 1] << np.uint64(8) | x[:, 2]


def bigrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text, and the code of each bigram; before the first piece stands code 0."""
    doc, w = pieces(found)
    v = np.concatenate([np.zeros(1, np.uint64), w[:-1]])[: len(w)]
    v[blobs.groups(doc)] = 0
    return doc, v << np.uint64(BITS) | w


def first_of(code: np.ndarray) -> np.ndarray:
    return code >> np.uint64(BITS)


def second_of(code: np.ndarray) -> np.ndarray:
    return code & np.uint64((1 << BITS) - 1)


def _range_of(piece: np.ndarray, buckets: int) -> np.ndarray:
    return blobs.range_bucket(blobs.spread((piece + np.uint64(1)) * FACTOR), buckets)


def _ranged(codes: np.ndarray, of: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """An order of sorted codes by range, sorted within each, and the codes of each range; ``of``: the pieces that name it."""
    bucket = _range_of(of, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, [(k, codes[order[a:b]]) for k, a, b in blobs.slices(bucket[order])]


def _bigram_ranges(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    return _ranged(codes, codes >> np.uint64(TOGETHER), buckets)


def _pack_codes(codes: np.ndarray) -> bytes:
    return blobs.ascending(codes << np.uint64(16))


def _codes(raw: bytes) -> np.ndarray:
    return blobs.from_ascending(raw) >> np.uint64(16)


# ``tongue`` is the language (``_tongue``). Slots below the number of bigram ranges are those
# ranges, the next ones the ranges of pieces; SUMS has numbers of the whole language.
ROWS = "tongue string, slot int, blobs array<binary>, sums array<long>"
SUMS = -1


def _tongue():
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*[(t, slot, blobs.pack(x), sums) for t, slot, x, sums in rows], strict=True)) or [()] * 4
    types = (pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], ["tongue", "slot", "blobs", "sums"])


def _of_classes(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, and 3 or more, and how many there are."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum()), len(counts)]


def _count(buckets: int) -> Callable:
    """Map (tongue, text): the distinct bigrams of each portion and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blobs.portions(batches):
            by = defaultdict(list)
            for tongue, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                by[tongue].append(text)
            rows = []
            for tongue, found in by.items():
                codes, n = np.unique(bigrams(found)[1], return_counts=True)
                order, parts = _bigram_ranges(codes, buckets)
                at = 0
                for k, part in parts:
                    rows.append((tongue, k, [_pack_codes(part), blobs.numbers(n[order[at : at + len(part)]])], None))
                    at += len(part)
            yield _rows(rows)

    return run


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and the sums of their columns of ``values``."""
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(blobs.groups(codes[order]))
    return codes[order][starts], np.add.reduceat(values[:, order], starts, axis=1) if len(starts) else values


def _by_piece_range(piece_buckets: int, *columns: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """By range of pieces: of each column (sorted pieces, rows of values), the pieces that fall into the range and their values."""
    parts = []
    for codes, values in columns:
        order, found = _ranged(codes, codes, piece_buckets)
        ends = np.cumsum([len(x) for _, x in found], dtype=np.int64).tolist()
        parts.append({k: (x, values[:, order[end - len(x) : end]]) for (k, x), end in zip(found, ends, strict=True)})
    none = [(codes[:0], values[:, :0]) for codes, values in columns]
    for k in sorted(set().union(*parts)):
        yield k, [blob for part, empty in zip(parts, none, strict=True) for codes, values in [part.get(k, empty)] for blob in (_pack_codes(codes), values.astype("<i8").tobytes())]


#: Numbers of a bigram or a second piece, and of a first piece.
WIDTHS = (1, 4)


def _from_blobs(found: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of blobs as sorted codes and the rows of their values."""
    return [(_codes(x), np.frombuffer(v, "<i8").reshape(width, -1)) for x, v, width in zip(found[::2], found[1::2], WIDTHS, strict=False)]


def _merge(buckets: int, piece_buckets: int) -> Callable:
    """Reduce a range of bigrams: its sorted array, and what it tells of second and of first pieces."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = [blobs.unpack(x) for x in table.column("blobs").to_pylist()]
        codes, n = _summed(np.concatenate([_codes(x[0]) for x in got]), np.concatenate([blobs.from_numbers(x[1]) for x in got])[None])
        tongue, slot, counts = key[0].as_py(), key[1].as_py(), n[0]
        rows = [(tongue, slot, [_pack_codes(codes), n.astype("<i8").tobytes()], None), (tongue, SUMS, [], [*_of_classes(counts), *[0] * 6])]
        # of a first piece: all bigrams, and the distinct ones that occur once, twice, more often
        stats = _summed(first_of(codes), np.stack([counts, counts == 1, counts == 2, counts >= 3]).astype(np.int64))
        second = _summed(second_of(codes), np.ones((1, len(codes)), np.int64))
        rows += [(tongue, buckets + k, found, None) for k, found in _by_piece_range(piece_buckets, second, stats)]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _merge_pieces(key: tuple, table: pa.Table) -> pa.Table:
    """Reduce a range of pieces: the sorted array of the second ones, with the distinct pieces before each, and that of the first ones with their sums."""
    got = [_from_blobs(blobs.unpack(x)) for x in table.column("blobs").to_pylist()]
    columns = []
    for k, width in enumerate(WIDTHS):
        held = [x[k] for x in got if len(x[k][0])]
        columns.append(_summed(np.concatenate([c for c, _ in held]), np.concatenate([v for _, v in held], axis=1)) if held else (np.zeros(0, np.uint64), np.zeros((width, 0), np.int64)))
    tongue, slot = key[0].as_py(), key[1].as_py()
    packed = [blob for codes, values in columns for blob in (_pack_codes(codes), values.astype("<i8").tobytes())]
    return pa.Table.from_batches([_rows([(tongue, slot, packed, None), (tongue, SUMS, [], [*[0] * 6, *_of_classes(columns[0][1][0])])])])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose."""
    if min(n1, n2, n3) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])


@dataclass(frozen=True)
class KneserNey:
    """The numbers of a whole language."""

    #: discounts of bigrams, and of second pieces by the number of pieces that stand before them
    bigram: np.ndarray
    piece: np.ndarray
    #: distinct bigrams and second pieces
    bigrams: int
    pieces: int
    #: what the discounts of second pieces leave for all of them alike
    rest: float

    @staticmethod
    def of(sums: list[int]) -> KneserNey:
        bigram, piece = discounts(*sums[:4]), discounts(*sums[6:10])
        rest = float(piece[1:] @ np.array([sums[6], sums[7], sums[10]])) / max(1, sums[5])
        return KneserNey(bigram, piece, sums[5], sums[11], rest)

    def log_p(self, count, first, once, twice, more, before, bigrams) -> np.ndarray:
        """ln p of bigrams: ``count`` of each, of its first piece all bigrams and the distinct ones by class, of its second piece those ``before`` it."""
        lower = np.maximum(before - self.piece[np.minimum(before, 3)], 0) / np.maximum(bigrams, 1) + self.rest / max(1, self.pieces)
        left = self.bigram[1] * once + self.bigram[2] * twice + self.bigram[3] * more
        seen = first > 0
        total = np.maximum(first, 1)
        return np.log(np.where(seen, np.maximum(count - self.bigram[np.minimum(count, 3)], 0) / total + left / total * lower, lower) + 1e-300)


@dataclass(frozen=True)
class Model:
    """Sorted arrays in ``table`` (``ROWS``), and each language's numbers."""

    table: DataFrame
    languages: dict[str, KneserNey]
    buckets: int
    piece_buckets: int


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def fit(docs: DataFrame, buckets: int | None = None) -> Model:
    """Count a model of each language over all documents; the driver sees one row a language."""
    rows = docs.select(_tongue().alias("tongue"), "text")
    if buckets is None:
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_text_bytes(docs) // BUCKET_BYTES))
    piece_buckets = min(buckets, PIECE_BUCKETS)
    counted = rows.mapInArrow(_count(buckets), ROWS).groupBy("tongue", "slot")
    merged = cut_lineage(counted.applyInArrow(_merge(buckets, piece_buckets), ROWS))
    seconds = cut_lineage(merged.where(F.col("slot") >= buckets).groupBy("tongue", "slot").applyInArrow(_merge_pieces, ROWS))
    sums = merged.unionByName(seconds).where(F.col("slot") == SUMS).groupBy("tongue").agg(*[F.sum(F.get("sums", k)).alias(f"s{k}") for k in range(12)]).collect()
    table = merged.where(F.col("slot").between(0, buckets - 1)).unionByName(seconds.where(F.col("slot") >= buckets))
    return Model(table, {r["tongue"]: KneserNey.of(list(r)[1:]) for r in sums}, buckets, piece_buckets)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's UTF-8 bytes."""
    words = text.split()
    n_symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    # bytes that go on a character are not counted; no white space is among them
    word_chars = sum(map(len, words)) - len(text.translate(None, CHARACTER_STARTS))
    lines = text.split(b"\n")
    n_dup = 0
    if len(lines) > 1:
        held = Counter(x for x in lines if x and not x.isspace())
        n_dup = held.total() - len(held)
    n = len(words)
    n_repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            covered = 0  # up to this word, all counted
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    n_repeat += i + 3 - max(i, covered)
                    covered = i + 3
    return n, word_chars, n_symbols, n_dup, n_repeat


#: All bytes but those that continue a UTF-8 character.
CHARACTER_STARTS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


DOCUMENTS = "portion int, documents binary"


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map documents: those of a batch that go to one portion as one compressed row."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        portion = batch.column(0).to_numpy()
        order = np.argsort(portion, kind="stable")
        rows = []
        for k, a, b in blobs.slices(portion[order]):
            sink = pa.BufferOutputStream()
            part = batch.take(pa.array(order[a:b]))
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            rows.append((k, pack(sink.getvalue())))
        c = list(zip(*rows, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary())], ["portion", "documents"])


def _unbundle(table: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.concat_tables([pa.ipc.open_stream(unpack(x)).read_all() for x in table.column("documents").to_pylist()])


ANSWERS = "tongue string, slot int, portion int, blobs array<binary>"


def _answers(rows: list[tuple]) -> pa.Table:
    c = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(x, t) for x, t in zip(c, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.binary())), strict=True)], ["tongue", "slot", "portion", "blobs"])


def _by_tongue(table: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """By language: its rows of the portion, and text (a place among the rows) and code of each bigram."""
    by, held = defaultdict(list), texts(table.column("text"))
    for k, tongue in enumerate(table.column("tongue").to_pylist()):
        by[tongue].append(k)
    for tongue, rows in by.items():
        yield tongue, np.array(rows), *bigrams([held[k] for k in rows])


def _ask(buckets: int, piece_buckets: int) -> Callable:
    """Reduce a portion of documents: its distinct bigrams, second and first pieces, each to its range."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for tongue, _, _, code in _by_tongue(_unbundle(table)):
            codes, second, first = np.unique(code), np.unique(second_of(code)), np.unique(first_of(code))
            out += [(tongue, k, key[0].as_py(), blobs.pack([_pack_codes(part)])) for k, part in _bigram_ranges(codes, buckets)[1]]
            nothing = [(x, np.zeros((0, len(x)), np.int64)) for x in (second, first)]
            out += [(tongue, buckets + k, key[0].as_py(), blobs.pack(found[::2])) for k, found in _by_piece_range(piece_buckets, *nothing)]
        return _answers(out)

    return run


def _look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
    """What a range knows of the codes asked for, 0 where it has none: the counts of bigrams, or the numbers of second and of first pieces."""
    if not held.num_rows:
        return _answers([])
    arrays, out = _from_blobs(blobs.unpack(held.column("blobs")[0].as_py())), []

    def find(codes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> list[bytes]:
        if not len(keys):
            return [bytes(8 * len(codes))] * len(values)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return [x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in np.where(keys[at] == codes, values[:, at], 0)]

    for row in asked.to_pylist():
        found = [x for codes, (keys, values) in zip(blobs.unpack(row["blobs"]), arrays, strict=True) for x in find(_codes(codes), keys, values)]
        out.append((row["tongue"], row["slot"], row["portion"], blobs.pack(found)))
    return _answers(out)


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _placed(order: np.ndarray, came: list[np.ndarray]) -> np.ndarray:
    """What came back, range by range, in the order of the codes; ``order`` is theirs by range."""
    values = np.concatenate([np.zeros(0, np.int64), *came])
    if len(values) != len(order):
        raise ValueError("a portion of documents changed while it was scored")
    out = np.empty(len(order), np.int64)
    out[order] = values
    return out


def nats(n: int, doc: np.ndarray, code: np.ndarray, count: np.ndarray, stats: np.ndarray, before: np.ndarray, numbers: KneserNey) -> np.ndarray:
    """The sum of -ln p of the bigrams (doc, code) of each of ``n`` texts, its own counts left out.

    ``count`` is of the sorted codes that occur, ``stats`` of their sorted first pieces (all
    bigrams, the distinct ones by class), ``before`` of their sorted second pieces.
    """
    codes = np.unique(code)
    first, second = np.unique(first_of(codes)), np.unique(second_of(codes))
    pair, times = np.unique(doc * max(1, len(codes)) + np.searchsorted(codes, code), return_counts=True)
    of, which = pair // max(1, len(codes)), pair % max(1, len(codes))
    c = count[which]
    left, right = np.searchsorted(first, first_of(codes))[which], np.searchsorted(second, second_of(codes))[which]
    rest = np.maximum(c - times, 0)
    gone = rest == 0
    # what a text took from the classes of its bigrams, by first piece; pairs are sorted by text and first piece
    context = np.cumsum(blobs.groups(of, left)) - 1
    moved = lambda old, new: np.bincount(context, new.astype(np.int64) - old)[context].astype(np.int64)
    all_, once, twice, more = [np.maximum(stats[k][left] + moved(old, new), 0) for k, (old, new) in enumerate(((c, rest), (c == 1, rest == 1), (c == 2, rest == 2), (c >= 3, rest >= 3)))]
    _, following = np.unique(of * max(1, len(second)) + right, return_inverse=True)
    ways = np.maximum(before[right] - np.bincount(following, gone)[following].astype(np.int64), 0)
    log_p = numbers.log_p(rest, all_, once, twice, more, ways, numbers.bigrams - np.bincount(of, gone, n)[of])
    return -np.bincount(of, times * log_p, n)


MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _score(languages: dict[str, KneserNey], buckets: int, piece_buckets: int) -> Callable:
    """Reduce a portion of documents and what came back for it: the measures of each document."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _unbundle(table)
        counts = [base_counts(x.encode("utf-8", "replace")) for x in texts(table.column("text"))]
        scores = np.full(table.num_rows, np.nan)
        came = defaultdict(lambda: defaultdict(list))
        for r in sorted(answers.to_pylist(), key=lambda r: r["slot"]):
            found = [_from_planes(x) for x in blobs.unpack(r["blobs"])]
            # a bigram's count is number 0; of pieces, those before a second one are number 1, the sums of a first one 2 to 5
            for k, x in enumerate(found, int(r["slot"] >= buckets)):
                came[r["tongue"]][k].append(x)
        for tongue, rows, doc, code in _by_tongue(table):
            if tongue in came and len(code):
                codes = np.unique(code)
                first, second, of = np.unique(first_of(codes)), np.unique(second_of(codes)), came[tongue]
                by_first = _ranged(first, first, piece_buckets)[0]
                stats = [_placed(by_first, of[k]) for k in (2, 3, 4, 5)]
                before = _placed(_ranged(second, second, piece_buckets)[0], of[1])
                scores[rows] = nats(len(rows), doc, code, _placed(_bigram_ranges(codes, buckets)[0], of[0]), stats, before, languages[tongue])
        columns = list(zip(*counts, strict=True)) or [()] * 5
        words = np.array(columns[0], float)
        scores = np.divide(scores, words, out=np.full(len(words), np.nan), where=words > 0)
        names = [x.split()[0] for x in MEASURED.split(", ")]
        return pa.table([table.column("doc_id"), table.column("lang"), *[pa.array(c, pa.int64()) for c in columns], pa.array(scores, pa.float64(), mask=np.isnan(scores))], names)

    return run


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, the base counts and log_perplexity (null without a word) of each document of the corpus that ``model`` counted."""
    portions = max(1, -(-_text_bytes(docs) // blobs.PORTION))
    portion = F.pmod(F.xxhash64("doc_id", "text"), F.lit(portions)).cast("int").alias("portion")
    rows = docs.select(portion, "doc_id", "lang", _tongue().alias("tongue"), "text").mapInArrow(_bundle, DOCUMENTS)
    asked = rows.groupBy("portion").applyInArrow(_ask(model.buckets, model.piece_buckets), ANSWERS)
    key = ["tongue", "slot"]
    answers = asked.groupBy(*key).cogroup(model.table.select(*key, "blobs").groupBy(*key)).applyInArrow(_look_up, ANSWERS)
    return rows.groupBy("portion").cogroup(answers.groupBy("portion")).applyInArrow(_score(model.languages, model.buckets, model.piece_buckets), MEASURED)


def judge(measured: DataFrame, width_below: float = 8.0, width_above: float = 6.0, floor: float = 0.1) -> DataFrame:
    """``measured`` with base_failed, the band of its language, perplexity and kept.

    A band reaches ``width_below`` and ``width_above`` times the distance of median and
    quartile to either side of the median of ln perplexity, and ``floor`` at least; for a text shorter than the median
    it is wider by the square root of the ratio, as a short text's mean varies more.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = cut_lineage(measured.withColumn("base_failed", failed))  # read for the bands and for the rows
    quartiles, chars = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000), F.percentile_approx("word_chars", 0.5, 10_000)
    bands = measured.where(~F.col("base_failed")).groupBy(F.col("lang").alias("_lang")).agg(quartiles.alias("_q"), chars.alias("_chars"))
    bands = cut_lineage(bands)
    bands = F.broadcast(bands) if bands.count() <= MANY_LANGUAGES else bands
    q, wider = F.col("_q"), F.sqrt(F.greatest(F.lit(1.0), F.col("_chars") / F.greatest("word_chars", F.lit(1))))
    lower, upper = q[1] - F.greatest(F.lit(floor), width_below * (q[1] - q[0])) * wider, q[1] + F.greatest(F.lit(floor), width_above * (q[2] - q[1])) * wider
    joined = measured.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumns({"lower": lower, "upper": upper})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return joined.drop("_lang", "_q", "_chars").withColumns({"perplexity": F.exp("log_perplexity"), "kept": ~F.col("base_failed") & inside})
