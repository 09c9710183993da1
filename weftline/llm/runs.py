"""Periodic runs of words: stretches that repeat a period at least twice.

At the scale of blocks of ``b`` words (a power of two) the text is cut into blocks, and each
is looked for in the window that follows it, at distances 2b - 1 to 4b - 2 (up to 5 and from
7 to 14 at b = 4; distance 6 falls to b = 2). A run of such a period is long enough to hold a
whole block and its copy one period later. Where a block occurs, the sum of squared
differences of word numbers is zero; that sum is two sums of squares less twice a
convolution, which is taken exactly: by number-theoretic transforms modulo two primes whose
product is larger than any such sum. The distance of each occurrence is then extended to
both sides as far as words that lie so far apart are equal, which gives the run.

Blocks with a word triple (pair, word) that doesn't come again at any such distance have no
occurrence there and aren't transformed, which is most of ordinary text. Texts of a portion
stand one after another with numbers of their own, so that no run reaches from one into the
next. What lies in a run whose period divides the distance is that run again and isn't
extended.

Defined results: a null text has no words; words of blank texts likewise; repeated rows come
out as often as they went in; no runs give four nulls and the digests of empty strings or of
all words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.blobs import portions
from weftline.llm.tables import release_memory, text_bytes

SHORTEST = 12
#: Primes of the transforms, each one more than a multiple of a power of two, and a primitive root of each (fixed values).
PRIMES = ((998244353, 3), (2013265921, 31))
#: Numbers that a transform works on at once.
AT_ONCE = 1 << 18


def _power_table(root: int, n: int, p: int) -> np.ndarray:
    """1, root, root^2, ... modulo p, n of them."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), p)) % np.uint64(p)])
    return out[:n]


def _transform(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """The transform of each row modulo p; ``root`` is a root of unity of the rows' length (a power of two).

    Halves are folded step by step, from the longest distance to the shortest, so the result
    is in bit-reversed order; ``_back`` takes that order.
    """
    rows, n = x.shape
    q = np.uint64(p)
    while n > 1:
        halves = x.reshape(rows, -1, 2, n // 2)
        low, high = halves[:, :, 0], halves[:, :, 1]
        x = np.stack([(low + high) % q, (low + (q - high)) % q * _power_table(root, n // 2, p) % q], axis=2).reshape(rows, -1)
        root, n = root * root % p, n // 2
    return x


def _back(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Undoes ``_transform``."""
    rows, size = x.shape
    q, n = np.uint64(p), 2
    while n <= size:
        step = pow(root, (size // n) * (p - 2), p)  # the inverse of the root of this length
        halves = x.reshape(rows, -1, 2, n // 2)
        low, high = halves[:, :, 0], halves[:, :, 1] * _power_table(step, n // 2, p) % q
        x = np.stack([(low + high) % q, (low + (q - high)) % q], axis=2).reshape(rows, -1)
        n *= 2
    return x * np.uint64(pow(size, p - 2, p)) % q


def mismatches(block: np.ndarray, window: np.ndarray, p: int, generator: int) -> np.ndarray:
    """Sums of squared differences modulo p of each block with its window at each place where it lies whole inside."""
    b, places = block.shape[1], window.shape[1] - block.shape[1] + 1
    size = 1 << (window.shape[1] - 1).bit_length()
    q, root = np.uint64(p), pow(generator, (p - 1) // size, p)
    held = lambda a: np.pad(a.astype(np.uint64) % q, ((0, 0), (0, size - a.shape[1])))
    product = _transform(held(block[:, ::-1]), p, root) * _transform(held(window), p, root) % q
    both = _back(product, p, root)[:, b - 1 : b - 1 + places]
    square = lambda a: a.astype(np.uint64) % q * (a.astype(np.uint64) % q) % q
    upto = np.pad(np.cumsum(square(window), axis=1), ((0, 0), (1, 0)))
    return (np.sum(square(block), axis=1)[:, None] + (upto[:, b : b + places] - upto[:, :places]) + np.uint64(2) * (q - both)) % q


def _scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, least distance, largest distance) such that a run of each period up to ``longest`` holds a block and its copy."""
    yield 4, 1, 5
    yield 2, 6, 6
    b = 4
    while 2 * b - 1 <= longest:
        yield b, 2 * b - 1, 4 * b - 2
        b *= 2


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """A number for each stretch of ``n`` words (the last ones are stretches of their own)."""
    y = x
    for k in range(1, n):
        longer = np.unique(y[: len(x) - k] * np.int64(len(x) + n) + x[k:], return_inverse=True)[1]
        y = np.concatenate([longer, np.arange(k) + len(x)])
    return y


def _repeated(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of ``width`` words that come more than once begin, by stretch, and a number of each that grows with the place."""
    gram = _grams(x, width)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    often = np.zeros(len(x), bool)
    often[1:] |= same
    often[:-1] |= same
    order = order[often]
    return order, gram[order] * np.int64(4 * len(x) + 8) + order


def _candidates(x: np.ndarray, b: int, low: int, high: int, order: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the blocks that occur again at a distance from ``low`` to ``high``."""
    n = len(x)
    # a block may occur only if each of its stretches of ``width`` words comes again at such a distance
    again = np.searchsorted(keys, keys + low)
    comes = np.zeros(n, bool)
    inside = again < len(keys)
    comes[order[inside]] = keys[again[inside]] <= keys[inside] + high
    blocks = n // b
    held = comes[: blocks * b].reshape(blocks, b)[:, : max(1, b - width + 1)].all(axis=1)
    places = np.flatnonzero(held) * b
    places = places[places + low + b <= n]
    padded = np.concatenate([x, np.arange(high + b, dtype=np.int64) + n])  # numbers that no word has
    found = []
    most = max(1, AT_ONCE // (8 * b))
    for k in range(0, len(places), most):
        at = places[k : k + most]
        block = padded[at[:, None] + np.arange(b)]
        window = padded[at[:, None] + np.arange(low, high + b)]
        zero = np.ones((len(at), high - low + 1), bool)
        for p, generator in PRIMES:
            zero &= mismatches(block, window, p, generator) == 0
        row, distance = np.nonzero(zero)
        found.append((at[row], distance + low))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, distance = (np.concatenate(c) for c in zip(*found, strict=True))
    return place, distance


def _reach(same: np.ndarray) -> int:
    """Length of the leading stretch of True."""
    return len(same) if same.all() else int(np.argmin(same))


def _extend(x: np.ndarray, at: int, q: int, first: int, last: int) -> tuple[int, int]:
    """(start, end) of the stretch around x[at:at + q] in x[first:last] in which words q apart are equal."""
    end, step = at, 64
    while end < last - q:
        ahead = min(step, last - q - end)
        more = _reach(x[end : end + ahead] == x[end + q : end + q + ahead])
        end += more
        if more < ahead:
            break
        step *= 2
    start, step = at, 64
    while start > first:
        back = min(step, start - first)
        more = _reach((x[start - back : start] == x[start - back + q : start + q])[::-1])
        start -= more
        if more < back:
            break
        step *= 2
    return start, end + q


def _factors(q: int) -> list[int]:
    """The primes that divide q."""
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] * (q > 1)


def find_runs(x: np.ndarray, starts: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, end, period) of all runs, by start and period.

    ``x`` has the numbers of the words of all texts one after another, those of different
    texts different (below 2^20 the sums are exact; beyond, extension alone decides);
    ``starts`` says where each text begins, and where the last ends.
    """
    n = len(x)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    if n < shortest:
        return np.zeros((0, 3), np.int64)
    orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    longest = int(np.diff(starts).max()) // 2
    for b, low, high in _scales(longest):
        width = min(b, 3)
        if width not in orders:
            orders[width] = _repeated(x, width)
        place, distance = _candidates(x, b, low, high, *orders[width], width)
        if not len(place):
            continue
        by = np.lexsort((place, distance))
        place, distance = place[by], distance[by]
        known = np.array(sorted(found.values()), np.int64).reshape(-1, 3)
        cuts = np.flatnonzero(np.diff(distance, prepend=-1)).tolist()
        for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(distance)], strict=True)):
            q = int(distance[a])
            at = place[a:z]
            if len(known):
                divides = known[q % known[:, 2] == 0]
                at = at[~_inside(at, at + q, divides)]
            done, fresh = -1, []
            for begin in at.tolist():
                if begin < done:
                    continue
                text = int(np.searchsorted(starts, begin, "right")) - 1
                start, end = _extend(x, begin, q, int(starts[text]), int(starts[text + 1]))
                done = end - q
                if end - start < max(shortest, 2 * q) or (start, q) in found:
                    continue
                if any((x[start : start + q] == x[start + q // f : start + q // f + q]).all() for f in _factors(q)):
                    continue  # the smallest period is a part of this one
                found[start, q] = (start, end, q)
                fresh.append((start, end, q))
            if fresh:
                known = np.concatenate([known, np.array(fresh, np.int64)])
    return np.array(sorted(found.values(), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _inside(begin: np.ndarray, end: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each stretch lies inside one of the runs."""
    if not len(runs):
        return np.zeros(len(begin), bool)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    farthest = np.maximum.accumulate(runs[:, 1])
    k = np.searchsorted(runs[:, 0], begin, "right") - 1
    return (k >= 0) & (farthest[np.maximum(k, 0)] >= end)


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, the tail of every tenth one (by crc32 of its id) replaced by a part of itself repeated."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def _numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the words, from 0, each text's own; and where each text begins."""
    x, used = [], 0
    for words in documents:
        of = _Numbers()
        x.append(np.fromiter(map(of.__getitem__, words), np.int64, len(words)) + used)
        used += len(of)
    return np.concatenate([np.zeros(0, np.int64), *x]), np.cumsum([0, *map(len, documents)])


def describe(documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text: (start, length, period) of its runs by start and period, and its words without repeats, joined by spaces."""
    x, starts = _numbered(documents)
    runs = find_runs(x, starts)
    of = np.searchsorted(starts, runs[:, 0], "right") - 1
    dropped = np.zeros(len(x) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    dropped = np.cumsum(dropped) > 0
    out = []
    cuts = np.searchsorted(of, np.arange(len(documents) + 1)).tolist()
    for k, words in enumerate(documents):
        own = runs[cuts[k] : cuts[k + 1]]
        if len(own):
            gone = dropped[starts[k] : starts[k + 1]].tolist()
            words = [w for w, d in zip(words, gone, strict=True) if not d]
        out.append(([(int(s - starts[k]), int(e - s), int(q)) for s, e, q in own.tolist()], b" ".join(words)))
    return out


def run_digests(docs: DataFrame) -> DataFrame:
    """n_runs, the longest run, and digests of all runs and of the text without repeats, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids = batch.column(0).to_pylist()
            documents = [planted_words(i, text.split()) for i, text in zip(ids, text_bytes(batch.column(1)), strict=True)]
            rows = []
            for own, kept in describe(documents):
                start, length, period = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                rows.append((len(own), start, length, period, 1000 * length // period if own else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
