"""Exact removal of repeated byte strings, by an enhanced suffix array over anchors.

Every string of ``LEAST`` bytes has an anchor: the least hashed k-byte string in it. Equal
strings have equal anchors at equal places, so a repeat is found where its anchor is, and
only the suffixes at anchors that two documents share are sorted, about one in a hundred
positions of ordinary text. What decides over all strings of an anchor is the text right of
it and left of it, as far as such a string reaches.

The suffixes of an anchor are sorted by the text to the right, with the lengths of their
common prefixes beside them. A scan with a stack walks the tree of common-prefix intervals
of that array; inside each interval the occurrences are sorted by the text to the left and
scanned likewise. A node of both scans has different bytes next to it on both sides: it is
a maximal repeat within the reach of its anchor, with all its occurrences. A leaf, whose
occurrences are equal as far as the anchor reaches, goes on in its neighbours' nodes, and
those with the same occurrences are chained to whole repeats (``repeat_groups``).

What decides what in removal: copies of a whole text go by its 128-bit hash; rows of one
leaf go as far as the anchor reaches; what only a part of an anchor's occurrences share
is decided by the nodes of its tree. Anchors are compared byte by byte.

Documents whose whole texts are equal are one document until the end. What a task sees
twice it settles itself and passes on once, and an anchor that very many documents share
is settled by the hashes of its strings, one row a string and task; so no group of copies
meets in one task. The listing sends every occurrence to its anchor's bucket, as a group's
rows are its result.

Defined results: null and empty texts have no bytes; a null doc_id counts as smaller than
all others; rows of one doc_id don't remove each other's bytes; texts shorter than
``LEAST`` bytes are kept whole; repeated rows are alike.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.blobs import ascending, from_ascending, from_numbers, groups, numbers, portions, range_bucket, slices, spread
from weftline.llm.tables import cut_lineage

LEAST = 50
ANCHOR = 20
#: How far the strings of an anchor reach to either side of it.
REACH = LEAST - ANCHOR
#: Documents with an anchor beyond which its strings are compared by hash.
HOT = 5000
#: Bytes of text a bucket stands for, about.
BUCKET_BYTES = 64 << 20
NO_ID = -(2**63)
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(data: np.ndarray, size: int, factor: np.uint64 = A) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position, put together from powers of two."""
    n = len(data) - size + 1
    total, done, h, width = np.zeros(n, np.uint64), 0, data.astype(np.uint64) + np.uint64(1), 1
    while True:
        if size & width:
            total = spread(total * factor + h[done : done + n])
            done += width
        if 2 * width > size:
            return total
        h = spread(h[:-width] * factor + h[width:])
        width *= 2


def _sliding(least: Callable, x: np.ndarray, size: int) -> np.ndarray:
    """The minimum or maximum of each ``size`` neighbours."""
    n, width = len(x) - size + 1, 1
    while 2 * width <= size:
        x = least(x[:-width], x[width:])
        width *= 2
    return least(x[:n], x[size - width : size - width + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of ``LEAST`` bytes; equal hashes in one string all count."""
    if len(data) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_hashes(data, ANCHOR)
    least = _sliding(np.minimum, h, REACH + 1)
    pad = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(h == _sliding(np.maximum, np.concatenate([pad, least, pad]), REACH + 1))
    # anchors have small hashes; mixed anew, they spread evenly over buckets
    return at, spread(h[at] * B)


def interval_scan(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of a sorted list; ``lcp[i]`` is of the items i and i + 1."""
    out, stack = [], []
    for i, length in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > length:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    return out


def _common(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the next."""
    if len(x) < 2:
        return np.zeros(0, np.int64)
    other = x[1:] != x[:-1]
    first = np.where(other.any(1), other.argmax(1), x.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def repeats_of_anchor(right: np.ndarray, right_sizes: np.ndarray, left: np.ndarray, left_sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes to the left, bytes to the right, occurrences) of the maximal repeats around one anchor.

    The occurrences are sorted by ``right``; ``left`` reads from the anchor backwards.
    """
    by_left = np.lexsort([left_sizes, *left.T[::-1]])
    rank = np.empty(len(by_left), np.int64)
    rank[by_left] = np.arange(len(by_left))
    common = _common(right, right_sizes)
    for to_right, first, last in interval_scan(common.tolist()):
        inside = first + np.argsort(rank[first : last + 1], kind="stable")
        shared = _common(left[inside], left_sizes[inside])
        if shared.max() < REACH - to_right:
            continue
        for to_left, a, b in interval_scan(shared.tolist()):
            if to_left + to_right >= REACH:
                found = inside[a : b + 1]
                if common[found.min() : found.max()].min() == to_right:  # else a deeper interval holds them all
                    yield to_left, to_right, found


# Rows between tasks carry columns of numbers as bytes. ``bucket`` says who gets them, ``kind`` what they are.
ROWS = "bucket int, kind int, blobs array<binary>"
#: of a bucket of anchors (or strings): who has what
ENTRIES, CONTEXTS, STRINGS = range(3)
#: of a bucket of documents: what a document shares, or which of its bytes go
SHARED, COVERED = range(3, 5)
HOT_ANCHORS = 5


def _rows(rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
    """Rows with their blobs compressed; those of hot anchors are read on the driver and stay as they are."""
    pack = zstandard.ZstdCompressor(level=1).compress
    c = list(zip(*[(b, k, blobs if k == HOT_ANCHORS else [pack(x) for x in blobs]) for b, k, blobs in rows], strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.binary()))], ["bucket", "kind", "blobs"])


def _read(table: pa.Table) -> dict[int, list[list[bytes]]]:
    """The blobs by kind, as they were before ``_rows``."""
    out, unpack = defaultdict(list), zstandard.ZstdDecompressor().decompress
    for kind, blobs in zip(table.column("kind").to_pylist(), table.column("blobs").to_pylist(), strict=True):
        out[kind].append([unpack(x) for x in blobs])
    return out


def _joined(blobs: list[list[bytes]], column: int, dtype: str = "<i8") -> np.ndarray:
    return np.concatenate([np.frombuffer(b[column], dtype) for b in blobs])


def _to_owners(kind: int, docs: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows that bring values to the buckets of their documents."""
    bucket = range_bucket(spread(docs.astype(np.uint64) * A), buckets)
    order = np.argsort(bucket, kind="stable")
    for k, a, b in slices(bucket[order]):
        part = order[a:b]
        yield k, kind, [docs[part].astype("<i8").tobytes(), *[c[part].tobytes() for c in columns]]


def _named(docs: np.ndarray) -> tuple[bytes, bytes]:
    """Document ids as a list of names and places in it."""
    names, place = np.unique(docs, return_inverse=True)
    return names.astype("<i8").tobytes(), place.astype("<u4" if len(names) > 1 << 16 else "<u2").tobytes()


def _from_names(names: bytes, place: bytes) -> np.ndarray:
    n = np.frombuffer(names, "<i8")
    return n[np.frombuffer(place, "<u4" if len(n) > 1 << 16 else "<u2")]


def _named_texts(docs: np.ndarray, owners: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Owners as a list of names and places in it, with the document ids of the names; an owner has one id."""
    _, first = np.unique(owners, return_index=True)
    names, place = _named(owners)
    return names, docs[first].astype("<i8").tobytes(), place


def _from_texts(names: bytes, docs: bytes, place: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _from_names(docs, place), _from_names(names, place)


def _data(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    """The bytes of each text, as views of the batch."""
    texts = batch.column(column).cast(pa.large_binary())
    if not len(texts):
        return []
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return [data[x:y] for x, y in zip(at, at[1:], strict=False)]


def _upper(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16) << np.uint64(16)


def _anchor_entries(buckets: int) -> Callable:
    """Map (owner, text): each anchor of a batch with the least and largest owner that has it, and who shares which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            owners = dict(zip(batch.column(0).to_pylist(), _data(batch, 1), strict=True))
            found = [np.unique(_upper(anchors(x)[1])) for x in owners.values()]
            h = np.concatenate([np.zeros(0, np.uint64), *found])
            doc = np.repeat(np.array(list(owners), np.int64), [len(x) for x in found])
            order = np.lexsort([doc, h])
            h, doc = h[order], doc[order]
            starts = np.flatnonzero(groups(h))
            n = np.diff(np.append(starts, len(h)))
            several = np.repeat(n > 1, n)
            rows = list(_to_owners(SHARED, doc[several], [h[several]], buckets))
            anchor, low, high = h[starts], doc[starts], doc[starts + n - 1]
            for k, a, b in slices(range_bucket(anchor, buckets)):
                rows.append((k, ENTRIES, [ascending(anchor[a:b]), *_named(low[a:b]), *_named(high[a:b][n[a:b] > 1]), numbers(n[a:b])]))
            yield _rows(rows)

    return run


def _shared_anchors(buckets: int, hot: int) -> Callable:
    """Reduce a bucket of anchors: bring each owner those that others have too; name the hot ones."""

    def run(table: pa.Table) -> pa.Table:
        got = _read(table)
        out = [(int(table.column("bucket")[0].as_py()), SHARED, b) for b in got[SHARED]]
        if got[ENTRIES]:
            h = np.concatenate([from_ascending(b[0]) for b in got[ENTRIES]])
            low = np.concatenate([_from_names(b[1], b[2]) for b in got[ENTRIES]])
            n = np.concatenate([from_numbers(b[5]) for b in got[ENTRIES]])
            high = low.copy()
            high[n > 1] = np.concatenate([_from_names(b[3], b[4]) for b in got[ENTRIES]])
            order = np.argsort(h, kind="stable")
            h, low, high, n = h[order], low[order], high[order], n[order]
            starts = np.flatnonzero(groups(h))
            size = np.diff(np.append(starts, len(h)))
            shared = np.repeat(np.minimum.reduceat(low, starts) < np.maximum.reduceat(high, starts), size) & (n == 1)  # the others have told themselves
            out += _to_owners(SHARED, low[shared], [h[shared]], buckets)
            out.append((0, HOT_ANCHORS, [h[starts][np.add.reduceat(n, starts) > hot].tobytes()]))
        return pa.Table.from_batches([_rows(out)])

    return run


def _gather(columns: int) -> Callable:
    """Reduce a bucket of documents: (doc, its values, column after column)."""

    def run(table: pa.Table) -> pa.Table:
        got = [b for blobs in _read(table).values() for b in blobs]
        doc = _joined(got, 0)
        values = [_joined(got, 1 + k) for k in range(columns)]
        order = np.argsort(doc, kind="stable")
        doc, values = doc[order], [v[order] for v in values]
        starts = np.flatnonzero(groups(doc)).tolist()
        blobs = [[v[a:b].tobytes() for v in values] for a, b in zip(starts, [*starts[1:], len(doc)], strict=True)]
        return pa.table([pa.array(doc[starts], pa.int64()), pa.array(blobs, pa.list_(pa.binary()))], ["owner", "blobs"])

    return run


def _sort_contexts(h: np.ndarray, right: np.ndarray, right_sizes: np.ndarray, left: np.ndarray, left_sizes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The suffix array: the order of the suffixes from the anchors on, equal ones by what stands to the left, then by document."""
    key = np.concatenate([h.astype(">u8").view(np.uint8).reshape(-1, 8), right, right_sizes[:, None], left, left_sizes[:, None]], axis=1)
    return np.lexsort([doc, np.ascontiguousarray(key).view(f"S{key.shape[1]}").reshape(-1)])


def _contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors with what is right of them, and what is left of them backwards; the sizes of both sides where the text ends before."""
    pad = np.zeros(REACH, np.uint8)
    padded, reach = np.concatenate([pad, data, pad]), np.arange(REACH)
    right = padded[(at + REACH)[:, None] + np.arange(ANCHOR + REACH)]
    left = padded[(at + REACH - 1)[:, None] - reach]
    return right, np.minimum(REACH, len(data) - at - ANCHOR).astype(np.uint8), left, np.minimum(REACH, at).astype(np.uint8)


def _settle(h, doc, at, right, right_sizes, left, left_sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted contexts: where a new class of equal ones begins, the least document of each row's class, and whether a row is covered as a whole."""
    both = np.concatenate([right, right_sizes[:, None], left, left_sizes[:, None]], axis=1)
    new = groups(h)
    new[1:] |= (both[1:] != both[:-1]).any(1)
    starts = np.flatnonzero(new)
    least = np.repeat(doc[starts], np.diff(np.append(starts, len(h))))
    whole = (doc > least) & (right_sizes.astype(int) + left_sizes >= REACH)
    return starts, least, whole


def _context_rows(buckets: int, hot: np.ndarray, every: bool) -> Callable:
    """Map (doc, text, shared anchors, owner): the contexts of its shared anchors, or the strings of hot ones, and what a batch settles itself.

    With ``every`` nothing is settled and all contexts are sent.
    """
    hot = np.sort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            parts, strings = [], []
            for doc, data, blobs, owner in zip(batch.column(0).to_pylist(), _data(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                shared = np.unique(np.frombuffer(blobs[0], "<u8"))
                at, h = anchors(data)
                h = _upper(h)
                mine = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
                very = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
                here = at[mine & ~very]
                if len(here):
                    parts.append((h[mine & ~very], np.full(len(here), doc), np.full(len(here), owner), here, *_contexts(data, here)))
                if (mine & very).any():
                    first = np.unique((at[mine & very][:, None] - np.arange(REACH + 1)).reshape(-1))
                    first = first[(first >= 0) & (first <= len(data) - LEAST)]
                    strings.append((window_hashes(data, LEAST)[first], window_hashes(data, LEAST, B)[first], np.full(len(first), doc), np.full(len(first), owner), first))
            rows = []
            if parts:
                h, doc, owner, at, *sides = [np.concatenate(c) for c in zip(*parts, strict=True)]
                order = _sort_contexts(h, *sides, doc)
                h, doc, owner, at, sides = h[order], doc[order], owner[order], at[order], [c[order] for c in sides]
                _, least, whole = _settle(h, doc, at, *sides)
                rows += _to_owners(COVERED, owner[whole], [(at - sides[3])[whole].astype("<i8"), (at + ANCHOR + sides[1])[whole].astype("<i8")], buckets)
                send = (doc == least) | every
                h, doc, owner, at, sides = h[send], doc[send], owner[send], at[send], [c[send] for c in sides]
                for k, a, b in slices(range_bucket(h, buckets)):
                    rows.append((k, CONTEXTS, [ascending(h[a:b]), *_named_texts(doc[a:b], owner[a:b]), numbers(at[a:b]), *[np.ascontiguousarray(c[a:b]).tobytes() for c in sides]]))
            if strings:
                one, two, doc, owner, at = [np.concatenate(c) for c in zip(*strings, strict=True)]
                order = np.lexsort([doc, two, one])
                one, two, doc, owner, at = one[order], two[order], doc[order], owner[order], at[order]
                starts = np.flatnonzero(groups(one, two))
                least = np.repeat(doc[starts], np.diff(np.append(starts, len(one))))
                rows += _to_owners(COVERED, owner[doc > least], [at[doc > least].astype("<i8"), (at[doc > least] + LEAST).astype("<i8")], buckets)
                send = doc == least
                one, two, doc, owner, at = one[send], two[send], doc[send], owner[send], at[send]
                for k, a, b in slices(range_bucket(one, buckets)):
                    rows.append((k, STRINGS, [one[a:b].tobytes(), two[a:b].tobytes(), *_named_texts(doc[a:b], owner[a:b]), numbers(at[a:b])]))
            yield _rows(rows)

    return run


def _context_columns(got: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The contexts of a bucket in the order of its suffix array: anchor, doc, at, right, its sizes, left, its sizes; their owners, and the anchors' bytes.

    Anchors are numbered by their bytes, so that equal hashes of different ones are apart.
    """
    h = np.concatenate([from_ascending(b[0]) for b in got])
    doc, owner = [np.concatenate(c) for c in zip(*[_from_texts(*b[1:4]) for b in got], strict=True)]
    at = np.concatenate([from_numbers(b[4]) for b in got])
    sides = [_joined(got, 5, "u1").reshape(-1, ANCHOR + REACH), _joined(got, 6, "u1"), _joined(got, 7, "u1").reshape(-1, REACH), _joined(got, 8, "u1")]
    order = _sort_contexts(h, *sides, doc)
    h, (right, *others) = h[order], [c[order] for c in sides]
    new = groups(h)
    new[1:] |= (right[1:, :ANCHOR] != right[:-1, :ANCHOR]).any(1)
    return [new.cumsum(), doc[order], at[order], np.ascontiguousarray(right[:, ANCHOR:]), *others], owner[order], right[:, :ANCHOR]


def repeat_groups_of(columns: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(bytes left of the anchor, bytes right of it, classes, places of the classes) of the maximal repeats of a bucket.

    ``classes`` number the distinct contexts of an anchor; the last item tells where each
    class begins among the rows (with the end).
    """
    anchor, doc, at, *sides = columns
    starts, _, _ = _settle(anchor, doc, at, *sides)
    ends = np.append(starts, len(anchor))
    of = anchor[starts]
    first = np.flatnonzero(groups(of))
    size = np.diff(np.append(first, len(of)))
    right, right_sizes, left, left_sizes = [c[starts] for c in sides]
    right_sizes, left_sizes = right_sizes.astype(np.int64), left_sizes.astype(np.int64)
    # most anchors have two contexts: a tree of two leaves is one interval, and those are looked at all at once
    two = first[size == 2]
    if len(two):
        to_right = _pairwise(right, right_sizes, two)
        to_left = _pairwise(left, left_sizes, two)
        for k in np.flatnonzero(to_right + to_left >= REACH).tolist():
            yield int(to_left[k]), int(to_right[k]), np.array([two[k], two[k] + 1]), ends
    for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        part = slice(a, a + n)
        for to_left, to_right, inside in repeats_of_anchor(right[part], right_sizes[part], left[part], left_sizes[part]):
            yield to_left, to_right, a + inside, ends


def _pairwise(x: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    other = x[first] != x[first + 1]
    return np.minimum(np.where(other.any(1), other.argmax(1), x.shape[1]), np.minimum(sizes[first], sizes[first + 1]))


def _covered_bytes(buckets: int) -> Callable:
    """Reduce a bucket of anchors or strings: bring each document the stretches that an earlier one has."""

    def run(table: pa.Table) -> pa.Table:
        got = _read(table)
        out = [(int(table.column("bucket")[0].as_py()), COVERED, b) for b in got[COVERED]]
        owners, starts, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if got[CONTEXTS]:
            columns, owner, _ = _context_columns(got[CONTEXTS])
            _, doc, at, _, right_sizes, _, left_sizes = columns
            _, _, whole = _settle(*columns)
            owners.append(owner[whole])
            starts.append((at - left_sizes)[whole])
            stops.append((at + ANCHOR + right_sizes)[whole])
            # by row and bytes to the left: the most bytes to the right, and one
            reach = np.zeros((len(doc), REACH + 1), np.uint8)
            for to_left, to_right, classes, ends in repeat_groups_of(columns):
                rows = np.concatenate([np.arange(ends[c], ends[c + 1]) for c in classes.tolist()])
                later = rows[doc[rows] > doc[rows].min()]
                reach[later, to_left] = np.maximum(reach[later, to_left], to_right + 1)
            # a stretch that lies in one that begins further left says nothing new
            further = np.maximum.accumulate(reach[:, ::-1], axis=1)[:, ::-1]
            further = np.concatenate([further[:, 1:], np.zeros((len(doc), 1), np.uint8)], axis=1)
            row, to_left = np.nonzero(reach > further)
            owners.append(owner[row])
            starts.append(at[row] - to_left)
            stops.append(at[row] + ANCHOR + reach[row, to_left].astype(np.int64) - 1)
        if got[STRINGS]:
            one, two = _joined(got[STRINGS], 0, "<u8"), _joined(got[STRINGS], 1, "<u8")
            doc, owner = [np.concatenate(c) for c in zip(*[_from_texts(*b[2:5]) for b in got[STRINGS]], strict=True)]
            at = np.concatenate([from_numbers(b[5]) for b in got[STRINGS]])
            order = np.lexsort([doc, two, one])
            one, two, doc, owner, at = one[order], two[order], doc[order], owner[order], at[order]
            first = np.flatnonzero(groups(one, two))
            later = doc > np.repeat(doc[first], np.diff(np.append(first, len(one))))
            owners.append(owner[later])
            starts.append(at[later])
            stops.append(at[later] + LEAST)
        out += _to_owners(COVERED, np.concatenate(owners), [np.concatenate(starts).astype("<i8"), np.concatenate(stops).astype("<i8")], buckets)
        return pa.Table.from_batches([_rows(out)])

    return run


GROUPS = "shape binary, first long, n_bytes long, open_left boolean, open_right boolean, occurrences array<struct<doc_id:long,owner:long,start:long>>"


def _repeat_rows(table: pa.Table) -> pa.Table:
    """Reduce a bucket of anchors: every interval of its trees, the leaves too, that two texts share, with its occurrences.

    ``shape`` is a hash of where the occurrences lie to one another, ``first`` where the
    first one begins.
    """
    got, out = _read(table), []
    if got[CONTEXTS]:
        columns, owner, core = _context_columns(got[CONTEXTS])
        _, doc, at, right, right_sizes, left, left_sizes = columns
        starts, _, _ = _settle(*columns)
        stops = np.append(starts[1:], len(doc))
        inner, held = [], set()
        for to_left, to_right, classes, ends in repeat_groups_of(columns):
            inner.append((to_left, to_right, np.concatenate([np.arange(ends[c], ends[c + 1]) for c in classes.tolist()])))
            held |= {(c, to_left, to_right) for c in classes.tolist()}
        # a leaf that a text's end cuts short may be part of what others have: then a node holds it with them
        leaves = [(int(left_sizes[a]), int(right_sizes[a]), np.arange(a, b)) for c, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)) if int(left_sizes[a]) + int(right_sizes[a]) >= REACH and b > a + 1 and (c, int(left_sizes[a]), int(right_sizes[a])) not in held]
        for to_left, to_right, rows in leaves + inner:
            if (owner[rows] == owner[rows[0]]).all():
                continue
            # only if the anchor is one of the string's own does every occurrence of the string have it
            k = rows[0]
            if to_left not in anchors(np.concatenate([left[k, :to_left][::-1], core[k], right[k, :to_right]]))[0]:
                continue
            rows = rows[np.lexsort([at[rows], owner[rows]])]
            begin = at[rows] - to_left
            shape = hashlib.sha256(owner[rows].astype("<i8").tobytes() + (begin - begin[0]).astype("<i8").tobytes()).digest()[:16]
            places = [{"doc_id": int(d), "owner": int(o), "start": int(x)} for d, o, x in zip(doc[rows], owner[rows], begin, strict=True)]
            out.append((shape, int(begin[0]), to_left + ANCHOR + to_right, to_left == REACH, to_right == REACH, places))
    c = list(zip(*out, strict=True)) or [()] * 6
    occurrence = pa.list_(pa.struct([("doc_id", pa.int64()), ("owner", pa.int64()), ("start", pa.int64())]))
    return pa.table([pa.array(x, t) for x, t in zip(c, (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), occurrence), strict=True)], [x.split()[0] for x in GROUPS.split(", ")])


def removal(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, bytes]:
    """n_removed, n_spans and the bytes that stay after the stretches are cut out."""
    if not len(starts):
        return 0, 0, raw
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    gone = step.cumsum()[:-1] > 0
    return int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, raw, text_key) of each document."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text.alias("raw"), F.md5(text).alias("text_key"))


#: Hexadecimal digits of a text's 32 that are its owner's number.
OWNER_DIGITS = 16


def _half(key: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(key, first, digits), 16, -10).cast("long")


def _owners(keys: DataFrame) -> Column:
    """The number of each text of ``keys`` (distinct, ``text_key``): half of its 128 bits of hash, or the other half where texts share the first.

    Of n texts about n^2 / 2^65 pairs share a half (three of 10^10 texts), so the keys of
    those are few enough to be named in the expression.
    """
    numbered = keys.select("text_key", _half(F.col("text_key"), 1, OWNER_DIGITS).alias("owner"))
    alike = numbered.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.min("text_key").alias("least")).where("n > 1")
    shared: list[str] = []
    if alike.count():
        others = numbered.join(alike.select("owner", "least"), "owner").where(F.col("text_key") > F.col("least"))
        shared = [r["text_key"] for r in others.select("text_key").collect()]
    owner = _half(F.col("text_key"), 1, OWNER_DIGITS)
    if shared:
        owner = F.when(F.col("text_key").isin(shared), _half(F.col("text_key"), 17, 16)).otherwise(owner)
    return owner.alias("owner")


class RepeatPlan:
    """The steps that removal and the listing of groups have in common."""

    def __init__(self, docs: DataFrame, hot: int = HOT, buckets: int | None = None, every: bool = False):
        spark = docs.sparkSession
        # both joins below take these three columns by the same keys, so the texts are shuffled once
        self.rows = _keyed(docs)
        # of equal texts the least id; those sums are all that meets by text, and copies are the rows that aren't found here
        firsts = self.rows.groupBy("text_key").agg(F.min("id").alias("id"), F.max(F.length("raw")).cast("long").alias("size"))
        firsts = cut_lineage(firsts.select("id", "text_key", "size"))
        owner = _owners(firsts)
        self.texts = firsts.withColumn("owner", owner)
        if buckets is None:
            total = self.texts.agg(F.sum("size")).first()[0] or 0
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
        self.buckets = buckets
        entries = self.rows.select(owner, "raw").mapInArrow(_anchor_entries(buckets), ROWS)
        shared = cut_lineage(entries.groupBy("bucket").applyInArrow(_shared_anchors(buckets, hot), ROWS))
        self.hot = _hot_anchors(shared)
        lists = shared.where(F.col("kind") == SHARED).groupBy("bucket").applyInArrow(_gather(1), "owner long, blobs array<binary>")
        held = self.texts.join(lists, "owner").select("id", "text_key", "owner", "blobs")
        self.contexts = self.rows.join(held, ["id", "text_key"]).select("id", "raw", "blobs", "owner").mapInArrow(_context_rows(buckets, self.hot, every), ROWS)


#: Hot anchors that tasks may hold (8 bytes each).
HOT_AT_ONCE = 1 << 20


def _hot_anchors(shared: DataFrame) -> np.ndarray:
    """The anchors that more than ``hot`` documents have, ``HOT_AT_ONCE`` at most.

    Any beyond that number are compared like all other anchors, with the same results from
    larger groups.
    """
    found = shared.where(F.col("kind") == HOT_ANCHORS).select(F.explode("blobs").alias("b")).where(F.length("b") > 0)
    parts, n = [np.zeros(0, np.uint64)], 0
    for r in found.toLocalIterator():
        parts.append(np.frombuffer(r["b"], "<u8")[: HOT_AT_ONCE - n])
        n += len(parts[-1])
        if n >= HOT_AT_ONCE:
            break
    return np.concatenate(parts)


def remove_repeats(docs: DataFrame, hot: int = HOT, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of each document.

    A byte goes if a string of ``LEAST`` bytes that covers it also starts in a document with
    a smaller id.
    """
    plan = RepeatPlan(docs, hot, buckets)
    covered = plan.contexts.groupBy("bucket").applyInArrow(_covered_bytes(plan.buckets), ROWS)
    stretches = covered.groupBy("bucket").applyInArrow(_gather(2), "owner long, blobs array<binary>")
    marks = plan.texts.join(stretches, "owner", "left").select("id", "text_key", "owner", "blobs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for raw, copy, blobs in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                if copy and len(raw) >= LEAST:
                    found = len(raw), 1, b""
                elif copy or not blobs:
                    found = 0, 0, raw
                else:
                    found = removal(raw, np.frombuffer(blobs[0], "<i8"), np.frombuffer(blobs[1], "<i8"))
                sizes.append(len(raw))
                removed.append(found[0])
                spans.append(found[1])
                kept.append(found[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return plan.rows.join(marks, ["id", "text_key"], "left").select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "raw", F.col("owner").isNull().alias("copy"), "blobs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_groups(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The maximal repeats of ``LEAST`` bytes or more that two texts share, one row an occurrence: group, n_bytes, open_left, open_right, doc_id, owner, start.

    Intervals of neighbouring anchors whose occurrences lie alike are one repeat, however
    long. Each group has all occurrences of its bytes. A side is open where the bytes go on
    but other texts share them too, so that a repeat with more occurrences tells how far.

    An occurrence is given for each distinct text: its owner, and the least doc_id that has
    it (a null one shows as the least long). ``text_owners`` says which documents have a text.
    """
    plan = RepeatPlan(docs, 2**62, buckets, every=True)
    found = plan.contexts.groupBy("bucket").applyInArrow(_repeat_rows, GROUPS).withColumn("stop", F.col("first") + F.col("n_bytes"))
    order = Window.partitionBy("shape").orderBy("first", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = found.withColumn("part", F.sum(F.when(F.col("first") > before, 1).otherwise(0)).over(order))
    one = chained.groupBy("shape", "part").agg(
        F.min("first").alias("first"),
        F.max("stop").alias("stop"),
        F.min(F.struct("first", "open_left")).alias("l"),
        F.max(F.struct("stop", (~F.col("open_right")).alias("closed"))).alias("r"),
        F.min_by("occurrences", "first").alias("occurrences"),
    )
    group = F.xxhash64("shape", "part").alias("group")
    rows = one.select(group, (F.col("stop") - F.col("first")).alias("n_bytes"), F.col("l.open_left").alias("open_left"), (~F.col("r.closed")).alias("open_right"), F.explode("occurrences").alias("o"))
    return rows.select("group", "n_bytes", "open_left", "open_right", "o.doc_id", "o.owner", "o.start")


def text_owners(docs: DataFrame) -> DataFrame:
    """(doc_id, owner): the text of each document, as ``repeat_groups`` names it."""
    rows = _keyed(docs).select("id", "text_key")
    return rows.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), _owners(rows.select("text_key").distinct()))
