"""Matrix Market files as a Spark data source, ``spark.read.format("mtx")``.

A file is read by ranges of bytes; a line belongs to the range in which it begins. Besides
i, j and v each entry has ``at``, its ordinal in the order of the files and of the lines in
them (the file's number and the line's byte), so that a sort by (i, j, at) keeps equal
coordinates in file order however the file was split. The mirrored half of a symmetric file
comes from the same lines.

Writing is one pass: tasks write parts and count their entries, and the commit writes the
header with the sum, so the size line is right without counting first. Parts of failed tasks
are removed.

Options of reading: ``split_bytes``. Of writing: ``rows``, ``columns``, ``field`` (real,
integer, pattern) and ``symmetry``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from weftline.sources.mtx import PATTERN_VALUE, parse_banner
from weftline.sources.stores import listed, opened, ranges

#: Bits of ``at`` that hold a line's byte in its file.
BYTE_BITS = 44
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20


@dataclass
class Head:
    field: str
    symmetry: str
    rows: int
    columns: int
    entries: int
    file: str
    begins: int


def read_head(files: list[tuple[str, int]], path: str) -> Head:
    """The banner and the size line, which one file begins with, and the byte after them."""
    store = opened(path)[0]
    for name, _ in files:
        with store.open_input_file(name) as f:
            if f.read_at(14, 0) != b"%%MatrixMarket":
                continue
            raw, at, banner = b"", 0, ""
            while True:
                end = raw.find(b"\n", at)
                if end < 0:
                    more = f.read_at(READ_BYTES, len(raw))
                    if more:
                        raw += more
                        continue
                    end = len(raw)
                line = raw[at:end].decode().strip()
                if not banner:
                    banner = line
                elif line and not line.startswith("%"):
                    field, symmetry = parse_banner(banner)
                    return Head(field, symmetry, *map(int, line.split()), file=name, begins=end + 1)
                elif end >= len(raw):
                    raise ValueError(f"{name} has no size line")
                at = end + 1
    raise ValueError(f"{path} has no Matrix Market banner")


@dataclass
class Piece(InputPartition):
    name: str
    number: int
    begin: int
    end: int


class MtxReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.files = listed(path)
        self.head = read_head(self.files, path)

    def partitions(self) -> list[Piece]:
        return [Piece(name, k, a, b) for k, (name, size) in enumerate(self.files) for a, b in ranges(size, self.split_bytes)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        head = self.head
        begin = max(piece.begin, head.begins if piece.name == head.file else 0)
        with opened(self.path)[0].open_input_file(piece.name) as f:
            at, rest = begin, b""
            if begin and begin == piece.begin:  # the line that reaches into this piece is the one before's
                at, rest = begin - 1, None
            while at < piece.end or rest:
                raw = f.read_at(READ_BYTES, at)
                if rest is None:
                    first = raw.find(b"\n") + 1
                    if not first:
                        if not raw:
                            return
                        at += len(raw)
                        continue
                    if at + first >= piece.end:
                        return
                    raw, at, rest = raw[first:], at + first, b""
                block, from_, at = rest + raw, at - len(rest), at + len(raw)
                # whole lines that begin in this piece
                limit = piece.end - from_
                last = block.rfind(b"\n", 0, limit) + 1 if raw else len(block)
                if limit <= len(block) and (end := block.find(b"\n", max(limit - 1, 0))) >= 0:
                    last = end + 1
                    yield from self._parsed(block[:last], from_, piece.number)
                    return
                yield from self._parsed(block[:last], from_, piece.number)
                rest = block[last:]
                if not raw:
                    return

    def _parsed(self, block: bytes, from_: int, number: int) -> Iterator[pa.RecordBatch]:
        lines = block.split(b"\n")
        at = np.cumsum([from_, *[len(x) + 1 for x in lines[:-1]]], dtype=np.int64)
        kept = [k for k, x in enumerate(lines) if x.strip() and not x.lstrip().startswith(b"%")]
        if not kept:
            return
        at = at[kept] | np.int64(number) << np.int64(BYTE_BITS)
        width = 2 if self.head.field == "pattern" else 3
        words = np.array([x for k in kept for x in lines[k].split()[:width]]).reshape(-1, width)
        i, j = words[:, 0].astype(np.int64) - 1, words[:, 1].astype(np.int64) - 1
        v = np.full(len(i), PATTERN_VALUE) if width == 2 else words[:, 2].astype(np.float64)
        if self.head.symmetry == "symmetric":
            off = i != j
            i, j, v, at = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([v, v[off]]), np.concatenate([at, at[off]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, v, at)], ["i", "j", "v", "at"])


@dataclass
class Written(WriterCommitMessage):
    part: str
    entries: int


class MtxWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.field, self.symmetry = options["path"], options.get("field", "real"), options.get("symmetry", "general")
        self.rows, self.columns = int(options["rows"]), int(options["columns"])
        parse_banner(self._banner())
        if not overwrite and opened(self.path)[0].get_file_info(opened(self.path)[1]).type.name != "NotFound":
            raise FileExistsError(self.path)

    def _banner(self) -> str:
        return f"%%MatrixMarket matrix coordinate {self.field} {self.symmetry}"

    def write(self, rows: Iterator) -> Written:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        part, n = f"part-{uuid.uuid4().hex}.mtx", 0
        with store.open_output_stream(f"{folder}/_{part}") as f:  # hidden until it is committed
            for row in rows:
                if self.symmetry == "symmetric" and row.j > row.i:
                    continue
                value = "" if self.field == "pattern" else f" {int(row.v)}" if self.field == "integer" else f" {row.v!r}"
                f.write(f"{row.i + 1} {row.j + 1}{value}\n".encode())
                n += 1
        return Written(part, n)

    def commit(self, messages: list[Written]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/head.mtx") as f:
            f.write(f"{self._banner()}\n{self.rows} {self.columns} {sum(m.entries for m in messages if m)}\n".encode())
        for m in messages:
            if m:
                store.move(f"{folder}/_{m.part}", f"{folder}/{m.part}")

    def abort(self, messages: list[Written]) -> None:
        store, folder = opened(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{folder}/_{m.part}")


class MtxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "i long, j long, v double, at long"

    def reader(self, schema: StructType) -> MtxReader:
        return MtxReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> MtxWriter:
        return MtxWriter(dict(self.options), overwrite)


def counted(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows, columns and entries of the size line, entries found, and whether all of them fit it.

    A mirrored entry counts with the one it mirrors.
    """
    head = read_head(listed(path), path)
    spark.dataSource.register(MtxSource)
    found = spark.read.format("mtx").load(path)
    inside = F.col("i").between(0, head.rows - 1) & F.col("j").between(0, head.columns - 1)
    lower = found.where("j <= i") if head.symmetry == "symmetric" else found
    n = lower.agg(F.count("*").alias("found"), F.coalesce(F.sum((~inside).cast("long")), F.lit(0)).alias("outside"))
    told = [F.lit(x).cast("long").alias(name) for name, x in (("rows", head.rows), ("columns", head.columns), ("entries", head.entries))]
    return n.select(*told, "found", ((F.col("found") == head.entries) & (F.col("outside") == 0)).alias("fits"))
