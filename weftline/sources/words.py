"""Files of packed little-endian words as a Spark data source, ``spark.read.format("words")``.

A file lies in parts, one a task, each named by the place of its first word; the parts' bytes
one after another are the file's. A row is (word, value); what a task writes must be a run of
consecutive words in order, which a range partitioning by ``word`` and a sort within give, or,
with the option ``runs``, several such runs, each of which becomes a part.
Parts are read by ranges of bytes. No task and no driver holds more than a portion.

Option ``kind``: u4 (default), u8 or f4.

``spark.read.format("csr_words")`` reads row pointers, columns and values side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from weftline.sources.stores import listed, opened, ranges

SPLIT_BYTES = 32 << 20
PORTION = 1 << 18


def _first(name: str) -> int:
    """The place of a part's first word."""
    return int(name.rpartition("-")[2].partition(".")[0])


@dataclass
class Piece(InputPartition):
    name: str
    first: int
    begin: int
    end: int


class WordsReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.bytes = path, f"<{kind}", np.dtype(kind).itemsize

    def partitions(self) -> list[Piece]:
        each = SPLIT_BYTES // self.bytes * self.bytes
        return [Piece(name, _first(name), a, b) for name, size in listed(self.path) for a, b in ranges(size, each)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        with opened(self.path)[0].open_input_file(piece.name) as f:
            for at in range(piece.begin, piece.end, PORTION * self.bytes):
                values = np.frombuffer(f.read_at(min(PORTION * self.bytes, piece.end - at), at), self.kind)
                first = piece.first + at // self.bytes
                value = values.astype(np.float64 if self.kind == "<f4" else np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(value)], ["word", "value"])


@dataclass
class Part:
    hidden: str
    first: int
    words: int


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part]


class WordsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, runs: bool, overwrite: bool):
        self.path, self.kind, self.runs = path, f"<{kind}", runs
        store, folder = opened(path)
        if not overwrite and store.get_file_info(folder).type.name != "NotFound":
            raise FileExistsError(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        parts, f = [], None
        for batch in batches:
            if batch.column(0).null_count or batch.column(1).null_count:
                raise ValueError("a word without a place or a value")
            words, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(self.kind)
            ends = [0, *(np.flatnonzero(np.diff(words) != 1) + 1).tolist(), len(words)]
            for a, b in zip(ends, ends[1:]):
                if a == b:
                    continue
                if f is None or words[a] != parts[-1].first + parts[-1].words:
                    if f is not None:
                        f.close()
                        if not self.runs:
                            raise ValueError(f"word {words[a]} comes where {parts[-1].first + parts[-1].words} is due")
                    parts.append(Part(f"_{uuid.uuid4().hex}", int(words[a]), 0))
                    f = store.open_output_stream(f"{folder}/{parts[-1].hidden}")
                f.write(values[a:b].tobytes())
                parts[-1].words += b - a
        if f is not None:
            f.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        at = 0
        for part in sorted((part for m in messages if m for part in m.parts), key=lambda part: part.first):
            if part.first != at:
                raise ValueError(f"words {at} to {part.first} are missing or doubled")
            at += part.words
            store.move(f"{folder}/{part.hidden}", f"{folder}/part-{part.first:020d}.bin")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        for part in (part for m in messages if m for part in m.parts):
            store.delete_file(f"{folder}/{part.hidden}")


class WordsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "words"

    def schema(self) -> str:
        return f"word long, value {'double' if self.options.get('kind') == 'f4' else 'long'}"

    def reader(self, schema: StructType) -> WordsReader:
        return WordsReader(self.options["path"], self.options.get("kind", "u4"))

    def writer(self, schema: StructType, overwrite: bool) -> WordsWriter:
        return WordsWriter(self.options["path"], self.options.get("kind", "u4"), self.options.get("runs") == "true", overwrite)


class Words:
    """The words of a file in parts, by their places."""

    def __init__(self, path: str, kind: str):
        self.store, self.kind = opened(path)[0], np.dtype(f"<{kind}")
        self.parts = [(_first(name), size // self.kind.itemsize, name) for name, size in listed(path)]
        self.words = sum(n for _, n, _ in self.parts)

    def read(self, begin: int, end: int) -> np.ndarray:
        got = [np.zeros(0, self.kind)]
        for first, n, name in self.parts:
            a, b = max(begin, first), min(end, first + n)
            if a < b:
                with self.store.open_input_file(name) as f:
                    got.append(np.frombuffer(f.read_at((b - a) * self.kind.itemsize, (a - first) * self.kind.itemsize), self.kind))
        return np.concatenate(got)

    def last_up_to(self, value: int, low: int = 0) -> int:
        """The place, ``low`` or later, of the last word that isn't larger, of words in order."""
        high = self.words
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.read(middle, middle + 1)[0] <= value else (low, middle)
        return low


@dataclass
class Entries(InputPartition):
    begin: int
    end: int


class CsrReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Entries]:
        return [Entries(a, b) for a, b in ranges(Words(f"{self.path}/col_indices", "u4").words, SPLIT_BYTES // 4)] or [Entries(0, 0)]

    def read(self, piece: Entries) -> Iterator[pa.RecordBatch]:
        starts, columns, values, row = Words(f"{self.path}/row_ptrs", "u8"), Words(f"{self.path}/col_indices", "u4"), Words(f"{self.path}/values", "f4"), 0
        for at in range(piece.begin, piece.end, PORTION):
            end = min(at + PORTION, piece.end)
            row = starts.last_up_to(at, row)
            last = starts.last_up_to(end - 1, row)
            pos = np.arange(at, end)
            rows = row + np.searchsorted(starts.read(row, last + 1).astype(np.int64), pos, "right") - 1
            arrays = [rows, pos, columns.read(at, end).astype(np.int64), values.read(at, end).astype(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["row", "pos", "j", "v"])


class CsrSource(DataSource):
    """Entries (row, pos, j, v) of the files ``row_ptrs``, ``col_indices`` and ``values`` under a folder."""

    @classmethod
    def name(cls) -> str:
        return "csr_words"

    def schema(self) -> str:
        return "row long, pos long, j long, v double"

    def reader(self, schema: StructType) -> CsrReader:
        return CsrReader(self.options["path"])


def write_words(words: DataFrame, path: str, kind: str = "u4", ordered: bool = False) -> None:
    """Write (word, value), each word from 0 once, in any order; if they come ``ordered``, in long runs of consecutive ones, they aren't shuffled."""
    words.sparkSession.dataSource.register(WordsSource)
    words = words.select("word", "value")
    words = words if ordered else words.repartitionByRange("word").sortWithinPartitions("word")
    words.write.format("words").option("kind", kind).option("runs", str(ordered).lower()).mode("append").save(path)


def read_words(spark: SparkSession, path: str, kind: str = "u4") -> DataFrame:
    spark.dataSource.register(WordsSource)
    return spark.read.format("words").option("kind", kind).load(path)


def write_records(records: DataFrame, offsets: DataFrame, path: str) -> None:
    """Partition records (blk, word, value) and their offsets (blk, ptr) as two files of words, ``records`` and ``offsets``.

    Offsets are by block from 0; one more tells where the last record ends.
    """
    placed = records.join(offsets, "blk").select((F.col("ptr") + F.col("word")).alias("word"), "value")
    write_words(placed, f"{path}/records")
    starts = offsets.select(F.col("blk").alias("word"), F.col("ptr").alias("value"))
    end = placed.agg(F.count("*").alias("value")).join(offsets.agg(F.count("*").alias("word"))).select("word", "value")  # one row each
    write_words(starts.unionByName(end), f"{path}/offsets")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(blk, word, value) of the records that ``write_records`` wrote; a record's words are found by its offset and length."""
    offsets = read_words(spark, f"{path}/offsets").select(F.col("word").alias("blk"), F.col("value").alias("ptr"))
    ends = offsets.select((F.col("blk") - 1).alias("blk"), F.col("ptr").alias("end"))
    spans = offsets.join(ends, "blk").select("blk", "ptr", F.explode(F.sequence(F.col("ptr"), F.col("end") - 1)).alias("at"))
    words = read_words(spark, f"{path}/records").withColumnRenamed("word", "at")
    return words.join(spans, "at").select("blk", (F.col("at") - F.col("ptr")).alias("word"), "value")
