"""Matrix Market coordinate files, read and written as Spark text.

Indices are 1-based in files and 0-based here. Supported are real, integer and pattern
fields with general or symmetric layout; pattern entries get ``PATTERN_VALUE``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.matrix import symmetric_expand

#: The fixed value of entries that a file gives without one.
PATTERN_VALUE = 0.1234


@dataclass(frozen=True)
class Header:
    field: str
    symmetry: str
    rows: int
    columns: int
    entries: int
    size_line: str


def parse_banner(banner: str) -> tuple[str, str]:
    """(field, symmetry) of a banner; an unsupported kind raises."""
    words = banner.lower().split()
    if len(words) != 5 or words[1:3] != ["matrix", "coordinate"] or words[3] not in ("real", "integer", "pattern") or words[4] not in ("general", "symmetric"):
        raise ValueError(f"unsupported Matrix Market kind: {banner}")
    return words[3], words[4]


def read_header(spark: SparkSession, path: str) -> Header:
    """The banner and the size line; a missing path and an unsupported kind raise."""
    lines = spark.read.text(path)
    banner = lines.where(F.col("value").startswith("%%MatrixMarket")).select("value", F.col("_metadata.file_path").alias("file")).first()
    if banner is None:
        raise ValueError(f"{path} has no Matrix Market banner")
    field, symmetry = parse_banner(banner["value"])
    # only the file with the banner has the size line, and takes of one file come in its order
    size = spark.read.text(banner["file"]).where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()["value"]
    rows, columns, entries = map(int, size.split())
    return Header(field, symmetry, rows, columns, entries, size)


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a Matrix Market file (or a folder of one in parts), the mirrored half included."""
    header = read_header(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = F.col("value") == F.lit(header.size_line)
    # an entry may look like the size line; of such lines, which are all alike, one is that line
    alike = lines.where(size).agg(F.count("*").alias("n")).where("n > 1").select(F.explode(F.sequence(F.lit(2), "n"))).select(F.lit(header.size_line).alias("value"))
    words = F.split(F.trim("value"), r"\s+")
    value = F.lit(PATTERN_VALUE) if header.field == "pattern" else words[2].cast("double")
    found = lines.where(~size).unionByName(alike).select((words[0].cast("long") - 1).alias("i"), (words[1].cast("long") - 1).alias("j"), value.alias("v"))
    return symmetric_expand(found) if header.symmetry == "symmetric" else found


def write_mtx(m: DataFrame, path: str, rows: int, columns: int, field: str = "real", symmetry: str = "general", comment: str | None = None) -> None:
    """Write a matrix as Matrix Market text, in parts; the first part begins with the header.

    A symmetric file takes the entries on and below the diagonal; a pattern file has no
    values and an integer file whole ones.
    """
    spark = m.sparkSession
    if symmetry == "symmetric":
        m = m.where("j <= i")
    value = {"real": [F.col("v").cast("string")], "integer": [F.col("v").cast("long").cast("string")], "pattern": []}[field]
    head = [f"%%MatrixMarket matrix coordinate {field} {symmetry}", *([f"% {comment}"] if comment else []), f"{rows} {columns} {m.count()}"]
    header = spark.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    lines = m.select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *value).alias("value"))
    header.unionByName(lines).write.text(path)
