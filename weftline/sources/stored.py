"""Matrices kept as bucketed tables, so that products over them join without a shuffle by key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def store(m: DataFrame, table: str, by: str, buckets: int, path: str) -> DataFrame:
    """Write (i, j, v) as a table in buckets of ``by`` under ``path`` and return it.

    A product's left side is stored by column (j), its right side by row (i), with as many
    buckets; entries are dealt before they are written, so that a bucket is one file.
    """
    m.select("i", "j", "v").repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).format("parquet").saveAsTable(table)
    return m.sparkSession.table(table)
