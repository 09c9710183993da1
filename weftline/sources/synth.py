"""Generated matrices whose entries are a function of their row labels, so that any engine can make them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed numbers of the arithmetic hash
MULTIPLIER, STEP, START = 1103515245, 2654435761, 12345


def _draw(i, t, modulus: int):
    return F.pmod((i * MULTIPLIER + t * STEP + START) % F.lit(2147483647), F.lit(modulus))


def synth_square(spine: DataFrame, size: int, per_row: int = 4) -> DataFrame:
    """``per_row`` draws of a column in [1, size) for each row label, value 1 each; equal ones are summed."""
    drawn = spine.select(F.col("i").cast("long").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("t"))
    return drawn.select("i", (_draw(F.col("i"), F.col("t"), size - 1) + 1).cast("long").alias("j")).groupBy("i", "j").agg(F.count("*").cast("double").alias("v"))


def synth_rect(spine: DataFrame, columns: int, per_row: int = 3) -> DataFrame:
    """``per_row`` draws of a column in [1, columns) and a value for each row label; the last draw of a coordinate stays."""
    drawn = spine.select(F.col("i").cast("long").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("t"))
    placed = drawn.select("i", (_draw(F.col("i"), F.col("t"), columns - 1) + 1).cast("long").alias("j"), "t", (_draw(F.col("i") + 7, F.col("t"), 2001) - 1000).cast("double").alias("v"))
    return placed.groupBy("i", "j").agg(F.max_by("v", "t").alias("v"))
