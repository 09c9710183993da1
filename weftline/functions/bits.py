"""Bit arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that an element's list number takes.
ID_BITS = 14


def bit_width(n: Column) -> Column:
    """Bits that a positive number takes: 1 for 1, 2 for 2 and 3, 3 for 4 to 7."""
    return F.length(F.bin(n.cast("long")))


def next_power(n: Column) -> Column:
    """The least power of two that is not below ``n``."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.expr("1L") * F.pow(F.lit(2.0), bit_width(n - 1))).cast("long")


def pack(i: Column, j: Column, bits: Column) -> Column:
    """One number of a row and a column, the column in the lower ``bits``."""
    return F.call_function("shiftleft", i.cast("long"), bits.cast("int")).bitwiseOR(j.cast("long"))


def unpack_row(key: Column, bits: Column) -> Column:
    return F.call_function("shiftright", key, bits.cast("int"))


def unpack_column(key: Column, bits: Column) -> Column:
    return key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)


def encode_element(value: Column, number: Column) -> Column:
    """A value and its list number in one sortable code; equal values sort by list."""
    return F.shiftleft(value.cast("long"), ID_BITS).bitwiseOR(number.cast("long"))


def element_value(code: Column) -> Column:
    return F.shiftright(code, ID_BITS)


def element_number(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << ID_BITS) - 1))
