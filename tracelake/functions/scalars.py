"""Decoding of binary columns in DataFrame functions, for bytes that are already in a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARSETS = {6: "ISO-8859-1", 7: "UTF-8", 8: "UTF-16LE", 9: "UTF-16BE"}


def bit_is_set(value: Column, position: int) -> Column:
    """Whether bit ``position`` of an integer is set."""
    return F.getbit(value, F.lit(position)) == 1


def hex_text(content: Column) -> Column:
    """Bytes as lower-case hexadecimal text."""
    return F.lower(F.hex(content))


def decoded_text(content: Column, data_type: int) -> Column:
    """Bytes of a string data type as text without trailing NULs."""
    return F.regexp_replace(F.decode(content, CHARSETS[data_type]), "\x00+$", "")


def unsigned(content: Column, byte_offset: int, width: int, little: bool = True, bit_offset: int = 0, bit_count: int | None = None) -> Column:
    """Up to 63 unsigned bits inside a binary column as a long."""
    part = F.substring(content, byte_offset + 1, width)
    value = F.conv(F.hex(part), 16, -10).cast("long")
    if little:  # the bytes change places as a number, which is cheaper than as text; missing ones are the highest
        value = reduce(Column.bitwiseOR, [F.shiftleft(F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(255)), 8 * (width - 1 - k)) for k in range(width)])
        value = F.call_function("shiftrightunsigned", value, 8 * (width - F.octet_length(part)))
    if width == 8:
        return F.when(value >= 0, value.cast("decimal(20,0)")).otherwise((value.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)"))
    count = 8 * width - bit_offset if bit_count is None else bit_count
    return F.shiftright(value, bit_offset).bitwiseAND(F.lit((1 << count) - 1))


def signed(content: Column, byte_offset: int, width: int, little: bool = True, bit_offset: int = 0, bit_count: int | None = None) -> Column:
    """Up to 56 signed bits inside a binary column as a long."""
    count = 8 * width - bit_offset if bit_count is None else bit_count
    value = unsigned(content, byte_offset, width, little, bit_offset, bit_count)
    return F.when(value >= 1 << (count - 1), value - (1 << count)).otherwise(value)


def bracket(keys: list[float], x: Column) -> Column:
    """The i with keys[i] <= x < keys[i + 1], -1 below the first key."""
    ks = F.array(*map(F.lit, map(float, keys)))
    return F.size(F.filter(ks, lambda k: k <= x)) - 1
