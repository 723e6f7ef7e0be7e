"""Integers as bit patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_value(value: str | int, bits: int) -> int:
    """A signed value: decimal as it is, hexadecimal as a pattern of `bits` bits; out of range is an error."""
    if bits not in (32, 64):
        raise ValueError("bit width must be 32 or 64")
    text = str(value).strip().lower().replace("_", "")
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text)
    if body.startswith("0x"):
        number = int(body, 16)
        if number >= 1 << bits:
            raise ValueError(f"{value} has more than {bits} bits")
        number = number - (1 << bits) if sign > 0 and number >= 1 << (bits - 1) else sign * number
    else:
        number = sign * int(body)
    if not -(1 << (bits - 1)) <= number < 1 << (bits - 1):
        raise ValueError(f"{value} is out of range for {bits} bits")
    return number


def hex_pattern(value: Column, bits: int) -> Column:
    """The bit pattern as `0x` and bits / 4 digits."""
    digits = bits // 4
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.right(F.hex(value.cast("long")), F.lit(digits)), digits, "0")))


def wrap(value: Column, bits: int) -> Column:
    """An unsigned reading to the signed one, without overflow under ANSI."""
    top = 1 << (bits - 1)
    return F.when(value >= top, value - (1 << bits)).otherwise(value)


def sign_extend(value: Column, bits: int) -> Column:
    """The low `bits` bits as a signed number."""
    return F.shiftright(F.shiftleft(value.cast("long"), 64 - bits), 64 - bits)


def high16(value: Column, bits: int = 32) -> Column:
    """A 16-bit operand placed at the top of a register."""
    return F.shiftleft(sign_extend(value, 16), bits - 16)
