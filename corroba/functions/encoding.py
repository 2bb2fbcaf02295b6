"""Binary encodings: LEB128 numbers and modified UTF-8 texts, over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leb128_bytes(number: int, signed: bool) -> bytes:
    out = bytearray()
    if not signed:
        number &= 0xFFFFFFFFFFFFFFFF
    while True:
        low, number = number & 0x7F, number >> 7
        if number == 0 and not (signed and low & 0x40) or signed and number == -1 and low & 0x40:
            return bytes([*out, low])
        out.append(low | 0x80)


def leb128_number(data: bytes, signed: bool) -> int | None:
    """The number at the start of the bytes; null if they end before it does."""
    value = shift = 0
    for byte in data:
        value |= (byte & 0x7F) << shift
        shift += 7
        if not byte & 0x80:
            if signed and byte & 0x40:
                value -= 1 << shift
            return (value + (1 << 63)) % (1 << 64) - (1 << 63)
    return None


def mutf8_bytes(text: str) -> bytes:
    """U+0000 as two bytes, characters beyond U+FFFF as two surrogates of three bytes each."""
    units = text.encode("utf-16-le", "surrogatepass")
    out = bytearray()
    for i in range(0, len(units), 2):
        u = units[i] | units[i + 1] << 8
        if 0 < u < 0x80:
            out.append(u)
        elif u < 0x800:
            out += bytes([0xC0 | u >> 6, 0x80 | u & 0x3F])
        else:
            out += bytes([0xE0 | u >> 12, 0x80 | u >> 6 & 0x3F, 0x80 | u & 0x3F])
    return bytes(out)


def mutf8_text(data: bytes) -> str | None:
    """The text, single surrogates replaced; null where the bytes are no modified UTF-8."""
    units, i = [], 0
    while i < len(data):
        b = data[i]
        n = 1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 0
        rest = data[i + 1 : i + n]
        if not n or b == 0 or len(rest) != n - 1 or any(x >> 6 != 2 for x in rest):
            return None
        value = b if n == 1 else b & (0x1F if n == 2 else 0x0F)
        for x in rest:
            value = value << 6 | x & 0x3F
        units.append(value)
        i += n
    return b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace")


@F.pandas_udf(T.BinaryType())
def uleb128(number: pd.Series) -> pd.Series:
    return number.map(lambda x: leb128_bytes(int(x), False))


@F.pandas_udf(T.BinaryType())
def sleb128(number: pd.Series) -> pd.Series:
    return number.map(lambda x: leb128_bytes(int(x), True))


@F.pandas_udf(T.LongType())
def from_uleb128(data: pd.Series) -> pd.Series:
    return data.map(lambda x: leb128_number(x, False))


@F.pandas_udf(T.LongType())
def from_sleb128(data: pd.Series) -> pd.Series:
    return data.map(lambda x: leb128_number(x, True))


@F.pandas_udf(T.BinaryType())
def mutf8(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else mutf8_bytes(x))


@F.pandas_udf(T.StringType())
def from_mutf8(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else mutf8_text(x))
