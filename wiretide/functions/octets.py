"""Column expressions over payload bytes, given as upper-case hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8(hexed: Column, at: int | Column) -> Column:
    """The byte at an offset as int; null past the end."""
    pos = F.lit(at) if isinstance(at, int) else at
    piece = F.substring(hexed, pos * 2 + 1, F.lit(2)) if not isinstance(at, int) else F.substring(hexed, 2 * at + 1, 2)
    return F.when(F.length(piece) == 2, F.conv(piece, 16, 10).cast("int"))


def u16(hexed: Column, at: int) -> Column:
    """Two bytes, the first the higher."""
    piece = F.substring(hexed, 2 * at + 1, 4)
    return F.when(F.length(piece) == 4, F.conv(piece, 16, 10).cast("int"))


def size(hexed: Column) -> Column:
    """Length in bytes."""
    return (F.length(hexed) / 2).cast("int")


def crc16(hexed: Column, count: Column) -> Column:
    """CRC-16/MODBUS of the first `count` bytes: start 0xFFFF, reflected polynomial 0xA001.

    count must be 1 at least: the caller guards shorter payloads.
    """
    bits = F.sequence(F.lit(1), F.lit(8))

    def shift(acc: Column, _: Column) -> Column:
        half = F.shiftrightunsigned(acc, 1)
        return F.when(acc.bitwiseAND(F.lit(1)) == 1, half.bitwiseXOR(F.lit(0xA001))).otherwise(half)

    def byte(acc: Column, i: Column) -> Column:
        value = F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.aggregate(bits, acc.bitwiseXOR(value), shift)

    return F.aggregate(F.sequence(F.lit(0), count - 1), F.lit(0xFFFF), byte)


def crc16_of(data: bytes) -> int:
    """The same checksum of bytes on the driver."""
    crc = 0xFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0xA001 if crc & 1 else 0)
    return crc
