"""Perceptual hashes as long bits and as 16 hexadecimal digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_hex(h: Column) -> Column:
    """Bits of 16 hexadecimal digits; null for anything else."""
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.conv(h, 16, -10).cast("long"))


def to_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two long hashes."""
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def hex_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two hexadecimal hashes; null if either is invalid."""
    return distance(from_hex(a), from_hex(b))


def sign_bits(vector: Column) -> Column:
    """The signs of a 64-dimensional vector as a hash, the first dimension highest."""
    bits = F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.conv(bits, 2, -10).cast("long")
