"""Derived hash vectors as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_bits(vec: Column | str) -> Column:
    """1 where an element is positive, else 0."""
    return F.transform(vec, lambda x: F.when(x > 0, 1).otherwise(0))


def pack_words(bits: Column, length: int) -> Column:
    """Bits in 64-bit words, the first bit highest; the last word is padded with 0."""
    words = []
    for at in range(0, length, 64):
        n = min(64, length - at)
        word = F.aggregate(F.slice(bits, at + 1, n), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))
        words.append(F.shiftleft(word, 64 - n) if n < 64 else word)
    return F.array(*words)


def to_uint8(vec: Column | str) -> Column:
    """Min-max scaled to 0..255 and truncated; null for a constant zero vector."""
    v = F.transform(vec, lambda x: x.cast("double"))
    low, high = F.array_min(v), F.array_max(v)
    scaled = F.transform(v, lambda x: F.floor(F.lit(255.0) * (x - low) / (high - low)).cast("int"))
    flat = F.transform(v, lambda x: F.lit(0))
    return F.when((low == 0) & (high == 0), F.lit(None)).when(low == high, flat).otherwise(scaled)
