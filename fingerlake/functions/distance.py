"""Distances between vectors in one row, as JVM expressions.

Hamming is the share of unequal positions, in 0..1, and not a count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_CUSTOM: dict[str, Callable[[Column, Column], Column]] = {}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def hamming(a: Column, b: Column) -> Column:
    """Of arrays of bits or booleans."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))) / F.size(a)


def hamming_words(a: Column, b: Column, length: int) -> Column:
    """Of packed 64-bit words that hold ``length`` bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / F.lit(float(length))


def register_metric(name: str, f: Callable[[Column, Column], Column]) -> None:
    """Make a custom metric known; ``f`` may wrap an Arrow UDF."""
    _CUSTOM[name] = f


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    """The named distance; an unknown name fails while the plan is built."""
    known = {"euclidean": l2, "sqeuclidean": squared_l2, "cosine": cosine, "hamming": hamming} | _CUSTOM
    if metric not in known:
        raise NotImplementedError(f"no metric {metric!r}; known: {sorted(known)}")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return known[metric](col(a), col(b))


def between(metric: str, a: np.ndarray, b: np.ndarray) -> float:
    """The named distance of two numpy vectors."""
    x, y = np.asarray(a, float), np.asarray(b, float)
    if metric == "hamming":
        return float((x != y).mean())
    if metric == "cosine":
        return float(1 - x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
    sq = float(((x - y) ** 2).sum())
    if metric not in ("euclidean", "sqeuclidean"):
        raise NotImplementedError(f"no metric {metric!r}")
    return float(np.sqrt(sq)) if metric == "euclidean" else sq
