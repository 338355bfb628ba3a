"""Text forms of hash vectors as column expressions.

A vector is an array of numbers of one element type: ``bool`` (one bit an element,
first element in the highest bit of the first byte), ``uint8`` (held in a wider
integer, as Spark's byte is signed) or ``float32`` (little endian).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = {"float32": 32, "uint8": 8, "bool": 1}
FORMATS = ("hex", "base64")


def _check(dtype: str, form: str | None = None) -> None:
    if dtype not in BITS:
        raise NotImplementedError(f"vectors of {dtype} have no text form")
    if form is not None and form not in FORMATS:
        raise ValueError(f"unknown text form {form!r}; use one of {FORMATS}")


def byte_length(hash_length: int, dtype: str) -> int:
    """Bytes that hold ``hash_length`` elements."""
    _check(dtype)
    return -(-hash_length * BITS[dtype] // 8)


def string_length(hash_length: int | Column, dtype: str, form: str = "hex"):
    """Characters of the text form; takes a number or a column."""
    _check(dtype, form)
    if isinstance(hash_length, Column):
        n = F.ceil(hash_length * BITS[dtype] / F.lit(8))
        return (n * 2 if form == "hex" else F.ceil(n / F.lit(3)) * 4).cast("long")
    n = byte_length(hash_length, dtype)
    return 2 * n if form == "hex" else -(-n // 3) * 4


def hex_to_base64(c: Column | str) -> Column:
    return F.base64(F.unhex(c))


def base64_to_hex(c: Column | str) -> Column:
    return F.lower(F.hex(F.unbase64(c)))


def encode(vector: np.ndarray | None, dtype: str, form: str = "base64") -> str | None:
    """Text form of one numpy vector; None stays None."""
    import base64

    _check(dtype, form)
    if vector is None:
        return None
    raw = np.packbits(np.asarray(vector, bool)).tobytes() if dtype == "bool" else np.asarray(vector).astype("<f4" if dtype == "float32" else "u1").tobytes()
    return raw.hex() if form == "hex" else base64.b64encode(raw).decode()


def decode(text: str | None, dtype: str, hash_length: int, form: str = "base64", verify: bool = True) -> np.ndarray | None:
    """Inverse of :func:`encode`; a wrong length raises unless ``verify`` is off."""
    import base64

    _check(dtype, form)
    if text is None:
        return None
    if verify and len(text) != string_length(hash_length, dtype, form):
        raise ValueError(f"expected {string_length(hash_length, dtype, form)} characters, got {len(text)}")
    raw = bytes.fromhex(text) if form == "hex" else base64.b64decode(text)
    if dtype == "bool":
        return np.unpackbits(np.frombuffer(raw, np.uint8))[:hash_length].astype(bool)
    return np.frombuffer(raw, "<f4" if dtype == "float32" else "u1")[:hash_length]


def vector_to_string(dtype: str, form: str = "base64"):
    """Column function: array -> text, in Arrow batches."""
    _check(dtype, form)

    @F.arrow_udf(T.StringType())
    def to_text(values: pa.Array) -> pa.Array:
        return pa.array([encode(None if v is None else np.asarray(v), dtype, form) for v in values.to_pylist()], pa.string())

    return to_text


def string_to_vector(dtype: str, hash_length: int, form: str = "base64", verify: bool = True):
    """Column function: text -> array of doubles (floats), ints or booleans."""
    _check(dtype, form)
    element, arrow = {"float32": (T.FloatType(), pa.float32()), "uint8": (T.ShortType(), pa.int16()), "bool": (T.BooleanType(), pa.bool_())}[dtype]

    @F.arrow_udf(T.ArrayType(element))
    def to_vector(values: pa.Array) -> pa.Array:
        out = [decode(v, dtype, hash_length, form, verify) for v in values.to_pylist()]
        return pa.array([None if v is None else v.tolist() for v in out], pa.list_(arrow))

    return to_vector


def valid_string(c: Column, hash_length: int, dtype: str, form: str) -> Column:
    """Whether a request's hash text can be decoded; a null cannot."""
    _check(dtype, form)
    shape = "^[0-9a-fA-F]*$" if form == "hex" else "^[A-Za-z0-9+/]*={0,2}$"
    return F.coalesce((F.length(c) == string_length(hash_length, dtype, form)) & c.rlike(shape), F.lit(False))
