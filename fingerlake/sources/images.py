"""Images and files as DataFrames."""

from __future__ import annotations

import urllib.request

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerlake.operators.hashing import decode_png


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(filepath, image)``; a file that is no image has height -1."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("filepath"), "image")


def read_image(source, timeout: float | None = None) -> np.ndarray:
    """One RGB array from a path, URL, bytes or buffer; PNG without other libraries."""
    if hasattr(source, "read"):
        data = source.read()
    elif isinstance(source, bytes):
        data = source
    elif str(source).startswith(("http://", "https://")):
        with urllib.request.urlopen(source, timeout=timeout) as r:  # noqa: S310  the caller's own address
            data = r.read()
    else:
        with open(source, "rb") as f:
            data = f.read()
    try:
        x = decode_png(data)
    except ValueError:
        try:
            import cv2
        except ImportError:
            raise
        x = cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR)
        if x is None:
            raise ValueError("the image cannot be decoded") from None
        x = x[..., ::-1]
    if x.ndim == 2 or x.shape[2] == 1:
        x = np.repeat(x.reshape(*x.shape[:2], 1), 3, 2)
    return np.ascontiguousarray(x[..., :3])


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    """``(filepath, md5, length)`` of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("filepath"), F.md5("content").alias("md5"), "length")
