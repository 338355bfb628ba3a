"""Labelled file collections with checksums, and hash tables as CSV."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
import warnings
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerlake.operators.evaluation import HASH_COLUMNS, check_schema

DATASET = ("filepath", "category")


def from_tuples(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(files, "filepath string, category string")


def _md5(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def save_dataset(df: DataFrame, path: str) -> None:
    """Write ``index.csv`` and the files to a folder, or to a ``.zip``.

    Files that share a name get new ones, with a warning; rows without a file stay
    in the index. A collection's index is small, and its files are copied by the
    driver, as a zip file has one writer.
    """
    rows = [r.asDict() for r in df.toLocalIterator()]
    names = [os.path.basename(r["filepath"]) for r in rows if r["filepath"]]
    clash = len(set(names)) != len(names)
    if clash:
        warnings.warn("some files share a name and are renamed", stacklevel=2)
    folder = path.removesuffix(".zip") + ".tmp" if path.endswith(".zip") else path
    os.makedirs(folder, exist_ok=True)
    out = []
    for r in rows:
        src = r.pop("filepath")
        name = None
        if src:
            name = f"{uuid.uuid4().hex}{os.path.splitext(src)[1]}" if clash else os.path.basename(src)
            if os.path.abspath(src) != os.path.abspath(os.path.join(folder, name)):
                shutil.copy(src, os.path.join(folder, name))
        out.append({**r, "filename": name, "md5": _md5(os.path.join(folder, name)) if name else None})
    import pandas as pd

    pd.DataFrame(out).to_csv(os.path.join(folder, "index.csv"), index=False)
    if path.endswith(".zip"):
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(os.listdir(folder)):
                z.write(os.path.join(folder, f), f)
        shutil.rmtree(folder)


def _holds(path: str, crc: int) -> bool:
    if not os.path.exists(path):
        return False
    have = 0
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            have = zlib.crc32(part, have)
    return have == crc


def load_dataset(spark: SparkSession, path: str, storage: str | None = None, verify: bool = True) -> DataFrame:
    """Read what :func:`save_dataset` wrote; checksums are compared in a join.

    A zip is unpacked to ``storage``, but for files that are there already with the
    content that the zip states; others of the same name are replaced.
    """
    folder = path
    if path.endswith(".zip"):
        if storage is None:
            raise ValueError("a folder to unpack to is needed")
        folder = storage
        with zipfile.ZipFile(path) as z:
            for n in z.namelist():
                if not _holds(os.path.join(folder, n), z.getinfo(n).CRC):
                    z.extract(n, folder)
    index = spark.read.csv(os.path.join(folder, "index.csv"), header=True)
    if verify:
        files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.md5("content").alias("found"))
        bad = index.where("filename is not null").join(files, "filename", "left").where("found is null or found <> md5").limit(3).collect()
        if bad:
            raise ValueError(f"checksums differ: {[r['filename'] for r in bad]}")
    full = F.when(F.col("filename").isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("filename")))
    return index.withColumn("filepath", full).drop("filename", "md5")


def save_hashes(df: DataFrame, path: str) -> None:
    check_schema(df, HASH_COLUMNS).write.mode("overwrite").csv(path, header=True)


def load_hashes(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return check_schema(df, HASH_COLUMNS).withColumn("hasher_hash_length", F.col("hasher_hash_length").cast(T.IntegerType()))
