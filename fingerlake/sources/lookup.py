"""Database lookups by id, request checks, and match requests to a web service."""

from __future__ import annotations

import json
import logging
import os
import urllib.request
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerlake.functions.codecs import valid_string


def select_by_ids(table: str, ids: Iterable, paramstyle: str = "pyformat", columns: Iterable[str] = ("*",)) -> tuple[str, object]:
    """A parameterised statement for the rows of some ids, and its parameters."""
    ids = list(ids)
    cols = ", ".join(columns)
    if paramstyle == "pyformat":
        return f"SELECT {cols} FROM {table} WHERE id IN %(ids)s", {"ids": tuple(ids)}
    if paramstyle == "qmark":
        return f"SELECT {cols} FROM {table} WHERE id IN ({', '.join('?' * len(ids))})", ids
    raise NotImplementedError(f"paramstyle {paramstyle!r}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 32, **options: str) -> DataFrame:
    """A table scanned in parallel ranges of ``key``."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    return r.options(**options).load()


def split_requests(requests: DataFrame, hash_length: int, dtype: str = "uint8", form: str = "base64") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason) of (id, hash) requests."""
    ok = valid_string(F.col("hash"), hash_length, dtype, form) & F.col("id").isNotNull()
    reason = F.when(F.col("id").isNull(), "no id").when(F.col("hash").isNull(), "no hash").otherwise("hash has a wrong length or characters")
    return requests.where(ok), requests.where(~ok).withColumn("reason", reason)


def match_requests(hashes: DataFrame, min_quality: int = 90, batch: int = 100) -> DataFrame:
    """``(batch, body)``: JSON bodies of the hashes whose quality is above the limit.

    ``hashes`` has (filepath, md5, hash, quality); md5 may be null and is then left
    out of the body.
    """
    good = hashes.where((F.col("quality") > min_quality) & F.col("hash").isNotNull())
    groups = F.greatest(F.lit(1), F.ceil(F.lit(good.count()) / batch)).cast("int")
    item = F.struct(F.col("filepath").alias("id"), F.col("md5"), F.col("hash").alias("sha"))
    rows = good.select(F.pmod(F.xxhash64("filepath"), groups).alias("batch"), item.alias("item"))
    return rows.groupBy("batch").agg(F.to_json(F.struct(F.array_sort(F.collect_list("item")).alias("hashes"))).alias("body"))


def post_matches(requests: DataFrame, url: str, token: str | None = None) -> DataFrame:
    """Send the bodies, a few a task; https only, unless the environment allows else."""
    import pyarrow as pa

    if not url.startswith("https://") and os.environ.get("FINGERLAKE_ALLOW_HTTP") != "1":
        raise ValueError("matches are sent over https only")
    token = token or os.environ.get("FINGERLAKE_MATCH_TOKEN")
    if not token:
        raise ValueError("a token is needed")

    def run(batches):
        for b in batches:
            out = []
            for body in b.column("body").to_pylist():
                req = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {token}"})  # noqa: S310
                with urllib.request.urlopen(req) as r:  # noqa: S310
                    out.append(json.dumps(json.load(r)))
            yield pa.RecordBatch.from_arrays([b.column("batch").cast(pa.int64()), pa.array(out, pa.string())], names=["batch", "response"])

    return requests.mapInArrow(run, "batch long, response string")


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"name": record.name, "level": record.levelname, "message": record.getMessage(), "time": self.formatTime(record)})


def json_logger(name: str, level: int = logging.INFO) -> logging.Logger:
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(_Json())
        log.addHandler(h)
    return log


def import_optional(package: str, extra: str | None = None):
    """The package, or an ImportError that says how to get it."""
    import importlib

    try:
        return importlib.import_module(package)
    except ModuleNotFoundError as e:
        if e.name and not package.startswith(e.name):
            raise
        raise ImportError(f"{package} is needed for this" + (f"; install the extra {extra!r}" if extra else "")) from e
