"""Cutting lineage through tables written to the cluster's shared folder.

Tables that are not needed any more are dropped by :func:`discard`. Those behind a lazy
result must outlive it: their owner is the session, which drops them in
:func:`cleanup`, at the end of a :func:`scratch` block, or when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}
#: Paths written by each application and not dropped yet.
_WRITTEN: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only with a
    local master: on a cluster such a folder would vanish with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="fingerlake-")
        atexit.register(shutil.rmtree, folder, True)
        _LOCAL[app] = "file://" + folder
    return _LOCAL[app]


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    The result's plan is a plain scan, so a lost executor costs a re-read and
    not a recomputation. Types and column order are those of ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fl-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return adopt(spark, path, df.schema)


def own(spark: SparkSession, path: str) -> str:
    """``path``, which the session drops from now on."""
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = set()
        atexit.register(_at_exit, spark)
    _WRITTEN[app].add(path)
    return path


def adopt(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, which the session drops from now on."""
    out = spark.read.schema(schema).parquet(path)
    out._fl_path = own(spark, path)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete the folder of a path that the session owns."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a table that :func:`materialize` returned."""
    path = getattr(df, "_fl_path", None)
    if path:
        drop_path(df.sparkSession, path)


def cleanup(spark: SparkSession, keep: set[str] | None = None) -> int:
    """Drop the session's tables but ``keep``; results that read them must be consumed by then."""
    paths = set(_WRITTEN.get(spark.sparkContext.applicationId, ())) - (keep or set())
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def _at_exit(spark: SparkSession) -> None:
    # The session may be stopped and its machine gone by now.
    with contextlib.suppress(Exception):
        cleanup(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are dropped at the end, so results must be consumed inside."""
    before = set(_WRITTEN.get(spark.sparkContext.applicationId, ()))
    try:
        yield
    finally:
        cleanup(spark, before)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch of the jobs started inside.

    For Python stages over long texts, whose memory follows the batch.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)
