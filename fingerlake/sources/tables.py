"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fingerlake.session import let_workers_import


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` as a lazy scan; filters and column lists reach the reader."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` as a stream of its files, whether it is one file or a folder of them."""
    folder = sf_dir.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
