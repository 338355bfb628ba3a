"""Framewise hashing and mean vectors over streams of frames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fingerlake.plans.lineage import adopt, discard, drop_path, own, shared_dir


def framewise_stream(frames: DataFrame, threshold: float, metric: str = "euclidean") -> DataFrame:
    """Frames kept so far, as they arrive: (video_id, frame_index, vec).

    State is one vector for each video, the first frame seen. Frames of a trigger
    are ordered by index; a frame that arrives after a later trigger's is compared
    with the same anchor, so lateness changes nothing but the choice of the anchor.
    """

    def far(a: np.ndarray, b: np.ndarray) -> float:
        if metric == "hamming":
            return float((a != b).mean())
        return float(np.sqrt(((a - b) ** 2).sum()))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("frame_index", kind="stable")
        first = np.asarray(state.get[0]) if state.exists else None
        keep = []
        for i, v in enumerate(pdf["vec"]):
            x = np.asarray(v, float)
            if first is None:
                first = x
                keep.append(i)
            elif far(x, first) > threshold:
                keep.append(i)
        state.update((first.tolist(),))
        yield pdf.iloc[keep][["video_id", "frame_index", "vec"]]

    kind = frames.schema["video_id"].dataType.simpleString()
    f = frames.select("video_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("vec").cast("array<double>").alias("vec"))
    return f.groupBy("video_id").applyInPandasWithState(run, f"video_id {kind}, frame_index long, vec array<double>", "first array<double>", "append", GroupStateTimeout.NoTimeout)


def mean_stream(frames: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Mean of each element for each video and window; (video_id, window, i, mean).

    ``frames`` has (video_id, ts timestamp, vec). Frames later than the watermark
    are dropped.
    """
    e = frames.withWatermark("ts", watermark).select("video_id", "ts", F.posexplode("vec").alias("i", "x"))
    return e.groupBy("video_id", F.window("ts", window), "i").agg(F.avg("x").alias("mean"))


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB and not on the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def run_to_end(stream: DataFrame, label: str = "stream") -> DataFrame:
    """The whole result of an aggregated stream once all that is there has been read.

    Each trigger's complete result is written by the executors to the shared folder
    and replaces the one before, so the driver holds no rows.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/fl-{label}-{uuid.uuid4().hex}"
    state = own(spark, f"{base}-state")
    last: list[DataFrame] = []

    def write(df: DataFrame, batch: int) -> None:
        path = f"{base}-{batch}"
        df.write.mode("overwrite").parquet(path)
        while last:
            discard(last.pop())
        last.append(adopt(spark, path, stream.schema))

    try:
        with _state_on_disk(spark):
            q = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        drop_path(spark, state)
    return last[0] if last else spark.createDataFrame([], stream.schema)
