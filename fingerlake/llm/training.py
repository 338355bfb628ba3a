"""Labelled training rows for the models of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``per_class`` texts of each class, as (text, label) on the driver.

    The bound is what keeps training on the driver possible at any size of the
    corpus; which rows are taken depends only on a hash of their id, so a larger
    table gives a sample of the same kind. Rows with a null id, label or text are
    left out; an id that is labelled both ways counts as 1. Sorted, so that the
    order of partitions plays no part.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64(F.lit(17), "__id"), "__id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # The picked ids are at most 2 x per_class rows, whatever the input.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where("__t is not null").join(F.broadcast(picked), "__id").select("__id", "__t", "__y").collect()
    return [(r["__t"], r["__y"]) for r in sorted(rows, key=lambda r: (r["__id"], r["__t"]))]
