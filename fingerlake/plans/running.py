"""Running sums over an order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerlake.plans.lineage import materialize


def ranged(df: DataFrame, order: list[Column], name: str = "__range") -> DataFrame:
    """``df`` cut into ranges of ``order`` by number, as a written table.

    Writing fixes the ranges: they are found by sampling, and a retried task might
    otherwise number them anew.
    """
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ranged")


def sums_before(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds the sum of each column over the rows before, within ``keys``.

    ``sums`` maps columns to the names of their sums. ``bucket`` must ascend with ``order``.
    Whole buckets are accumulated over one row each; rows are ordered only inside
    their bucket, so a hot key is spread over its buckets.
    """
    names = [*keys, bucket]
    per = df.groupBy(*names).agg(*[F.sum(c).alias(f"__b_{o}") for c, o in sums.items()])
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(n).alias(f"__k_{n}") for n in names], *[F.coalesce(F.sum(f"__b_{o}").over(w), F.lit(0)).alias(f"__s_{o}") for o in sums.values()])
    on = [df[n].eqNullSafe(per[f"__k_{n}"]) for n in names]
    rows = df.join(per, on).drop(*[f"__k_{n}" for n in names])
    inner = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for c, o in sums.items():
        rows = rows.withColumn(o, F.col(f"__s_{o}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).drop(f"__s_{o}")
    return rows
