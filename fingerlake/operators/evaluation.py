"""How well a hasher separates: distances, thresholds at a precision, recall."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerlake.functions import nearest
from fingerlake.functions.distance import distance
from fingerlake.plans.lineage import materialize
from fingerlake.plans.running import ranged, sums_before
from fingerlake.plans.strategy import blocks

HASH_COLUMNS = ("error", "filepath", "hash", "hasher_name", "hasher_dtype", "hasher_distance_metric", "hasher_hash_length", "category", "guid", "input_filepath", "transform_name")
METRIC_COLUMNS = ("guid", "transform_name", "hasher_name", "category", "distance_to_closest_correct_image", "distance_to_closest_incorrect_image", "distance_to_closest_image", "closest_incorrect_guid")


def filter_in(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns are among the given values (null is among none)."""
    for c, vs in values.items():
        vs = list(vs) if isinstance(vs, (list, tuple, set, frozenset)) else [vs]
        found = {r[0] for r in df.where(F.col(c).isin(vs)).select(c).distinct().collect()}  # at most len(vs) rows
        if missing := [v for v in vs if v not in found]:
            warnings.warn(f"{c} never has {missing}", stacklevel=2)
        df = df.where(F.col(c).isin(vs))
    return df


def check_schema(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df`` if it has exactly these columns, in any order."""
    if set(df.columns) != set(columns):
        raise ValueError(f"expected columns {sorted(columns)}, got {sorted(df.columns)}")
    return df


def union_distinct(*hashsets: DataFrame) -> DataFrame:
    """All rows of several hash tables, each once."""
    out = hashsets[0]
    for h in hashsets[1:]:
        out = out.unionByName(h)
    return out.distinct()


#: Rows of a block that are compared with rows of another at once; None for as many as ``strategy.blocks`` says.
BLOCK: int | None = None


def metrics(hashes: DataFrame, metric: str = "euclidean", vec_col: str = "vec", warn: bool = False) -> DataFrame:
    """Per transformed row the nearest untransformed hashes.

    ``hashes`` has (guid, transform_name, hasher_name, category, vec). A row of
    another transform than ``noop`` is compared with the noop rows of its hasher
    and category: those of its own guid are correct, others are not. Null hashes,
    and guids that lack either side, are left out; with ``warn`` null hashes are counted
    first and named in a warning. Of equally near incorrect guids the smallest is named.

    Blocks of both sides are compared by matrix products, so a category's n^2 work is spread
    over its pairs of blocks, and only each row's best of a block are shuffled. What the products
    cannot tell apart is compared by differences, so that equal distances tie. A
    registered metric is an expression and is joined pair by pair.
    """
    custom = metric not in ("euclidean", "sqeuclidean", "cosine", "hamming")
    if custom:
        distance(metric, "vec", "n_vec")  # raises where the metric is unknown
    if warn and (n := hashes.where(F.col(vec_col).isNull()).count()):
        warnings.warn(f"{n} rows without a hash are left out", stacklevel=2)
    h = hashes.select("guid", "transform_name", "hasher_name", "category", F.col(vec_col).alias("vec")).where("vec is not null")
    noop, rest = h.where("transform_name = 'noop'"), h.where("transform_name <> 'noop'")
    both = noop.select("guid", "hasher_name").distinct().join(rest.select("guid", "hasher_name").distinct(), ["guid", "hasher_name"], "left_semi")
    noop, rest = noop.join(both, ["guid", "hasher_name"], "left_semi"), rest.join(both, ["guid", "hasher_name"], "left_semi")
    # Written, so that a row's number is the same in every attempt.
    t = materialize(rest.withColumn("__row", F.monotonically_increasing_id()), "transformed")
    keys = ["hasher_name", "category"]
    if custom:
        n = noop.select(*keys, F.col("guid").alias("n_guid"), F.col("vec").alias("n_vec"))
        right = F.col("guid") == F.col("n_guid")
        pair = t.join(n, keys).withColumn("d", distance(metric, "vec", "n_vec"))
        return _nearest(t, pair.select(F.col("__row").alias("row"), F.when(right, F.col("d")).alias("right"), F.when(~right, F.col("d")).alias("wrong"), F.when(~right, F.col("n_guid")).alias("wrong_guid")))
    count = lambda df, name: df.groupBy(*keys).agg(blocks(F.count("*"), BLOCK).alias(name))
    sizes = count(t, "tn").join(count(noop, "nn"), keys)
    left = t.join(sizes, keys).select(*keys, "__row", "guid", "vec", F.pmod(F.xxhash64("__row"), F.col("tn")).cast("int").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("nn") - 1)).alias("hi"))
    right = noop.join(sizes, keys).select(*[F.col(c).alias(f"n_{c}") for c in keys], F.col("guid").alias("n_guid"), F.col("vec").alias("n_vec"), F.pmod(F.xxhash64("guid"), F.col("nn")).cast("int").alias("n_hi"), F.explode(F.sequence(F.lit(0), F.col("tn") - 1)).alias("n_lo"))
    guid = h.schema["guid"].dataType.simpleString()

    def flat(col: pa.ChunkedArray) -> np.ndarray:
        a = col.combine_chunks()
        return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["row", "right", "wrong", "wrong_guid"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64()), a["guid"].slice(0, 0)], names=names)
        b = b.sort_by("n_guid")
        x, y = flat(a["vec"]), flat(b["n_vec"])
        codes = np.unique(np.array(a["guid"].to_pylist() + b["n_guid"].to_pylist()), return_inverse=True)[1]
        own = codes[: len(x)], codes[len(x) :]
        near = nearest.nearest_same(x, y, metric, own)
        i, j, d = nearest.nearest(x, y, 1, metric, own)
        at, wrong = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        at[i], wrong[i] = j, d
        if metric == "euclidean":
            near, wrong = np.sqrt(near), np.sqrt(wrong)
        none = ~np.isfinite(wrong)
        named = b["n_guid"].combine_chunks().take(pa.array(at, mask=none))
        return pa.table([a["__row"], pa.array(near, mask=~np.isfinite(near)), pa.array(wrong, mask=none), named], names=names)

    got = left.groupBy(*keys, "lo", "hi").cogroup(right.groupBy(*[f"n_{c}" for c in keys], "n_lo", "n_hi")).applyInArrow(run, f"row long, right double, wrong double, wrong_guid {guid}")
    return _nearest(t, got)


def _nearest(t: DataFrame, got: DataFrame) -> DataFrame:
    """The metric columns of ``t`` from (row, right, wrong, wrong_guid) candidates."""
    best = got.groupBy(F.col("row").alias("__row")).agg(
        F.min("right").alias("distance_to_closest_correct_image"),
        F.min("wrong").alias("distance_to_closest_incorrect_image"),
        F.least(F.min("right"), F.min("wrong")).alias("distance_to_closest_image"),
        F.min_by("wrong_guid", F.when(F.col("wrong").isNotNull(), F.struct("wrong", "wrong_guid"))).alias("closest_incorrect_guid"),
    )
    return t.join(best, "__row").select(*METRIC_COLUMNS)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with the columns of ``b``, which has a row for each key; nulls agree."""
    b = b.select(*[F.col(k).alias(f"__j_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(b, [a[k].eqNullSafe(b[f"__j_{k}"]) for k in keys]).drop(*[f"__j_{k}" for k in keys])


def threshold_precision_recall(df: DataFrame, by: list[str], precision: float = 99.9, pos: str = "pos", neg: str = "neg") -> DataFrame:
    """Per group the largest threshold before precision first falls below target.

    Rows are ranked by ``pos``; at each rank tp is the rank, fp the number of
    ``neg`` at or below. ``(by..., threshold, precision, recall)`` in percent. If
    the first rank fails already: its pos, null and 0. If none fails: the largest
    pos, 100 and 100.

    Equal distances are counted first; running counts are taken by ranges of the
    distance, so one large group is spread over the cluster. Among equal ``pos`` precision
    rises with the rank, so the first of them is the one that may fail.
    """
    keys = by or ["__all"]
    d = df.withColumn("__all", F.lit(0)) if not by else df
    p = d.where(F.col(pos).isNotNull()).select(*keys, F.col(pos).alias("x"), F.lit(1).alias("p"), F.lit(0).alias("n"))
    q = d.where(F.col(neg).isNotNull()).select(*keys, F.col(neg).alias("x"), F.lit(0).alias("p"), F.lit(1).alias("n"))
    e = p.union(q).groupBy(*keys, "x").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    order = [*map(F.col, keys), F.col("x")]
    e = sums_before(ranged(e, order), keys, "__range", [F.col("x")], {"p": "tp", "n": "fp"}).where("p > 0")
    first = F.col("tp") + 1
    e = e.withColumn("prec", 100.0 * first / (first + F.col("fp") + F.col("n")))
    g = e.groupBy(*keys).agg(F.min(F.when(F.col("prec") < precision, first)).alias("fb"), F.sum("p").alias("total"), F.max("x").alias("top"), F.min("x").alias("low"))
    e = _same(e, g, keys)
    last = F.col("fb") - 1
    at = e.groupBy(*keys).agg(F.max(F.when((F.col("tp") < last) & (last <= F.col("tp") + F.col("p")), F.col("x"))).alias("at"))
    cut = F.when(F.col("fb").isNull(), F.col("top")).when(F.col("fb") == 1, F.col("low")).otherwise(F.col("at"))
    e = _same(e, at, keys).withColumn("cut", cut)
    under = F.col("x") <= F.col("cut")
    g = e.groupBy(*keys).agg(F.first("cut").alias("threshold"), F.first("fb").alias("fb"), F.min(F.when(under, F.col("prec"))).alias("prec"), F.round(100.0 * F.sum(F.when(under, F.col("p"))) / F.first("total"), 3).alias("rec"))
    out = g.select(
        *keys,
        "threshold",
        F.when(F.col("fb").isNull(), 100.0).when(F.col("fb") == 1, F.lit(None)).otherwise(F.col("prec")).alias("precision"),
        F.when(F.col("fb").isNull(), 100.0).when(F.col("fb") == 1, 0.0).otherwise(F.col("rec")).alias("recall"),
    )
    return out if by else out.drop("__all")


def threshold_recall(m: DataFrame, precision: float = 99.9, grouping: list[str] | None = None) -> DataFrame:
    """Threshold, precision, recall and ``n_exemplars`` for each group and hasher.

    Multi-hash files count once: the least distances of each guid (and transform,
    where the table has several) stand for it. ``grouping`` may be empty.
    """
    grouping = ["category", "transform_name"] if grouping is None else grouping
    keys = [*grouping, "hasher_name"]
    inner = list(dict.fromkeys([*keys, "guid", "transform_name"]))
    # Written, as it is read several times and may stand for a comparison of all pairs.
    m = materialize(m.select(*inner, "distance_to_closest_correct_image", "distance_to_closest_incorrect_image"), "metrics")
    least = m.groupBy(*inner).agg(F.min("distance_to_closest_correct_image").alias("pos"), F.min("distance_to_closest_incorrect_image").alias("neg"))
    n = m.groupBy(*keys).agg(F.count("*").alias("n_exemplars"))
    return threshold_precision_recall(least, keys, precision).join(n, keys)


def histograms(m: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Counts of correct and incorrect distances in equal bins up to the largest.

    ``(by..., bin, low, high, n_correct, n_incorrect)``, bins from 0.
    """
    pos, neg = "distance_to_closest_correct_image", "distance_to_closest_incorrect_image"
    m = materialize(m.select(*by, pos, neg), "metrics")  # read twice
    top = m.groupBy(*by).agg(F.greatest(F.max(pos), F.max(neg)).alias("top"))
    e = m.select(*by, F.explode(F.array(F.struct(F.col(pos).alias("x"), F.lit(1).alias("p")), F.struct(F.col(neg).alias("x"), F.lit(0).alias("p")))).alias("e")).where("e.x is not null").join(top, by)
    e = e.withColumn("bin", F.when(F.col("top") == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.col("e.x") * bins / F.col("top")))).cast("int"))
    g = e.groupBy(*by, "bin", "top").agg(F.sum("e.p").alias("n_correct"), F.sum(1 - F.col("e.p")).alias("n_incorrect"))
    return g.select(*by, "bin", (F.col("bin") * F.col("top") / bins).alias("low"), ((F.col("bin") + 1) * F.col("top") / bins).alias("high"), "n_correct", "n_incorrect")


def earth_mover(m: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., emd)``: area between both distances' distribution functions."""
    pos, neg = "distance_to_closest_correct_image", "distance_to_closest_incorrect_image"
    m = materialize(m.select(*by, pos, neg), "metrics")  # ranges are found by a first reading
    e = m.select(*by, F.explode(F.array(F.struct(F.col(pos).alias("x"), F.lit(1).alias("p")), F.struct(F.col(neg).alias("x"), F.lit(0).alias("p")))).alias("e")).where("e.x is not null")
    keys = by or ["__all"]
    e = e.withColumn("__all", F.lit(0)).select(*keys, "e.x", "e.p").groupBy(*keys, "x").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("n"))
    e = ranged(e, [*map(F.col, keys), F.col("x")])
    whole = e.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    # A range's last distance goes on to the next range's first: one row a range.
    nxt = e.groupBy(*keys, "__range").agg(F.min("x").alias("first")).withColumn("then", F.lead("first").over(Window.partitionBy(*keys).orderBy("__range"))).drop("first")
    e = sums_before(e, keys, "__range", [F.col("x")], {"p": "before_p", "n": "before_n"})
    e = _same(_same(e, whole, keys), nxt, [*keys, "__range"])
    gap = F.abs((F.col("before_p") + F.col("p")) / F.col("all_p") - (F.col("before_n") + F.col("n")) / F.col("all_n"))
    lead = F.coalesce(F.lead("x").over(Window.partitionBy(*keys, "__range").orderBy("x")), "then")
    out = e.withColumn("a", gap * (lead - F.col("x"))).groupBy(*keys).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("emd"))
    return out if by else out.drop("__all")


def largest_distance(m: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Upper bound of all distances for each hasher."""
    by = by or ["hasher_name"]
    return m.groupBy(*by).agg(F.greatest(F.max("distance_to_closest_correct_image"), F.max("distance_to_closest_incorrect_image")).alias("bound"))


def same_guid(t: Column, n: Column) -> Column:
    """The mask between transformed and untransformed rows."""
    return t == n
