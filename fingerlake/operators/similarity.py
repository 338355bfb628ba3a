"""Similarity joins under a strict distance threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerlake.functions.nearest import each_within, within
from fingerlake.functions.vectors import pack_words
from fingerlake.plans.lineage import materialize
from fingerlake.plans.strategy import blocks, choose

#: Blocks of a side of a join with itself, whose pairs are half as many.
SPREAD = 12

METRICS = ("euclidean", "sqeuclidean", "cosine", "hamming")
_PAIR = "id1 long, id2 long, distance double"


def _vectors(col: pa.ChunkedArray) -> np.ndarray:
    a = col.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def _blocked(df: DataFrame, id_col: str, vec_col: str, by: list[str], block: int | None) -> tuple[DataFrame, DataFrame]:
    """(vectors with a block number inside their ``by`` group, blocks of each group)."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(by)]).where("id is not null and vec is not null")
    keys = [f"by{i}" for i in range(len(by))]
    sizes = v.groupBy(*keys).agg(blocks(F.count("*"), block, SPREAD).alias("blocks"))
    if keys:
        v = v.join(sizes, keys)
    else:
        v = v.crossJoin(F.broadcast(sizes))  # one row
    return v.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), sizes


def threshold_pairs(df: DataFrame, threshold: float, metric: str = "euclidean", id_col: str = "id", vec_col: str = "vec", by: list[str] | None = None, block: int | None = None, length: int | None = None) -> DataFrame:
    """``(id1, id2, distance)``: all pairs with ``distance < threshold``, id1 < id2.

    Exact. Vectors are hashed into blocks (see ``strategy.blocks``); each pair of blocks
    is compared by tiled matrix products in one group, so the n^2 work is spread over the cluster
    and no side is broadcast. With ``by`` only rows that agree on these columns
    meet (null agrees with nothing). Pairs of one id are left out; a pair of ids
    several vectors appears once, with its smallest distance. Where the ``length`` of bit
    hashes is told and few bits may differ, they are packed and joined by bands.
    """
    if metric not in METRICS:
        raise NotImplementedError(f"no metric {metric!r}")
    if length is not None and choose(metric, threshold, length, by) == "bands":
        return hamming_pairs(df.select(F.col(id_col).alias("id"), pack_words(F.col(vec_col), length).alias("words")), threshold, length)
    by = by or []
    keys = [f"by{i}" for i in range(len(by))]
    v, _ = _blocked(df, id_col, vec_col, by, block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = v.select("id", "vec", "b", *keys, other.alias("o")).select("id", "vec", *keys, F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids, x, side = t["id"].to_numpy(), _vectors(t["vec"]), t["side"].to_numpy()
        same = t["lo"][0].as_py() == t["hi"][0].as_py()
        l, r = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for i, j, d in each_within(x[l], x[r], metric, threshold):
            a, b = ids[l][i], ids[r][j]
            keep = (a < b) if same else (a != b)
            a, b, d = a[keep], b[keep], d[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(d, pa.float64())], names=["id1", "id2", "distance"])

    pairs = sent.groupBy(*keys, "lo", "hi").applyInArrow(run, _PAIR)
    return pairs.groupBy("id1", "id2").agg(F.min("distance").alias("distance"))


def cross_vector_pairs(queries: DataFrame, vectors: DataFrame, threshold: float, metric: str = "euclidean", block: int | None = None) -> DataFrame:
    """``(qid, qsub, mid, msub)`` of (id, sub, vec) tables, ``distance < threshold``."""

    def blocked(df: DataFrame) -> DataFrame:
        n = df.agg(blocks(F.count("*"), block).alias("blocks"))
        return df.where("vec is not null").crossJoin(F.broadcast(n)).withColumn("b", F.pmod(F.xxhash64("id", "sub"), F.col("blocks")).cast("int"))  # n is one row

    q, m = blocked(queries), blocked(vectors)
    qn, mn = q.select("blocks").limit(1), m.select("blocks").limit(1)
    left = q.drop("blocks").crossJoin(F.broadcast(mn)).select("id", "sub", "vec", F.col("b").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("hi"))
    # Renamed, as both sides may come from one table.
    right = m.drop("blocks").crossJoin(F.broadcast(qn)).select(F.col("id").alias("mid"), F.col("sub").alias("msub"), F.col("vec").alias("mvec"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mlo"), F.col("b").alias("mhi"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, _ = within(_vectors(a["vec"]), _vectors(b["mvec"]), metric, threshold)
        return pa.table([a["id"].take(pa.array(i)), a["sub"].take(pa.array(i)), b["mid"].take(pa.array(j)), b["msub"].take(pa.array(j))], names=["qid", "qsub", "mid", "msub"])

    return left.groupBy("lo", "hi").cogroup(right.groupBy("mlo", "mhi")).applyInArrow(run, "qid long, qsub long, mid long, msub long")


def vector_matches(files: DataFrame, threshold: float, metric: str = "euclidean", block: int | None = None) -> DataFrame:
    """``(id1, id2, sub1, sub2)``: matching vectors of different files, id1 < id2.

    Each pair of blocks meets once, so each pair of vectors is compared once.
    """
    n = files.agg(blocks(F.count("*"), block, SPREAD).alias("blocks"))  # one row
    v = files.where("vec is not null").crossJoin(F.broadcast(n)).withColumn("b", F.pmod(F.xxhash64("id", "sub"), F.col("blocks")).cast("int"))
    v = v.select("id", "sub", "vec", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    v = v.select("id", "sub", "vec", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") <= F.col("o")).alias("left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        x, left, ids = _vectors(t["vec"]), t["left"].to_numpy(), t["id"].to_numpy()
        same = t["lo"][0].as_py() == t["hi"][0].as_py()
        l, r = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        for i, j, _ in each_within(x[l], x[r], metric, threshold):
            i, j = l[i], r[j]
            # In one block every pair comes both ways; elsewhere the smaller id goes first.
            keep = ids[i] < ids[j] if same else ids[i] != ids[j]
            i, j = i[keep], j[keep]
            turn = ids[i] > ids[j]
            i, j = pa.array(np.where(turn, j, i)), pa.array(np.where(turn, i, j))
            cols = [t[c].combine_chunks().take(k) for c in ("id", "sub") for k in (i, j)]
            yield pa.RecordBatch.from_arrays(cols, names=["id1", "id2", "sub1", "sub2"])

    kinds = [files.schema[c].dataType.simpleString() for c in ("id", "sub")]
    return v.groupBy("lo", "hi").applyInArrow(run, f"id1 {kinds[0]}, id2 {kinds[0]}, sub1 {kinds[1]}, sub2 {kinds[1]}")


def overlap_counts(files: DataFrame, threshold: float, metric: str = "euclidean", dense: bool = False) -> DataFrame:
    """Per pair of files how many vectors of each have a match in the other.

    ``files`` has (id, sub, vec). ``(id1, id2, overlap1, overlap2, fraction1,
    fraction2)``; with ``dense`` all pairs of files appear, also without a match.
    """
    sizes = files.groupBy("id").agg(F.count("*").alias("n"))
    got = vector_matches(files, threshold, metric).groupBy("id1", "id2").agg(F.countDistinct("sub1").alias("overlap1"), F.countDistinct("sub2").alias("overlap2"))
    a, b = sizes.select(F.col("id").alias("id1"), F.col("n").alias("n1")), sizes.select(F.col("id").alias("id2"), F.col("n").alias("n2"))
    if dense:
        got = a.join(b, F.col("id1") < F.col("id2")).join(got, ["id1", "id2"], "left").fillna(0, ["overlap1", "overlap2"])
    else:
        got = got.join(a, "id1").join(b, "id2")
    return got.select("id1", "id2", "overlap1", "overlap2", (F.col("overlap1") / F.col("n1")).alias("fraction1"), (F.col("overlap2") / F.col("n2")).alias("fraction2"))


def overlap_histogram(files: DataFrame, threshold: float, metric: str = "euclidean") -> DataFrame:
    """``(overlap1, overlap2, n)``: how many pairs of files have each overlap, as ``overlap_counts(dense=True)`` has them.

    Pairs without a match are what the number of files leaves, so they are not made.
    """
    got = overlap_counts(files, threshold, metric).groupBy("overlap1", "overlap2").agg(F.count("*").alias("n"))
    got = materialize(got, "overlaps")  # read twice, a few rows
    m = files.select("id").where("id is not null").distinct().agg(F.count("*").alias("m"))
    rest = m.crossJoin(got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))  # one row each
    zero = rest.select(F.lit(0).cast("long").alias("overlap1"), F.lit(0).cast("long").alias("overlap2"), (F.expr("m * (m - 1) div 2") - F.col("n")).alias("n"))
    return got.union(zero.where("n > 0"))


def overlap_pairs(files: DataFrame, threshold: float, minimum_overlap: float = 0.0, metric: str = "euclidean") -> DataFrame:
    """``(id1, id2)`` whose fractions both reach ``minimum_overlap`` and exceed 0."""
    least = F.least("fraction1", "fraction2")
    return overlap_counts(files, threshold, metric).where((least >= minimum_overlap) & (least > 0)).select("id1", "id2")


def cross_overlap_pairs(queries: DataFrame, files: DataFrame, threshold: float, minimum_overlap: float = 0.0, metric: str = "euclidean") -> DataFrame:
    """``(query_id, match_id)``, ordered pairs; an id may match itself."""
    hit = cross_vector_pairs(queries, files, threshold, metric).groupBy("qid", "mid").agg(F.countDistinct("qsub").alias("a"), F.countDistinct("msub").alias("b"))
    qn, mn = queries.groupBy("id").agg(F.count("*").alias("qn")), files.groupBy("id").agg(F.count("*").alias("mn"))
    hit = hit.join(qn, hit["qid"] == qn["id"]).drop("id").join(mn, hit["mid"] == mn["id"]).drop("id")
    least = F.least(F.col("a") / F.col("qn"), F.col("b") / F.col("mn"))
    return hit.where((least >= minimum_overlap) & (least > 0)).select(F.col("qid").alias("query_id"), F.col("mid").alias("match_id"))


def hamming_pairs(df: DataFrame, threshold: float, length: int, id_col: str = "id", words_col: str = "words") -> DataFrame:
    """Pairs of packed hashes with a share of unequal bits below ``threshold``.

    With few allowed bits k a pair must agree on one of k + 1 bands, so an equi-join
    on (band, value) finds all candidates and a popcount decides: exact, without a
    cross join. Where the bands would be under 12 bits they would select nothing,
    and the blocked comparison of all pairs takes over.
    """
    allowed = int(np.ceil(threshold * length)) - 1
    if allowed < 0:
        allowed = 0
    bands = allowed + 1
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(words_col).alias("words")).where("id is not null and words is not null")
    bit = lambda i: F.shiftrightunsigned(F.col("words")[i // 64], 63 - i % 64).bitwiseAND(1)
    if length // bands < 12:
        bits = v.select("id", F.array(*[bit(i).cast("int") for i in range(length)]).alias("vec"))
        return threshold_pairs(bits, threshold, "hamming", "id", "vec")
    cuts = np.linspace(0, length, bands + 1).astype(int)
    keys = []
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        value = F.lit(0).cast("long")
        for i in range(lo, hi):
            value = F.xxhash64(value, bit(i)) if hi - lo > 62 else F.shiftleft(value, 1).bitwiseOR(bit(i))
        keys.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
    e = v.select("id", "words", F.explode(F.array(*keys)).alias("key"))
    a, b = e.alias("a"), e.alias("b")
    d = F.aggregate(F.zip_with("a.words", "b.words", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / F.lit(float(length))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), d.alias("distance"))
    return pairs.where(F.col("distance") < threshold).groupBy("id1", "id2").agg(F.min("distance").alias("distance"))


def drop_duplicates(df: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """``df`` without the first member of every pair."""
    gone = pairs.select(F.col("id1").alias("__gone")).distinct()
    return df.join(gone, df[id_col] == gone["__gone"], "left_anti")


def union_pairs(*parts: DataFrame) -> DataFrame:
    """Distinct canonical pairs over several hashers or groups."""
    out = None
    for p in parts:
        p = p.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
        out = p if out is None else out.union(p)
    return out.where("id1 <> id2").distinct()
