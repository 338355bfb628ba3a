"""k-nearest-neighbour lookups with metadata, exact and over an inverted file."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fingerlake.functions.codecs import byte_length, valid_string
from fingerlake.functions.nearest import nearest, within
from fingerlake.plans.strategy import blocks


class TuningFailure(RuntimeError):
    """No number of probed lists reaches the wanted recall."""


class QueryDecodingFailure(ValueError):
    """A query's hash text does not decode to the index's vector length."""


def _top(q: str, k: int) -> Window:
    return Window.partitionBy(q).orderBy("distance", "id")


def knn(queries: DataFrame, vectors: DataFrame, k: int = 1, threshold: float | Column | None = None, block: int | None = None) -> DataFrame:
    """``(qid, rank, id, distance)`` of the k nearest by L2; exact.

    ``queries`` is (qid, vec) and ``vectors`` (id, vec). Each block of vectors is
    compared with each block of queries by tiled matrix products that keep k
    candidates a query; only these are shuffled to the final ranking. Neighbours
    at ``threshold`` (a number, or an expression over ``qid``) or beyond are
    dropped. Ties go to the smaller id.
    """

    def numbered(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        n = df.agg(blocks(F.count("*"), block).alias("n"))
        return df.where("vec is not null").crossJoin(F.broadcast(n)).withColumn("b", F.pmod(F.xxhash64(key), F.col("n")).cast("int")), n  # n is one row

    q, qn = numbered(queries.select("qid", "vec"), "qid")
    v, vn = numbered(vectors.select("id", "vec"), "id")
    left = q.drop("n").crossJoin(F.broadcast(vn)).select("qid", "vec", F.col("b").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("hi"))
    right = v.drop("n").crossJoin(F.broadcast(qn)).select("id", F.col("vec").alias("vec"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("vlo"), F.col("b").alias("vhi"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table([a["qid"].slice(0, 0), b["id"].slice(0, 0), pa.array([], pa.float64())], names=["qid", "id", "distance"])
        if not a.num_rows or not b.num_rows:
            return none
        b = b.sort_by("id")
        i, j, d = nearest(_rows(a["vec"]), _rows(b["vec"]), k)
        return pa.table([a["qid"].take(pa.array(i)), b["id"].take(pa.array(j)), pa.array(np.sqrt(d))], names=["qid", "id", "distance"])

    qt, vt = queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    cand = left.groupBy("lo", "hi").cogroup(right.groupBy("vlo", "vhi")).applyInArrow(run, f"qid {qt}, id {vt}, distance double")
    out = cand.withColumn("rank", F.row_number().over(_top("qid", k))).where(F.col("rank") <= k)
    if threshold is not None:
        out = out.where(F.col("distance") < threshold)
    return out.select("qid", "rank", "id", "distance")


def with_metadata(matches: DataFrame, metadata: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """``(qid, matches)``: each query's matches, nearest first, with metadata maps."""
    meta = metadata.select(F.col(id_col).alias("id"), F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]).alias("metadata"))
    m = matches.join(meta, "id", "left").select("qid", F.struct("rank", "distance", "id", "metadata").alias("m"))
    m = m.groupBy("qid").agg(F.array_sort(F.collect_list("m"), lambda a, b: a["rank"] - b["rank"]).alias("m"))
    return m.select("qid", F.transform("m", lambda x: F.struct(x["distance"].alias("distance"), x["id"].alias("id"), x["metadata"].alias("metadata"))).alias("matches"))


def lookup(table: DataFrame, ids: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Rows of ``table`` whose id is among ``ids``; ids not found are left out."""
    wanted = ids.select(F.col(id_col)).distinct()
    return table.select(id_col, *[c for c in columns if c != id_col]).join(wanted, id_col, "left_semi")


#: Vectors of a list that are compared in one group.
CHUNK = 4096


def _rows(col: pa.ChunkedArray) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that a table of ``width`` columns over them is bounded."""
    step = max(1, (1 << 20) // max(1, width))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


@dataclass
class InvertedFile:
    """Posting lists by nearest centroid: ``postings`` is (list_id, id, vec)."""

    postings: DataFrame
    centroids: np.ndarray
    nprobe: int = 1
    #: (recall in percent, milliseconds, probed lists) of the last :meth:`tune`.
    tuned: tuple | None = None

    def __post_init__(self):
        if set(self.postings.columns) != {"list_id", "id", "vec"}:
            raise ValueError("postings need the columns list_id, id and vec")
        if self.centroids.ndim != 2 or not len(self.centroids):
            raise ValueError("centroids are a matrix of at least one row")

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    @property
    def hash_length(self) -> int:
        return self.centroids.shape[1]

    @property
    def ntotal(self) -> int:
        return self.postings.count()

    def set_nprobe(self, n: int) -> int:
        self.nprobe = max(1, min(int(n), self.nlist))
        return self.nprobe

    def _ranked(self, queries: DataFrame, n: int) -> DataFrame:
        """(qid, vec, lists): the ``n`` nearest lists of each query, nearest first."""
        c = self.centroids

        def probe(batches):
            for b in _slices(batches, len(c)):
                x = _rows(b.column("vec"))
                if len(x) and x.shape[1] != c.shape[1]:
                    raise ValueError(f"queries have {x.shape[1]} elements, the index {c.shape[1]}")
                far = (c * c).sum(1)[None, :] - 2 * x @ c.T if len(x) else np.zeros((0, len(c)))
                near = np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)
                off = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)) if len(x) else pa.array([0], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("vec"), pa.ListArray.from_arrays(off, pa.array(near.ravel()))], names=["qid", "vec", "lists"])

        q = queries.select("qid", "vec").where("vec is not null")
        return q.mapInArrow(probe, f"qid {q.schema['qid'].dataType.simpleString()}, vec {q.schema['vec'].dataType.simpleString()}, lists array<int>")

    def _scan(self, queries: DataFrame, pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
        """(qid, id, distance) of what ``pick`` takes from each chunk of a probed list.

        ``pick`` gets the queries that probe a list and a chunk of its vectors. Lists are
        hashed into few groups and a query is sent once to each group in which it probes
        a list, with the numbers of these, and not once for each of them. A group holds
        some ``CHUNK`` vectors; lists that are longer are cut into chunks of about that.
        """
        spark = queries.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        n = np.zeros(self.nlist, np.int64)
        for r in self.postings.groupBy("list_id").count().collect():  # a row for each list
            n[r["list_id"]] = r["count"]
        chunks, probed = -(-n // CHUNK), self.nprobe
        groups = int(max(1, min(self.nlist, max(tasks, -(-n.sum() // (4 * CHUNK))))))
        # Chunk c of a list lies in group (list + c) % groups.
        sizes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(chunks)], "list_id int, chunks int")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, probed):
                flat, row = b.column("lists").flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(b.column("lists").offsets.to_numpy()))
                row, lists, n = np.repeat(row, chunks[flat]), np.repeat(flat, chunks[flat]), chunks[flat]
                group = (lists + np.arange(len(lists)) - np.repeat(np.cumsum(n) - n, n)) % groups
                order = np.lexsort((lists, group, row))
                row, lists, group = row[order], lists[order], group[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])]) if len(row) else np.zeros(0, np.int64)
                off, of = pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(row[new])
                yield pa.RecordBatch.from_arrays([b.column("qid").take(of), b.column("vec").take(of), pa.array(group[new].astype(np.int32)), pa.ListArray.from_arrays(off, pa.array(lists.astype(np.int32)))], names=["qid", "qvec", "qgroup", "qlists"])

        kinds = queries.schema["qid"].dataType.simpleString(), self.postings.schema["id"].dataType.simpleString()
        q = self._ranked(queries, self.nprobe)
        q = q.mapInArrow(send, f"qid {kinds[0]}, qvec {q.schema['vec'].dataType.simpleString()}, qgroup int, qlists array<int>")
        chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
        v = self.postings.join(F.broadcast(sizes), "list_id").select("list_id", "id", "vec", F.pmod(F.col("list_id") + chunk, F.lit(groups)).cast("int").alias("group"))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            b = b.take(pa.array(np.argsort(np.array([repr(x) for x in b["id"].to_pylist()]), kind="stable"))) if b.num_rows and pa.types.is_nested(b["id"].type) else b.sort_by("id")
            x, y, theirs = _rows(a["qvec"]), _rows(b["vec"]), b["list_id"].to_numpy()
            lists = a["qlists"].combine_chunks()
            flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(a)), np.diff(lists.offsets.to_numpy())) if len(a) else np.zeros(0, np.int64)
            empty = np.zeros(0, np.int64)
            found = [(empty, empty, np.zeros(0))]
            by, to = np.argsort(flat, kind="stable"), np.argsort(theirs, kind="stable")
            for at in np.unique(theirs):
                l = to[slice(*np.searchsorted(theirs[to], (at, at + 1)))]
                r = np.unique(row[by[slice(*np.searchsorted(flat[by], (at, at + 1)))]])
                if len(r):
                    i, j, d = pick(x[r], y[l])
                    found.append((r[i], l[j], d))
            i, j, d = (np.concatenate(c) for c in zip(*found))
            return pa.table([a["qid"].take(pa.array(i)), b["id"].take(pa.array(j)), pa.array(d)], names=["qid", "id", "distance"])

        return q.groupBy("qgroup").cogroup(v.groupBy("group")).applyInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, distance double")

    def search(self, queries: DataFrame, k: int = 1, threshold: float | Column | None = None) -> DataFrame:
        """As :func:`knn`, over the ``nprobe`` nearest lists only."""

        def pick(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
            i, j, d = nearest(x, y, k)
            return i, j, np.sqrt(d)

        out = self._scan(queries, pick).withColumn("rank", F.row_number().over(_top("qid", k))).where(F.col("rank") <= k)
        if threshold is not None:
            out = out.where(F.col("distance") < threshold)
        return out.select("qid", "rank", "id", "distance")

    def range_search(self, queries: DataFrame, threshold: float) -> DataFrame:
        """(qid, id, distance): all vectors of the probed lists nearer than ``threshold``."""

        return self._scan(queries, lambda x, y: within(x, y, "euclidean", threshold))

    def noisy_queries(self, n_query: int = 100, max_noise: int = 3, seed: int = 0) -> DataFrame:
        """``n_query`` of the index's uint8 vectors with up to ``max_noise`` added to each element."""
        total = self.ntotal
        if n_query > total:
            raise ValueError(f"{n_query} queries are more than the index's {total} vectors")
        some = self.postings.select("id", "vec").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n_query)
        noise = lambda x, i: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(2 * max_noise + 1)) - max_noise).cast("double")
        return some.select(F.col("id").alias("qid"), F.transform("vec", lambda x, i: F.least(F.lit(255.0), F.greatest(F.lit(0.0), x.cast("double") + noise(x, i)))).alias("vec"))

    def tune(self, queries: DataFrame | None = None, min_recall: float = 99.0, n_query: int = 100, max_noise: int = 3, seed: int = 0) -> int:
        """Set and return the fewest probed lists whose share of right nearest
        neighbours, in percent, reaches ``min_recall``; all lists for 100.

        ``queries`` is (qid, vec); without it :meth:`noisy_queries` are taken. A query
        is answered rightly once the list of its true neighbour is probed, so one
        exhaustive pass over the queries gives the recall at every number of lists.
        """
        queries = self.noisy_queries(n_query, max_noise, seed) if queries is None else queries
        began = time.time()
        if min_recall >= 100:
            warnings.warn("only an exhaustive search is sure to have a recall of 100 %", stacklevel=2)
            n, recall = self.nlist, 100.0
        else:
            want = self._all().search(queries, 1).select("qid", "id")
            home = want.join(self.postings.select("id", "list_id"), "id").groupBy("qid").agg(F.min("list_id").alias("list_id"))
            rank = self._ranked(queries, self.nlist).join(home, "qid").groupBy(F.array_position("lists", F.col("list_id")).alias("n")).count()
            got = sorted((r["n"], r["count"]) for r in rank.collect())  # at most a row for each list
            total, found, n, recall = sum(c for _, c in got), 0, None, 0.0
            for at, c in got:
                found += c
                if 100 * found / total >= min_recall:
                    n, recall = int(at), 100 * found / total
                    break
            if n is None or n >= self.nlist > 1:
                raise TuningFailure(f"no number of lists below {self.nlist} reaches {min_recall} %")
        self.tuned = (recall, 1000 * (time.time() - began), n)
        return self.set_nprobe(n)

    def _all(self) -> InvertedFile:
        return InvertedFile(self.postings, self.centroids, self.nlist)

    def refill(self, vectors: DataFrame) -> InvertedFile:
        """An index of the same lists over the current (id, vec), whatever it held before."""
        return _filled(vectors.select("id", "vec").where("vec is not null"), self.centroids, self.nprobe)

    def save(self, path: str) -> None:
        self.postings.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/postings")
        spark = self.postings.sparkSession
        rows = [(i, c.tolist(), self.nprobe) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "list_id int, centroid array<double>, nprobe int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str, expect: int | None = None) -> InvertedFile:
        """Read back; ``expect`` is the number of vectors it must hold."""
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()  # one row for each list
        out = InvertedFile(spark.read.parquet(f"{path}/postings"), np.array([r["centroid"] for r in rows]), rows[0]["nprobe"])
        if expect is not None and out.ntotal != expect:
            raise ValueError(f"the index holds {out.ntotal} vectors, not {expect}")
        return out


def number_of_lists(n: int) -> int:
    return int(max(min(4 * math.sqrt(n), n / 39), 1))


def _centres(vectors: DataFrame, lists: int, length: int, seed: int) -> np.ndarray:
    """Centroids of ``lists`` lists; one list has the origin."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if lists <= 1:
        return np.zeros((1, length))
    fit = vectors.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    return np.array(KMeans(k=lists, seed=seed, maxIter=15).fit(fit).clusterCenters())


def build_index(vectors: DataFrame, pct_probe: float = 0.0, approximate: bool = True, nlist: int | None = None, train_rows: int = 50_000, seed: int = 7) -> InvertedFile | None:
    """An inverted file over (id, vec), or None for an empty table.

    Centroids are fitted by k-means on at most ``train_rows`` vectors; without
    ``approximate`` there is one list, so a search is exhaustive.
    """
    v = vectors.select("id", "vec").where("vec is not null")
    n = v.count()
    if not n:
        return None
    lists = (nlist or number_of_lists(n)) if approximate else 1
    fit = v.sample(fraction=train_rows / n, seed=seed) if n > train_rows else v
    centres = _centres(fit, lists, v.select(F.size("vec")).first()[0], seed)
    return _filled(v, centres, max(math.ceil(pct_probe * lists), 1))


def _filled(v: DataFrame, centres: np.ndarray, nprobe: int) -> InvertedFile:
    def assign(batches):
        for b in batches:
            x = _rows(b.column("vec"))
            if len(x) and x.shape[1] != centres.shape[1]:
                raise ValueError(f"vectors have {x.shape[1]} elements, the index {centres.shape[1]}")
            near = ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), b.column("id"), b.column("vec")], names=["list_id", "id", "vec"])

    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    out = InvertedFile(v.mapInArrow(assign, f"list_id int, id {kinds['id']}, vec {kinds['vec']}"), centres)
    out.set_nprobe(nprobe)
    return out


def from_table(table: DataFrame, hash_length: int, train_size: int | None = None, ids_train: DataFrame | None = None, index: InvertedFile | None = None, dtype: str = "uint8", distance_metric: str = "euclidean", seed: int = 7) -> InvertedFile:
    """An index over a table of (id, hash), hashes being bytes of uint8.

    Such a table comes from :func:`sources.lookup.read_jdbc` or any other source. Lists
    are fitted on ``ids_train`` or on ``train_size`` rows chosen by a hash of their
    id (39 a list by default, which is also the least); a given ``index`` is not
    fitted again but emptied and filled with the table's rows.
    """
    if dtype != "uint8":
        raise ValueError("only hashes of uint8 can be indexed")
    if distance_metric != "euclidean":
        raise ValueError("only the euclidean distance can be indexed")
    rows = table.where("hash is not null")
    bad = rows.where(F.length("hash") != hash_length).limit(1).count()
    if bad or (index is not None and index.hash_length != hash_length):
        raise ValueError(f"hashes are not of length {hash_length}")
    byte = F.transform(F.sequence(F.lit(1), F.lit(hash_length)), lambda i: F.conv(F.hex(F.substring("hash", i, F.lit(1))), 16, 10).cast("float"))
    v = rows.select("id", byte.alias("vec"))
    if index is not None:
        return index.refill(v)
    n = rows.count()
    lists = int(min(4 * math.sqrt(n), n / 39))
    if train_size is not None and train_size > n:
        raise ValueError(f"cannot train on {train_size} of {n} hashes")
    if lists < 1:
        raise ValueError("an index needs at least 39 hashes")
    chosen = ids_train.count() if ids_train is not None else train_size or 39 * lists
    if chosen < 39 * lists:
        raise ValueError(f"{n} hashes need at least {39 * lists} to train on, not {chosen}")
    fit = v.join(ids_train.select("id").distinct(), "id", "left_semi") if ids_train is not None else v.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(chosen)
    return _filled(v, _centres(fit, lists, hash_length, seed), 1)


def approximate_pairs(index: InvertedFile, files: DataFrame, counts: DataFrame, threshold: float, minimum_overlap: float = 0.0) -> DataFrame:
    """File pairs as ``overlap_pairs`` gives, from the lists that are probed.

    ``files`` is (id, sub, vec) and ``index`` was built over ids ``struct(id,
    sub)``; ``counts`` is (id, n).
    """
    q = files.select(F.struct("id", "sub").alias("qid"), "vec")
    hit = index.range_search(q, threshold).where("qid.id < id.id")
    hit = hit.groupBy(F.col("qid.id").alias("id1"), F.col("id.id").alias("id2")).agg(F.countDistinct("qid.sub").alias("a"), F.countDistinct("id.sub").alias("b"))
    n1, n2 = counts.select(F.col("id").alias("id1"), F.col("n").alias("n1")), counts.select(F.col("id").alias("id2"), F.col("n").alias("n2"))
    least = F.least(F.col("a") / F.col("n1"), F.col("b") / F.col("n2"))
    return hit.join(n1, "id1").join(n2, "id2").where((least >= minimum_overlap) & (least > 0)).select("id1", "id2")


def decode_queries(requests: DataFrame, hash_length: int, dtype: str = "uint8", form: str = "base64", strict: bool = True) -> DataFrame:
    """(id, hash text) -> (qid, vec); invalid texts raise, or are left out."""
    good = valid_string(F.col("hash"), hash_length, dtype, form)
    if strict and requests.where(~good).limit(1).count():
        raise QueryDecodingFailure(f"a query's hash is not {byte_length(hash_length, dtype)} bytes of {form}")
    from fingerlake.functions.codecs import string_to_vector

    return requests.where(good).select(F.col("id").alias("qid"), string_to_vector(dtype, hash_length, form)("hash").alias("vec"))
