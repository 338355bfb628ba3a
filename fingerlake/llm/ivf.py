"""Nearest neighbours of chosen rows: an inverted file that tunes itself to a recall.

The rows that ``asks`` marks are queries; every usable row is in the index. Centres are
fitted by k-means on a sample of at most ``SAMPLE_BYTES`` of vectors, chosen by a hash,
and every row goes into the list of its nearest centre. For ``TUNE`` queries, chosen by
a hash too, the true neighbours are found by comparing them with every row; the ranks of
these neighbours' lists give the recall at every number of lists, and the smallest number
that reaches ``RECALL`` is what all queries probe. Where all pairs of queries and rows are
at most ``EXACT_PAIRS``, there is one list and the answer is exact.

Lists are laid out in parts of at most about ``PART_BYTES``, near lists in the same part;
a list that is larger is spread over several parts, and whoever probes it goes to
all of them, so there is no cap and no hot list. A row is sent once, a query once to each
part that has a list it probes; a part's rows come first and its queries pass by in batches.
The sampled rows in a query's lists give a bound that its neighbours there exceed.

Vectors are compared as whole numbers of ``SCALE``, whose sums of products a 32-bit float
holds exactly: answers depend neither on tiles nor on how the table is partitioned. A
part answers with the cosines, in 64 bits, of the best ``SPARE`` more than ``k``.

Cases: unusable vectors are those of :mod:`ann`, and neither queries nor neighbours; equal
vectors and rows with equal id are distinct, and a row is never its own neighbour; of
neighbours with equal cosine the smaller id comes first, null before all; a table of n
usable rows gives at most n - 1 neighbours each; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerlake.llm.ann import _S, _heads, _matrix, _packed, _ragged, _usable
from fingerlake.plans.lineage import discard, materialize

K = 10
RECALL = 0.93
#: Queries whose true neighbours decide how many lists are probed.
TUNE = 512
EXACT_PAIRS = 1_000_000_000
MAX_LISTS = 8192
SAMPLE_BYTES = 16_000_000
ROUNDS = 5
#: Bytes of a part's vectors.
PART_BYTES = 48_000_000
SCALE = 4000
SPARE = 6
#: Rows and queries of one product; rows are padded to a multiple of ``GROUP``.
ROWS, ASKS, GROUP = 2048, 1024, 16
#: Queries whose best are held at once.
BATCH = 4096
SEED = 5

_NEVER = -(1 << 24)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _S(SCALE))


class _Tops:
    """The best ``m`` of each query as sorted numbers: query, distance, place."""

    def __init__(self, asks: np.ndarray, m: int, floor: np.ndarray | None = None):
        self.asks, self.m = asks, m
        #: What a candidate must exceed.
        self.floor = np.full(len(asks), _NEVER, np.float64) if floor is None else floor
        self.room = np.empty(ROWS * ASKS, _S)
        self.keys = [np.zeros(0, np.uint64)]
        self.held = self.pending = 0

    def compare(self, q: np.ndarray, rows: np.ndarray, real: int, place: int) -> None:
        """Offer ``rows``, padded from ``real`` on, to the queries ``q``; the first has place ``place``."""
        for i in range(0, len(rows), ROWS):
            block = rows[i : i + ROWS]
            for j in range(0, len(q), ASKS):
                self._tile(q[j : j + ASKS], block, real - i, place + i)

    def _tile(self, q: np.ndarray, block: np.ndarray, real: int, place: int) -> None:
        n = len(block)
        sim = np.matmul(block, self.asks[q].T, out=self.room[: n * len(q)].reshape(n, len(q)))
        sim[max(0, real) :] = _NEVER
        sim = sim.reshape(n // GROUP, GROUP, len(q))
        most = sim.max(axis=1)
        need = (self.floor[q] + 1).astype(_S)
        new = np.flatnonzero(need == _NEVER + 1)
        if len(new) and n // GROUP > self.m:
            # So many groups have something as good, so no worse one is wanted.
            need[new] = np.maximum(need[new], np.partition(most[:, new], n // GROUP - self.m, axis=0)[n // GROUP - self.m])
        c, a = np.divmod(np.flatnonzero(most >= need), len(q))
        got = sim[c, :, a]
        h, g = np.nonzero(got >= need[a][:, None])
        far = ((1 << 24) - got[h, g].astype(np.int64)).astype(np.uint64)
        self.keys.append((q[a[h]].astype(np.uint64) << np.uint64(48)) | (far << np.uint64(22)) | (place + c[h] * GROUP + g).astype(np.uint64))
        self.pending += len(h)
        if self.pending > 20_000 + self.held:
            self.squeeze()

    def squeeze(self) -> None:
        k = np.concatenate(self.keys)
        k.sort()
        q = (k >> np.uint64(48)).astype(np.int64)
        head = _heads(q)
        rank = np.arange(len(k)) - np.repeat(head, np.diff(np.append(head, len(k))))
        last = rank == self.m - 1
        self.floor[q[last]] = (1 << 24) - ((k[last] >> np.uint64(22)) & np.uint64((1 << 26) - 1)).astype(np.int64)
        self.keys = [k[rank < self.m]]
        self.held, self.pending = len(self.keys[0]), 0

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, place)."""
        self.squeeze()
        k = self.keys[0]
        return (k >> np.uint64(48)).astype(np.int64), ((k >> np.uint64(22)) & np.uint64((1 << 26) - 1)).astype(np.int64), (k & np.uint64((1 << 22) - 1)).astype(np.int64)


def _padded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((-len(x) % GROUP, x.shape[1]), x.dtype)])


def _nearest_list(w: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[(w[i : i + ROWS] @ centres.T).argmax(axis=1) for i in range(0, len(w), ROWS)]])


def _fit(x: np.ndarray, lists: int) -> np.ndarray:
    """Centres of spherical k-means."""
    c = x[np.random.default_rng(SEED).choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        at = _nearest_list(x, c)
        order = np.argsort(at, kind="stable")
        head = _heads(at[order])
        mean = np.add.reduceat(x[order], head, axis=0)
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        c[at[order][head]] = mean / np.where(norm > 0, norm, 1)
    return c


def _near_order(c: np.ndarray) -> np.ndarray:
    """The centres so that near ones are close: halves along the widest direction, and so on."""
    out, todo = [], [np.arange(len(c))]
    while todo:
        ix = todo.pop()
        if len(ix) <= 4:
            out.append(ix)
            continue
        v = c[ix] - c[ix].mean(axis=0)
        d = v[np.argmax((v * v).sum(axis=1))]
        for _ in range(5):
            d = v.T @ (v @ d)
            d = d / max(np.linalg.norm(d), 1e-30)
        by = ix[np.argsort(v @ d, kind="stable")]
        todo += [by[len(by) // 2 :], by[: len(by) // 2]]
    return np.concatenate(out)


def _parts(size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first part, number of parts) of each list, and the number of all parts."""
    first, pieces = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    part, filled = -1, math.inf
    for i in range(len(size)):
        if size[i] > room:
            first[i], pieces[i] = part + 1, math.ceil(size[i] / room)
            part, filled = part + pieces[i], math.inf
            continue
        if filled + size[i] > room:
            part, filled = part + 1, 0
        first[i] = part
        filled += size[i]
    return first, pieces, int(part) + 1


def _place(centres: np.ndarray):
    """Adds each row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_nearest_list(_whole(_matrix(b.column("vec"))), centres))], names=[*b.schema.names, "list"])

    return run


def _truth(asks: np.ndarray, own: np.ndarray, k: int):
    """Near rows of every query asked, by their lists: (q, far, list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = None
        for b in batches:
            if not b.num_rows:
                continue
            w = _whole(_matrix(b.column("vec")))
            tops = _Tops(asks, k + 1, floor)
            tops.compare(np.arange(len(asks)), _padded(w), len(w), 0)
            q, far, place = tops.best()
            floor = tops.floor
            other = b.column("row").to_numpy()[place] != own[q]
            yield pa.RecordBatch.from_arrays([pa.array(q[other]), pa.array(far[other]), b.column("list").take(pa.array(place[other]))], names=["q", "far", "list"])

    return run


def _probes(placed: DataFrame, centres: np.ndarray, k: int) -> int:
    """How many lists reach ``RECALL`` for a sample of the queries."""
    t = placed.where("asks").orderBy("hash", "vec_id", "vec").limit(TUNE).select("row", "vec").toArrow()
    asks = _whole(_matrix(t["vec"]))
    found = placed.select("row", "vec", "list").mapInArrow(_truth(asks, t["row"].to_numpy(), k), "q long, far long, list long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("far", "list"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "list").toArrow()
    if not true.num_rows:
        return 1
    order = np.argsort(-(asks @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), 1)
    at = np.sort(place[true["q"].to_numpy(), true["list"].to_numpy()])
    return int(at[math.ceil(RECALL * len(at)) - 1]) + 1


def _floors(w: np.ndarray, probed: np.ndarray, sample: np.ndarray, lists: np.ndarray, m: int) -> np.ndarray:
    """What the best ``m`` of each query's lists exceed, by the sampled rows in these lists.

    Of the sample's groups ``m`` have a row this good; ``probed`` has a row for each list.
    """
    most = [np.full((0, len(w)), _NEVER, _S)]
    for i in range(0, len(sample) // GROUP * GROUP, ROWS):
        block = sample[i : i + ROWS]
        block = block[: len(block) // GROUP * GROUP]
        sim = block @ w.T
        np.copyto(sim, _NEVER, where=~probed[lists[i : i + len(block)]])
        most.append(sim.reshape(-1, GROUP, len(w)).max(axis=1))
    most = np.concatenate(most)
    if len(most) < m:
        return np.full(len(w), _NEVER, np.float64)
    return np.maximum(np.partition(most, len(most) - m, axis=0)[len(most) - m].astype(np.float64) - 1, _NEVER)


def _send(centres: np.ndarray, first: np.ndarray, pieces: np.ndarray, probes: int, sample: np.ndarray, k: int):
    """Each row to its list's part, each query to the parts of the lists it probes."""
    names = ["part", "asks", "row", "vec_id", "vec", "lists", "floor"]
    sampled = _nearest_list(sample, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, row = b.column("list").to_numpy(), b.column("row").to_numpy()
            part = first[at] + (row + (row >> 33)) % pieces[at]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(at), bool)), b.column("row"), b.column("vec_id"), b.column("vec"), _packed(np.arange(len(at) + 1), at.astype(np.int32)), pa.nulls(len(at), pa.float64())], names=names)
            asks = np.flatnonzero(b.column("asks").to_numpy(zero_copy_only=False))
            for i in range(0, len(asks), ASKS // 2):
                ix = asks[i : i + ASKS // 2]
                w = _whole(_matrix(b.column("vec").take(pa.array(ix))))
                probed = np.ones((len(ix), len(centres)), bool)
                if probes < len(centres):
                    near = np.argpartition(-(w @ centres.T), probes - 1, axis=1)[:, :probes]
                    probed[:] = False
                    np.put_along_axis(probed, near, True, 1)
                floor = _floors(w, np.ascontiguousarray(probed.T), sample, sampled, k + 1 + SPARE)
                # Lists ascend, and so do their parts.
                who, lists = np.nonzero(probed)
                n = pieces[lists]
                who, lists = np.repeat(who, n), np.repeat(lists, n)
                part = first[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(n) - n, n)
                head = _heads(who * (int(first.max() + pieces.max()) + 1) + part)
                src = pa.array(ix[who[head]])
                yield pa.RecordBatch.from_arrays([pa.array(part[head]), pa.array(np.ones(len(head), bool)), *[b.column(c).take(src) for c in ("row", "vec_id", "vec")], _packed(np.append(head, len(who)), lists.astype(np.int32)), pa.array(floor[who[head]])], names=names)

    return run


class _Shelf:
    """A part's rows, list after list, ids ascending in each."""

    def __init__(self, table: pa.Table):
        table = table.append_column("list", pa.array(_ragged(table["lists"], np.int32)[1]))
        order = pc.sort_indices(table, [(c, "ascending") for c in ("list", "vec_id", "vec")], null_placement="at_start")
        table = table.select(["row", "vec_id", "vec", "list"]).take(order).combine_chunks()
        self.ids = table["vec_id"].combine_chunks()
        self.rank = pc.rank(self.ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        self.rows = table["row"].to_numpy()
        self.x = _matrix(table["vec"])
        lists = table["list"].to_numpy()
        head = _heads(lists)
        self.size = np.diff(np.append(head, len(lists)))
        room = -(-self.size // GROUP) * GROUP
        self.start = np.cumsum(room) - room
        self.lists = lists[head]
        #: Row of each place of the padded layout.
        self.at = np.zeros(int(room.sum()), np.int64)
        self.at[np.arange(len(lists)) + np.repeat(self.start - head, self.size)] = np.arange(len(lists))
        self.w = np.zeros((len(self.at), self.x.shape[1]), _S)
        self.w[np.arange(len(lists)) + np.repeat(self.start - head, self.size)] = _whole(self.x)

    def answer(self, b: pa.RecordBatch, k: int) -> pa.RecordBatch:
        y = _matrix(b.column("vec"))
        n, lists = _ragged(b.column("lists"), np.int32)
        q = np.repeat(np.arange(len(n)), n)
        order = np.argsort(lists, kind="stable")
        lists, q = lists[order], q[order]
        cuts = np.append(_heads(lists), len(lists))
        tops = _Tops(_whole(y), k + 1 + SPARE, b.column("floor").to_numpy().copy())
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            i = int(np.searchsorted(self.lists, lists[lo]))
            if i < len(self.lists) and self.lists[i] == lists[lo]:
                s, size = int(self.start[i]), int(self.size[i])
                tops.compare(q[lo:hi], self.w[s : s - (-size // GROUP) * GROUP], size, s)
        q, _, place = tops.best()
        at = self.at[place]
        other = self.rows[at] != b.column("row").to_numpy()[q]
        q, at = q[other], at[other]
        sim = np.zeros(len(q))
        for i in range(0, len(q), 8192):
            u, v = y[q[i : i + 8192]].astype(np.float64), self.x[at[i : i + 8192]].astype(np.float64)
            sim[i : i + 8192] = (u * v).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))
        far = -np.clip(sim, -1, 1)
        order = np.lexsort((self.rank[at], far, q))
        q, at, far = q[order], at[order], far[order]
        head = _heads(q)
        keep = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q)))) < k
        q, at, far = q[keep], at[keep], far[keep]
        head = _heads(q)
        near = pa.StructArray.from_arrays([pa.array(far), self.ids.take(pa.array(at))], names=["far", "id"])
        src = pa.array(q[head])
        return pa.RecordBatch.from_arrays([b.column("row").take(src), b.column("vec_id").take(src), pa.ListArray.from_arrays(pa.array(np.append(head, len(q)).astype(np.int32)), near)], names=["row", "vec_id", "near"])


def _answers(k: int):
    """A partition is a part: its rows first, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shelf = None
        for b in batches:
            rows = b.num_rows - int(b.column("asks").to_numpy(zero_copy_only=False).sum())
            if rows:
                held.append(b.slice(0, rows))
            if rows < b.num_rows and (held or shelf):
                if shelf is None:
                    shelf = _Shelf(pa.Table.from_batches(held))
                    held = []
                for i in range(rows, b.num_rows, BATCH):
                    yield shelf.answer(b.slice(i, BATCH), k)

    return run


def nearest(vectors: DataFrame, asks: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, rank, neighbour_id, similarity)``: the ``k`` nearest rows of each row that ``asks`` marks.

    ``asks`` is an expression of ``vec_id``, as the id is called here.
    """
    unit, dim = _usable(vectors, id_col, vec_col)
    digest = F.pmod(F.xxhash64(F.lit(SEED), "vec_id", "vec"), F.lit(1 << 40))
    unit = unit.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", F.coalesce(asks, F.lit(False)).alias("asks"), digest.alias("hash"))
    unit = materialize(unit, "unit")
    count = unit.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asks")).first()
    n, dim = count["n"], max(1, dim)
    kind = unit.schema["vec_id"].dataType.simpleString()
    room = min(1 << 20, max(64, PART_BYTES // (4 * dim)), max(8192, n // 48))
    centres, size, probes = np.zeros((1, dim), _S), np.array([n]), 1
    placed, sample = unit.withColumn("list", F.lit(0).cast("long")), np.zeros((0, dim), _S)
    if n * (count["asks"] or 0) > EXACT_PAIRS:
        most = SAMPLE_BYTES // (4 * dim)
        some = unit.where(F.col("hash") <= int(min(1.0, 1.1 * most / n) * (1 << 40)))
        x = _matrix(some.orderBy("hash", "vec").limit(most).select("vec").toArrow()["vec"])
        lists = min(MAX_LISTS, int(4 * math.sqrt(n)), len(x) // 4)
        if lists > 1:
            centres = _fit(x, lists)
            centres, sample = _whole(centres[_near_order(centres)]), _whole(x)
            placed = materialize(unit.mapInArrow(_place(centres), f"row long, vec_id {kind}, vec binary, asks boolean, hash long, list long"), "placed")
            discard(unit)
            unit = placed
            size = np.zeros(lists, np.int64)
            for r in placed.groupBy("list").count().collect():
                size[r["list"]] = r["count"]
            probes = _probes(placed, centres, k)
    first, pieces, parts = _parts(size, room)
    sent = placed.mapInArrow(_send(centres, first, pieces, probes, sample, k), f"part long, asks boolean, row long, vec_id {kind}, vec binary, lists binary, floor double")
    sent = sent.repartitionById(max(1, parts), F.col("part").cast("int")).sortWithinPartitions("asks")
    got = sent.mapInArrow(_answers(k), f"row long, vec_id {kind}, near array<struct<far: double, id: {kind}>>")
    best = got.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    out = best.select("vec_id", F.posexplode("near").alias("__at", "__near"))
    out = out.select("vec_id", (F.col("__at") + 1).cast("int").alias("rank"), F.col("__near.id").alias("neighbour_id"), (-F.col("__near.far")).alias("similarity"))
    out = materialize(out, "nearest")
    discard(unit)
    return out
