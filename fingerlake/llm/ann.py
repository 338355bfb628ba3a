"""Approximate nearest neighbours: NN-descent graph and greedy graph search.

Every vector keeps a list of its ``LIST`` most similar vectors. A round of
NN-descent lets the neighbours of each node (those in its list and those that list
it) meet and compare each other; whoever is closer than the worst in a list gets
in. A pair meets once: only pairs with an entry that is new since the last round
are compared. Rounds end when fewer than ``SETTLED`` of all entries change. The
lists start from the leaves of a few random projection trees.

A query walks the graph: it holds its best candidates, visits the lists of those it
has not visited yet, and stops when the nearest ``BEAM`` are visited. A row of the
table starts at its own list, any other vector at seeded entry nodes.

Nodes are numbered in the order of a projection tree whose planes go through the
table's mean, ties by a hash of id and vector, and each run of numbers is a part: near nodes
share parts, a part's size follows from the vectors' length, and nothing depends on how the
table is partitioned. The other trees' leaves are runs of their orders too, so a dense
spot makes many leaves and not a large one. A vector is sent once to each part in which it is
met, with the nodes that meet it there, and comparisons are matrix products inside
a part; parts answer with list candidates only. Lists and vectors travel as bytes. Each
round is written to the shared folder; broadcast are the seeds of a search only.

Similarity is the cosine. Cases: vectors that are null or zero, hold a null or NaN,
or have another length than most, are neither queries nor neighbours; equal vectors
and rows with equal vec_id are distinct nodes, and a node is never its own
neighbour; a null vec_id is carried through; ties go to the lower node number; a
table of n usable rows gives at most n - 1 neighbours each; columns besides the id and
the vector play no part, whatever their names. If a bound on rounds or hops ends the
search before it has settled, a warning says so.
"""

from __future__ import annotations

import gc
import itertools
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerlake.plans.lineage import discard, materialize
from fingerlake.plans.running import sums_before

K = 10
LIST = 56
NEW = 40
#: Rows and columns of one product among a hub's company.
TILE = 1024
TREES = 4
LEAF = 600
SETTLED = 0.002
MAX_ROUNDS = 40
BEAM = 16
MAX_HOPS = 100
#: Nodes of a part at most, and bytes of the vectors that may meet there.
PART_NODES = 4096
PART_BYTES = 256_000_000
ENTRIES = 32
SEED = 3

_STATE = "part long, row long, vec binary, ids binary, sims binary, fresh binary, news long, ahead boolean"
_MSG = "part long, row long, ids binary, sims binary"
_BACK = "part long, row long, by binary, fresh binary"
_I, _S, _F = np.int64, np.float32, np.bool_


def _ragged(col: pa.ChunkedArray | pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values) of a column of packed arrays."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, dtype)
    _, off, data = a.buffers()
    at = np.frombuffer(off, np.int32)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    return np.diff(at).astype(np.int64) // np.dtype(dtype).itemsize, np.frombuffer(raw.tobytes(), dtype)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    n, flat = _ragged(col, _S)
    return flat.reshape(len(n), -1) if len(n) else np.zeros((0, 1), _S)


def _packed(off: np.ndarray, values: np.ndarray) -> pa.Array:
    """A column of packed arrays from offsets and flat values."""
    v = np.ascontiguousarray(values)
    at = (np.asarray(off, np.int64) * v.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(v)])


def _heads(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _lists(rows: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Group flat values by ``rows``, which are sorted."""
    at = _heads(rows)
    off = np.concatenate([at, [len(rows)]])
    return rows[at], [_packed(off, v) for v in values]


def _by_row(table: pa.Table) -> pa.Table:
    """The table in order of its nodes, however it arrived."""
    return table.take(pa.array(np.argsort(table["row"].to_numpy(), kind="stable")))


def _top(at: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The ``size`` best distinct entries of each list ``at``; an entry known before stays old.

    Lists and ids, then lists and similarities, are sorted as one number each.
    """
    order = np.argsort((at.astype(np.uint64) << np.uint64(40)) | ids.astype(np.uint64))
    at, ids, sims, fresh = at[order], ids[order], sims[order], fresh[order]
    if len(at):
        once = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])]))
        at, ids, sims, fresh = at[once], ids[once], np.maximum.reduceat(sims, once), np.logical_and.reduceat(fresh, once)
    far = ((1 - np.clip(sims.astype(np.float64), -1, 1)) * (1 << 38)).astype(np.uint64)
    order = np.argsort((at.astype(np.uint64) << np.uint64(40)) | far, kind="stable")
    at, ids, sims, fresh = at[order], ids[order], sims[order], fresh[order]
    head = _heads(at)
    keep = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at)))) < size
    return at[keep], ids[keep], sims[keep], fresh[keep]


class _Best:
    """The best ``LIST`` candidates of each row, kept as sorted numbers.

    A number holds the row, its distance and the candidate, rows and candidates by
    their places in the part's tables; a part's tables are small enough for that.
    """

    def __init__(self, rows: int, candidates: int, worst: np.ndarray):
        self.bits = max(1, (candidates - 1).bit_length())
        self.far = min(32, 64 - self.bits - max(1, (rows - 1).bit_length()))
        if self.far < 20:
            raise ValueError(f"a part with {rows} and {candidates} vectors is too large")
        self.scale = ((1 << self.far) - 1) / 2.0
        self.worst = worst.copy()
        self.keys: list[np.ndarray] = []
        self.held = self.pending = 0

    def add(self, u: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        """Offer ``v`` to ``u``."""
        far = ((1 - np.clip(s.astype(np.float64), -1, 1)) * self.scale).astype(np.uint64)
        self.keys.append((((u.astype(np.uint64) << np.uint64(self.far)) | far) << np.uint64(self.bits)) | v.astype(np.uint64))
        self.pending += len(u)
        if self.pending > 3_000_000 + self.held:
            self.squeeze()

    def _rows(self, k: np.ndarray) -> np.ndarray:
        return (k >> np.uint64(self.far + self.bits)).astype(np.int64)

    def _sims(self, k: np.ndarray) -> np.ndarray:
        return 1 - ((k >> np.uint64(self.bits)) & np.uint64((1 << self.far) - 1)).astype(np.float64) / self.scale

    def squeeze(self) -> None:
        k = np.concatenate([np.zeros(0, np.uint64), *self.keys])
        k.sort()
        if len(k):
            k = k[np.concatenate([[True], k[1:] != k[:-1]])]
        head = _heads(self._rows(k))
        rank = np.arange(len(k)) - np.repeat(head, np.diff(np.append(head, len(k))))
        last = k[rank == LIST - 1]
        # A full row wants nothing worse than its last, but for the rounding of distances.
        at = self._rows(last)
        self.worst[at] = np.maximum(self.worst[at], self._sims(last) - 2 / self.scale)
        k = k[rank < LIST]
        self.keys, self.held, self.pending = [k], len(k), 0

    def answer(self, rows: np.ndarray, ids: np.ndarray, span: int) -> pa.Table:
        """Candidate lists of ``rows``, which name the rows by place as ``ids`` the candidates."""
        self.squeeze()
        k = self.keys[0]
        at = self._rows(k)
        head = _heads(at)
        off = np.append(head, len(at))
        to = rows[at[head]]
        return pa.table([pa.array(to // span), pa.array(to), _packed(off, ids[(k & np.uint64((1 << self.bits) - 1)).astype(np.int64)]), _packed(off, self._sims(k).astype(_S))], names=["part", "row", "ids", "sims"])


def _leaf_lists(seed: int, size: int, span: int):
    """Exact lists inside a tree's leaf, which is halved until it is small."""

    def run(table: pa.Table) -> pa.Table:
        table = _by_row(table)
        rows, x = table["row"].to_numpy(), _matrix(table["vec"])
        rng = np.random.default_rng([seed, int(rows[0]) & 0x7FFFFFFF])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [np.arange(len(rows))]
        while todo:
            ix = todo.pop()
            if len(ix) > LEAF:
                a, b = rng.choice(ix, 2, replace=False)
                by = ix[np.argsort(x[ix] @ (x[a] - x[b]), kind="stable")]
                todo += [by[: len(by) // 2], by[len(by) // 2 :]]
                continue
            g = x[ix] @ x[ix].T
            np.fill_diagonal(g, -2)
            k = min(size, len(ix) - 1)
            if k:
                best = np.argpartition(-g, k - 1, axis=1)[:, :k]
                out.append((np.repeat(rows[ix], k), rows[ix][best].ravel(), np.take_along_axis(g, best, 1).ravel()))
        if not out:
            return _nothing()
        r, i, s = (np.concatenate(v) for v in zip(*out))
        order = np.argsort(r, kind="stable")
        rows_out, lists = _lists(r[order], i[order], s[order].astype(np.float32))
        return pa.table([pa.array(rows_out // span), pa.array(rows_out), *lists], names=["part", "row", "ids", "sims"])

    return run


def _merge(size: int):
    """Put candidates into the lists of their part's nodes.

    ``news`` counts a list's fresh entries, ``ahead`` tells of one in the beam.
    """

    def run(state: pa.Table, cand: pa.Table) -> pa.Table:
        if not state.num_rows:
            return state
        state = _by_row(state)
        rows = state["row"].to_numpy()
        ln, ids = _ragged(state["ids"], _I)
        _, sims = _ragged(state["sims"], _S)
        _, fresh = _ragged(state["fresh"], _F)
        cn, cids = _ragged(cand["ids"], _I)
        _, csims = _ragged(cand["sims"], _S)
        at = np.concatenate([np.repeat(np.arange(len(rows)), ln), np.repeat(np.searchsorted(rows, cand["row"].to_numpy()), cn)])
        owner, i, s, f = _top(at, np.concatenate([ids, cids]), np.concatenate([sims, csims]), np.concatenate([fresh, np.ones(len(cids), bool)]), size)
        off = np.searchsorted(owner, np.arange(len(rows) + 1))
        rank = np.arange(len(owner)) - np.repeat(off[:-1], np.diff(off))
        news = np.bincount(owner[f], minlength=len(rows))
        ahead = np.bincount(owner[f & (rank < BEAM)], minlength=len(rows)) > 0
        return pa.table([state["part"], state["row"], state["vec"], _packed(off, i), _packed(off, s.astype(_S)), _packed(off, f), pa.array(news), pa.array(ahead)], names=["part", "row", "vec", "ids", "sims", "fresh", "news", "ahead"])

    return run


def _chosen(rows: np.ndarray, lens: np.ndarray, fresh: np.ndarray, limit: int) -> np.ndarray:
    """Which fresh entries take part in this round: the ``limit`` best of each list."""
    rank = np.cumsum(fresh) - fresh
    start = np.concatenate([[0], np.cumsum(lens)[:-1]])
    base = np.repeat(rank[np.minimum(start, max(len(rank) - 1, 0))] if len(rank) else rank, lens)
    return fresh & (rank - base < limit)


def _reverse(span: int, every: bool = False):
    """Tell every listed node who lists it: (part, row, by, fresh)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ln, ids = _ragged(b.column("ids"), _I)
            _, fresh = _ragged(b.column("fresh"), _F)
            row = b.column("row").to_numpy()
            rows = np.repeat(row, ln)
            pick = np.zeros(len(ids), bool) if every else _chosen(row, ln, fresh, NEW)
            go = np.ones(len(ids), bool) if every else pick | ~fresh
            order = np.argsort(ids[go], kind="stable")
            dest, lists = _lists(ids[go][order], rows[go][order], pick[go][order])
            yield pa.RecordBatch.from_arrays([pa.array(dest // span), pa.array(dest), *lists], names=["part", "row", "by", "fresh"])

    return run


def _visits(span: int):
    """Send each node to the nodes it is a neighbour of, once to each part."""

    def run(state: pa.Table, back: pa.Table) -> pa.Table:
        names = ["dest", "row", "vec", "worst", "hosts", "fresh"]
        state = _by_row(state)
        rows = state["row"].to_numpy()
        ln, ids = _ragged(state["ids"], _I)
        _, sims = _ragged(state["sims"], _S)
        _, fresh = _ragged(state["fresh"], _F)
        pick = _chosen(rows, ln, fresh, NEW)
        go = pick | ~fresh
        bn, by = _ragged(back["by"], _I)
        _, bf = _ragged(back["fresh"], _F)
        who = np.concatenate([np.repeat(rows, ln)[go], np.repeat(back["row"].to_numpy(), bn)])
        host = np.concatenate([ids[go], by])
        new = np.concatenate([pick[go], bf])
        order = np.lexsort((~new, host, who))
        who, host, new = who[order], host[order], new[order]
        once = np.concatenate([[True], (who[1:] != who[:-1]) | (host[1:] != host[:-1])]) if len(who) else np.zeros(0, bool)
        who, host, new = who[once], host[once], new[once]
        at = np.searchsorted(rows, who)
        end = np.cumsum(ln)
        worst = np.full(len(rows), -2, _S)
        full = ln >= LIST
        worst[full] = sims[end[full] - 1]
        dest = host // span
        order = np.lexsort((at, dest))
        dest, at, host, new = dest[order], at[order], host[order], new[order]
        head = _heads(dest * max(1, len(rows)) + at)
        off = np.concatenate([head, [len(at)]])
        src = pa.array(at[head])
        return pa.table([pa.array(dest[head]), state["row"].take(src), state["vec"].take(src), pa.array(worst[at[head]]), _packed(off, host), _packed(off, new)], names=names)

    return run


def _nothing() -> pa.Table:
    """No candidates."""
    return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["part", "row", "ids", "sims"])


def _meet(span: int):
    """The neighbours of each of the part's nodes compare each other."""

    def run(table: pa.Table) -> pa.Table:
        table = _by_row(table)
        rows, x = table["row"].to_numpy(), _matrix(table["vec"])
        worst = table["worst"].to_numpy()
        ln, host = _ragged(table["hosts"], _I)
        _, new = _ragged(table["fresh"], _F)
        ix = np.repeat(np.arange(len(rows)), ln)
        order = np.lexsort((ix, ~new, host))
        host, ix, new = host[order], ix[order], new[order]
        cuts = np.concatenate([_heads(host), [len(host)]])
        best = _Best(len(rows), len(rows), worst)
        worst = best.worst
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            n_new = int(new[lo:hi].sum())
            if not n_new:
                continue
            fresh_ix, old_ix = ix[lo : lo + n_new], ix[lo + n_new : hi]
            every = np.concatenate([fresh_ix, old_ix])
            # All of a hub's company meets, a tile of at most TILE x TILE at a time.
            for i, j in itertools.product(range(0, n_new, TILE), range(0, len(every), TILE)):
                fi, ej = fresh_ix[i : i + TILE], every[j : j + TILE]
                sim = x[fi] @ x[ej].T
                for u, v, s in ((fi, ej, sim), (ej, fi, sim.T)):
                    p, q = np.nonzero(s > worst[u][:, None])
                    ok = u[p] != v[q]
                    best.add(u[p[ok]], v[q[ok]], s[p[ok], q[ok]])
        return best.answer(rows, rows, span)

    return run


def _clean(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of rounds that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, vec) of the usable rows as packed unit vectors, and their length."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec")).where("vec is not null")
    if dim is None:
        size = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = size["d"] if size else 0

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            # Null elements have become NaN, and so has their norm.
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.flatnonzero((norm > 0) & (norm < np.inf))
            x = (x[ok] / norm[ok, None]).astype(_S)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(ok)), _packed(np.arange(len(ok) + 1) * dim, x.ravel())], names=["vec_id", "vec"])

    kind = v.schema["vec_id"].dataType.simpleString()
    return v.where((F.size("vec") == dim) & (F.lit(dim) > 0)).mapInArrow(unit, f"vec_id {kind}, vec binary"), dim


def _mean(v: DataFrame, dim: int) -> np.ndarray:
    """The mean vector: one sum a task comes to the driver."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                s += _matrix(b.column("vec")).sum(axis=0, dtype=np.float64)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["s", "n"])

    got = v.select("vec").mapInArrow(total, "s binary, n long").collect()
    return sum((np.frombuffer(r["s"]) for r in got), np.zeros(dim)) / max(1, sum(r["n"] for r in got))


def _ordered(v: DataFrame, planes: np.ndarray, shift: np.ndarray, n: int, ties: list[str], out: str) -> DataFrame:
    """Adds ``out`` and ``tree``: a row's place in the order of each tree of ``planes``.

    A row's code has a bit for the side of each plane. Places are counted over
    the codes' leading bits, and inside these row by row.
    """
    trees, bits, _ = planes.shape
    kind = v.schema["vec_id"].dataType.simpleString() if "vec_id" in v.columns else None
    keep = [c for c in v.columns if c != "vec" or trees == 1]

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vec")) - shift.astype(_S)
            for t in range(trees):
                code = (x @ planes[t].T > 0) @ (1 << np.arange(bits - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(np.full(b.num_rows, t + 1)), pa.array(code.astype(np.int64))], names=[*keep, "tree", "code"])

    types = {"vec_id": kind, "vec": "binary", "row": "long"}
    coded = v.mapInArrow(side, ", ".join(f"{c} {types[c]}" for c in keep) + ", tree long, code long")
    low = max(0, bits - max(0, math.ceil(math.log2(max(1, n) / 1024))))
    coded = coded.withColumn("bucket", F.shiftright("code", low)).withColumn("one", F.lit(1).cast("long"))
    order = [F.col("code"), *[F.col(c) for c in ties]] if "row" in keep else [F.col("code"), F.xxhash64("vec_id", "vec"), F.col("vec_id"), F.col("vec")]
    return sums_before(coded, ["tree"], "bucket", order, {"one": out}).drop("code", "bucket", "one")


def _planes(trees: int, n: int, dim: int, seed: int) -> np.ndarray:
    """Eight planes more than it takes to tell runs of a thousand rows apart."""
    bits = min(56, max(1, math.ceil(math.log2(max(1, n) / 1024)) + 8))
    return np.random.default_rng(seed).normal(size=(trees, bits, max(1, dim))).astype(_S)


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """``(graph, nodes, span)`` after NN-descent has settled; a part has ``span`` nodes."""
    unit, dim = _usable(vectors, id_col, vec_col)
    unit = materialize(unit, "unit")
    n = unit.count()
    mean = _mean(unit, max(1, dim))
    nodes = materialize(_ordered(unit, _planes(1, n, dim, SEED), mean, n, [], "row").select(F.col("row").cast("long").alias("row"), "vec_id", "vec"), "vectors")
    discard(unit)
    span = max(64, min(PART_NODES, PART_BYTES // (4 * max(1, dim) * 3 * LIST)))
    none = F.lit(b"")
    base = nodes.select(F.expr(f"row div {span}").alias("part"), "row", "vec", none.alias("ids"), none.alias("sims"), none.alias("fresh"))
    run = 4 * LEAF
    leaves = nodes.select(F.expr(f"row div {run}").alias("leaf"), "row", "vec")
    if n > run:
        places = _ordered(nodes.select("row", "vec"), _planes(TREES - 1, n, dim, SEED + 1), mean, n, ["row"], "place")
        places = places.select("row", F.expr(f"tree * {1 << 40} + cast(place as long) div {run}").alias("leaf"))
        leaves = leaves.unionByName(places.join(nodes.select("row", "vec"), "row").select("leaf", "row", "vec"))
    first = leaves.groupBy("leaf").applyInArrow(_leaf_lists(SEED, LIST, span), _MSG)
    state = _merged(base, first)
    for _ in range(MAX_ROUNDS):
        _clean(vectors.sparkSession)
        back = state.select("row", "ids", "fresh").mapInArrow(_reverse(span), _BACK)
        met = state.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_visits(span), "dest long, row long, vec binary, worst float, hosts binary, fresh binary")
        cand = met.groupBy("dest").applyInArrow(_meet(span), _MSG)
        nxt = _merged(_aged(state), cand)
        discard(state)
        state = nxt
        row = state.agg(F.sum(F.length("fresh")).alias("all"), F.sum("news").alias("new")).first()
        if (row["new"] or 0) <= SETTLED * (row["all"] or 0):
            break
    else:
        warnings.warn(f"the neighbour graph has not settled after {MAX_ROUNDS} rounds", stacklevel=2)
    return state, nodes, span


def _marked(state: DataFrame, left) -> DataFrame:
    """``state`` with other fresh marks: ``left(rows, lengths, fresh)`` stay fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ln, fresh = _ragged(b.column("fresh"), _F)
            now = left(b.column("row").to_numpy(), ln, fresh)
            off = np.concatenate([[0], np.cumsum(ln)])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("part", "row", "vec", "ids", "sims")], _packed(off, now)], names=["part", "row", "vec", "ids", "sims", "fresh"])

    return state.mapInArrow(run, "part long, row long, vec binary, ids binary, sims binary, fresh binary")


def _aged(state: DataFrame) -> DataFrame:
    """The entries that took part in a round are no longer fresh."""
    return _marked(state, lambda rows, ln, fresh: fresh & ~_chosen(rows, ln, fresh, NEW))


def _merged(state: DataFrame, cand: DataFrame) -> DataFrame:
    return materialize(state.groupBy("part").cogroup(cand.groupBy("part")).applyInArrow(_merge(LIST), _STATE), "graph")


def _ask(span: int):
    """Each query goes to the nearest nodes of its beam that it has not visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ln, ids = _ragged(b.column("ids"), _I)
            _, sims = _ragged(b.column("sims"), _S)
            _, fresh = _ragged(b.column("fresh"), _F)
            at = np.repeat(np.arange(len(ln)), ln)
            rank = np.arange(len(ids)) - np.repeat(np.cumsum(ln) - ln, ln)
            go = fresh & (rank < BEAM)
            worst = np.full(len(ln), -2, _S)
            full = ln >= LIST
            worst[full] = sims[np.cumsum(ln)[full] - 1]
            host, who = ids[go], at[go]
            dest = host // span
            order = np.lexsort((who, dest))
            dest, who, host = dest[order], who[order], host[order]
            head = _heads(dest * max(1, len(ln)) + who)
            off = np.concatenate([head, [len(who)]])
            src = pa.array(who[head])
            yield pa.RecordBatch.from_arrays([pa.array(dest[head]), b.column("row").take(src), b.column("vec").take(src), pa.array(worst[who[head]]), _packed(off, host)], names=["part", "row", "vec", "worst", "hosts"])

    return run


def _residents(span: int):
    """Send each node to the parts of the nodes that list it."""

    def run(state: pa.Table, back: pa.Table) -> pa.Table:
        state = _by_row(state)
        rows = state["row"].to_numpy()
        bn, by = _ragged(back["by"], _I)
        at = np.searchsorted(rows, np.repeat(back["row"].to_numpy(), bn))
        dest = by // span
        order = np.lexsort((by, at, dest))
        dest, at, by = dest[order], at[order], by[order]
        head = _heads(dest * max(1, len(rows)) + at)
        off = np.concatenate([head, [len(at)]])
        src = pa.array(at[head])
        return pa.table([pa.array(dest[head]), state["row"].take(src), state["vec"].take(src), _packed(off, by)], names=["part", "row", "vec", "hosts"])

    return run


def _look(span: int, own: bool):
    """Queries compare themselves with the lists of the nodes they visit."""

    def run(here: pa.Table, asking: pa.Table) -> pa.Table:
        if not asking.num_rows or not here.num_rows:
            return _nothing()
        here, asking = _by_row(here), _by_row(asking)
        x, y = _matrix(here["vec"]), _matrix(asking["vec"])
        ids, rows, worst = here["row"].to_numpy(), asking["row"].to_numpy(), asking["worst"].to_numpy()
        hn, hh = _ragged(here["hosts"], _I)
        qn, qh = _ragged(asking["hosts"], _I)
        hi, qi = np.repeat(np.arange(len(hn)), hn), np.repeat(np.arange(len(qn)), qn)
        order = np.argsort(hh, kind="stable")
        hh, hi = hh[order], hi[order]
        order = np.argsort(qh, kind="stable")
        qh, qi = qh[order], qi[order]
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], qh[1:] != qh[:-1]])), [len(qh)]])
        best = _Best(len(rows), len(ids), worst)
        for lo, hi_ in zip(cuts[:-1], cuts[1:]):
            l, r = np.searchsorted(hh, [qh[lo], qh[lo] + 1])
            if l == r:
                continue
            q, w = qi[lo:hi_], hi[l:r]
            sim = y[q] @ x[w].T
            m, n = np.nonzero(sim > best.worst[q][:, None])
            m_, n_ = q[m], w[n]
            ok = rows[m_] != ids[n_] if own else np.ones(len(m), bool)
            best.add(m_[ok], n_[ok], sim[m[ok], n[ok]])
        return best.answer(rows, ids, span)

    return run


def _visited(state: DataFrame) -> DataFrame:
    """Mark the nodes of the beam as visited."""

    def left(rows: np.ndarray, ln: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        rank = np.arange(len(fresh)) - np.repeat(np.cumsum(ln) - ln, ln)
        return fresh & (rank >= BEAM)

    return _marked(state, left)


def greedy(graph: DataFrame, walkers: DataFrame, span: int, own: bool) -> DataFrame:
    """Walk until every query has visited the ``BEAM`` nearest nodes it knows.

    ``walkers`` has the graph's columns; ``fresh`` marks what is not visited yet.
    With ``own`` a query's row is its node, which it does not return.
    """
    spark = graph.sparkSession
    back = graph.select("row", "ids", "fresh").mapInArrow(_reverse(span, every=True), _BACK)
    here = graph.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_residents(span), "part long, row long, vec binary, hosts binary")
    here = materialize(here, "here")
    for _ in range(MAX_HOPS):
        _clean(spark)
        asks = walkers.mapInArrow(_ask(span), "part long, row long, vec binary, worst float, hosts binary")
        cand = here.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(_look(span, own), _MSG)
        nxt = _merged(_visited(walkers), cand)
        discard(walkers)
        walkers = nxt
        if not walkers.where("ahead").limit(1).count():
            break
    else:
        warnings.warn(f"some queries have not settled after {MAX_HOPS} hops", stacklevel=2)
    discard(here)
    return walkers


def _best(k: int):
    """(row, rank, node, similarity) of each list's first ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ln, ids = _ragged(b.column("ids"), _I)
            _, sims = _ragged(b.column("sims"), _S)
            rank = np.arange(len(ids)) - np.repeat(np.cumsum(ln) - ln, ln)
            go = rank < k
            rows = np.repeat(b.column("row").to_numpy(), ln)
            yield pa.RecordBatch.from_arrays([pa.array(rows[go]), pa.array((rank[go] + 1).astype(np.int32)), pa.array(ids[go]), pa.array(sims[go].astype(np.float64))], names=["row", "rank", "n", "similarity"])

    return run


def _result(walkers: DataFrame, queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    best = walkers.select("row", "ids", "sims").mapInArrow(_best(k), "row long, rank int, n long, similarity double")
    near = nodes.select(F.col("row").alias("n"), F.col("vec_id").alias("neighbour_id"))
    return best.join(queries.select("row", "vec_id"), "row").join(near, "n").select("vec_id", "rank", "neighbour_id", "similarity")


def neighbours(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, rank, neighbour_id, similarity)``: every row's ``k`` nearest."""
    graph, nodes, span = build(vectors, id_col, vec_col)
    walkers = materialize(_marked(graph, lambda rows, ln, fresh: np.ones(len(fresh), bool)), "walk")
    walkers = greedy(graph, walkers, span, True)
    discard(graph)
    return _result(walkers, nodes, nodes, k)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``k`` nearest rows of ``vectors`` for each of ``queries`` (same columns)."""
    graph, nodes, span = build(vectors, id_col, vec_col)
    dim = max(1, _usable(vectors, id_col, vec_col)[1])
    ask = materialize(_usable(queries, id_col, vec_col, dim)[0].withColumn("row", F.monotonically_increasing_id()), "queries")
    entry = [r["row"] for r in nodes.select("row").orderBy(F.xxhash64(F.lit(SEED), "row")).limit(ENTRIES).collect()]
    ids, fresh = np.array(entry, np.int64).tobytes(), np.ones(len(entry), bool).tobytes()
    sims = np.full(len(entry), -2, _S).tobytes()
    walkers = ask.select(F.expr(f"row div {span}").alias("part"), "row", "vec", F.lit(ids).alias("ids"), F.lit(sims).alias("sims"), F.lit(fresh).alias("fresh"))
    walkers = greedy(graph, materialize(walkers, "walk"), span, False)
    discard(graph)
    return _result(walkers, ask, nodes, k)
