"""Near-duplicate search with ProbMinHash signatures.

A document is a weighted set: its word trigrams, weighted by their number of
occurrences. Two documents are compared by the probability Jaccard similarity

    J_P(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i)

which does not change when one document is repeated as a whole. Each element
starts a Poisson process whose rate is its weight; every arrival lands in one of
``REGISTERS`` registers and a register keeps the element that arrived first.
Elements stop as soon as their next arrival is later than the latest register.
The share of registers on which two signatures agree estimates J_P.

Documents that agree on a whole band of registers become candidates. The estimate
only rules out candidates that are ``MARGIN`` below the threshold; every pair that
connects two documents is verified by the exact J_P of their texts.

Cases: a null text is never a duplicate; equal texts (the empty one too) are
exact duplicates whatever their ids; a text of one or two words has one element;
a null doc_id takes part and sorts last; repeated rows are copies of each other; of
equal ids the smaller text hash leads. Further columns are carried through whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerlake.llm.names import free_name, quoted
from fingerlake.operators.graph import connected_components
from fingerlake.plans.lineage import arrow_batches, discard, materialize

REGISTERS = 128
BAND_ROWS = 3
THRESHOLD = 0.5
#: A pair is not verified if its estimate is this far below the threshold: 3.4 standard
#: deviations of a share of 128 registers, so of pairs at the threshold 0.04 % are missed.
MARGIN = 0.15
#: Members of a bucket that are compared in one piece; larger buckets are cut into tiles.
TILE = 1024
SHINGLE = 3
#: Most rows of (id, hash) that are broadcast, some 50 MB.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch where texts go to Python.
TEXT_ROWS = 1000

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_P = _U(0x100000001B3 | 1)
_PINV = _U(pow(0x100000001B3 | 1, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 95]] = True
_GROUP_ELEMENTS = 200_000
_DOC_BITS = 20


def _mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def shingles(buf: np.ndarray, starts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit hash) of every word n-gram.

    ``buf`` has the lower-case UTF-8 bytes of all documents, each followed by a
    blank; document d begins at ``starts[d]``.
    """
    word = _IS_WORD[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(buf)]])
    b, e = edge[::2], edge[1::2]
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up = np.empty(len(buf) + 1, np.uint64)
    up[0] = 1
    up[1:] = _P
    np.cumprod(up, out=up)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + _U(1)) * up[:-1], out=total[1:])
    down = np.empty(len(buf), np.uint64)
    down[0] = 1
    down[1:] = _PINV
    np.cumprod(down, out=down)
    w = _mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64) * _GOLD)
    doc = np.searchsorted(starts, b, side="right") - 1
    h = w.copy()
    last = doc.copy()
    for k in range(1, n):
        shift = np.zeros(len(w), np.uint64)
        same = np.zeros(len(w), bool)
        if len(w) > k:
            same[:-k] = doc[k:] == doc[:-k]
            shift[:-k] = np.where(same[:-k], w[k:], _U(0))
        h = _mix(h * _U(3) + shift + _U(k))
        last = np.where(same, last, -1)
    # An n-gram that would run over the document's end counts only where the
    # document has fewer than n words, at its first word.
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    keep = (last >= 0) | first
    return doc[keep], h[keep]


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, element) with the number of occurrences, sorted."""
    if not len(h):
        return doc, h, np.empty(0)
    # A fixed split of the key, so that an element's hash is the same in any company.
    key = (doc.astype(np.uint64) << _U(64 - _DOC_BITS)) | (h >> _U(_DOC_BITS))
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    w = np.diff(np.concatenate([at, [len(key)]])).astype(np.float64)
    key = key[at]
    return (key >> _U(64 - _DOC_BITS)).astype(np.int64), (key << _U(_DOC_BITS)) >> _U(_DOC_BITS), w


def _signatures(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers' elements, ``n_docs`` x ``m``; documents without an element have zeros."""
    q = np.full(n_docs * m, np.inf)
    sig = np.zeros(n_docs * m, np.int32)
    x = np.zeros(len(h))
    seed = _mix(h + _GOLD)
    base = doc * m
    elem = (_mix(h ^ _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.uint32).view(np.int32)
    r = 0
    while len(x):
        r += 1
        u = _mix(seed + _U(r * int(_GOLD) % (1 << 64)))
        x = x - np.log(((u >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        slot = base + ((u & _U(0x7FF)) * _U(m) >> _U(11)).astype(np.int64)
        np.minimum.at(q, slot, x)
        won = x == q[slot]
        sig[slot[won]] = elem[won]
        latest = q.reshape(n_docs, m).max(axis=1)
        go = x < latest[base // m]
        if not go.all():
            x, w, seed, base, elem = x[go], w[go], seed[go], base[go], elem[go]
    return sig.reshape(n_docs, m)


def _utf8(values: pa.Array) -> list[bytes]:
    return pc.cast(pc.utf8_lower(pc.fill_null(values, "")), pa.binary()).to_pylist()


def signatures(values: pa.Array, m: int = REGISTERS, n: int = SHINGLE) -> list[np.ndarray | None]:
    """One signature for each text; None where it is null or has no word."""
    texts = _utf8(values)
    out: list[np.ndarray | None] = []
    i = 0
    while i < len(texts):
        size, j = 0, i
        while j < len(texts) and j - i < 1 << _DOC_BITS and (j == i or size + len(texts[j]) < 6 * _GROUP_ELEMENTS):
            size += len(texts[j]) + 1
            j += 1
        part = texts[i:j]
        buf = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])[:-1]]).astype(np.int64)
        doc, h, w = weighted(*shingles(buf, starts, n))
        sig = _signatures(doc, h, w, len(part), m)
        has = np.zeros(len(part), bool)
        has[doc] = True
        out += [sig[k] if has[k] else None for k in range(len(part))]
        i = j
    return out


_SKETCH = T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


@F.arrow_udf(_SKETCH)
def _sketch_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Band keys from whole registers, and the registers' lowest bytes."""
    kind = pa.struct([("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
    n = REGISTERS // BAND_ROWS
    for values in batches:
        sigs = signatures(values)
        has = np.array([s is not None for s in sigs], bool)
        full = np.stack([s for s in sigs if s is not None]) if has.any() else np.zeros((0, REGISTERS), np.int32)
        wide = full.astype(np.uint32).astype(np.uint64)
        key = np.broadcast_to(np.arange(n, dtype=np.uint64) * _GOLD, (len(full), n))
        for k in range(BAND_ROWS):
            key = _mix(key ^ wide[:, k : n * BAND_ROWS : BAND_ROWS] + _GOLD)
        at = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(at * n), pa.array(np.ascontiguousarray(key).view(np.int64).ravel()))
        low = (full & 0xFF).astype(np.uint8)
        sig = pa.array([low[i].tobytes() if h else None for i, h in zip(at[:-1], has)], pa.binary())
        yield pa.StructArray.from_arrays([bands, sig], fields=list(kind))


def weighted_set(text: str, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A text's elements, sorted, and their weights."""
    buf = np.frombuffer(text.lower().encode() + b" ", np.uint8)
    return weighted(*shingles(buf, np.zeros(1, np.int64), n))[1:]


def probability_jaccard(a: str, b: str, n: int = SHINGLE) -> float:
    """Exact J_P of two texts; texts without words agree only if both have none."""
    return set_similarity(weighted_set(a, n), weighted_set(b, n))


def set_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    # sum_j max(x_j/x_i, y_j/y_i) for each shared i, by the ratio c = (y_j/x_j) / (y_i/x_i):
    # element j gives x_j/x_i where its ratio y_j/x_j is at most i's, else y_j/y_i.
    xa, yb = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - yb.sum()
    ratio = yb / xa
    order = np.argsort(ratio, kind="stable")
    cx, cy = np.cumsum(xa[order]), np.cumsum(yb[order])
    upto = np.searchsorted(ratio[order], ratio, side="right") - 1
    below, above = cx[upto] + only_a, cy[-1] - cy[upto] + only_b
    return float((1.0 / (below / xa + above / yb)).sum())


@F.arrow_udf(T.DoubleType())
def _exact_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    # The pairs of a task share many texts; each is cut once in a batch.
    seen: dict[str, tuple] = {}

    def of(t: str) -> tuple:
        if t not in seen:
            seen[t] = weighted_set(t)
        return seen[t]

    return pa.array([set_similarity(of(x), of(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@F.arrow_udf(T.DoubleType())
def _estimate_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """J_P by the share of equal bytes, less the share that is equal by chance."""
    x = [np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, REGISTERS) for v in (a, b)]
    return pa.array(((x[0] == x[1]).mean(axis=1) - 1 / 256) / (1 - 1 / 256), pa.float64())


def _estimates(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, est) of the pairs that may reach ``threshold``."""
    sig = nodes.select("h", "sig")
    both = pairs.join(sig.select(F.col("h").alias("u"), F.col("sig").alias("su")), "u").join(sig.select(F.col("h").alias("v"), F.col("sig").alias("sv")), "v")
    return both.select("u", "v", _estimate_udf("su", "sv").alias("est")).where(F.col("est") >= threshold - MARGIN)


def _tile_pairs(h: np.ndarray, c: np.ndarray, chunk: np.ndarray, sig: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile in different components whose estimate is at least ``least``."""
    one = chunk[0]
    left = np.flatnonzero(chunk == one)
    right = np.flatnonzero(chunk != one) if (chunk != one).any() else left
    us, vs = [], []
    step = max(1, (1 << 23) // (len(right) * REGISTERS))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        est = (sig[rows][:, None] == sig[right][None]).mean(axis=2)
        i, j = np.nonzero(((est - 1 / 256) / (1 - 1 / 256) >= least) & (c[rows][:, None] != c[right][None]))
        us.append(h[rows[i]])
        vs.append(h[right[j]])
    u, v = np.concatenate(us), np.concatenate(vs)
    return np.minimum(u, v), np.maximum(u, v)


def _cross(parts: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v): pairs of a bucket in different components that may reach ``threshold``.

    ``parts`` has (key, h, c, n). A signature is sent once for each tile, and
    only pairs that pass the estimate leave it.
    """
    chunks = F.ceil(F.col("n") / TILE).cast("long")
    t = parts.withColumn("m", chunks).withColumn("a", F.pmod(F.xxhash64("key", "h"), F.col("m"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    t = t.join(nodes.select("h", "sig"), "h")
    t = t.select("key", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "h", "c", F.col("a").alias("chunk"), "sig")
    t = t.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            key, lo, hi, h, c, chunk = (table[x].to_numpy() for x in ("key", "lo", "hi", "h", "c", "chunk"))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1), len(key)]
            got = [_tile_pairs(h[x:y], c[x:y], chunk[x:y], sig[x:y], threshold - MARGIN) for x, y in zip(cuts[:-1], cuts[1:])]
            u, v = (np.concatenate(x) for x in zip(*got))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=kind)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            key, lo, hi = (table[x].to_numpy() for x in ("key", "lo", "hi"))
            # The last tile may go on in the next batch.
            start = int(np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))[-1]) + 1 if (key[0], lo[0], hi[0]) != (key[-1], lo[-1], hi[-1]) else 0
            if start:
                yield pairs(table.slice(0, start))
            held = table.slice(start)
        if held is not None and held.num_rows:
            yield pairs(held)

    return t.mapInArrow(run, "u long, v long").distinct()


def _exact(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of (u, v) the pairs whose texts' J_P is at least ``threshold``."""
    ends = materialize(pairs.select(F.col("u").alias("h")).union(pairs.select(F.col("v").alias("h"))).distinct(), "ends")
    # Up to a checked size the hashes go to the texts; beyond it both are shuffled.
    send = F.broadcast if ends.count() <= BROADCAST_ROWS else lambda x: x
    some = materialize(texts.join(send(ends), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")), "texts")
    both = pairs.join(some.select(F.col("h").alias("u"), F.col("text").alias("tu")), "u").join(some.select(F.col("h").alias("v"), F.col("text").alias("tv")), "v")
    good = materialize(both.select("u", "v", _exact_udf("tu", "tv").alias("j")).where(F.col("j") >= threshold).select("u", "v"), "exact")
    discard(some)
    discard(ends)
    return good


def _labelled(df: DataFrame, comp: DataFrame, key: str, out: str) -> DataFrame:
    """Adds the component of ``key``; a node without an edge is its own."""
    c = comp.select(F.col("id").alias(key), F.col("component").alias(out))
    return df.join(c, key, "left").withColumn(out, F.coalesce(out, key))


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document that has a duplicate, with its group.

    Returns ``(doc_id, h, group_id, group_h, group_size, keeper)``: ``h`` is the
    text's 64-bit hash; the group's keeper is its smallest doc_id, and
    ``group_id``/``group_h`` are that document's id and hash. Groups are the
    components of the verified pairs. Of repeated rows with the keeper's id and
    text all are marked ``keeper``; :func:`drop_near_duplicates` leaves one.

    In a bucket of documents that share a band each is first compared with the one
    of the smallest hash, and each document's best pair of this kind is verified. What is then
    connected needs no further comparison: the groups would be the same. All pairs of
    a bucket that are still in different components are compared next and verified
    where the estimate allows, so no candidate is capped away, and a bucket of copies
    costs as many comparisons as it has members.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    texts = d.select(F.xxhash64("text").alias("h"), "text")
    spark = docs.sparkSession
    with arrow_batches(spark, TEXT_ROWS):
        base = materialize(d.select("doc_id", F.xxhash64("text").alias("h"), _sketch_udf("text").alias("s")).select("doc_id", "h", "s.bands", "s.sig"), "sig")
    nodes = materialize(base.where("sig is not null").groupBy("h").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    w = Window.partitionBy("key")
    buckets = nodes.select("h", F.explode("bands").alias("key")).withColumn("hub", F.min("h").over(w)).withColumn("n", F.count("*").over(w)).where("n > 1")
    buckets = materialize(buckets, "buckets")
    star = buckets.where("h <> hub").select(F.col("hub").alias("u"), F.col("h").alias("v")).distinct()
    best = _estimates(star, nodes, threshold).groupBy("v").agg(F.max_by("u", F.struct("est", "u")).alias("u"))
    best = materialize(best.select("u", "v"), "best")
    with arrow_batches(spark, TEXT_ROWS):
        first = _exact(best, texts, threshold)
    comp = materialize(connected_components(first, "u", "v"), "comp")
    # Members of a bucket that are not connected yet.
    parts = _labelled(buckets.select("key", "h", "n"), comp, "h", "c")
    parts = parts.withColumn("lo", F.min("c").over(w)).withColumn("hi", F.max("c").over(w)).where("lo <> hi").select("key", "h", "c", "n")
    cross = materialize(_cross(parts, nodes, threshold).join(best, ["u", "v"], "left_anti"), "cross")
    with arrow_batches(spark, TEXT_ROWS):
        second = _exact(cross, texts, threshold)
    discard(comp)
    comp = materialize(connected_components(first.union(second), "u", "v"), "comp").withColumnRenamed("id", "h")
    member = base.select("doc_id", "h").join(comp, "h", "left")
    member = materialize(member.select("doc_id", "h", F.coalesce("component", "h").alias("component")), "members")
    for t in (base, nodes, buckets, best, first, cross, second):
        discard(t)
    lead = member.groupBy("component").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h")).alias("lead")).where("group_size > 1")
    out = member.join(lead, "component")
    same = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("h") == F.col("lead.h"))
    return out.select("doc_id", "h", F.col("lead.doc_id").alias("group_id"), F.col("lead.h").alias("group_h"), "group_size", same.alias("keeper"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but one document of each group; columns unchanged.

    The document with the smallest doc_id stays; of rows that repeat its id and
    text one stays. Documents in no group, and those with a null text, pass.
    """
    groups = materialize(near_duplicate_groups(docs, threshold), "groups")
    drop = groups.where("not keeper").select(F.col("doc_id").alias("__id"), F.col("h").alias("__hash")).distinct()
    repeated = groups.where("keeper").groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__hash")).count().where("count > 1").drop("count")
    name = free_name(docs, "__hash")
    d = docs.withColumn(name, F.xxhash64("text"))
    on = lambda o: (d[name] == o["__hash"]) & d["doc_id"].eqNullSafe(o["__id"]) & d["text"].isNotNull()
    marks = materialize(drop.withColumn("__many", F.lit(False)).union(repeated.withColumn("__many", F.lit(True))), "marks")
    size = marks.agg(F.count("*").alias("n"), F.count(F.when(F.col("__many"), 1)).alias("many")).first()
    # Up to a checked size the marks go to the texts; beyond it both are shuffled.
    send = F.broadcast if size["n"] <= BROADCAST_ROWS else lambda x: x
    kept = d.join(send(marks), on(marks), "left_anti")
    if size["many"]:
        many = send(marks.where("__many"))
        kept = kept.unionByName(d.join(many, on(many), "left_semi").dropDuplicates([name, "doc_id"]))
    return kept.select(*map(quoted, docs.columns))
