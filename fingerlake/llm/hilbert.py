"""Shards along a Hilbert curve through the documents' metadata.

Language, source and length are quantised to 2^BITS equal-depth levels each; the
cell's position on a three-dimensional Hilbert curve orders the documents, and
runs of about ``SHARD_CHARS`` characters are cut from that order. Neighbours on
the curve are neighbours in every dimension, so a shard covers a small box and a
reader that filters on any of the dimensions can skip most files by their
minima and maxima (:func:`shard_manifest`).

Levels: the values of a dimension are put in order, null first, and a value's
level is the share of the rows whose value is smaller, times 2^BITS.

Cases: null metadata are values of their own; a null length weighs 0; ties on the
curve are ordered by doc_id (null first), then by length; repeated rows are kept;
an empty table gives no shard; further columns are carried through by
:func:`write_shards` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerlake.llm.names import free_name, quoted
from fingerlake.plans.running import ranged, sums_before

BITS = 7
SHARD_CHARS = 16_000_000
DIMENSIONS = ("lang", "source", "n_chars")


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Distance along the curve of a cell, after Skilling (2004)."""
    x = list(point)
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    q = m
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    d = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            d = d << 1 | v >> b & 1
    return d


def automaton() -> list[int]:
    """The curve as a machine that reads one bit of each coordinate at a time.

    Entry ``8 * state + octant`` is ``64 * next state + digit``. The states are
    found by comparing the orders of sub-cells two levels down, which tell the
    orientations of a three-dimensional Hilbert curve apart.
    """
    bits = 9

    def cell(path: list[int]) -> int:
        xyz = [0, 0, 0]
        for o in path + [0] * (bits - len(path)):
            xyz = [v << 1 | o >> (2 - k) & 1 for k, v in enumerate(xyz)]
        return hilbert_index(tuple(xyz), bits)

    def digits(path: list[int]) -> tuple[int, ...]:
        shift = 3 * (bits - len(path) - 1)
        return tuple(cell([*path, o]) >> shift & 7 for o in range(8))

    def sign(path: list[int]) -> tuple:
        return digits(path), tuple(digits([*path, o]) for o in range(8))

    states = {sign([]): 0}
    todo: list[list[int]] = [[]]
    table: list[int] = []
    while todo:
        path = todo.pop(0)
        own = digits(path)
        for o in range(8):
            nxt = sign([*path, o]) if len(path) < 7 else None
            if nxt is None:
                raise AssertionError("the curve has more orientations than expected")
            if nxt not in states:
                states[nxt] = len(states)
                todo.append([*path, o])
            table.append(64 * states[nxt] + own[o])
    return table


def hilbert_column(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """The curve index as a JVM expression: a fold over the bits."""
    table = F.array(*[F.lit(v) for v in automaton()])

    def step(acc: Column, b: Column) -> Column:
        octant = F.call_function("shiftright", x, b).bitwiseAND(1) * 4 + F.call_function("shiftright", y, b).bitwiseAND(1) * 2 + F.call_function("shiftright", z, b).bitwiseAND(1)
        e = F.element_at(table, (acc["s"] * 8 + octant + 1).cast("int"))
        return F.struct((acc["d"] * 8 + e % 64).cast("long").alias("d"), (e / 64).cast("int").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).alias("s"))
    return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), start, step, lambda acc: acc["d"])


def _levels(docs: DataFrame, col: str, bits: int) -> DataFrame:
    """(value, level) of a dimension; one row for each distinct value.

    The values are spread over ranges; the rows before a range are summed over one
    row a range, so no task sees all values. The table is written, which fixes the
    ranges.
    """
    per = docs.groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    per = ranged(per, [F.col("__v").asc_nulls_first()])
    total = per.agg(F.sum("__n").alias("__all"))  # one row
    per = sums_before(per, [], "__range", [F.col("__v").asc_nulls_first()], {"__n": "__before"}).crossJoin(F.broadcast(total))
    return per.select("__v", F.floor(F.col("__before") * (1 << bits) / F.col("__all")).cast("int").alias("__level"))


def hilbert_shards(docs: DataFrame, shard_chars: int = SHARD_CHARS, bits: int = BITS) -> DataFrame:
    """``(doc_id, lang, source, n_chars, hilbert, shard)`` for every document.

    Only metadata columns are read. Per-value and per-cell totals are grouped
    first; what is accumulated in one task is one row for each range of values, or
    for each occupied cell (at most 2^(3 x bits)), never one for each document.
    """
    d = docs.select("doc_id", *DIMENSIONS)
    for i, c in enumerate(DIMENSIONS):
        lv = _levels(docs, c, bits).withColumnRenamed("__v", f"__v{i}").withColumnRenamed("__level", f"__l{i}")
        d = d.join(lv, d[c].eqNullSafe(lv[f"__v{i}"])).drop(f"__v{i}")
    d = d.withColumn("hilbert", hilbert_column(F.col("__l0"), F.col("__l1"), F.col("__l2"), bits)).withColumn("__chars", F.coalesce(F.col("n_chars").cast("long"), F.lit(0).cast("long")))
    d = sums_before(d, [], "hilbert", [F.col("doc_id").asc_nulls_first(), F.col("n_chars").asc_nulls_first()], {"__chars": "__before"})
    return d.select("doc_id", *DIMENSIONS, "hilbert", F.floor(F.col("__before") / shard_chars).cast("long").alias("shard"))


def shard_manifest(shards: DataFrame) -> DataFrame:
    """Per shard the number of rows, the characters and each dimension's bounds."""
    bounds = [f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]
    return shards.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), *bounds)


def write_shards(docs: DataFrame, path: str, shard_chars: int = SHARD_CHARS) -> None:
    """Write ``docs`` as one file group for each shard, in curve order.

    The folders are named by the shard, ``shard=...`` or, where ``docs`` has such a column,
    ``shard_=...``. Rows with the same id and metadata share the first of their shards.
    """
    keys = ["doc_id", *DIMENSIONS]
    shard, curve = free_name(docs, "shard"), free_name(docs, "hilbert")
    s = hilbert_shards(docs, shard_chars).groupBy(*keys).agg(F.min("hilbert").alias(curve), F.min("shard").alias(shard))
    s = s.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], curve, shard)
    on = [docs[c].eqNullSafe(s[f"__k{i}"]) for i, c in enumerate(keys)]
    full = docs.join(s, on).select(*[docs[quoted(c)] for c in docs.columns], s[curve], s[shard])
    full.repartitionByRange(shard).sortWithinPartitions(shard, curve, docs["doc_id"]).drop(curve).write.partitionBy(shard).parquet(path)


def oracle(table: str = "documents", shard_chars: int = SHARD_CHARS, bits: int = BITS) -> str:
    """The same assignment as DuckDB SQL; the curve is folded with the same table."""
    t = automaton()
    levels = []
    for i, c in enumerate(DIMENSIONS):
        levels.append(f"l{i} AS (SELECT v, CAST(floor(b * {1 << bits} / t) AS INTEGER) AS l FROM (SELECT v, coalesce(sum(n) OVER (ORDER BY v ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM (SELECT {c} AS v, count(*) AS n FROM {table} GROUP BY 1)))")
    fold = "0"
    cols = f"doc_id, {', '.join(DIMENSIONS)}"
    steps = []
    prev = "p"
    for k, b in enumerate(range(bits - 1, -1, -1)):
        e = f"tab[s * 8 + ((x >> {b}) & 1) * 4 + ((y >> {b}) & 1) * 2 + ((z >> {b}) & 1) + 1]"
        steps.append(f"s{k} AS (SELECT {cols}, x, y, z, tab, h * 8 + {e} % 64 AS h, {e} // 64 AS s FROM {prev})")
        prev = f"s{k}"
    return (
        f"WITH {', '.join(levels)}, p AS (SELECT {', '.join('d.' + c for c in ('doc_id', *DIMENSIONS))}, l0.l AS x, l1.l AS y, l2.l AS z, {t} AS tab, CAST({fold} AS BIGINT) AS h, 0 AS s FROM {table} d "
        + " ".join(f"JOIN l{i} ON d.{c} IS NOT DISTINCT FROM l{i}.v" for i, c in enumerate(DIMENSIONS))
        + f"), {', '.join(steps)} SELECT {cols}, h AS hilbert, CAST(floor(coalesce(sum(coalesce(n_chars, 0)) OVER (ORDER BY h, doc_id ASC NULLS FIRST, n_chars ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {shard_chars}) AS BIGINT) AS shard FROM {prev}"
    )
