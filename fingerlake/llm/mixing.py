"""Mixing sources to target weights with Sainte-Laguë quotas.

The documents of a source are put in a seeded order and cut into blocks of about
``BLOCK_TOKENS`` tokens. Blocks are then given to the sources one at a time, as
seats in a parliament: the next goes to the source with the highest quotient
``weight / (2 x blocks so far + 1)``. Every ``SHARD_BLOCKS`` seats make a shard,
so each shard's quotas are whole numbers and close to the target. A source's j-th
seat takes its j-th block in a second seeded order.

Without ``total_blocks`` the mixture ends before the first seat that a source has
no block left for: the weights then hold throughout, and nothing is repeated. With
``exhaust`` such a source drops out instead and the others go on, each seat still to
the highest quotient, until every block has one (or ``total_blocks`` are seated): no
text with tokens is lost, and the weights hold among the sources that are left.

Tokens are counted as runs between blanks unless ``tokens`` gives a better count,
for example :func:`vocabulary_count`.

Cases: rows with a null or empty text have no tokens and go with the block they
fall in; a null source is a source; a source without a weight, or whose weight is
not positive, gets no seat; equal quotients go to the larger weight, then to the
smaller name, null first; repeated rows are ordered next to each other; an empty
table gives an empty mixture; further columns are carried through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerlake.llm.names import free_name, quoted
from fingerlake.llm.secretscan import VOCABULARY, tokenizer
from fingerlake.plans.lineage import materialize
from fingerlake.plans.running import sums_before

BLOCK_TOKENS = 20_000
SHARD_BLOCKS = 64
SEED = 11
#: About so many seats are ranked in one task.
SEAT_BUCKET = 20_000
#: Default target: a source's share is its tokens to this power.
TEMPERATURE = 0.7


def token_count(text: str = "text") -> Column:
    """Runs of anything but blanks; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def vocabulary_count(text: str = "text", path: str = VOCABULARY) -> Column:
    """Tokens of the vocabulary at ``path``; 0 for null."""

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = tokenizer(path)
        for values in batches:
            yield pa.array([0 if (t := v.as_py()) is None else len(enc.encode_ordinary(t)) for v in values], pa.int64())

    return count(F.col(text))


def blocks_of(docs: DataFrame, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, tokens, block, text_hash)`` of every row.

    A row belongs to the block that its first token falls in.
    """
    d = docs.select("doc_id", "source", (tokens if tokens is not None else token_count()).alias("tokens"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    d = d.withColumn("__key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    d = d.withColumn("__bucket", F.substring("__key", 1, 3))
    d = sums_before(d, ["source"], "__bucket", [F.col("__key"), F.col("text_hash")], {"tokens": "__before"})
    return d.select("doc_id", "source", "tokens", F.floor(F.col("__before") / block_tokens).cast("long").alias("block"), "text_hash")


def _weights(blocks: DataFrame, weights: dict | None, temperature: float) -> DataFrame:
    """(source, weight, available blocks); sources without tokens are left out."""
    per = blocks.groupBy("source").agg(F.sum("tokens").alias("__tokens"), F.countDistinct("block").alias("available"))
    if weights is None:
        w = F.pow(F.col("__tokens").cast("double"), F.lit(temperature))
    else:
        w = F.lit(None).cast("double")
        for name, x in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
    return per.select("source", w.alias("weight"), "available").where("weight > 0 and __tokens > 0")


def quotas(weights: DataFrame, total_blocks: int | None = None, shard_blocks: int = SHARD_BLOCKS, exhaust: bool = False) -> DataFrame:
    """``(source, seat, shard, rank)``: every seat in order of its quotient.

    The order ends at the largest quotient of the seats that a source cannot fill, its
    (available + 1)-th; with ``exhaust`` it does not end. A seat's place is close to
    half the sum of all weights over its quotient, so buckets of this number, about
    ``SEAT_BUCKET`` seats each, are counted first and seats are ranked inside them:
    no task ranks them all.
    """
    w = weights.select("source", "weight", F.col("available").cast("long").alias("available"))
    seats = w.where("available > 0").select("source", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("available") - 1)).alias("j"))
    seats = seats.withColumn("quotient", F.col("weight") / (2 * F.col("j") + 1))
    if not exhaust:
        # One row: the first seat that some source cannot fill.
        end = w.select("source", "weight", (F.col("weight") / (2 * F.col("available") + 1)).alias("quotient"))
        end = end.orderBy(F.desc("quotient"), F.desc("weight"), F.col("source").asc_nulls_first()).limit(1)
        end = end.select(F.col("quotient").alias("__q"), F.col("weight").alias("__w"), F.col("source").alias("__s"))
        smaller = F.coalesce(F.col("source") < F.col("__s"), F.col("source").isNull() & F.col("__s").isNotNull())
        tie = (F.col("quotient") == F.col("__q")) & ((F.col("weight") > F.col("__w")) | ((F.col("weight") == F.col("__w")) & smaller))
        seats = seats.crossJoin(F.broadcast(end)).where((F.col("quotient") > F.col("__q")) | tie).drop("__q", "__w", "__s")
    total = w.agg(F.sum("weight").alias("__all"))  # one row
    seats = seats.crossJoin(F.broadcast(total)).withColumn("__bucket", F.floor(F.col("__all") / F.col("quotient") / (2 * SEAT_BUCKET))).drop("__all")
    seats = seats.withColumn("__one", F.lit(1).cast("long"))
    order = [F.desc("quotient"), F.desc("weight"), F.col("source").asc_nulls_first()]
    seats = sums_before(seats, [], "__bucket", order, {"__one": "seat"}).withColumn("seat", F.col("seat").cast("long"))
    if total_blocks is not None:
        seats = seats.where(F.col("seat") < total_blocks)
    return seats.select("source", "seat", F.floor(F.col("seat") / shard_blocks).cast("long").alias("shard"), F.col("j").alias("rank"))


def _chosen(blocks: DataFrame, weights: dict | None, total_blocks: int | None, shard_blocks: int, seed: int, temperature: float, exhaust: bool) -> DataFrame:
    """The rows of ``blocks`` whose block has a seat, with ``seat`` and ``shard``."""
    seats = quotas(_weights(blocks, weights, temperature), total_blocks, shard_blocks, exhaust)
    pick = blocks.select("source", "block").distinct()
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")), F.lit(":"), F.col("block").cast("string")))
    # A source's blocks in a seeded order, ranked bucket by bucket of the key.
    pick = pick.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 3)).withColumn("__one", F.lit(1).cast("long"))
    pick = sums_before(pick, ["source"], "__bucket", [F.col("__key"), F.col("block")], {"__one": "__rank"})
    s = seats.withColumnRenamed("source", "__source")
    chosen = pick.join(s, pick["source"].eqNullSafe(s["__source"]) & (pick["__rank"] == s["rank"])).select(F.col("source").alias("__source"), F.col("block").alias("__block"), "seat", "shard")
    return blocks.join(chosen, blocks["source"].eqNullSafe(chosen["__source"]) & (blocks["block"] == chosen["__block"])).drop("__source", "__block")


def mixture(docs: DataFrame, weights: dict | None = None, total_blocks: int | None = None, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, temperature: float = TEMPERATURE, exhaust: bool = False) -> DataFrame:
    """``(doc_id, source, tokens, shard, seat, text_hash)`` of the chosen rows."""
    blocks = materialize(blocks_of(docs, tokens, block_tokens, seed), "blocks")
    out = _chosen(blocks, weights, total_blocks, shard_blocks, seed, temperature, exhaust)
    return out.select("doc_id", "source", "tokens", "shard", "seat", "text_hash")


def mix(docs: DataFrame, weights: dict | None = None, total_blocks: int | None = None, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, temperature: float = TEMPERATURE, exhaust: bool = False) -> DataFrame:
    """The rows of ``docs`` that :func:`mixture` chose; columns unchanged.

    Of rows with equal id, source and text as many stay as the mixture chose, no
    matter which; they can only differ in other columns.
    """
    blocks = materialize(blocks_of(docs, tokens, block_tokens, seed), "blocks")
    same = ["doc_id", "source", "text_hash"]
    got = _chosen(blocks, weights, total_blocks, shard_blocks, seed, temperature, exhaust).groupBy(*same).agg(F.count("*").alias("__n"))
    got = materialize(got.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), "__n"), "chosen")
    name = free_name(docs, "__hashed")
    d = docs.withColumn(name, F.md5(F.coalesce(docs["text"], F.lit(""))))
    on = lambda o: d["doc_id"].eqNullSafe(o["__id"]) & d["source"].eqNullSafe(o["__source"]) & (d[name] == o["__hash"])
    # Only rows that repeat can be chosen in part, where a block ends among them.
    every = blocks.groupBy(*same).agg(F.count("*").alias("__all")).where("__all > 1")
    e = every.select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("text_hash").alias("__h"), "__all")
    part = got.join(e, got["__id"].eqNullSafe(e["__i"]) & got["__source"].eqNullSafe(e["__s"]) & (got["__hash"] == e["__h"])).where("__n < __all")
    part = materialize(part.select("__id", "__source", "__hash", "__n"), "part")
    kept = d.join(got, on(got), "left_semi")
    if part.limit(1).count():
        kept = kept.join(part, on(part), "left_anti")
        rank, most = free_name(docs, "__rank"), free_name(docs, "__most")
        p = part.withColumnRenamed("__n", most)
        some = d.join(p, on(p)).select(*[d[quoted(c)] for c in d.columns], p[most])
        some = some.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", "source", name).orderBy(name)))
        kept = kept.unionByName(some.where(F.col(rank) <= F.col(most)).drop(rank, most))
    return kept.select(*map(quoted, docs.columns))


def oracle(block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, temperature: float = TEMPERATURE) -> str:
    """The default mixture of ``documents`` as DuckDB SQL."""
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS text_hash,
         md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents),
b AS (
  SELECT doc_id, source, tokens, text_hash, CAST(floor(coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY k, text_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {block_tokens}) AS BIGINT) AS block FROM d),
w AS (
  SELECT source, pow(CAST(sum(tokens) AS DOUBLE), {temperature}) AS weight, count(DISTINCT block) AS available FROM b GROUP BY source HAVING sum(tokens) > 0),
s AS (
  SELECT source, weight, available, j, weight / (2 * j + 1) AS quotient FROM (SELECT source, weight, available, unnest(range(0, available + 1)) AS j FROM w)),
r AS (SELECT source, available, j, row_number() OVER (ORDER BY quotient DESC, weight DESC, source ASC NULLS FIRST) - 1 AS seat FROM s),
q AS (SELECT source, j, seat FROM r WHERE seat < (SELECT min(seat) FROM r WHERE j = available)),
p AS (
  SELECT source, block, row_number() OVER (PARTITION BY source ORDER BY md5(concat('{seed}:', coalesce(source, ''), ':', CAST(block AS VARCHAR))), block) - 1 AS rank
  FROM (SELECT DISTINCT source, block FROM b))
SELECT b.doc_id, b.source, b.tokens, CAST(floor(q.seat / {shard_blocks}) AS BIGINT) AS shard, CAST(q.seat AS BIGINT) AS seat, b.text_hash
FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source AND b.block = p.block
JOIN q ON q.source IS NOT DISTINCT FROM p.source AND q.j = p.rank"""
