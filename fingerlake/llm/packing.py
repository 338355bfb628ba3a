"""Packing documents into windows by minimum bin slack.

A document of more than ``WINDOW`` tokens is cut into full windows and a rest.
Pieces are spread over groups of about ``GROUP_PIECES``; inside a group windows
are filled one after the other: a dynamic program over the multiset of the
remaining lengths, whose reachable sums are the bits of one integer, finds the
sum closest to the window's capacity; walking back through the program gives how
many pieces of each length make that sum, and these are taken out.

Tokens are counted as runs between blanks unless ``tokens`` gives a better count, as
the registered query does with :func:`mixing.vocabulary_count`; each document is
counted once.

Cases: a row without a token (null or empty text) is in no window; pieces of equal
length are taken in order of doc_id (null last), then of their place in the
document; repeated rows are packed each for itself; rows without an id are spread over
the groups by their texts; a long document may fill windows of its own; an empty table
gives no window; doc_id may have any type that sorts, and further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerlake.llm.mixing import token_count
from fingerlake.plans.lineage import materialize

WINDOW = 2048
GROUP_PIECES = 8192
SEED = 23


def best_fill(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, number) of the sub-multiset whose sum is closest below ``capacity``.

    Lengths are taken from the longest down, each in binary portions of its
    count; the search ends once the capacity itself is reached. ``seen[i]`` has
    the sums that portions before i can make.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, full = 1, 1 << capacity
    portions: list[tuple[int, int]] = []
    seen: list[int] = []
    for length, count in zip(lengths.tolist(), counts.tolist()):
        count = min(count, capacity // length)
        part = 1
        while count and not reach & full:
            take = min(part, count)
            seen.append(reach)
            portions.append((length, take))
            reach |= (reach << (length * take)) & mask
            count -= take
            part *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for (length, take), before in zip(reversed(portions), reversed(seen)):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return list(used.items())


def pack_lengths(lengths: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """Window number of each piece, 0 up; every length is at most ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    values, first, counts = np.unique(-lengths[order], return_index=True, return_counts=True)
    values, left, nxt = -values, counts.copy(), first.copy()
    place = {int(v): i for i, v in enumerate(values)}
    out = np.empty(len(lengths), np.int64)
    done = window = 0
    while done < len(lengths):
        live = left > 0
        for length, n in best_fill(values[live], left[live], capacity):
            i = place[length]
            out[order[nxt[i] : nxt[i] + n]] = window
            nxt[i] += n
            left[i] -= n
            done += n
        window += 1
    return out


def _pieces(docs: DataFrame, window: int, tokens: Column | None) -> DataFrame:
    d = docs.select("doc_id", (tokens if tokens is not None else token_count()).alias("tokens"), F.xxhash64("text").alias("__text"))
    # Written, as both the number of groups and the packing read the counts.
    d = materialize(d, "counts").where("tokens > 0")
    starts = F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("tokens") / window) - 1).cast("long"))
    d = d.select("doc_id", "__text", "tokens", F.explode(starts).alias("piece"))
    return d.select("doc_id", "__text", (F.col("piece") * window).alias("start"), F.least(F.lit(window).cast("long"), F.col("tokens") - F.col("piece") * window).alias("length"))


def pack(docs: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES, tokens: Column | None = None, seed: int = SEED) -> DataFrame:
    """One row for each window.

    ``(group, window, doc_ids, starts, lengths, filled, slack)``: the pieces'
    documents, first tokens and lengths side by side, longest first. The number
    of groups follows the number of pieces, so a group's program costs the same
    at any size of the corpus, and only ids and lengths are shuffled.
    """
    pieces = _pieces(docs, window, tokens)
    # One count decides the groups; it reads what the packing itself reads.
    groups = max(1, -(-pieces.count() // group_pieces))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("start"), F.when(F.col("doc_id").isNull(), F.col("__text")))
    pieces = pieces.withColumn("group", F.pmod(place, F.lit(groups)).cast("long")).drop("__text")
    # Ids and lengths are few bytes but costly to pack, so the tasks are not left to their size.
    spark = docs.sparkSession
    pieces = pieces.repartition(min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), "group")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        lengths = table["length"].to_numpy()
        where = pack_lengths(lengths, window)
        order = np.lexsort((np.arange(len(where)), -lengths, where))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(where[order])) + 1, [len(order)]]).astype(np.int32)
        taken = table.take(pa.array(order))
        lists = {c: pa.ListArray.from_arrays(pa.array(cuts), taken[c].combine_chunks()) for c in ("doc_id", "start", "length")}
        filled = np.add.reduceat(lengths[order], cuts[:-1])
        n = len(filled)
        group = pa.array(np.full(n, table["group"][0].as_py(), np.int64))
        columns = [group, pa.array(np.arange(n, dtype=np.int64)), lists["doc_id"], lists["start"], lists["length"], pa.array(filled), pa.array(window - filled)]
        return pa.table(columns, names=["group", "window", "doc_ids", "starts", "lengths", "filled", "slack"])

    schema = f"`group` long, window long, doc_ids array<{kind}>, starts array<long>, lengths array<long>, filled long, slack long"
    return pieces.groupBy("group").applyInArrow(run, schema)
