"""Graph operators over edge DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fingerlake.plans.lineage import discard, materialize
from fingerlake.plans.running import ranged, sums_before


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label each node that has an edge with the smallest node of its component.

    Alternating large-star and small-star rounds: edges are rewired towards the
    smallest neighbour until each component is one star. Both steps are a minimum by
    node, combined before the shuffle, joined back and made distinct, so neither a row nor a task ever
    holds a node's neighbours; the number of rounds grows with the logarithm of the
    component's size. Each round is written to the shared folder.

    Edges with a null end and self-loops are ignored. Returns ``(id, component)``.
    """
    cur = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    cur = cur.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = materialize(cur, "cc")
    seen = _checksum(cur)
    for _ in range(max_rounds):
        # Edges go from the larger to the smaller node. Large star: l's larger neighbours
        # go to the smallest of l and its neighbours.
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = cur.join(least, "v").select("u", F.least("v", "m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(star.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _checksum(nxt)
        discard(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())


def build_edges(pairs: DataFrame, src: str = "id1", dst: str = "id2") -> DataFrame:
    """Distinct undirected edges ``(src, dst)`` with src < dst; loops are dropped."""
    e = pairs.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
    return e.where("src is not null and dst is not null and src <> dst").distinct()


def communities(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """``(id, community)`` by label propagation.

    Every node takes the commonest label among its neighbours and itself, all at
    once; ties go to the smallest label, so the outcome does not depend on order
    or partitioning. Ends when no label changes, or after ``rounds``.
    """
    both = materialize(edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).union(edges.select("dst", "src")), "adj")
    label = materialize(both.select("id", F.col("id").alias("community")).distinct(), "label")
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("id", "n"), "n").select("id", "community").union(label.select("id", "community"))
        count = votes.groupBy("id", "community").count()
        best = count.groupBy("id").agg(F.min_by("community", F.struct(-F.col("count"), F.col("community"))).alias("community"))
        nxt = materialize(best, "label")
        moved = nxt.join(label.withColumnRenamed("community", "was"), "id").where("community <> was").limit(1).count()
        discard(label)
        label = nxt
        if not moved:
            break
    return label


def greedy_cliques(nodes: Iterable, edges: Iterable[tuple]) -> list[list]:
    """Take out a maximum clique until no node is left.

    Of several maximum cliques the one whose sorted members are greatest is taken.
    Connected parts are worked on one by one, as a clique lies in one of them, and
    their cliques are put in that order afterwards.
    """
    near: dict = {v: set() for v in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out, seen = [], set()
    for v in list(near):
        if v in seen:
            continue
        part, todo = {v}, [v]
        while todo:
            more = near[todo.pop()] - part
            part |= more
            todo += more
        seen |= part
        out += _cliques_of_part(part, near)
    return sorted(out, key=lambda c: (len(c), c), reverse=True)


def _greater(a: int, b: int) -> bool:
    """Whether set ``a`` has the greater sorted members, of two sets of one size."""
    d = a ^ b
    return d != 0 and not a & d & -d


def _cliques_of_part(left: set, near: dict) -> list[list]:
    """The cliques of one connected part; sets are the bits of an integer, the least node lowest."""
    ids = sorted(left)
    at = {v: i for i, v in enumerate(ids)}
    adj = [sum(1 << at[u] for u in near[v]) for v in ids]
    rest, out = (1 << len(ids)) - 1, []
    while rest:
        best = size = 0

        def grow(clique: int, n: int, cand: int, gone: int) -> None:
            nonlocal best, size
            if not cand:
                if not gone and (n > size or (n == size and _greater(clique, best))):
                    best, size = clique, n
                return
            room = cand.bit_count()
            if n + room < size or (n + room == size and not _greater(clique | cand, best)):
                return
            most, pivot, some = -1, 0, cand | gone
            while some and most < room:
                bit = some & -some
                some ^= bit
                k = (adj[bit.bit_length() - 1] & cand).bit_count()
                if k >= most:
                    most, pivot = k, bit.bit_length() - 1
            some = cand & ~adj[pivot]
            while some:
                i = some.bit_length() - 1
                some ^= 1 << i
                grow(clique | 1 << i, n + 1, cand & adj[i], gone & adj[i])
                cand ^= 1 << i
                gone |= 1 << i

        grow(0, 0, rest, 0)
        out.append([ids[i] for i in range(len(ids)) if best >> i & 1])
        rest &= ~best
        adj = [a & rest for a in adj]
    return out


def cliques(edges: DataFrame, groups: DataFrame, batch: int = 1000) -> DataFrame:
    """``(id, clique)``: nodes of each group of ``groups`` (id, group) in cliques.

    A group is worked on in batches of ``batch`` nodes by id, each with the edges among its
    nodes in a task of its own; a clique is named by its smallest member. Only edges inside a
    group count. Nodes are numbered by ranges, so no task sees a large group.
    """
    kind = groups.schema["id"].dataType.simpleString()
    r = ranged(groups.select("id", "group", F.lit(1).alias("__one")), [F.col("group"), F.col("id")])
    n = sums_before(r, ["group"], "__range", [F.col("id")], {"__one": "__n"})
    n = materialize(n.select("id", "group", F.floor(F.col("__n") / batch).cast("long").alias("part")), "parts")  # read three times
    g1, g2 = n.select(F.col("id").alias("src"), F.col("group").alias("g1"), F.col("part").alias("p1")), n.select(F.col("id").alias("dst"), F.col("group").alias("g2"), F.col("part").alias("p2"))
    inner = edges.join(g1, "src").join(g2, "dst").where("g1 = g2 and p1 = p2").select(F.col("g1").alias("group"), F.col("p1").alias("part"), "src", "dst")

    def run(nodes: pa.Table, links: pa.Table) -> pa.Table:
        found = greedy_cliques(sorted(nodes["id"].to_pylist()), zip(links["src"].to_pylist(), links["dst"].to_pylist()))
        rows, names = [v for c in found for v in c], [min(c) for c in found for _ in c]
        typ = nodes.schema.field("id").type
        return pa.table([pa.array(rows, typ), pa.array(names, typ)], names=["id", "clique"])

    # By number, as the few bytes of many batches would be put into one task.
    spark = groups.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return n.repartition(tasks, "group", "part").groupBy("group", "part").cogroup(inner.groupBy("group", "part")).applyInArrow(run, f"id {kind}, clique {kind}")


def pairs_to_clusters(ids: DataFrame, pairs: DataFrame, strictness: str = "clique", batch: int = 1000, id_col: str = "id") -> DataFrame:
    """``(id, cluster)`` for every id; ids without a pair are clusters of one.

    ``component``: connected; ``community``: label propagation inside components;
    ``clique``: everyone paired with everyone. Clusters are named by their
    smallest member, so numbering needs no global sort; see :func:`numbered`.
    """
    if strictness not in ("clique", "community", "component"):
        raise ValueError("strictness must be clique, community or component")
    edges = build_edges(pairs)
    if strictness == "component":
        lab = connected_components(edges).select("id", F.col("component").alias("cluster"))
    else:
        edges = materialize(edges, "edges")
        lab = communities(edges)
        if strictness == "community":
            # A label can name a node that has left; the smallest member does not.
            lab = lab.select("id", F.min("id").over(Window.partitionBy("community")).alias("cluster"))
        else:
            lab = cliques(edges, lab.select("id", F.col("community").alias("group")), batch).select("id", F.col("clique").alias("cluster"))
    every = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    return every.join(lab, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def numbered(clusters: DataFrame) -> DataFrame:
    """Clusters numbered 0 up in order of their names; one row a cluster is ranked."""
    names = clusters.select("cluster").distinct()
    rank = names.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster")).cast("long") - 1)
    return clusters.join(rank, "cluster").select("id", F.col("n").alias("cluster"))
