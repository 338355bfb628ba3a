"""Exact top-k documents for each query, by the three-phase uniform threshold.

A query is a set of terms and a document's score the sum of its BM25 weights for
these terms, in whole millionths, so that sums are exact and ties are true ties.
Each term has a list of (document, weight); the lists lie spread over the tasks.

1. Every task gives each list's ``k`` best entries; the best of all tasks make a
   partial sum for some documents, and a query's k-th largest partial sum t1 is a
   lower bound of its k-th score. The cutoff ``t1 / m`` for a query of m terms is
   safe: a document whose every weight is below it scores less than t1.
2. With the cutoffs broadcast, each task collects the entries that reach them and
   adds them up. A document stays a candidate while its sum, plus the cutoff for each list
   that gave no entry, reaches the k-th largest sum that the task has seen.
3. The k-th largest sum t2 >= t1 of all tasks is a better bound, and candidates below it
   are dropped. The lists of those left are looked up again and give their exact
   scores; the k best of each query remain, ties by doc_id.

What is broadcast is one number for each query and the queries' terms; queries are
taken in rounds of at most ``QUERY_TERMS`` terms, read from their table one after the other.
Candidates are broadcast up to ``BROADCAST_ROWS`` and shuffled beyond.

Cases: a null or empty query, or one none of whose terms occurs, has no result; a
null or empty document scores nothing; a null doc_id ranks last among ties;
repeated queries and repeated documents each count on their own, the latter tied; ids
may have any type that sorts; columns besides ids and texts play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerlake.plans.lineage import discard, materialize

K = 10
K1, B = 1.2, 0.75
SCALE = 1_000_000
QUERY_TERMS = 20_000
#: Entries that a task adds up at once.
CELLS = 2_000_000
#: Most candidates (query, row) that are broadcast, some 20 MB.
BROADCAST_ROWS = 1_000_000

SEPARATORS = r""" \t\n\r.,;:!?()"|#$%&*"""
_TERM = re.compile(f"[^{SEPARATORS}]+")
_BLANKS = bytes.maketrans(b" \t\n\r.,;:!?()\"|#$%&*", b" " * 19)


def terms(text: str | None) -> list[str]:
    """Lower-case runs between blanks and punctuation, in order."""
    return _TERM.findall((text or "").lower())


def _words(text: bytes) -> list[bytes]:
    """The terms of a lower-case text in UTF-8."""
    if b"\x0b" in text or b"\x0c" in text:  # blanks for split(), but no separators
        return [w.encode() for w in _TERM.findall(text.decode())]
    return text.translate(_BLANKS).split()


def _postings(docs: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """``(doc_id, length, terms, counts)``: each document's query terms."""
    share = docs.sparkSession.sparkContext.broadcast({t.encode(): i for t, i in vocab.items()})
    size = max(1, len(vocab))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = share.value.get
        for b in batches:
            length, found = [], []
            for t in pc.cast(pc.utf8_lower(pc.fill_null(b.column("text"), "")), pa.binary()):
                ws = _words(t.as_py())
                length.append(len(ws))
                found.append(np.fromiter((i for i in map(get, ws) if i is not None), np.int64))
            n = np.array([len(f) for f in found], np.int64)
            key, count = np.unique(np.repeat(np.arange(len(n)), n) * size + np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            off = pa.array(np.searchsorted(key // size, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (key % size, count)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(length, pa.int64()), *lists], names=["doc_id", "length", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, length long, terms array<int>, counts array<int>")


class _Scorer:
    """Weights of a batch of postings."""

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean

    def weights(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the batch, term, weight) of every entry."""
        lists = b.column("terms")
        t = lists.flatten().to_numpy(zero_copy_only=False)
        tf = b.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        dl = b.column("length").to_numpy(zero_copy_only=False).astype(np.float64)[row]
        w = self.idf[t] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / self.mean))
        return row, t, np.floor(w * SCALE + 0.5).astype(np.int64)


def _best(keys: np.ndarray, scores: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each key; ties by ``ties`` ascending."""
    order = np.lexsort((ties, -scores, keys))
    s = keys[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s, side="left")
    return order[rank < k]


def _search(docs: DataFrame, queries: list[tuple[int, list[str]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocab = {t: i for i, t in enumerate(sorted({t for _, ts in queries for t in ts}))}
    want = [np.array(sorted({vocab[t] for t in ts}), np.int64) for _, ts in queries]
    number = np.array([n for n, _ in queries], np.int64)
    posts = materialize(_postings(docs, vocab).withColumn("row", F.monotonically_increasing_id()), "postings")
    total = posts.agg(F.count("*").alias("n"), F.sum("length").alias("len")).first()
    n_docs, mean = total["n"], float(total["len"] or 0) / max(1, total["n"])
    df = np.zeros(len(vocab))
    for r in posts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each query term
        df[r["t"]] = r["count"]
    idf = np.where(df > 0, np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), 0.0)
    scorer = _Scorer(idf, mean or 1.0)

    def local_lists(batches):
        held = None
        least = np.zeros(len(idf), np.int64)  # the k-th best entry of each list so far
        for b in batches:
            row, t, w = scorer.weights(b)
            new = (t.astype(np.int64), b.column("row").to_numpy()[row], w)
            if held is not None:
                may = w >= least[t]
                new = tuple(np.concatenate([x, y[may]]) for x, y in zip(held, new))
            keep = _best(new[0], new[2], new[1], k)
            held = tuple(x[keep] for x in new)
            n = np.bincount(held[0], minlength=len(idf))
            low = np.full(len(idf), np.iinfo(np.int64).max)
            np.minimum.at(low, held[0], held[2])
            least = np.where(n >= k, low, 0)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["t", "row", "w"])

    lists = posts.mapInArrow(local_lists, "t long, row long, w long")
    lists = lists.withColumn("n", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("w"), "row"))).where(F.col("n") <= k)
    qt = spark.createDataFrame([(q, int(t)) for q, ts in enumerate(want) for t in ts] or [(-1, -1)], "q long, t long")
    sums = lists.join(qt, "t").groupBy("q", "row").agg(F.sum("w").alias("s"))
    kth = sums.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "row"))).where(F.col("n") == k)
    m = np.array([len(w) for w in want], np.int64)
    t1 = np.zeros(len(want), np.int64)
    for r in kth.collect():  # one row for each query
        t1[r["q"]] = r["s"]
    # Each term's queries, side by side, and the lowest of their cutoffs.
    asked = np.concatenate([np.zeros(0, np.int64), *(np.full(len(w), q) for q, w in enumerate(want))])
    term = np.concatenate([np.zeros(0, np.int64), *want])
    asked, term = asked[np.argsort(term, kind="stable")], np.sort(term)
    first = np.searchsorted(term, np.arange(len(vocab) + 1))
    cut = np.full(len(vocab), np.iinfo(np.int64).max)
    np.minimum.at(cut, term, -(-t1[asked] // m[asked]))
    many = np.diff(first)

    def collect(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        low = t1.copy()  # the k-th largest sum of each query so far
        for b in batches:
            row, t, w = scorer.weights(b)
            go = (w > 0) & (w >= cut[t])
            row, t, w = row[go].astype(np.int64), t[go], w[go]
            # Whole documents, as many as have about CELLS entries in all queries.
            step = np.cumsum(many[t]) // CELLS
            step = step[np.searchsorted(row, row, side="left")] if len(row) else step
            found = []
            for lo, hi in zip((cuts := np.concatenate([np.flatnonzero(np.diff(step, prepend=-1)), [len(step)]]))[:-1], cuts[1:]):
                r, e, x = row[lo:hi], t[lo:hi], w[lo:hi]
                n = many[e]
                at = np.repeat(first[e] - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, r, x = asked[at], np.repeat(r, n), np.repeat(x, n)
                reach = x * m[q] >= t1[q]
                q, r, x = q[reach], r[reach], x[reach]
                order = np.argsort(r * len(m) + q, kind="stable")
                q, r, x = q[order], r[order], x[order]
                head = np.flatnonzero(np.diff(r * len(m) + q, prepend=-1))
                if len(head):
                    found.append((q[head], r[head], np.add.reduceat(x, head), np.diff(np.append(head, len(q)))))
            if not found:
                continue
            q, r, x, n = (np.concatenate(c) for c in zip(*found))
            may = x >= low[q]
            held = tuple(np.concatenate(c) for c in zip(held, (q[may], x[may])))
            keep = _best(held[0], held[1], np.zeros(len(held[0])), k)
            held = tuple(c[keep] for c in held)
            worst = np.full(len(m), np.iinfo(np.int64).max)
            np.minimum.at(worst, held[0], held[1])
            full = np.bincount(held[0], minlength=len(m)) >= k
            low = np.where(full, np.maximum(low, worst), low)
            # m x the upper bound, as the cutoff t1 / m need not be whole.
            may = x * m[q] + (m[q] - n) * t1[q] >= low[q] * m[q]
            yield pa.RecordBatch.from_arrays([pa.array(c[may]) for c in (q, b.column("row").to_numpy()[r], x, n)], names=["q", "row", "s", "n"])

    some = materialize(posts.mapInArrow(collect, "q long, row long, s long, n long"), "candidates")
    kth = some.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("i") == k)
    t2 = t1.copy()
    for r in kth.select("q", "s").collect():  # one row for each query
        t2[r["q"]] = max(t2[r["q"]], r["s"])

    def left(batches):
        for b in batches:
            q, s, n = (b.column(c).to_numpy() for c in ("q", "s", "n"))
            yield b.filter(pa.array(s * m[q] + (m[q] - n) * t1[q] >= t2[q] * m[q])).select(["q", "row"])

    maybe = materialize(some.mapInArrow(left, "q long, row long"), "left")
    send = F.broadcast if maybe.count() <= BROADCAST_ROWS else lambda x: x
    ask = [set(w.tolist()) for w in want]

    def resolve(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row, t, w = scorer.weights(b)
            q = b.column("q").to_numpy()
            mine = np.fromiter((x in ask[y] for x, y in zip(t.tolist(), q[row].tolist())), bool, len(t))
            exact = np.bincount(row[mine], w[mine], minlength=b.num_rows).astype(np.int64)
            sure = np.flatnonzero((exact >= t2[q]) & (exact > 0))
            yield pa.RecordBatch.from_arrays([pa.array(number[q[sure]]), *(b.column(c).take(pa.array(sure)) for c in ("doc_id", "row")), pa.array(exact[sure])], names=["q", "doc_id", "row", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = posts.join(send(maybe), "row").select("q", "doc_id", "row", "length", "terms", "counts").mapInArrow(resolve, f"q long, doc_id {kind}, row long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    best = materialize(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "doc_id", "score"), "best")
    for table in (posts, some, maybe):
        discard(table)
    return best


def _rounds(queries: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """(item_id, terms) of the queries that have terms, at most ``QUERY_TERMS`` at a time."""
    part: list[tuple[object, list[str]]] = []
    size = 0
    for r in queries.select("item_id", "text").orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator():
        ts = terms(r["text"])
        if part and size + len(set(ts)) > QUERY_TERMS:
            yield part
            part, size = [], 0
        if ts:
            part.append((r["item_id"], ts))
            size += len(set(ts))
    if part:
        yield part


def top_documents(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of every query."""
    spark = docs.sparkSession
    kind = T.StructType([T.StructField("q", T.LongType()), T.StructField("item_id", queries.schema["item_id"].dataType)])
    out = None
    for part in _rounds(queries):
        got = _search(docs, [(n, ts) for n, (_, ts) in enumerate(part)], k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(part)], kind)
        got = got.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")  # the round's queries
        out = got if out is None else out.unionByName(got)
    if out is None:
        kinds = [queries.schema["item_id"].dataType, T.IntegerType(), docs.schema["doc_id"].dataType, T.LongType()]
        return spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in zip(("item_id", "rank", "doc_id", "score"), kinds)]))
    return out


def oracle(k: int = K) -> str:
    """The same ranking as DuckDB SQL."""
    cut = "'[^ \\t\\n\\r.,;:!?()\"|#$%&*]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), {cut}) AS ws FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), {cut}))) AS t FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM d),
p AS (SELECT r, doc_id, dl, t, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS dl, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
w AS (SELECT r, doc_id, p.t, CAST(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1}::DOUBLE) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * dl / mean)) * {SCALE} + 0.5) AS BIGINT) AS w FROM p JOIN f USING (t), c),
s AS (SELECT q, item_id, r, doc_id, sum(w)::BIGINT AS score FROM w JOIN q USING (t) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
