import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fingerlake.llm import ann, ivf, queries, topk

from .conftest import frame, prose
from .test_layout import rows, sql


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist(), "l") for i, v in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<float>, row string")


def test_recall_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_NODES", 300)
    monkeypatch.setattr(ann, "LEAF", 100)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[10] = x[11]
    df = vectors(spark, x)
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour_id, r.similarity)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = [len(set(np.argsort(-s[i])[:10]) & {v[0] for v in got[i].values()}) / 10 for i in range(900)]
    assert np.mean(hits) >= 0.95 and min(len(v) for v in got.values()) == 10
    assert got[10][1][0] == 11 and all(got[i][k][1] == pytest.approx(s[i, got[i][k][0]], abs=1e-5) for i in range(0, 900, 90) for k in range(1, 11))
    q = rng.normal(size=(40, 24)).astype(np.float32)
    near = {}
    for r in ann.search(df, vectors(spark, q)).collect():
        near.setdefault(r.vec_id, set()).add(r.neighbour_id)
    t = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ u.T
    assert np.mean([len(set(np.argsort(-t[i])[:10]) & near[i]) / 10 for i in range(40)]) >= 0.9


def test_whole_company_of_a_hub_meets(monkeypatch):
    monkeypatch.setattr(ann, "TILE", 100)
    rng = np.random.default_rng(8)
    n, new = 700, 300
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fresh = np.arange(n) < new
    table = pa.table({"row": pa.array(np.arange(n)), "vec": pa.array([v.tobytes() for v in x], pa.binary()), "worst": pa.array(np.full(n, -2, np.float32)), "hosts": pa.array([np.int64(0).tobytes()] * n, pa.binary()), "fresh": pa.array([f.tobytes() for f in fresh], pa.binary())})
    got = {r["row"]: np.frombuffer(r["ids"], np.int64) for r in ann._meet(1)(table).to_pylist()}
    sim = x @ x.T
    np.fill_diagonal(sim, -3)
    sim[np.ix_(~fresh, ~fresh)] = -3
    assert all(int(sim[i].argmax()) in got[i] for i in range(n))


def test_odd_vectors(spark):
    data = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [0.0, 2.0], None), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [float("nan"), 1.0], "a"), (5, [1.0], "a"), (6, [1.0, None], "a")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, part string")
    got = ann.neighbours(df).collect()
    assert len(got) == 6 and {r.vec_id for r in got} == {1, None}
    assert [r.similarity for r in got if r.vec_id == 1 and r["rank"] == 1] == [1.0, 1.0]
    assert ann.neighbours(df.where("false")).count() == 0
    assert ann.neighbours(df.where("vec_id = 5")).count() == 0


def test_topk_matches_sql(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [prose(rng, int(rng.integers(3, 60))) for _ in range(150)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).union(frame(spark, [(500, texts[3], "en", "s"), (None, texts[3], None, None), (501, None, None, None), (502, "", None, None)]))
    q = [(i, " ".join(texts[i * 7].split()[:8]) + " The, unseen!", "z") for i in range(15)] + [(20, None, "z"), (21, "", "z"), (22, "unseen", "z"), (None, texts[9], "z"), (3, texts[40], "z")]
    queries = spark.createDataFrame(q, "item_id long, text string, doc_id string")
    want = sql(docs, topk.oracle(7), benchmark=queries)
    assert rows(topk.top_documents(docs, queries, 7)) == want
    monkeypatch.setattr(topk, "QUERY_TERMS", 20)
    monkeypatch.setattr(topk, "CELLS", 500)
    assert rows(topk.top_documents(docs.repartition(5), queries, 7)) == want
    assert rows(topk.top_documents(odd, queries, 3)) == sql(odd, topk.oracle(3), benchmark=queries)
    assert topk.top_documents(none, queries).count() == 0 and topk.top_documents(docs, queries.where("false")).count() == 0
    assert topk.top_documents(docs, queries.where("item_id = 20")).columns == ["item_id", "rank", "doc_id", "score"]


def found(df):
    return sorted((repr(r.vec_id), r["rank"], repr(r.neighbour_id), r.similarity) for r in df.collect())


def test_answers_do_not_depend_on_partitioning(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_NODES", 100)
    monkeypatch.setattr(ann, "LEAF", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 12)).astype(np.float32)
    x[100:140] = x[100]
    df = vectors(spark, x, [*range(490), *[7] * 10])
    want = found(ann.neighbours(df))
    assert want == found(ann.neighbours(df.repartition(7))) and len(want) == 5000


def test_no_hot_leaf_in_a_narrow_cone(spark, monkeypatch):
    """Vectors on one side of every plane through the origin make leaves like any others."""
    rng = np.random.default_rng(3)
    x = (5 + rng.uniform(size=(3000, 16))).astype(np.float32)
    x[:700] = x[0]
    real = ann._leaf_lists

    def spy(seed, size, span):
        run = real(seed, size, span)
        return lambda table: (_ for _ in ()).throw(AssertionError(table.num_rows)) if table.num_rows > 4 * ann.LEAF else run(table)

    monkeypatch.setattr(ann, "LEAF", 100)
    monkeypatch.setattr(ann, "_leaf_lists", spy)
    got = {}
    for r in ann.neighbours(vectors(spark, x)).collect():
        got.setdefault(r.vec_id, {})[r.neighbour_id] = r.similarity
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for i in range(0, 3000, 10):
        s = u[i] @ u.T
        s[i] = -2
        tenth = np.sort(s)[-10]
        hits.append(sum(v >= tenth - 1e-6 for v in got[i].values()) / 10)
    assert np.mean(hits) >= 0.9


def test_a_bound_that_ends_the_search_is_reported(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_ROUNDS", 1)
    monkeypatch.setattr(ann, "LEAF", 20)
    monkeypatch.setattr(ann, "MAX_HOPS", 1)
    x = np.random.default_rng(4).normal(size=(600, 30)).astype(np.float32)
    with pytest.warns(UserWarning, match="settled"):
        ann.neighbours(vectors(spark, x)).count()


def test_topk_odd_ids_and_blanks(spark, monkeypatch):
    """Ids of any type, characters that only some functions take for blanks, candidates that are shuffled."""
    rng = np.random.default_rng(7)
    texts = [prose(rng, 20) + f" w{i % 9}\x0bx \x0c y\u2028z \xa0{i % 5}" for i in range(80)]
    docs = spark.createDataFrame([(f"d{i:03}", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, row int")
    queries = spark.createDataFrame([(f"q{i}", texts[i] if i % 2 else f"w{i}\x0bx \u2028z 3", 1) for i in range(9)], "item_id string, text string, q int")
    want = sql(docs, topk.oracle(4), benchmark=queries)
    assert rows(topk.top_documents(docs, queries, 4)) == want and want
    monkeypatch.setattr(topk, "BROADCAST_ROWS", 0)
    assert rows(topk.top_documents(docs, queries, 4)) == want


def brute(x, ids, k=10):
    """By query: the ids of its ``k`` nearest, smaller id first where cosines are equal."""
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.round(u @ u[i], 9)
        s[i] = -2
        out[int(ids[i])] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r["rank"])):
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    return got


def test_op1_asks_for_every_fiftieth_row(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[300:340] = x[50]
    vectors(spark, x).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.op1_ann(spark, str(tmp_path))
    assert out.columns == ["vec_id", "rank", "neighbour_id", "similarity"]
    assert answers(out) == brute(x, np.arange(1200))


def test_index_reaches_its_recall_and_splits_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(ivf, "EXACT_PAIRS", 0)
    monkeypatch.setattr(ivf, "_parts", lambda size, room, real=ivf._parts: real(size, 300))
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 24)).astype(np.float32)
    x[1000:2500] = x[7]
    df = vectors(spark, x)
    asks = F.col("vec_id") % 50 == 0
    got, want = answers(ivf.nearest(df, asks)), brute(x, np.arange(6000))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9
    # Of a thousand equal vectors in several parts, the smallest ids.
    assert got[1050] == [7, *range(1000, 1009)]
    assert found(ivf.nearest(df, asks)) == found(ivf.nearest(df.repartition(7), asks))


def test_index_on_odd_vectors(spark, monkeypatch):
    data = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (None, [0.0, 2.0], None), (50, None, "a"), (100, [0.0, 0.0], "a"), (150, [float("nan"), 1.0], "a"), (200, [1.0], "a"), (250, [1.0, None], "a")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, row string")
    asks = F.col("vec_id") % 50 == 0
    for pairs in (0, ivf.EXACT_PAIRS):
        monkeypatch.setattr(ivf, "EXACT_PAIRS", pairs)
        got = ivf.nearest(df, asks).collect()
        assert sorted((r.vec_id, r["rank"], r.neighbour_id is None) for r in got) == [(0, 1, False), (0, 1, False), (0, 2, True), (0, 2, True)]
        assert [r.similarity for r in got if r["rank"] == 1] == [1.0, 1.0]
        assert ivf.nearest(df.where("false"), asks).count() == 0 and ivf.nearest(df, F.lit(False)).count() == 0
