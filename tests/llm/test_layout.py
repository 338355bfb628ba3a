import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fingerlake.llm import hilbert, mixing, packing, queries, secretscan

from .conftest import frame, prose


def sql(df, query, **more):
    con = duckdb.connect()
    for n, d in {"documents": df, **more}.items():
        con.register(f"t_{n}", d.toArrow())
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM t_{n}")
    cur = con.execute(query)
    cols = [c[0] for c in cur.description]
    return sorted(map(repr, (tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall())))


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_curve():
    t = hilbert.automaton()
    for bits in (1, 2, 3):
        pts = list(itertools.product(range(1 << bits), repeat=3))
        order = sorted(pts, key=lambda p: hilbert.hilbert_index(p, bits))
        assert sorted(hilbert.hilbert_index(p, bits) for p in pts) == list(range(8**bits))
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in itertools.pairwise(order))
        for p in pts:
            s = d = 0
            for b in range(bits - 1, -1, -1):
                e = t[s * 8 + (p[0] >> b & 1) * 4 + (p[1] >> b & 1) * 2 + (p[2] >> b & 1)]
                d, s = d * 8 + e % 64, e // 64
            assert d == hilbert.hilbert_index(p, bits)


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(0)
    r = [(i, prose(rng, int(rng.integers(1, 80))), str(rng.choice(["en", "de"])), f"s{min(4, rng.geometric(0.5))}") for i in range(300)]
    return frame(spark, r)


def test_shards_match_sql(odd, many, none):
    for df in (odd, many, none):
        assert rows(hilbert.hilbert_shards(df, 2000)) == sql(df, hilbert.oracle(shard_chars=2000))
    s = hilbert.shard_manifest(hilbert.hilbert_shards(many, 2000)).collect()
    assert len(s) > 5 and all(r.chars < 2000 + 400 for r in s)


def test_write_shards(many, tmp_path, spark):
    hilbert.write_shards(many, str(tmp_path / "out"), 2000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300


def test_mixture_matches_sql(odd, many, none):
    for df in (odd, many, none):
        assert rows(mixing.mixture(df, block_tokens=100, shard_blocks=8)) == sql(df, mixing.oracle(100, 8))
    out = mixing.mix(odd, block_tokens=100)
    assert out.columns == odd.columns


def divisor_seats(weights, n):
    got = {s: 0 for s in weights}
    order = []
    for _ in range(n):
        s = max(weights, key=lambda k: (weights[k] / (2 * got[k] + 1), weights[k], [-ord(c) for c in k]))
        got[s] += 1
        order.append(s)
    return order


def test_quotas_match_brute_force(spark, many):
    w = {"s1": 5.0, "s2": 3.0, "s3": 1.0, "s4": 0.5, "s9": 7.0, "s0": -1.0}
    m = mixing.mixture(many, weights=w, block_tokens=50, shard_blocks=4)
    seats = {r.seat: r.source for r in m.select("seat", "source").distinct().collect()}
    want = divisor_seats({k: v for k, v in w.items() if k in ("s1", "s2", "s3", "s4")}, len(seats))
    assert [seats[i] for i in range(len(seats))] == want
    for shard in range(len(seats) // 4):
        part = want[shard * 4 : shard * 4 + 4]
        assert {r.source for r in m.where(F.col("shard") == shard).collect()} == set(part)
    few = mixing.mixture(many, weights=w, block_tokens=50, total_blocks=3)
    assert few.agg(F.max("seat")).first()[0] == 2
    other = mixing.mixture(many, weights=w, block_tokens=50, total_blocks=3, seed=99)
    assert rows(few) != rows(other) and rows(few) == rows(mixing.mixture(many, weights=w, block_tokens=50, total_blocks=3))


def test_packing_query_counts_vocabulary_tokens(odd, spark, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    enc = secretscan.tokenizer()
    want = []
    for d in odd.collect():
        n = len(enc.encode_ordinary(d.text or ""))
        want += [(d.doc_id, s, min(packing.WINDOW, n - s)) for s in range(0, n, packing.WINDOW)]
    seen = []
    for r in queries.op9_packing(spark, str(tmp_path)).collect():
        assert r.filled == sum(r.lengths) == packing.WINDOW - r.slack <= packing.WINDOW
        seen += list(zip(r.doc_ids, r.starts, r.lengths))
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert len([p for p in seen if p[0] == 7]) > 10


def test_exhausted_source_drops_out(spark):
    """A hot source, a small one and a few rows without a source, by the pipeline's stage."""
    rng = np.random.default_rng(4)
    r = [(i, prose(rng, 5000), "en", "hot") for i in range(80)] + [(100 + i, prose(rng, 5000), "en", "mid") for i in range(20)]
    r += [(200 + i, prose(rng, 4500), "en", "small") for i in range(9)] + [(300, prose(rng, 5), "en", None), (301, None, "en", None)]
    docs = frame(spark, r)
    kept = corpus_pipeline.mixing_stage(spark, docs, "")
    assert rows(kept) == rows(docs)
    assert mixing.mix(docs).count() < 111
    m = mixing.mixture(docs, exhaust=True)
    seats = {x.seat: x.source for x in m.select("seat", "source").distinct().collect()}
    blocks = {s: m.where(F.col("source").eqNullSafe(s)).select("seat").distinct().count() for s in ("hot", "mid", "small", None)}
    tokens = {x.source: x.tokens**0.7 for x in m.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    got, want = dict.fromkeys(blocks, 0), []
    while any(got[s] < blocks[s] for s in blocks):
        s = max((s for s in blocks if got[s] < blocks[s]), key=lambda k: tokens[k] / (2 * got[k] + 1))
        got[s] += 1
        want.append(s)
    assert [seats[i] for i in range(len(seats))] == want
    assert mixing.mixture(docs, exhaust=True, total_blocks=5).agg(F.max("seat")).first()[0] == 4


def test_best_fill_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        lengths = rng.integers(1, 30, n)
        cap = int(rng.integers(1, 80))
        lengths = np.minimum(lengths, cap)
        v, c = np.unique(lengths, return_counts=True)
        got = packing.best_fill(v[::-1], c[::-1], cap)
        have = dict(zip(v.tolist(), c.tolist()))
        assert all(k <= have[x] for x, k in got)
        best = max(s for r in range(n + 1) for s in (sum(q) for q in itertools.combinations(lengths.tolist(), r)) if s <= cap)
        assert sum(x * k for x, k in got) == best


def test_packing(spark, odd, many, none):
    for df, window in ((many, 64), (odd, 1000)):
        out = packing.pack(df, window, group_pieces=100).collect()
        seen = []
        for r in out:
            assert len(r.doc_ids) == len(r.starts) == len(r.lengths) and sum(r.lengths) == r.filled == window - r.slack and r.filled <= window
            seen += list(zip(r.doc_ids, r.starts, r.lengths))
        want = []
        for d in df.collect():
            n = len([x for x in __import__("re").split(r"[ \t\n\r]+", d.text or "") if x])
            want += [(d.doc_id, s, min(window, n - s)) for s in range(0, n, window)]
        assert sorted(seen, key=repr) == sorted(want, key=repr)
    total = sum(r.filled for r in packing.pack(many, 64).collect())
    assert packing.pack(many, 64).count() <= total / 64 * 1.02 + 1
    assert packing.pack(none).count() == 0
    assert rows(packing.pack(many, 64)) == rows(packing.pack(many.repartition(7), 64))


def test_mix_keeps_what_the_mixture_chose(spark):
    """Equal rows at the end of a block: as many stay as were chosen."""
    rng = np.random.default_rng(6)
    t, u = prose(rng, 60), prose(rng, 45)
    docs = frame(spark, [(1, t, "en", "s")] * 5 + [(2, u, "en", "r"), (2, u, "en", "r"), (3, u, "en", "s")]).withColumnRenamed("quality", "a.b").withColumnRenamed("__new", "__id")
    for blocks in (1, 2, 3):
        m = mixing.mixture(docs, block_tokens=100, total_blocks=blocks)
        out = mixing.mix(docs, block_tokens=100, total_blocks=blocks)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in m.collect()), blocks
    assert mixing.mixture(docs, block_tokens=100, total_blocks=1).count() < 5


def test_seats_in_buckets(spark, monkeypatch):
    """Ranks over many buckets are those of one sort, ties included."""
    w = [(None, 2.0, 30), ("a", 2.0, 40), ("b", 6.0, 90), ("c", 0.5, 9), ("d", 6.0, 70)]
    weights = spark.createDataFrame(w, "source string, weight double, available long")
    for bucket in (3, 20_000):
        monkeypatch.setattr(mixing, "SEAT_BUCKET", bucket)
        for exhaust in (True, False):
            seats = [(x / (2 * j + 1), x, s is not None, s or "", j, n) for s, x, n in w for j in range(n if exhaust else n + 1)]
            seats.sort(key=lambda r: (-r[0], -r[1], r[2], r[3]))
            order = [(r[3] if r[2] else None, r[4]) for r in seats]
            if not exhaust:
                order = order[: next(i for i, r in enumerate(seats) if r[4] == r[5])]
            got = sorted((r.seat, r.source, r["rank"], r.shard) for r in mixing.quotas(weights, shard_blocks=7, exhaust=exhaust).collect())
            assert got == [(i, s, j, i // 7) for i, (s, j) in enumerate(order)]


def test_packing_odd_ids(spark, odd):
    out = packing.pack(odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), 1000)
    assert {i for r in out.collect() for i in r.doc_ids} == {"d1", None, "d6", "d7", "d8", "d9"}
    rng = np.random.default_rng(9)
    docs = frame(spark, [(None, prose(rng, 20), "en", "s") for _ in range(400)])
    got = packing.pack(docs, 64, group_pieces=50).collect()
    assert len({r.group for r in got}) == 8 and sum(r.filled for r in got) == 400 * 20


def test_write_shards_odd_tables(odd, many, none, tmp_path, spark):
    docs = many.withColumnRenamed("quality", "shard").withColumnRenamed("h", "hilbert").withColumnRenamed("__new", "a.b")
    hilbert.write_shards(docs, str(tmp_path / "a"), 2000)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(back.columns) == sorted([*docs.columns, "shard_"]) and back.count() == 300
    assert rows(back.select("doc_id", F.col("shard_").cast("long").alias("shard"))) == rows(hilbert.hilbert_shards(docs, 2000).select("doc_id", "shard"))
    hilbert.write_shards(odd, str(tmp_path / "b"), 2000)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 12
    hilbert.write_shards(none, str(tmp_path / "c"), 2000)
    # A filter on a dimension needs only some of the files.
    box = hilbert.shard_manifest(hilbert.hilbert_shards(many, 2000)).collect()
    assert any(r.max_source < "s2" or r.min_source > "s2" for r in box)
