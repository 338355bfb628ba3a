import itertools

import numpy as np
import pyarrow as pa
import pytest

from fingerlake.llm import neardup

from .conftest import frame, prose


def weights(text):
    w = "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()
    grams = [tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    return {g: grams.count(g) for g in set(grams)}


def brute_jp(a, b):
    x, y = weights(a), weights(b)
    if not x or not y:
        return float(len(x) == len(y))
    out = 0.0
    for i in x.keys() & y.keys():
        out += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return out


def vary(rng, text, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = prose(rng, 1)
    return " ".join(w)


def corpus(n=50, seed=1):
    rng = np.random.default_rng(seed)
    base = [prose(rng, int(rng.integers(40, 200))) for _ in range(n)]
    out = list(base)
    for t in base[:15]:
        out += [vary(rng, t, s) for s in (0.0, 0.02, 0.05, 0.12)]
    shared = prose(rng, 60)
    out += [prose(rng, 200) + " " + shared + " " + prose(rng, 200) for _ in range(10)]
    return out


def test_exact_similarity():
    rng = np.random.default_rng(2)
    t = prose(rng, 50)
    pairs = [(t, t + " " + t), (t, vary(rng, t, 0.1)), ("a b", "a b"), ("a b", "a c"), ("", ""), ("", "a"), ("a a a a a b", "a a a b b")]
    for a, b in pairs:
        assert neardup.probability_jaccard(a, b) == pytest.approx(brute_jp(a, b), abs=1e-9)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        t = prose(rng, 150)
        u = vary(rng, t, float(rng.uniform(0, 0.2)))
        a, b = neardup.signatures(pa.array([t, u]))
        errors.append((a == b).mean() - brute_jp(t, u))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signatures_do_not_depend_on_company():
    texts = corpus(20)
    together = neardup.signatures(pa.array(texts))
    for t, s in zip(texts[:5], together):
        assert (neardup.signatures(pa.array([t]))[0] == s).all()


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_groups_match_brute_force(spark):
    texts = corpus()
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = components(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if brute_jp(texts[i], texts[j]) >= neardup.THRESHOLD])
    got = {r.doc_id: (r.group_id, r.keeper, r.group_size) for r in neardup.near_duplicate_groups(docs).collect()}
    grouped = {i for i in range(len(texts)) if want.count(want[i]) > 1}
    agree = sum(got.get(i, (i,))[0] == want[i] for i in range(len(texts)))
    assert agree >= 0.97 * len(texts) and not set(got) - grouped
    kept = {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()}
    assert kept == set(range(len(texts))) - {i for i, (_, k, _) in got.items() if not k}
    assert neardup.drop_near_duplicates(docs).columns == docs.columns


def test_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.group_id, r.group_size, r.keeper) for r in neardup.near_duplicate_groups(odd).collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False)], key=repr)
    kept = sorted((r.doc_id for r in neardup.drop_near_duplicates(odd).collect()), key=repr)
    assert kept == sorted([1, 2, None, 3, 5, 6, 7, 8, 9], key=repr)
    assert neardup.near_duplicate_groups(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0


def test_names_with_dots(odd):
    docs = odd.withColumnRenamed("quality", "a.b").withColumnRenamed("__new", "group_id")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 9


def test_tiles_find_all_pairs(spark, monkeypatch):
    """A bucket cut into tiles gives the pairs of one that is not."""
    rng = np.random.default_rng(5)
    sig = [rng.integers(0, 4, neardup.REGISTERS).astype(np.uint8) for _ in range(6)]
    sig = [np.where(rng.random(neardup.REGISTERS) < 0.1, 9, sig[i % 6]).astype(np.uint8) for i in range(60)]
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "h long, sig binary")
    rows = [(1, i, i % 7, 60) for i in range(60)] + [(2, i, i, 3) for i in (3, 9, 10)] + [(5, i, i, 2) for i in (0, 6)]
    parts = spark.createDataFrame(rows, "key long, h long, c long, n long")

    def estimate(i, j):
        return ((sig[i] == sig[j]).mean() - 1 / 256) / (1 - 1 / 256)

    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 7 != j % 7 and estimate(i, j) >= 0.35}
    want |= {(i, j) for i, j in ((3, 9), (3, 10), (9, 10), (0, 6)) if estimate(i, j) >= 0.35}
    for tile in (1024, 7):
        monkeypatch.setattr(neardup, "TILE", tile)
        assert {tuple(r) for r in neardup._cross(parts, nodes, 0.5).collect()} == want and want


def test_every_pair_that_connects_is_verified(spark, monkeypatch):
    """Estimates that are wrong by chance put no one into a group."""
    texts = corpus(30)
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    monkeypatch.setattr(neardup, "MARGIN", 0.6)
    sure = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if brute_jp(texts[i], texts[j]) >= neardup.THRESHOLD}
    want = components(len(texts), sure)
    got = {r.doc_id: r.group_id for r in neardup.near_duplicate_groups(docs).collect()}
    assert set(got) <= {i for i in range(len(texts)) if want.count(want[i]) > 1} and all(want[i] == want[g] for i, g in got.items())
