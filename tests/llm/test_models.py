import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fingerlake.llm import quality, toxicity

from .conftest import frame, prose


def quality_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = prose(rng, int(rng.integers(20, 120)))
        if i % 2:
            t = " ".join(w + str(rng.choice(["###", "$$$", "%%%"])) for w in t.split()) if i % 4 == 1 else t.upper().replace(" ", "!! ")
        out.append((t, 1 - i % 2))
    return out


def test_quality_held_out():
    model = quality.fit(quality_rows(300), epochs=8)
    test = quality_rows(200, 9)
    p = model.predict([t.encode() for t, _ in test])
    y = np.array([v for _, v in test])
    assert ((p >= quality.THRESHOLD) == y).mean() > 0.95


def test_quality_is_the_same_alone_and_in_company():
    model = quality.fit(quality_rows(60), epochs=2)
    rng = np.random.default_rng(1)
    texts = [b"", prose(rng, 5).encode(), prose(rng, 9000).encode(), b"a", prose(rng, 200).encode()]
    both = model.predict(texts)
    assert both[0] == 0
    for t, p in zip(texts, both):
        assert model.predict([t])[0] == pytest.approx(p, abs=1e-6)
    # Brute force: every window of the padded text, one by one.
    t = texts[4]
    buf = np.frombuffer(bytes(quality.WIDTH) + t + bytes(64), np.uint8)
    resp = [model.emb[buf[i : i + quality.WIDTH]].reshape(-1) @ model.conv for i in range(0, len(t) + quality.WIDTH, quality.STEP)]
    h = np.maximum(np.max([*resp, np.zeros(quality.FILTERS)], axis=0) + model.shift, 0)
    assert 1 / (1 + np.exp(-(h @ model.out + model.bias))) == pytest.approx(both[4], abs=1e-5)


def test_quality_sees_the_end_of_a_long_text():
    model = quality.fit(quality_rows(300), epochs=8)
    rng = np.random.default_rng(4)
    t = prose(rng, 30_000)
    junk = " ".join(w + "###" for w in prose(rng, 60).split())
    a, b = model.predict([t.encode(), (t + " " + junk).encode()])
    assert b < a


def labels(spark, rows, name):
    other = "toxic" if name == "quality" else "quality"
    return spark.createDataFrame([(i, y, 0) for i, y in rows], f"doc_id long, {name} int, {other} int")


def test_quality_stage(spark, odd, none):
    rows = quality_rows(120)
    docs = frame(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)])
    lab = labels(spark, [(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (3, None)], "quality")
    scored = quality.quality_scores(docs, lab)
    assert scored.columns == ["doc_id", "quality_probability", "keep"] and scored.count() == 120
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.where("keep").collect()}
    got = quality.quality_scores(odd, lab.where("doc_id < 8")).collect()
    assert len(got) == 12 and all(r.quality_probability == 0 and not r.keep for r in got if r.doc_id in (2, 3, 4))
    assert quality.quality_scores(none, lab).count() == 0
    assert all(r.keep for r in quality.quality_scores(docs, lab.where("false")).collect())


BAD = ["grunk", "smeeb"]


def toxic_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    out, at = [], []
    for i in range(n):
        s = [prose(rng, 10).replace(".", "") for _ in range(int(rng.integers(2, 7)))]
        k = int(rng.integers(len(s)))
        if i % 3 == 0:
            s[k] += f" {BAD[i % 2]}{rng.choice(['', 'a', 'ot'])}"
        out.append((". ".join(s) + ".", int(i % 3 == 0)))
        at.append(k)
    return out, at


def test_toxicity_held_out_and_located():
    model = toxicity.fit(toxic_rows(400)[0], epochs=120)
    test, at = toxic_rows(200, 5)
    right = found = 0
    for (t, y), k in zip(test, at):
        p, scored = model.document(t)
        assert p == pytest.approx(1 - np.prod([1 - x[2] for x in scored]), abs=1e-9)
        right += (p >= 0.5) == y
        if y:
            found += max(scored, key=lambda x: x[2])[0] == k
    assert right >= 190 and found >= 0.95 * sum(y for _, y in test)


def test_toxic_sentences(spark, odd, none):
    rows, at = toxic_rows(240)
    docs = frame(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)])
    lab = labels(spark, [(i, y) for i, (_, y) in enumerate(rows)], "toxic")
    got = toxicity.toxic_sentences(docs, lab).collect()
    hit = {r.doc_id for r in got}
    want = {i for i, (_, y) in enumerate(rows) if y}
    assert len(hit ^ want) <= 4
    assert all(any(b in r.sentence for b in BAD) for r in got if r.sentence_score >= 0.5 and r.doc_id in want)
    assert {r.doc_id for r in toxicity.toxic_sentences(odd.withColumn("doc_id", F.col("doc_id") + 1000).union(docs), lab).collect()} == hit
    assert toxicity.toxic_sentences(none, lab).count() == 0
    assert toxicity.toxic_sentences(docs, lab.where("toxic = 0")).count() == 0
    twice = docs.where("doc_id = 0").union(docs.where("doc_id = 0")).withColumn("doc_id", F.col("doc_id"))
    assert toxicity.sentences("") == [] and toxicity.sentences("a.b! c\nd") == ["a.", "b!", "c", "d"] and twice.count() == 2


def slow_sentence(model, sentence, among):
    """A sentence's probability from the model's raw weights, word by word."""
    z = model.bias + model.crowd * np.log(among)
    for w in {x.lower() for x in re.split(r"[\W_]+", sentence) if x}:
        for f in [w] + [w[:k] + "*" for k in (4, 5) if len(w) > k]:
            z += model.weight.get(f, 0.0)
    return 1 / (1 + np.exp(-z))


def test_toxicity_query_matches_brute_force(spark):
    rows, _ = toxic_rows(240)
    rng = np.random.default_rng(3)
    long = ". ".join(prose(rng, 9).replace(".", "") for _ in range(3000))
    extra = [(900, long), (901, long + ". " + rows[0][0]), (902, None), (903, ""), (904, "?!"), (905, rows[0][0]), (905, rows[0][0]), (None, rows[0][0])]
    docs = frame(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)] + [(i, t, "en", "s") for i, t in extra])
    lab = labels(spark, [(i, y) for i, (_, y) in enumerate(rows)], "toxic")
    model = toxicity.train(docs, lab)
    want = []
    for i, t in [(i, t) for i, (t, _) in enumerate(rows)] + extra:
        parts = [x.strip() for x in re.findall(r"[^.!?\n]+[.!?]*", t or "") if x.strip()]
        scores = [slow_sentence(model, x, len(parts)) for x in parts]
        p = 1 - np.prod([1 - x for x in scores]) if parts else 0.0
        if p >= toxicity.THRESHOLD:
            want += [(i, n, round(p, 6), round(x, 6)) for n, x in enumerate(scores) if x >= toxicity.SENTENCE_THRESHOLD or x == max(scores)]
    got = [(r.doc_id, r.sentence_index, round(r.toxic_probability, 6), round(r.sentence_score, 6)) for r in toxicity.toxic_sentences(docs, lab).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ids = {r[0] for r in got}
    assert {905, None} <= ids and 901 in ids and 900 not in ids
    assert max(r[1] for r in got if r[0] == 901) >= 3000


def test_spread_evidence_is_not_overruled():
    """Many mild sentences may make a document toxic; the worst of them is named."""
    model = toxicity.NoisyOr(-2.9444, {})
    p, scored = model.document("a. " * 20)
    assert p == pytest.approx(1 - 0.95**20, abs=1e-3) and p > toxicity.THRESHOLD and len(scored) == 20


def test_quality_gradients():
    """Derivatives of the loss against differences, parameter by parameter."""
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.5, (256, quality.DIM))
    emb[0] = 0
    m = quality.ByteCNN(emb, rng.normal(0, 0.2, (quality.WIDTH * quality.DIM, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.3, quality.FILTERS), 0.1)
    buf, first = quality.layout([prose(rng, n).encode() for n in (3, 40, 200)])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.4, 0.7])

    def loss():
        n = len(buf) // quality.STEP - quality.CHUNK
        win = np.stack([buf[i * quality.STEP : i * quality.STEP + quality.WIDTH] for i in range(n)])
        resp = m.emb[win].reshape(n, -1) @ m.conv
        cuts = [*(first * quality.CHUNK), n]
        h = np.maximum(np.stack([resp[a:b].max(0) for a, b in zip(cuts[:-1], cuts[1:])]) + m.shift, 0)
        p = 1 / (1 + np.exp(-(h @ m.out + m.bias)))
        return float(np.mean(-weight * (y * np.log(p) + (1 - y) * np.log(1 - p))))

    got = quality.gradients(m, buf, first, y, weight)
    for param, grad in zip((m.emb, m.conv, m.shift, m.out), got):
        at = np.argwhere(np.abs(grad) > np.abs(grad).max() / 20)
        for i in at[rng.choice(len(at), min(6, len(at)), False)]:
            i, step = tuple(i), 1e-6
            param[i] += step
            up = loss()
            param[i] -= 2 * step
            down = loss()
            param[i] += step
            assert grad[i] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-8)
    m.bias += 1e-6
    up = loss()
    m.bias -= 2e-6
    assert got[4][0] == pytest.approx((up - loss()) / 2e-6, rel=1e-3)
