import numpy as np
import pytest

import corpus_pipeline
from fingerlake.llm import mixing, neardup, packing, quality, secretscan
from fingerlake.llm.training import labelled_sample

from .conftest import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    d = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(160):
        t = prose(rng, int(rng.integers(30, 120)))
        if i % 5 == 1:
            t = " ".join(w + "###" for w in t.split())
        if i % 20 == 2:
            t += " password=" + "".join(rng.choice(list("0123456789abcdef"), 18))
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(i % 5 != 1), 0))
    rows += [(1000 + i, rows[i * 5][1], "en", "s0", rows[i * 5][4]) for i in range(12)]
    rows += [(None, None, None, None, None), (2000, "", "en", "s1", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_run_matches_stage_by_stage_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = quality.fit(labelled_sample(docs, spark.read.parquet(f"{folder}/labels.parquet"), "quality", quality.TRAIN_PER_CLASS))
    p = model.predict([(r[1] or "").encode() for r in rows])
    rows = [r for r, x in zip(rows, p) if x >= quality.THRESHOLD]
    assert {r[0] for r in rows} >= {i for i in range(160) if i % 5 != 1} and not {r[0] for r in rows} & {i for i in range(160) if i % 5 == 1}
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    kept = []
    for r in rows:
        if not any(neardup.probability_jaccard(r[1], k[1]) >= neardup.THRESHOLD for k in kept):
            kept.append(r)
    clean = [(*r[:1], secretscan.redact(r[1]), *r[2:]) for r in kept]
    assert sum(secretscan.MASK in r[1] for r in clean) == 8
    frame = spark.createDataFrame([(*r[:4], len(r[1])) for r in clean], COLUMNS)
    want = sorted(map(repr, packing.pack(mixing.mix(frame)).collect()))
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, got.collect())) == want and want


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split(" ")[0] for c in COLUMNS.split(", ")]
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_stages_on_odd_rows(spark, folder, odd):
    """Nulls in any column, empty and very long texts, repeated rows and clashing columns."""
    docs = odd.withColumnRenamed("quality", "a.b").withColumn("tokens", odd["h"]).withColumn("keep", odd["h"]).withColumn("__id", odd["h"])
    count = {"quality": None, "neardup": None, "secrets": None, "mixing": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        count[name] = (docs.count(), len(rows))
        docs = spark.createDataFrame(rows, out.schema) if name != "quality" else docs
        assert stage(spark, docs.where("false"), folder).count() == 0
    # Quality drops texts that are null or empty; the later stages, given all rows, keep those,
    # but for a source that has no token at all, which gets no seat.
    assert count["quality"][1] <= 8
    assert count["neardup"] == (12, 9) and count["secrets"] == (9, 9) and count["mixing"] == (9, 5)
    windows = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert {i for w in windows for i in w.doc_ids} == {1, 6, 7, 8, 9}
