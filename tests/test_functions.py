import numpy as np
import pytest
from pyspark.sql import functions as F

from fingerlake.functions import codecs, distance, images, vectors


def rgb(g):
    return np.repeat(np.asarray(g)[..., None], 3, 2).astype(np.uint8)


RAMP = np.tile(np.round(np.linspace(0, 255, 32)), (32, 1)).astype(np.uint8)


@pytest.mark.parametrize(
    ("image", "want"),
    [(RAMP, "aaffffffffffffff"), (RAMP.T, "ff7fff7fff7fff7f"), (np.pad(np.full((16, 16), 255), 8), "dfff7dffffffdfff"), (np.zeros((32, 32)), "ffffffffffffffff")],
)
def test_phash_goldens(image, want):
    assert codecs.encode(images.PHash().compute(rgb(image)), "bool", "hex") == want


def test_phash_box_filter_golden():
    r, c = np.meshgrid(np.arange(48), np.arange(48), indexing="ij")
    g = (17 * r + 31 * c + (r * c) % 251) % 256
    assert codecs.encode(images.PHash(shift=1, smooth=True).compute(rgb(g)), "bool", "hex") == "7df08335398011ff"


def test_phash_parameters():
    for bad in ({"shift": -1}, {"size": 1}, {"shift": 30}):
        with pytest.raises(ValueError):
            images.PHash(**bad)
    assert images.PHashF().compute(rgb(np.zeros((32, 32)))) is None
    assert images.PHashU8().compute(rgb(np.zeros((32, 32)))) is None
    assert images.PHashU8().compute(rgb(RAMP)).max() == 255


@pytest.mark.parametrize("hasher", [images.AverageHash(), images.DHash(), images.PHash(), images.WaveletHash(), images.PDQHash(), images.PDQHashF(), images.PHashF()])
def test_hash_shapes_and_variants(hasher):
    x = np.random.default_rng(0).integers(0, 255, (96, 80, 3)).astype(np.uint8)
    x = images.resize(x, 12, 10)
    x = images.resize(x, 128, 128)
    v = hasher.compute(x)
    assert len(v) == hasher.length
    direct = {k: hasher.compute(y) for k, y in images.isometric(x).items()}
    if hasher.dtype == "bool":
        for k, w in hasher.compute_isometric(x).items():
            assert (w == direct[k]).mean() > 0.85, (hasher.name, k)


def test_isometric_dct_matches_transform():
    x = np.random.default_rng(1).normal(size=(16, 16))
    d = images._dct(16)
    full = {k: (d @ v @ d.T)[1:5, 1:5] for k, v in images.isometric(x).items()}
    for k, v in images.isometric_dct((d @ x @ d.T)[1:5, 1:5], 1).items():
        assert np.allclose(v, full[k]), k
    with pytest.raises(ValueError):
        images.isometric_dct(x, -1)


def test_quality():
    assert images.quality(rgb(np.zeros((64, 64)))) == 0
    noisy = np.random.default_rng(0).integers(0, 255, (64, 64))
    assert images.quality(rgb(noisy)) == 100
    ramp = np.r_[np.linspace(0, 49, 50), np.linspace(49, 0, 50)]
    low = np.outer(ramp, ramp) / 2401 * 255
    low[50:] = 0
    low[:, 50:] = 0
    assert 0 < images.quality(rgb(low)) < 100


def test_unletterbox():
    inner = np.random.default_rng(0).integers(60, 255, (120, 100, 3)).astype(np.uint8)
    for colour in ((0, 0, 0), (200, 0, 200)):
        x = np.full((220, 150, 3), colour, np.uint8)
        x[50:170, 25:125] = inner
        assert images.unletterbox(x) == (25, 125, 50, 170)
        assert images.unletterbox_crop(x).shape == (120, 100, 3)
    assert images.unletterbox(x, only_black=True) == (0, 150, 0, 220)
    assert images.unletterbox(inner) == (0, 100, 0, 120)
    tiny = np.zeros((200, 200, 3), np.uint8)
    tiny[90:110, 90:110] = 255
    assert images.unletterbox(tiny, min_fraction=0.05) is None
    with pytest.raises(ValueError):
        images.unletterbox(inner, min_fraction=2)
    with pytest.raises(TypeError):
        images.unletterbox_crop("x")


def test_watermark_and_optional_hashes():
    x = np.zeros((40, 60, 3), np.uint8)
    mark = np.full((10, 10, 4), 255, np.uint8)
    out = images.watermark(x, mark, 1.0, 0.5)
    assert out[:20].max() == 0 and (out[20:, 40:] == 255).all()
    try:
        import cv2  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            images.BlockMean()
    with pytest.raises(ValueError):
        images.WaveletHash(6)


@pytest.mark.parametrize("form", ["hex", "base64"])
@pytest.mark.parametrize("dtype", ["bool", "uint8", "float32"])
def test_codec_round_trip(dtype, form):
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 64, 144):
        v = {"bool": rng.random(n) > 0.5, "uint8": rng.integers(0, 256, n), "float32": rng.normal(size=n).astype("f4")}[dtype]
        s = codecs.encode(v, dtype, form)
        assert len(s) == codecs.string_length(n, dtype, form)
        assert (codecs.decode(s, dtype, n, form) == v).all()
    assert codecs.encode(None, dtype, form) is None
    with pytest.raises(ValueError):
        codecs.decode("00", dtype, 999, form)
    with pytest.raises(NotImplementedError):
        codecs.string_length(3, "int64")


def test_codec_columns(spark):
    df = spark.createDataFrame([(1, [0, 128, 255]), (2, None)], "id int, v array<int>")
    got = df.select("id", codecs.vector_to_string("uint8", "hex")("v").alias("h")).orderBy("id").collect()
    assert [r.h for r in got] == ["0080ff", None]
    back = df.select(codecs.string_to_vector("uint8", 3, "hex")(codecs.vector_to_string("uint8", "hex")("v")).alias("v")).collect()
    assert sorted((r.v for r in back), key=str) == [None, [0, 128, 255]] or [r.v for r in back] == [[0, 128, 255], None]
    ok = df.select(codecs.valid_string(F.lit("zz"), 1, "uint8", "hex").alias("a"), codecs.valid_string(F.lit("0f"), 1, "uint8", "hex").alias("b")).first()
    assert (ok.a, ok.b) == (False, True)


def test_distances(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=16), rng.normal(size=16)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), (a > 0).tolist(), (b > 0).tolist())], "a array<double>, b array<double>, p array<boolean>, q array<boolean>")
    r = df.select(
        distance.distance("euclidean", "a", "b").alias("l2"),
        distance.distance("sqeuclidean", "a", "b").alias("sq"),
        distance.distance("cosine", "a", "b").alias("c"),
        distance.distance("hamming", "p", "q").alias("h"),
        distance.hamming_words(vectors.pack_words(vectors.sign_bits("a"), 16), vectors.pack_words(vectors.sign_bits("b"), 16), 16).alias("w"),
    ).first()
    assert np.isclose(r.l2, np.linalg.norm(a - b)) and np.isclose(r.sq, ((a - b) ** 2).sum())
    assert np.isclose(r.c, 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert r.h == r.w == ((a > 0) != (b > 0)).mean()
    with pytest.raises(NotImplementedError):
        distance.distance("manhattan", "a", "b")
    distance.register_metric("manhattan", lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v))
    assert np.isclose(df.select(distance.distance("manhattan", "a", "b")).first()[0], np.abs(a - b).sum())


def test_unletterbox_rules():
    """No common corner, no content, thin borders, gray values."""
    x = np.zeros((200, 200, 3), np.uint8)
    assert images.unletterbox(x) is None and images.unletterbox_crop(x) is None
    x[60:160, 60:160] = 255
    assert images.unletterbox(x) == (60, 160, 60, 160)
    four = x.copy()
    four[0, 0], four[0, -1], four[-1, 0], four[-1, -1] = 10, 60, 120, 200
    assert images.unletterbox(four) == (0, 200, 0, 200)
    thin = np.full((100, 100, 3), 255, np.uint8)
    thin[:2] = 0
    assert images.unletterbox(thin) == (0, 100, 0, 100)
    thin[:3] = 0
    assert images.unletterbox(thin) == (0, 100, 3, 100)
    # The background is gray 76; pixels of the same gray in another colour are background too.
    same = np.full((200, 200, 3), (255, 0, 0), np.uint8)
    same[50:150, 50:150] = (0, 130, 0)
    assert images.unletterbox(same) is None
    gray = x[..., 0]
    assert images.unletterbox(gray) == (60, 160, 60, 160)
    part = np.zeros((200, 200, 3), np.uint8)
    part[60:160, 95:105] = 255
    assert images.unletterbox(part) is None and images.unletterbox(part, min_side=5, min_fraction=0.04) == (95, 105, 60, 160)
