import numpy as np
import pytest

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve xi yo zu".split()


def prose(rng, n):
    out = []
    for i in range(n):
        w = "".join(rng.choice(SYLLABLES, rng.integers(1, 4)))
        out.append(w + ("." if i % 12 == 11 else ""))
    return " ".join(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality double, __hash string, h long, __new string"


def frame(spark, rows):
    """Documents with columns whose names the operators might use themselves."""
    full = [(i, t, lang, s, None if t is None else len(t), 0.5, "x", 1, "y") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows."""
    rng = np.random.default_rng(0)
    a = prose(rng, 60)
    rows = [
        (1, a, "en", "s1"),
        (1, a, "en", "s1"),
        (2, None, None, None),
        (None, a, "en", None),
        (None, None, None, None),
        (3, "", "en", "s2"),
        (4, "", "en", "s2"),
        (5, "   \n\t", "de", "s2"),
        (6, prose(rng, 40_000), "en", "s1"),
        (7, "x" * 300_000, "en", "s1"),
        (8, "one", None, "s1"),
        (9, "é ü ñ 日本語 \x00 ok", "fr", "s3"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
