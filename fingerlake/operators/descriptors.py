"""Local descriptors: candidate pairs by shared descriptors, then geometry."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fingerlake.functions.images import gray, resize, unletterbox_crop
from fingerlake.operators.similarity import cross_overlap_pairs, overlap_pairs

DESCRIPTORS = "filepath string, keypoints array<array<float>>, descriptors array<array<float>>, descriptor_count int, width int, height int, hasher string"


class LocalHasher:
    """Ratio of the mutual nearest-neighbour test and the join threshold."""

    def __init__(self, name: str, ratio: float, threshold: float, overlap: float):
        self.name, self.ratio, self.threshold, self.overlap = name, ratio, threshold, overlap

    def compute(self, image: np.ndarray, max_features: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Keypoints and descriptors, the strongest ``max_features`` by the detector."""
        try:
            import cv2
        except ImportError as e:
            raise RuntimeError(f"{self.name} needs OpenCV") from e
        engine = cv2.SIFT_create(nfeatures=max_features) if self.name == "SIFT" else cv2.AKAZE_create(max_points=max_features)
        points, desc = engine.detectAndCompute(image, None)
        return np.array([p.pt for p in points], np.float32).reshape(-1, 2), desc


SIFT = LocalHasher("SIFT", 0.5, 100, 0.01)
AKAZE = LocalHasher("AKAZE", 0.85, 250, 0.01)


class PatchHasher(LocalHasher):
    """Normalised 8 x 8 patches around strong corners; needs no library."""

    def __init__(self):
        super().__init__("patch", 0.8, 0.35, 0.1)

    def compute(self, image, max_features=256):
        g = gray(image).astype(np.float64)
        gy, gx = np.gradient(g)

        def blur(a):
            s = np.cumsum(np.cumsum(np.pad(a, ((3, 2), (3, 2)), mode="edge"), 0), 1)
            return s[5:, 5:] - s[:-5, 5:] - s[5:, :-5] + s[:-5, :-5]

        a, b, c = blur(gx * gx), blur(gy * gy), blur(gx * gy)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        h, w = r.shape
        best = np.ones_like(r, bool)
        for dy in range(-3, 4):
            for dx in range(-3, 4):
                if dy or dx:
                    best &= r >= np.roll(r, (dy, dx), (0, 1))
        best[:6] = best[-6:] = False
        best[:, :6] = best[:, -6:] = False
        best &= r > 1e-3 * max(r.max(), 1e-9)
        ys, xs = np.nonzero(best)
        order = np.argsort(-r[ys, xs], kind="stable")[:max_features]
        desc = []
        for y, x in zip(ys[order], xs[order]):
            p = g[y - 4 : y + 4, x - 4 : x + 4].ravel()
            p = p - p.mean()
            desc.append(p / (np.linalg.norm(p) + 1e-9))
        return np.stack([xs[order], ys[order]], 1).astype(np.float32), np.array(desc, np.float32).reshape(-1, 64)


def preprocess(image: np.ndarray, max_size: int = 256, to_gray: bool = False) -> np.ndarray | None:
    """Crop the border, shrink the longer side to ``max_size``; None without content."""
    image = unletterbox_crop(image)
    if image is None:
        return None
    s = max_size / max(image.shape[:2])
    if s < 1:
        image = resize(image, max(1, round(image.shape[0] * s)), max(1, round(image.shape[1] * s)))
    return gray(image) if to_gray else image


def describe(images: DataFrame, hasher: LocalHasher, min_features: int = 10, max_features: int = 256, max_size: int = 256) -> DataFrame:
    """One row for each path; descriptors are null where fewer than ``min_features``."""
    from fingerlake.operators.hashing import from_spark_image

    def run(batches):
        for b in batches:
            rows = []
            for path, struct in zip(b.column("filepath").to_pylist(), b.column("image").to_pylist()):
                got = (None, None, None, None, None)
                try:
                    image = preprocess(from_spark_image(struct), max_size)
                    if image is not None:
                        pts, desc = hasher.compute(image, max_features)
                        if desc is not None and len(desc) >= min_features:
                            got = (pts[:max_features].tolist(), desc[:max_features].tolist(), min(len(desc), max_features), image.shape[1], image.shape[0])
                except ValueError:
                    pass
                rows.append((path, *got, hasher.name))
            kinds = [pa.string(), pa.list_(pa.list_(pa.float32())), pa.list_(pa.list_(pa.float32())), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = ["filepath", "keypoints", "descriptors", "descriptor_count", "width", "height", "hasher"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return images.select("filepath", "image").mapInArrow(run, DESCRIPTORS)


def area(points: np.ndarray) -> float:
    """Of the points' bounding box."""
    return float(np.prod(points.max(0) - points.min(0))) if len(points) else 0.0


def intersection(kept: np.ndarray, every: np.ndarray) -> float:
    """Share of the bounding box of all points that the kept ones span."""
    whole = area(every)
    return area(kept) / whole if whole else 0.0


def minimum_intersection(kept1, every1, kept2, every2) -> float:
    return min(intersection(kept1, every1), intersection(kept2, every2))


def ratio_matches(a: np.ndarray, b: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(near, good_a, good_b)``: each a's nearest b, and who passes the ratio test.

    A row passes if its nearest row of the other table is nearer than ``ratio``
    times its second nearest. Distances are squared, and so is the meaning of
    ``ratio``; without a second row none passes the test against that table.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)

    def good(d: np.ndarray) -> np.ndarray:
        if d.shape[1] < 2:
            return np.zeros(len(d), bool)
        two = np.partition(d, 1, axis=1)
        return two[:, 0] < ratio * two[:, 1]

    return d.argmin(axis=1), good(d), good(d.T)


def homography(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Least-squares projective map p -> q, or None."""

    def norm(x):
        c = x.mean(0)
        s = np.sqrt(2) / max(1e-12, np.linalg.norm(x - c, axis=1).mean())
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    tp, tq = norm(p), norm(q)
    ph, qh = np.c_[p, np.ones(len(p))] @ tp.T, np.c_[q, np.ones(len(q))] @ tq.T
    rows = []
    for (x, y, w), (u, v, z) in zip(ph, qh):
        rows += [[0, 0, 0, -z * x, -z * y, -z * w, v * x, v * y, v * w], [z * x, z * y, z * w, 0, 0, 0, -u * x, -u * y, -u * w]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    h = np.linalg.inv(tq) @ h @ tp
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def apply_homography(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    x = np.c_[p, np.ones(len(p))] @ h.T
    return x[:, :2] / np.where(np.abs(x[:, 2:]) < 1e-12, 1e-12, x[:, 2:])


def ransac(p: np.ndarray, q: np.ndarray, reach: float = 1.0, rounds: int = 50_000, confidence: float = 0.9999, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """Projective map that most points agree with to ``reach`` pixels, and which they are.

    Seeded samples of four pairs, until a better map has become less likely than
    1 - ``confidence`` at the share of agreement so far, or after ``rounds``.
    """
    rng = np.random.default_rng(seed)
    best = np.zeros(len(p), bool)
    done, need = 0, float(rounds)
    while done < min(need, rounds):
        done += 1
        s = rng.choice(len(p), 4, replace=False)
        h = homography(p[s], q[s])
        if h is None or not np.isfinite(h).all():
            continue
        ok = np.linalg.norm(apply_homography(h, p) - q, axis=1) < reach
        if ok.sum() > best.sum():
            best = ok
            hit = best.mean() ** 4
            need = 0 if hit >= 1 else math.log(1 - confidence) / math.log1p(-hit) if hit > 0 else rounds
    return (homography(p[best], q[best]), best) if best.sum() >= 4 else (None, best)


_POINTS = T.ArrayType(T.ArrayType(T.FloatType()))
#: ``match`` is the share of good matches, by which the first test is made.
STATS = T.StructType(
    [T.StructField("passed", T.BooleanType())]
    + [T.StructField(n, T.StringType() if n == "MAB" else T.DoubleType()) for n in ("match", "min_kpBM", "MAB", "intersection", "inliers", "bounds_intersection")]
    + [T.StructField(n, _POINTS) for n in ("final_matched_a_pts", "final_matched_b_pts")]
)


def validate(d1: dict, d2: dict, ratio: float, minimum_match: float = 0.4, minimum_intersection_share: float = 0.6, minimum_inliers: int = 5) -> dict:
    """Whether two images' descriptors agree in geometry, with the figures so far.

    In turn: the smaller of both images' shares of descriptors that pass the ratio test is at
    least ``minimum_match``; the matched keypoints (those of A that pass, and their
    nearest of B, A being the image with more keypoints) span enough of all keypoints of
    both; a projective map has ``minimum_inliers``; and each image, moved by it, covers
    enough of the other. The matched points are those of ``d1`` and ``d2``.
    """
    out: dict = dict.fromkeys(STATS.names)
    out["passed"] = False
    swap = len(d1["keypoints"] or ()) < len(d2["keypoints"] or ())
    a, b = (d2, d1) if swap else (d1, d2)
    if not len(a["descriptors"] or ()) or not len(b["descriptors"] or ()):
        return out
    ka, kb = (np.asarray(d["keypoints"], float).reshape(-1, 2) for d in (a, b))
    near, good_a, good_b = ratio_matches(a["descriptors"], b["descriptors"], ratio)
    out["match"] = float(min(good_a.mean(), good_b.mean()))
    if out["match"] < minimum_match:
        return out
    p, q = ka[good_a], kb[near[good_a]]
    out["min_kpBM"] = float(len(p))
    if len(p) < 4:
        return out
    out["intersection"] = minimum_intersection(p, ka, q, kb)
    if out["intersection"] < minimum_intersection_share:
        return out
    h, ok = ransac(p, q)
    if h is None:
        return out | {"MAB": "is-None"}
    out |= {"MAB": "good", "inliers": float(ok.sum())}
    if out["inliers"] < minimum_inliers:
        return out
    try:
        back = np.linalg.inv(h)
    except np.linalg.LinAlgError:
        return out | {"MAB": "inverse-failed"}
    size_a, size_b = (np.array([d["width"], d["height"]], float) for d in (a, b))
    origin = np.zeros(2)
    at = np.clip(apply_homography(h, np.stack([origin, size_a])), 0, size_b)
    bt = np.clip(apply_homography(back, np.stack([origin, size_b])), 0, size_a)
    share = min(abs(float(np.prod(bt[1] - bt[0]) / np.prod(size_a))), abs(float(np.prod(at[1] - at[0]) / np.prod(size_b))))
    points = [p[ok].tolist(), q[ok].tolist()]
    out |= {"bounds_intersection": share, "final_matched_a_pts": points[swap], "final_matched_b_pts": points[not swap]}
    out["passed"] = share >= minimum_intersection_share
    return out


def compute_pairs(described: DataFrame, hasher: LocalHasher, queries: DataFrame | None = None, minimum_overlap: float | None = None) -> DataFrame:
    """Candidate ``(path1, path2)``, or (query, match), by shared descriptors."""
    check_hasher(described, queries if queries is not None else described)
    least = hasher.overlap if minimum_overlap is None else minimum_overlap

    def long(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        d = df.where("descriptors is not null").select("filepath", F.xxhash64("filepath").alias("id"), "descriptors")
        return d.select("id", F.posexplode("descriptors").alias("sub", "vec")).withColumn("sub", F.col("sub").cast("long")), d.select("id", "filepath")

    v, names = long(described)
    if queries is None:
        pairs, n1 = overlap_pairs(v, hasher.threshold, least).select(F.col("id1").alias("a"), F.col("id2").alias("b")), names
    else:
        q, n1 = long(queries)
        pairs = cross_overlap_pairs(q, v, hasher.threshold, least).select(F.col("query_id").alias("a"), F.col("match_id").alias("b"))
    x, y = n1.select(F.col("id").alias("a"), F.col("filepath").alias("path1")), names.select(F.col("id").alias("b"), F.col("filepath").alias("path2"))
    out = pairs.join(x, "a").join(y, "b").select("path1", "path2")
    return out if queries is not None else out.select(F.least("path1", "path2").alias("path1"), F.greatest("path1", "path2").alias("path2"))


def check_hasher(a: DataFrame, b: DataFrame) -> str:
    """The one hasher that both tables were made with."""
    names = {r[0] or "SIFT" for df in (a, b) for r in df.select("hasher").distinct().limit(3).collect()}
    if len(names) > 1:
        raise ValueError(f"descriptors of different hashers do not compare: {sorted(names)}")
    return next(iter(names), "SIFT")


def deduplicate_described(described: DataFrame, hasher: LocalHasher, queries: DataFrame | None = None, verbose: bool = False, **limits) -> DataFrame:
    """Validated pairs of paths; with ``verbose`` also the match statistics."""
    pairs = compute_pairs(described, hasher, queries)
    cols = ["keypoints", "descriptors", "descriptor_count", "width", "height"]
    s = F.struct(*cols)
    left = (queries if queries is not None else described).select(F.col("filepath").alias("path1"), s.alias("d1"))
    right = described.select(F.col("filepath").alias("path2"), s.alias("d2"))
    kind = to_arrow_type(STATS)

    @F.arrow_udf(STATS)
    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([validate(x, y, hasher.ratio, **limits) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    out = pairs.join(left, "path1").join(right, "path2").select("path1", "path2", check("d1", "d2").alias("stats")).where("stats.passed")
    return out if verbose else out.drop("stats")
