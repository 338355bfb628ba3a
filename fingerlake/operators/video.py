"""Ordered aggregates over frame tables: (video_id, frame_index, ts, ...)."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from fractions import Fraction
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerlake.functions.codecs import encode
from fingerlake.functions.distance import distance


def framewise(frames: DataFrame, threshold: float, metric: str = "euclidean", vec: str = "vec", video: str = "video_id", order: str = "frame_index", quality: str | None = None, quality_threshold: float | None = None, anchor: str = "first") -> DataFrame:
    """The frames that a framewise hash keeps.

    Frames below the quality threshold go first. The first frame left is kept, and
    each later one whose distance to the anchor is over ``threshold``. With
    ``anchor="first"`` that is the video's first frame, one window function; with
    ``"previous"`` the last frame kept, a fold in one task for each video.
    """
    if metric == "hamming" and threshold > 1:
        raise ValueError("hamming distances are shares; the threshold must not exceed 1")
    if quality_threshold is not None:
        frames = frames.where(F.col(quality) >= quality_threshold)
    if anchor == "first":
        w = Window.partitionBy(video).orderBy(order)
        f = frames.withColumn("__first", F.first(vec).over(w)).withColumn("__n", F.row_number().over(w))
        return f.where((F.col("__n") == 1) | (distance(metric, vec, "__first") > threshold)).drop("__first", "__n")
    if anchor != "previous":
        raise ValueError("anchor must be first or previous")

    def far(a: np.ndarray, b: np.ndarray) -> float:
        if metric == "hamming":
            return float((a != b).mean())
        if metric == "cosine":
            return float(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
        sq = float(((a - b) ** 2).sum())
        return math.sqrt(sq) if metric == "euclidean" else sq

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        keep, last = [], None
        for i, v in enumerate(t[vec].to_pylist()):
            x = np.asarray(v, float)
            if last is None or far(x, last) > threshold:
                keep.append(i)
                last = x
        return t.take(pa.array(keep, pa.int64()))

    return frames.groupBy(video).applyInArrow(run, frames.schema)


def batches(kept: DataFrame, batch_size: int, video: str = "video_id", order: str = "frame_index") -> DataFrame:
    """Kept frames with a batch number: a batch closes once it exceeds ``batch_size``."""
    n = F.row_number().over(Window.partitionBy(video).orderBy(order))
    return kept.withColumn("batch", F.floor((n - 1) / (batch_size + 1)).cast("long"))


def sample_every(frames: DataFrame, step: int, video: str = "video_id", order: str = "frame_index") -> DataFrame:
    """Every ``step``-th frame from the first."""
    n = F.row_number().over(Window.partitionBy(video).orderBy(order))
    return frames.withColumn("__n", n - 1).where(F.pmod("__n", F.lit(step)) == 0).drop("__n")


def sample_rate(frames: DataFrame, file_fps: float, fps: float | str | None, video: str = "video_id", index: str = "frame_index", max_duration: float | None = None) -> DataFrame:
    """Frames at a wanted rate, by the indexes floor(k x step), step >= 1.

    ``fps="keyframes"`` keeps rows whose ``pict_type`` is I. A frame one past
    ``max_duration`` is still delivered.
    """
    if fps == "keyframes":
        return frames.where("pict_type = 'I'")
    step = 1.0 if fps is None else max(1.0, file_fps / fps)
    k = F.ceil(F.col(index) / F.lit(step))
    out = frames.where(F.floor(k * F.lit(step)) == F.col(index))
    if max_duration is not None:
        ts = F.col(index) / F.lit(file_fps)
        out = out.withColumn("__over", F.sum((ts > max_duration).cast("int")).over(Window.partitionBy(video).orderBy(index))).where("__over <= 1").drop("__over")
    return out


def _order(b: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch, video by video."""
    return np.argsort(b.column("video").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), kind="stable")


def _frames(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Vectors of a batch video by video, where each video begins, and the videos."""
    order = _order(b)
    code = b.column("video").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[order]
    at = np.flatnonzero(np.diff(code, prepend=-2))
    x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)[order]
    return x, at, b.column("video").take(pa.array(order[at]))


def mean_vector(frames: DataFrame, vec: str = "vec", video: str = "video_id", norm: float | None = 2, quality: str | None = None, quality_threshold: float | None = None) -> DataFrame:
    """``(video_id, vec)``: element-wise mean of the frames' vectors, Lp-normalised.

    A video without a usable frame has no row. Each Arrow batch gives one sum for
    each of its videos, and these are added up.
    """
    if quality_threshold is not None:
        frames = frames.where(F.col(quality) >= quality_threshold)
    kind = frames.schema[video].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, at, code = _frames(b)
                total = np.add.reduceat(x, at, axis=0)
                n = np.diff(np.append(at, len(x)))
                yield pa.RecordBatch.from_arrays([code, pa.array(n), pa.array([t.tobytes() for t in total], pa.binary())], names=["video", "n", "total"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in sorted(t["total"].to_pylist()))
        return pa.table([t["video"].slice(0, 1), pa.array([(total / sum(t["n"].to_pylist())).tolist()], pa.list_(pa.float64()))], names=[video, "vec"])

    parts = frames.where(F.col(vec).isNotNull()).select(F.col(video).alias("video"), F.col(vec).alias("vec")).mapInArrow(part, f"video {kind}, n long, total binary")
    v = parts.groupBy("video").applyInArrow(add, f"`{video}` {kind}, vec array<double>")
    if norm is None:
        return v
    total = F.pow(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(float(norm)))), F.lit(1.0 / norm))
    return v.withColumn("__t", total).select(video, F.transform("vec", lambda x: F.when(F.col("__t") == 0, 0.0).otherwise(x / F.col("__t"))).alias("vec"))


PERIODS = (2731, 4391, 9767, 14653)
M = 32


def _bessel(n: int, x: float) -> float:
    """exp(-x) I_n(x), by its power series in logarithms."""
    terms = []
    for k in count():
        t = (2 * k + n) * math.log(x / 2) - math.lgamma(k + 1) - math.lgamma(k + n + 1) - x
        terms.append(t)
        if k > x and t < max(terms) - 40:
            break
    top = max(terms)
    return math.exp(top) * sum(math.exp(t - top) for t in terms)


def temporal_weights(m: int = M, beta: float = 32.0) -> np.ndarray:
    """Weights of the Fourier terms 0..m-1 of a von-Mises kernel."""
    i0 = _bessel(0, beta)
    sinh = (1 - math.exp(-2 * beta)) / 2  # sinh(beta) exp(-beta)
    a = [(i0 - math.exp(-beta)) / (2 * sinh)] + [_bessel(i, beta) / sinh for i in range(1, m)]
    return np.sqrt(np.array(a))


def temporal_feature(frames: DataFrame, vec: str = "vec", video: str = "video_id", ts: str = "ts", m: int = M) -> DataFrame:
    """``(video_id, period, term, i, value)``: temporal match kernel features.

    For each period T and frequency j the sums over frames of
    ``w_j sin(2 pi j t / T) x`` (terms 0..m-1) and of the cosine (m..2m-1).
    Each Arrow batch gives one matrix for each of its videos, and these are added up.
    """
    w = temporal_weights(m)
    omega = np.stack([2 * np.pi * np.arange(m) / period for period in PERIODS])  # periods, m
    kind = frames.schema[video].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, at, code = _frames(b)
            t = b.column("t").take(pa.array(_order(b))).to_numpy(zero_copy_only=False)
            total = []
            for lo, hi in zip(at, np.append(at[1:], len(x))):
                angle = omega[:, :, None] * t[None, None, lo:hi]
                wave = np.concatenate([w[None, :, None] * np.sin(angle), w[None, :, None] * np.cos(angle)], axis=1)
                total.append((wave @ x[lo:hi]).tobytes())
            yield pa.RecordBatch.from_arrays([code, pa.array(total, pa.binary())], names=["video", "total"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in sorted(t["total"].to_pylist())).reshape(len(PERIODS), 2 * m, -1)
        p, j, i = (k.ravel() for k in np.indices(total.shape))
        same = t["video"].combine_chunks().take(pa.array(np.zeros(total.size, np.int64)))
        return pa.table([same, pa.array(p.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total.ravel())], names=[video, "period", "term", "i", "value"])

    parts = frames.where(F.col(vec).isNotNull()).select(F.col(video).alias("video"), F.col(ts).cast("double").alias("t"), F.col(vec).alias("vec")).mapInArrow(part, f"video {kind}, total binary")
    return parts.groupBy("video").applyInArrow(add, f"`{video}` {kind}, period int, term int, i int, value double")


def normalise_feature(fv: np.ndarray, how: str | None) -> np.ndarray:
    """(periods, 2m, d) normalised by ``feat``, ``freq``, both or ``matrix``.

    ``feat`` makes the vectors of each term unit vectors after the terms' weights
    are taken out; ``freq`` gives each element a mean square of 1 over the m
    frequencies; ``matrix`` makes each period's matrix a unit one.
    """
    if how not in (None, "feat", "freq", "feat_freq", "matrix"):
        raise ValueError("normalization must be feat, freq, feat_freq or matrix")
    eps = 1e-8
    m = fv.shape[1] // 2
    if how in ("feat", "feat_freq"):
        w = np.tile(temporal_weights(m), 2)[None, :, None]
        fv = fv / (np.sqrt(((fv / w) ** 2).sum(axis=2, keepdims=True) + eps) + eps)
    if how in ("freq", "feat_freq"):
        fv = fv / (np.sqrt((fv**2).sum(axis=1, keepdims=True) / m + eps) + eps)
    if how == "matrix":
        fv = fv / (np.sqrt((fv**2).sum(axis=(1, 2), keepdims=True) + eps) + eps)
    return fv


def temporal_scores(a: np.ndarray, b: np.ndarray, offsets=(0,), how: str | None = "matrix") -> np.ndarray:
    """Match score of two features (periods, 2m, d) at each time offset.

    At an offset o the score is that of ``a``'s frames moved back by o.
    """
    a, b = normalise_feature(np.asarray(a, float), how), normalise_feature(np.asarray(b, float), how)
    m = a.shape[1] // 2
    offsets = np.asarray(offsets, float)
    sa, ca, sb, cb = a[:, :m], a[:, m:], b[:, :m], b[:, m:]
    same = (sa * sb + ca * cb).sum(2)
    cross = (sa * cb - ca * sb).sum(2)
    out = []
    for p, period in enumerate(PERIODS):
        angle = 2 * np.pi * np.outer(offsets, np.arange(m)) / period
        out.append(np.cos(angle) @ same[p] + np.sin(angle) @ cross[p])
    score = np.mean(out, axis=0)
    return score / {"freq": m, "feat": 512, "feat_freq": 512}.get(how, 1)


def common_framerates(rates: dict[str, Fraction | float | None]) -> dict[Fraction, tuple[str, ...]]:
    """Group hashers so that few frames are decoded.

    Rates in a group are read at their least common multiple; of all partitions of
    the distinct rates the one with the least sum of group rates is taken, the
    fewer groups among equals. A helper for the planner: the input is a handful.
    """
    ids = {k: Fraction(v).limit_denominator(8_316_000) for k, v in rates.items() if v is not None}
    if any(v < Fraction(1, 8_316_000) for v in ids.values()):
        raise ValueError("frame rates below 1/8316000 are not supported")
    distinct = sorted(set(ids.values()))
    grid = math.lcm(*[r.denominator for r in distinct]) if distinct else 1

    def rate(group: tuple[Fraction, ...]) -> Fraction:
        return Fraction(math.lcm(*[int(r * grid) for r in group]), grid)

    best: tuple = ()

    def split(left: list[Fraction], groups: list[tuple[Fraction, ...]]) -> None:
        nonlocal best
        if not left:
            cost = (sum(map(rate, groups)), len(groups))
            if not best or cost < best[0]:
                best = (cost, groups)
            return
        head, tail = left[0], left[1:]
        for i, g in enumerate(groups):
            split(tail, [*groups[:i], (*g, head), *groups[i + 1 :]])
        split(tail, [*groups, (head,)])

    split(distinct, [])
    return {rate(g): tuple(k for k, v in ids.items() if v in g) for g in (best[1] if best else [])}


def synchronised(frames: DataFrame, hashers: dict[str, tuple[Fraction | float, Column]], video: str = "video_id", order: str = "frame_index") -> dict[str, DataFrame]:
    """Frames for each hasher from one numbered scan at the common rate.

    ``hashers`` maps a name to (rate, hash column); ``frames`` come at the rate of
    their group.
    """
    groups = common_framerates({k: r for k, (r, _) in hashers.items()})
    n = frames.withColumn("__n", F.row_number().over(Window.partitionBy(video).orderBy(order)) - 1)
    out = {}
    for rate, names in groups.items():
        for k in names:
            step = Fraction(rate) / Fraction(hashers[k][0]).limit_denominator(8_316_000)
            if step.denominator != 1:
                warnings.warn(f"{k} does not divide its group's rate", stacklevel=2)
            out[k] = n.where(F.pmod("__n", F.lit(int(step))) == 0).withColumn("vec", hashers[k][1]).drop("__n")
    return out


def slideshow(frames: DataFrame, in_fps: float, out_fps: float, offset: float = 0.0, max_frames: int | None = None, video: str = "video_id", ts: str = "ts") -> DataFrame:
    """Frames sampled at ``in_fps`` after ``offset`` seconds, retimed to ``out_fps``."""
    f = frames.where(F.col(ts) >= offset)
    f = f.withColumn("__slot", F.floor((F.col(ts) - offset) * in_fps))
    f = f.withColumn("__n", F.row_number().over(Window.partitionBy(video, "__slot").orderBy(ts))).where("__n = 1")
    f = f.withColumn("frame_index", F.row_number().over(Window.partitionBy(video).orderBy(ts)) - 1)
    if max_frames is not None:
        f = f.where(F.col("frame_index") < max_frames)
    return f.withColumn(ts, F.col("frame_index") / F.lit(float(out_fps))).drop("__slot", "__n")


def clip(frames: DataFrame, start: float = 0.0, end: float | None = None, ts: str = "ts") -> DataFrame:
    """Frames in [start, end) seconds, retimed to begin at 0."""
    f = frames.where(F.col(ts) >= start)
    if end is not None:
        f = f.where(F.col(ts) < end)
    return f.withColumn(ts, F.col(ts) - start)


def black_padding(frames: DataFrame, fps: float, duration_s: float = 0.0, duration_pct: float = 0.0, vec: str = "vec", video: str = "video_id", ts: str = "ts") -> DataFrame:
    """(video_id, ts, vec) with zero frames before and after each video.

    The pad lasts ``duration_s`` or ``duration_pct`` of the video, whichever is
    longer.
    """
    f = frames.select(video, ts, vec)
    span = f.groupBy(video).agg(F.max(ts).alias("__end"), F.first(F.transform(vec, lambda x: x * 0)).alias("__black"))
    pad = F.greatest(F.lit(float(duration_s)), F.lit(float(duration_pct)) * F.col("__end"))
    span = span.withColumn("__n", F.floor(pad * fps).cast("int"))
    one = span.where("__n > 0").select(video, "__end", "__black", "__n", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("k"))
    shift = F.col("__n") / F.lit(float(fps))
    before = one.select(video, (F.col("k") / F.lit(float(fps))).alias(ts), F.col("__black").alias(vec))
    after = one.select(video, (shift + F.col("__end") + (F.col("k") + 1) / F.lit(float(fps))).alias(ts), F.col("__black").alias(vec))
    own = f.join(span.select(video, "__n"), video).select(video, (F.col(ts) + shift).alias(ts), vec)
    return before.unionByName(own).unionByName(after)


class VideoHash:
    """A hash that is folded over a video's frames in order.

    ``process_frame`` gets each frame with the state it returned before (None at
    first), ``hash_from_final_state`` makes the vector, or several with ``multiple``. A state
    may list ``scenes``; ``end`` is set to the last frame's time.
    """

    name = "video"
    dtype = "float32"
    metric = "euclidean"
    length = 0
    multiple = False
    frames_per_second: float = 1.0

    def process_frame(self, frame: np.ndarray, frame_index: int, frame_timestamp: float, state: dict | None = None) -> dict:
        raise NotImplementedError

    def hash_from_final_state(self, state: dict) -> np.ndarray | list[np.ndarray]:
        raise NotImplementedError


VIDEO_RECORD = "video_id string, hash string, error string, scenes string, end double, hasher_name string, hasher_dtype string, hasher_distance_metric string, hasher_hash_length int"


def hash_videos(frames: DataFrame, hasher: VideoHash, form: str = "base64", errors: str = "raise", videos: DataFrame | None = None) -> DataFrame:
    """A row for each hash of each video, with its scenes as JSON and its end.

    ``frames`` is a table of the sources: (video_id, frame_index, ts, height, width,
    channels, data). Frames are sorted video by video and folded as they stream
    by, so a long video needs no more memory than its state. A video that fails,
    or of ``videos`` has no frame, is a row with ``error`` under ``errors="warn"``
    (a warning is given in the worker) or ``"ignore"``; under ``"raise"`` the job fails.
    """
    if errors not in ("raise", "warn", "ignore"):
        raise ValueError("errors must be raise, warn or ignore")
    about = (hasher.name, hasher.dtype, hasher.metric, hasher.length)
    names = [c.split(" ")[0] for c in VIDEO_RECORD.split(", ")]
    kinds = [pa.string()] * 4 + [pa.float64()] + [pa.string()] * 3 + [pa.int32()]

    def failed(video: str, e: Exception) -> tuple:
        if errors == "raise":
            raise e
        if errors == "warn":
            warnings.warn(f"{video}: {e}", stacklevel=2)
        return (video, None, str(e), None, None, *about)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("video_id", "frame_index", "ts", "height", "width", "channels", "data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for video, got in groupby(rows(batches), lambda r: r[0]):
            state, problem = None, None
            for _, index, ts, h, w, c, data in got:
                if problem is None:
                    try:
                        if data is None:
                            raise ValueError("the frame cannot be decoded")
                        state = hasher.process_frame(np.frombuffer(data, np.uint8).reshape(h, w, c), index, ts, state)
                        state["end"] = ts
                    except Exception as e:  # noqa: BLE001  a broken video is a row, not a failed job
                        problem = e
            try:
                if problem is not None:
                    raise problem
                v = hasher.hash_from_final_state(state)
                vs = v if hasher.multiple else [v]
                out = [(video, encode(x, hasher.dtype, form), None, json.dumps(state.get("scenes", [])), state["end"], *about) for x in vs]
            except Exception as e:  # noqa: BLE001
                out = [failed(video, e)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    f = frames.select("video_id", "frame_index", "ts", "height", "width", "channels", "data")
    got = f.repartition("video_id").sortWithinPartitions("video_id", "frame_index").mapInArrow(run, VIDEO_RECORD)
    if videos is None:
        return got
    lost = videos.select(F.col("video_id").cast("string").alias("video_id")).distinct().join(frames.select("video_id").distinct(), "video_id", "left_anti")
    if errors == "raise" and (some := lost.first()) is not None:
        raise ValueError(f"{some['video_id']} has no frame")
    none = lambda t: F.lit(None).cast(t)
    lost = lost.select("video_id", none("string"), F.lit("the video has no frame"), none("string"), none("double"), *map(F.lit, about)).toDF(*names)
    return got.unionByName(lost.withColumn("hasher_hash_length", F.col("hasher_hash_length").cast("int")))
