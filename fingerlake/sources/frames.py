"""Frame tables behind Spark's Python data source API: numpy videos, ffmpeg, OpenCV."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import subprocess
import warnings
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "video_id string, frame_index long, ts double, height int, width int, channels int, data binary"


def ffmpeg_path(tool: str = "ffmpeg") -> str:
    """The binary: from FINGERLAKE_FFMPEG / FINGERLAKE_FFPROBE, else from PATH."""
    found = os.environ.get(f"FINGERLAKE_{tool.upper()}") or shutil.which(tool)
    if not found:
        raise RuntimeError(f"{tool} is not installed")
    return found


def video_properties(path: str) -> dict:
    """Width, height, average rate (None where unknown), codec, start time and duration."""
    cmd = [ffmpeg_path("ffprobe"), "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height,avg_frame_rate,codec_name,start_time,duration", "-of", "json", path]
    return parse_properties(subprocess.run(cmd, check=True, capture_output=True).stdout)


def parse_properties(text: bytes | str) -> dict:
    s = json.loads(text)["streams"][0]
    num, _, den = s.get("avg_frame_rate", "0/0").partition("/")
    rate = int(num) / int(den or 1) if int(num) and int(den or 1) else None
    return {"width": s["width"], "height": s["height"], "fps": rate, "codec": s.get("codec_name"), "start_time": float(s.get("start_time", 0) or 0), "duration": float(s.get("duration", 0) or 0)}


def keyframes(frames: DataFrame) -> DataFrame:
    """``(video_id, frame_index)`` of the I-frames, in order."""
    return frames.where("pict_type = 'I'").select("video_id", "frame_index").distinct().orderBy("video_id", "frame_index")


def scaled(width: int, height: int, max_size: int | None) -> tuple[int, int]:
    """(width, height) with the longer side at most ``max_size``."""
    s = 1.0 if max_size is None else min(1.0, max_size / max(width, height))
    return max(1, round(width * s)), max(1, round(height * s))


def numpy_frames(path: str, fps: float, wanted: float | str | None = None, max_duration: float | None = None, max_size: int | None = None) -> Iterator[tuple]:
    """(index, time, image) of a ``.npy`` file that was recorded at ``fps``."""
    from fingerlake.functions.images import resize

    if wanted == "keyframes":
        raise ValueError("a numpy video has no keyframes")
    step = 1.0 if wanted is None else max(1.0, fps / wanted)
    video = np.load(path, mmap_mode="r")
    for k in range(len(video)):
        i = int(k * step)
        if i >= len(video):
            return
        f = np.ascontiguousarray(video[i])
        w, h = scaled(f.shape[1], f.shape[0], max_size)
        yield i, i / fps, f if (h, w) == f.shape[:2] else resize(f, h, w)
        if max_duration is not None and i / fps > max_duration:
            return


def ffmpeg_frames(path: str, fps: float = 1.0, wanted: float | str | None = None, max_duration: float | None = None, max_size: int | None = None) -> Iterator[tuple]:
    """(index, time, image) of any file that ffmpeg reads, from one pipe.

    The index counts the file's frames at its own rate; ``wanted`` thins them by
    ``floor(k x step)`` or, as ``"keyframes"``, to those that ffprobe flags.
    """
    about = video_properties(path)
    w, h = scaled(about["width"], about["height"], max_size)
    rate = about["fps"] or fps
    keys = set(_keyframe_numbers(path)) if wanted == "keyframes" else None
    step = 1.0 if wanted in (None, "keyframes") else max(1.0, rate / wanted)
    cmd = [ffmpeg_path(), "-v", "error", "-i", path, "-map", "0:v:0", "-vsync", "0", "-s", f"{w}x{h}", "-f", "rawvideo", "-pix_fmt", "rgb24", "-"]
    run = subprocess.Popen(cmd, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    i = k = 0
    try:
        while len(raw := run.stdout.read(w * h * 3)) == w * h * 3:
            if i in keys if keys is not None else i == int(k * step):
                k += 1
                yield i, about["start_time"] + i / rate, np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                if max_duration is not None and i / rate > max_duration:
                    return
            i += 1
        if run.wait():
            raise ValueError(run.stderr.read().decode(errors="replace").strip() or "ffmpeg failed")
    finally:
        run.kill()
        run.wait()
        run.stdout.close()
        run.stderr.close()


def _keyframe_numbers(path: str) -> list[int]:
    cmd = [ffmpeg_path("ffprobe"), "-v", "error", "-select_streams", "v:0", "-show_entries", "frame=pict_type", "-of", "json", path]
    got = json.loads(subprocess.run(cmd, check=True, capture_output=True).stdout)["frames"]
    return [i for i, f in enumerate(got) if f.get("pict_type") == "I"]


def opencv_frames(path: str, fps: float = 1.0, wanted: float | str | None = None, max_duration: float | None = None, max_size: int | None = None) -> Iterator[tuple]:
    """(index, time, image) by OpenCV's reader."""
    from fingerlake.sources.lookup import import_optional

    cv2 = import_optional("cv2")
    keys = set(_keyframe_numbers(path)) if wanted == "keyframes" else None
    video = cv2.VideoCapture(path)
    if not video.isOpened():
        raise ValueError("OpenCV cannot open the file")
    try:
        rate = video.get(cv2.CAP_PROP_FPS) or fps
        step = 1.0 if wanted in (None, "keyframes") else max(1.0, rate / wanted)
        i = k = 0
        while video.grab():
            if i in keys if keys is not None else i == int(k * step):
                k += 1
                ok, f = video.retrieve()
                if not ok:
                    raise ValueError(f"frame {i} cannot be decoded")
                w, h = scaled(f.shape[1], f.shape[0], max_size)
                yield i, i / rate, np.ascontiguousarray(cv2.resize(f, (w, h))[..., ::-1])
                if max_duration is not None and i / rate > max_duration:
                    return
            i += 1
    finally:
        video.release()


ENGINES = {"numpy": numpy_frames, "ffmpeg": ffmpeg_frames, "opencv": opencv_frames}


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.fps = float(options.get("fps", "1"))
        wanted = options.get("wanted")
        self.wanted = wanted if wanted in (None, "keyframes") else float(wanted)
        self.max_duration = float(options["max_duration"]) if "max_duration" in options else None
        self.max_size = int(options["max_size"]) if "max_size" in options else None
        self.engine, self.errors = options.get("engine", "auto"), options.get("errors", "raise")
        if self.engine != "auto" and self.engine not in ENGINES:
            raise ValueError(f"no engine {self.engine!r}")
        if self.errors not in ("raise", "warn", "ignore"):
            raise ValueError("errors must be raise, warn or ignore")
        ours = (".npy",) if self.engine == "numpy" or options.get("only_numpy") == "true" else (".npy", ".mp4", ".m4v", ".mov", ".avi", ".mkv", ".webm", ".gif", ".mpg", ".mpeg", ".wmv", ".flv", ".ts")
        self.paths = sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith(ours)) if os.path.isdir(path) else [path]

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, part: _Part) -> Iterator[tuple]:
        engine = self.engine if self.engine != "auto" else "numpy" if part.path.lower().endswith(".npy") else "ffmpeg"
        name = os.path.basename(part.path).removesuffix(".npy")
        try:
            for i, ts, f in ENGINES[engine](part.path, self.fps, self.wanted, self.max_duration, self.max_size):
                yield name, i, ts, f.shape[0], f.shape[1], f.shape[2], f.tobytes()
        except (ValueError, OSError, RuntimeError, EOFError, subprocess.SubprocessError) as e:
            if self.errors == "raise":
                raise
            if self.errors == "warn":
                warnings.warn(f"{part.path}: {e}", stacklevel=2)


class NumpyVideo(DataSource):
    """Format ``numpy_video``: files of frames x height x width x 3, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "numpy_video"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({**self.options, "only_numpy": "true"})


class Video(DataSource):
    """Format ``video``: files of any kind, each decoded in one task as it is read."""

    @classmethod
    def name(cls) -> str:
        return "video"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_videos(spark: SparkSession, path: str, fps: float = 1.0, wanted: float | str | None = None, max_duration: float | None = None, max_size: int | None = None, engine: str = "auto", errors: str = "raise") -> DataFrame:
    """Frames of every video under ``path``: (video_id, frame_index, ts, ..., data).

    ``.npy`` files, recorded at ``fps``, are read by numpy, others by ``ffmpeg`` or, as asked for,
    ``opencv``. ``wanted`` is a rate, ``"keyframes"`` or None for all frames; the
    first frame past ``max_duration`` is still delivered; the longer side is at most
    ``max_size``. What cannot be read raises, or ends the file under ``errors``
    ``"warn"`` and ``"ignore"``; :func:`operators.video.hash_videos` reports files without a frame.
    """
    spark.dataSource.register(NumpyVideo)
    spark.dataSource.register(Video)
    r = spark.read.format("video").option("fps", str(fps)).option("engine", engine).option("errors", errors)
    for k, v in (("wanted", wanted), ("max_duration", max_duration), ("max_size", max_size)):
        if v is not None:
            r = r.option(k, str(v))
    return r.load(path)


def hash_frames(frames: DataFrame, hasher) -> DataFrame:
    """``(video_id, frame_index, ts, vec, quality, error)``; vec is null for plain frames.

    A frame that cannot be hashed is a row with ``error``.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            vecs, qs, errors = [], [], []
            for h, w, c, d in zip(*(b.column(x).to_pylist() for x in ("height", "width", "channels", "data"))):
                v = q = problem = None
                try:
                    if d is None:
                        raise ValueError("the frame cannot be decoded")
                    v, q = hasher.compute_with_quality(np.frombuffer(d, np.uint8).reshape(h, w, c))
                except Exception as e:  # noqa: BLE001  a broken frame is a row, not a failed job
                    problem = str(e)
                vecs.append(None if v is None else v.astype(float).tolist())
                qs.append(q)
                errors.append(problem)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("video_id", "frame_index", "ts")], pa.array(vecs, pa.list_(pa.float64())), pa.array(qs, pa.int32()), pa.array(errors, pa.string())], names=["video_id", "frame_index", "ts", "vec", "quality", "error"])

    return frames.mapInArrow(run, "video_id string, frame_index long, ts double, vec array<double>, quality int, error string")


def output_path(source: str, target: str, ext: str | None = None) -> str:
    """``target`` with the extension ``ext``, or the source's where it has another."""
    ext = ext or os.path.splitext(source)[1]
    return target if target.lower().endswith(ext) else target + ext


def simple_transform(width: int | str = -1, height: int | str = -1, pad: str | None = None, codec: str | None = None, clip_pct: tuple | None = None, clip_s: tuple | None = None, sar: str | None = None, fps: float | None = None, output_ext: str | None = None) -> Callable[[str, str], str | None]:
    """A function (source, target) -> written file that re-encodes by ffmpeg.

    Scale (-1 keeps the aspect ratio), pad, frame rate and pixel aspect are filters in this order;
    without ``codec`` the source's is kept. ``clip_s`` is (start, length) in
    seconds and goes before ``clip_pct``, shares of the duration; either may be None.
    """
    p0, p1 = clip_pct or (None, None)
    s0, s1 = clip_s or (None, None)
    if any(p is not None and not 0 <= p <= 1 for p in (p0, p1)):
        raise ValueError("shares lie between 0 and 1")
    if p0 is not None and p1 is not None and p0 >= p1:
        raise ValueError("the end must follow the start")
    filters = [f"scale={width}:{height}"] if (width, height) != (-1, -1) else []
    filters += [f"{k}={v}" for k, v in (("pad", pad), ("fps", fps), ("setsar", sar)) if v is not None]

    def run(source: str, target: str) -> str | None:
        target = output_path(source, target, output_ext)
        about = video_properties(source) if codec is None or (p0 is not None and s0 is None) or (p1 is not None and s1 is None) else {}
        start = s0 if s0 is not None else p0 * about["duration"] if p0 is not None else None
        end = s1 if s1 is not None else p1 * about["duration"] if p1 is not None else None
        cmd = [ffmpeg_path(), "-v", "error", "-y", "-i", source, *(["-vf", ",".join(filters)] if filters else []), "-codec:v", codec or about["codec"]]
        for flag, at in (("-ss", start), ("-t", end)):
            cmd += [flag, str(at)] if at is not None else []
        subprocess.run([*cmd, target], check=True, capture_output=True)
        return target if os.path.isfile(target) else None

    return run


def transform_videos(videos: DataFrame, transforms: dict[str, Callable[[str, str], str | None]], storage: str, errors: str = "raise") -> DataFrame:
    """``(guid, transform_name, input_filepath, category, filepath, error)``.

    ``videos`` is (filepath, category). ``noop`` must be among the transforms and runs first; the
    others work on its output. A transform that fails raises, or is a row with
    ``error`` and without ``filepath`` under ``"warn"`` and ``"ignore"``; when ``noop`` fails, the others
    of the file are such rows too. ``storage`` is a folder that all machines share.
    """
    import pyarrow as pa

    if "noop" not in transforms:
        raise ValueError("a transform named noop is needed")
    names = ["guid", "transform_name", "input_filepath", "category", "filepath", "error"]

    def run(batches):
        for b in batches:
            rows = []
            for path, category in zip(b.column("filepath").to_pylist(), b.column("category").to_pylist()):
                guid = hashlib.md5((path or "").encode(), usedforsecurity=False).hexdigest()
                base, why = path, None
                for k in ["noop", *[k for k in transforms if k != "noop"]]:
                    got, problem = None, why
                    if why is None:
                        try:
                            got = transforms[k](base, os.path.join(storage, f"{guid}_{k}"))
                            problem = None if got else "nothing was written"
                        except Exception as e:  # noqa: BLE001  reported in a row, or raised below
                            problem = str(e)
                        if problem and errors == "raise":
                            raise ValueError(f"{k} of {path}: {problem}")
                    if k == "noop":
                        base, why = got, problem
                    if problem and errors == "warn":
                        warnings.warn(f"{k} of {path}: {problem}", stacklevel=2)
                    rows.append((guid, k, path, category, got, problem))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 6, names=names)

    return videos.select("filepath", F.col("category").cast("string").alias("category")).mapInArrow(run, ", ".join(f"{n} string" for n in names))


def with_pict_type(frames: DataFrame, every: int) -> DataFrame:
    """Mark each ``every``-th frame as an I-frame, for sources that do not say."""
    return frames.withColumn("pict_type", F.when(F.col("frame_index") % every == 0, "I").otherwise("P"))
