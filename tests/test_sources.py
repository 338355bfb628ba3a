import numpy as np
import pandas as pd
import pytest

from fingerlake import registry
from fingerlake.sources import frames, lookup
from fingerlake.streaming.framewise import framewise_stream, mean_stream


def test_select_by_ids():
    assert lookup.select_by_ids("t", [1, 2], "qmark", ["id", "hash"]) == ("SELECT id, hash FROM t WHERE id IN (?, ?)", [1, 2])
    assert lookup.select_by_ids("t", [1])[1] == {"ids": (1,)}
    with pytest.raises(NotImplementedError):
        lookup.select_by_ids("t", [1], "named")


def test_requests(spark):
    df = spark.createDataFrame([(1, "0aff"), (2, "0a"), (None, "0aff"), (3, None)], "id long, hash string")
    good, bad = lookup.split_requests(df, 2, "uint8", "hex")
    assert [r.id for r in good.collect()] == [1] and bad.count() == 3
    h = spark.createDataFrame([("a", "m", "h", 91), ("b", None, "h", 90), ("c", None, "h", 99)], "filepath string, md5 string, hash string, quality int")
    body = "".join(r.body for r in lookup.match_requests(h).collect())
    assert '"id":"a"' in body and '"id":"c"' in body and '"id":"b"' not in body
    with pytest.raises(ValueError):
        lookup.post_matches(h, "http://example.com", "t")


def test_import_optional():
    assert lookup.import_optional("json").dumps([]) == "[]"
    with pytest.raises(ImportError, match="extra"):
        lookup.import_optional("no_such_package", "x")


def test_video_source(spark, tmp_path):
    from fingerlake.functions.images import PHashF

    rng = np.random.default_rng(0)
    for v in range(2):
        np.save(tmp_path / f"v{v}.npy", rng.integers(0, 255, (4, 40, 50, 3)).astype(np.uint8))
    f = frames.read_videos(spark, str(tmp_path), 2.0)
    assert f.count() == 8 and f.agg({"ts": "max"}).first()[0] == 1.5
    h = frames.hash_frames(f, PHashF())
    assert h.where("size(vec) = 64").count() == 8
    assert frames.keyframes(frames.with_pict_type(f, 2)).count() == 4
    assert frames.parse_properties('{"streams": [{"width": 2, "height": 3, "avg_frame_rate": "0/0"}]}')["fps"] is None


def test_framewise_stream(spark, tmp_path):
    pd.DataFrame({"video_id": [1, 1, 1, 2], "frame_index": [0, 1, 2, 0], "vec": [[0.0], [1.0], [9.0], [5.0]]}).to_parquet(tmp_path / "a.parquet")
    s = spark.readStream.schema("video_id long, frame_index long, vec array<double>").parquet(str(tmp_path))
    q = framewise_stream(s, 4.0).writeStream.format("memory").queryName("kept").outputMode("append").start()
    try:
        q.processAllAvailable()
        pd.DataFrame({"video_id": [1, 2], "frame_index": [3, 1], "vec": [[0.5], [0.0]]}).to_parquet(tmp_path / "b.parquet")
        q.processAllAvailable()
        got = {(r.video_id, r.frame_index) for r in spark.table("kept").collect()}
    finally:
        q.stop()
    assert got == {(1, 0), (1, 2), (2, 0), (2, 1)}


def test_mean_stream(spark, tmp_path):
    pd.DataFrame({"video_id": [1, 1], "ts": pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:02"]).astype("datetime64[us]"), "vec": [[1.0, 2.0], [3.0, 4.0]]}).to_parquet(tmp_path / "a.parquet")
    s = spark.readStream.schema("video_id long, ts timestamp, vec array<double>").parquet(str(tmp_path))
    q = mean_stream(s).writeStream.format("memory").queryName("means").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {r.i: r["mean"] for r in spark.table("means").collect()}
    finally:
        q.stop()
    assert got == {0: 2.0, 1: 3.0}


def test_stream_of_a_folder_runs_to_its_end_without_the_driver(spark, tmp_path):
    day = pd.to_datetime("2024-01-01")
    for f in range(3):
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        n = np.arange(2000) + 2000 * f
        pd.DataFrame({"event_id": n, "ts": (day + pd.to_timedelta(n % 7, "h")).astype("datetime64[us]"), "user_id": n % 500, "event_type": "view", "value": n / 8, "props": ""}).to_parquet(tmp_path / "events.parquet" / f"{f}.parquet")
    n = np.arange(6000)
    want = pd.DataFrame({"video_id": n % 500, "start": 1704067200 + 3600 * (n % 7), "mean": n / 8}).groupby(["video_id", "start"])["mean"].mean().round(6)
    before = {t.name for t in spark.catalog.listTables()}
    rows = registry.stream_window_mean(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.video_id, r.start): r["mean"] for r in rows} == want.to_dict()
    assert {t.name for t in spark.catalog.listTables()} == before  # no table in the driver's memory


FAKE = """#!{python}
import json, sys
import numpy as np
a = sys.argv[1:]
src = a[a.index("-i") + 1] if "-i" in a else a[-1]
try:
    n, h, w = map(int, open(src).read().split())
except ValueError:
    sys.stderr.write("invalid data\\n")
    sys.exit(1)
if "frame=pict_type" in a:
    print(json.dumps({{"frames": [{{"pict_type": "I" if i % 4 == 0 else "P"}} for i in range(n)]}}))
elif "-show_entries" in a:
    print(json.dumps({{"streams": [{{"width": w, "height": h, "avg_frame_rate": "10/1", "codec_name": "x9", "duration": str(n / 10)}}]}}))
elif a[-1] == "-":
    w, h = map(int, a[a.index("-s") + 1].split("x"))
    for i in range(n):
        sys.stdout.buffer.write(np.full((h, w, 3), i, np.uint8).tobytes())
else:
    open(a[-1], "w").write(f"{{n}} {{h}} {{w}}")
    open(a[-1] + ".args", "w").write(" ".join(a))
"""


@pytest.fixture
def ffmpeg(tmp_path, monkeypatch):
    """A stand-in whose videos are text files: frames, height, width."""
    import sys

    tool = tmp_path / "bin" / "ffmpeg"
    tool.parent.mkdir()
    tool.write_text(FAKE.format(python=sys.executable))
    tool.chmod(0o755)
    monkeypatch.setenv("FINGERLAKE_FFMPEG", str(tool))
    monkeypatch.setenv("FINGERLAKE_FFPROBE", str(tool))
    return tool


def test_ffmpeg_frames(ffmpeg, tmp_path):
    v = tmp_path / "a.mp4"
    v.write_text("30 40 80")
    got = list(frames.ffmpeg_frames(str(v)))
    assert len(got) == 30 and got[3][0] == 3 and got[3][1] == pytest.approx(0.3) and got[3][2].shape == (40, 80, 3) and (got[3][2] == 3).all()
    assert [i for i, _, _ in frames.ffmpeg_frames(str(v), wanted=4.0)] == [0, 2, 5, 7, 10, 12, 15, 17, 20, 22, 25, 27]
    assert [i for i, _, _ in frames.ffmpeg_frames(str(v), wanted="keyframes")] == list(range(0, 30, 4))
    assert [i for i, _, _ in frames.ffmpeg_frames(str(v), max_duration=0.5)] == list(range(7))
    assert next(frames.ffmpeg_frames(str(v), max_size=20))[2].shape == (10, 20, 3)
    assert frames.scaled(100, 50, None) == (100, 50) and frames.scaled(100, 50, 200) == (100, 50)


def test_video_reader_kinds_and_errors(spark, ffmpeg, tmp_path, monkeypatch):
    folder = tmp_path / "videos"
    folder.mkdir()
    np.save(folder / "n.npy", np.zeros((6, 8, 8, 3), np.uint8))
    (folder / "notes.txt").write_text("no video")
    # Workers started earlier lack the stand-in, so ffmpeg is missing there: the file gives no frame.
    (folder / "bad.mp4").write_text("broken")
    f = frames.read_videos(spark, str(folder), 2.0, wanted=1.0, errors="ignore")
    assert sorted((r.video_id, r.frame_index, r.ts) for r in f.collect()) == [("n", 0, 0.0), ("n", 2, 1.0), ("n", 4, 2.0)]
    with pytest.raises(Exception, match="bad.mp4|ffmpeg|ffprobe|installed|exit status"):
        frames.read_videos(spark, str(folder), 2.0).collect()
    with pytest.raises(Exception, match="engine"):
        frames.read_videos(spark, str(folder), engine="other").collect()
    broken = spark.createDataFrame([("v", 0, 0.0, 8, 8, 3, None), ("v", 1, 0.5, 8, 8, 3, bytearray(192))], frames.SCHEMA)
    from fingerlake.functions.images import AverageHash

    got = {r.frame_index: r for r in frames.hash_frames(broken, AverageHash()).collect()}
    assert got[0].error and got[0].vec is None and got[1].error is None and len(got[1].vec) == 64


def test_video_transforms(spark, ffmpeg, tmp_path):
    v = tmp_path / "a.mp4"
    v.write_text("30 40 80")
    t = frames.simple_transform(width=160, pad="iw:ih+2", fps=5, sar="1/1", clip_pct=(0.5, None), clip_s=(None, 1.5))
    out = t(str(v), str(tmp_path / "out"))
    assert out.endswith("out.mp4")
    args = (tmp_path / "out.mp4.args").read_text()
    assert "-vf scale=160:-1,pad=iw:ih+2,fps=5,setsar=1/1 -codec:v x9 -ss 1.5 -t 1.5" in args
    assert frames.simple_transform(codec="y", output_ext=".gif")(str(v), str(tmp_path / "o.GIF")).endswith("o.GIF")
    for bad in ({"clip_pct": (0.5, 0.2)}, {"clip_pct": (-1, 0.5)}):
        with pytest.raises(ValueError):
            frames.simple_transform(**bad)

    def copy(a, b):
        return a if a.endswith("good") else None

    def upper(a, b):
        if a.endswith("good"):
            return a.upper()
        raise AssertionError("works on what noop gave only")

    df = spark.createDataFrame([("x/good", "c"), ("x/bad", None)], "filepath string, category string")
    got = {(r.input_filepath, r.transform_name): r for r in frames.transform_videos(df, {"up": upper, "noop": copy}, str(tmp_path), errors="ignore").collect()}
    assert len(got) == 4 and got["x/good", "up"].filepath == "X/GOOD" and got["x/good", "noop"].guid == got["x/good", "up"].guid
    assert got["x/bad", "noop"].error and got["x/bad", "up"].error and got["x/bad", "up"].filepath is None
    with pytest.raises(ValueError):
        frames.transform_videos(df, {"up": upper}, str(tmp_path))
    with pytest.raises(Exception, match="noop of x/bad"):
        frames.transform_videos(df, {"noop": copy}, str(tmp_path)).collect()
