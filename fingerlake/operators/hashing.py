"""Hash jobs over images: one pass in Arrow batches, errors as data."""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerlake.functions.codecs import encode
from fingerlake.functions.images import ImageHash, isometric, watermark
from fingerlake.operators.similarity import threshold_pairs, union_pairs
from fingerlake.plans.lineage import materialize

RECORD = "filepath string, hash string, quality int, variant string, error string, hasher_name string, hasher_dtype string, hasher_distance_metric string, hasher_hash_length int"


def from_spark_image(row: dict) -> np.ndarray:
    """RGB array of the image source's struct, whose bytes are BGR."""
    if row is None or row["height"] is None or row["height"] < 0:
        raise ValueError("the image cannot be decoded")
    a = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    if row["nChannels"] == 1:
        return np.repeat(a, 3, 2)
    return np.ascontiguousarray(a[..., 2::-1])


def to_image(value) -> np.ndarray:
    """A contiguous RGB uint8 array, or an error."""
    if not isinstance(value, np.ndarray) or value.ndim != 3 or value.shape[2] != 3 or value.dtype != np.uint8:
        raise ValueError("an RGB image of uint8 is needed")
    if not value.flags["C_CONTIGUOUS"]:
        raise ValueError("the image must be contiguous")
    return value


def decode_png(data: bytes) -> np.ndarray:
    """RGB(A) or gray 8-bit PNG without interlacing, in numpy."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, raw, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            raw += body
    if head is None or head[8] != 8 or head[9] not in (0, 2, 6) or head[12]:
        raise ValueError("this kind of PNG is not supported")
    w, h, c = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), {0: 1, 2: 3, 6: 4}[head[9]]
    try:
        lines = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + w * c)
    except (zlib.error, ValueError) as e:
        raise ValueError("the PNG data are broken") from e
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.uint8)
    for y in range(h):
        f, cur = lines[y, 0], lines[y, 1:].copy()
        if f == 2:
            cur += above
        elif f in (1, 3, 4):
            for i in range(w * c):
                a = int(cur[i - c]) if i >= c else 0
                b = int(above[i])
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + b) // 2
                else:
                    d = int(above[i - c]) if i >= c else 0
                    e = a + b - d
                    p = a if abs(e - a) <= abs(e - b) and abs(e - a) <= abs(e - d) else b if abs(e - b) <= abs(e - d) else d
                cur[i] = (int(cur[i]) + p) & 255
        out[y] = above = cur
    return out.reshape(h, w, c)


def encode_png(image: np.ndarray) -> bytes:
    """A gray, RGB or RGBA image as PNG bytes."""
    h, w = image.shape[:2]
    c = 1 if image.ndim == 2 else image.shape[2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * c)], 1).tobytes()
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def hash_images(images: DataFrame, hashers: Iterable[ImageHash], form: str = "base64", variants: bool = False, keep: Iterable[str] = ()) -> DataFrame:
    """One row for each image, hasher and variant; a failure is a row with ``error``.

    ``images`` is ``(filepath, image)`` with the image source's struct. Each image
    is decoded once for all hashers. A featureless image has a null hash. ``keep``
    names further columns, such as category, guid and transform_name, that each
    row carries on.
    """
    keep = list(keep)
    hashers = list(hashers)
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]

    def run(batches):
        for b in batches:
            out, at = [], []
            for n, (path, struct) in enumerate(zip(b.column("filepath").to_pylist(), b.column("image").to_pylist())):
                for h in hashers:
                    about = (h.name, h.dtype, h.metric, h.length)
                    try:
                        image = from_spark_image(struct)
                        _, q = h.compute_with_quality(image)
                        got = h.compute_isometric(image) if variants else {"r0": h.compute(image)}
                        for k, v in got.items():
                            vs = v if h.multiple and v is not None else [v]
                            out += [(path, encode(x, h.dtype, form), q, k, None, *about) for x in vs]
                    except Exception as e:  # noqa: BLE001  an unreadable file is a row, not a failed job
                        out.append((path, None, None, None, str(e), *about))
                at += [n] * (len(out) - len(at))
            own = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*own, *[b.column(c).take(pa.array(at, pa.int64())) for c in keep]], names=[*names, *keep])

    more = "".join(f", `{c}` {images.schema[c].dataType.simpleString()}" for c in keep)
    return images.select("filepath", "image", *keep).mapInArrow(run, RECORD + more)


def deduplicate_files(images: DataFrame, hashers: Iterable[tuple[ImageHash, float]], variants: bool = False, warn: bool = False) -> DataFrame:
    """``(path1, path2)`` of files that some hasher holds for the same.

    For each hasher with its threshold the hashes (of all eight variants, if asked
    for) are joined on distance; pairs are united over the hashers. Paths given
    twice count once (with ``warn`` they are counted and named in a warning), files
    with an error are left out.
    """
    from fingerlake.functions.codecs import string_to_vector

    files = images.dropDuplicates(["filepath"])
    if warn and (n := images.count() - files.count()):
        warnings.warn(f"{n} paths are given more than once", stacklevel=2)
    ids = files.select("filepath", F.xxhash64("filepath").alias("id"))
    parts = []
    for h, t in hashers:
        got = hash_images(files, [h], variants=variants).where("hash is not null")
        vec = string_to_vector(h.dtype, h.length)(F.col("hash"))
        v = got.select(F.xxhash64("filepath").alias("id"), vec.cast("array<tinyint>" if h.dtype == "bool" else "array<double>").alias("vec"))
        v = materialize(v, "hashes")  # images are hashed once, though counted and compared
        parts.append(threshold_pairs(v, t, h.metric, length=h.length).select("id1", "id2"))
    pairs = union_pairs(*parts)
    a, b = ids.select(F.col("filepath").alias("p1"), F.col("id").alias("id1")), ids.select(F.col("filepath").alias("p2"), F.col("id").alias("id2"))
    return pairs.join(a, "id1").join(b, "id2").select(F.least("p1", "p2").alias("path1"), F.greatest("p1", "p2").alias("path2"))


def transform_images(images: DataFrame, transforms: dict[str, Callable[[np.ndarray], np.ndarray]], errors: str = "raise") -> DataFrame:
    """``(guid, transform_name, input_filepath, category, filepath, image)``.

    ``images`` is (filepath, category, image). ``noop`` must be among the
    transforms and runs first; the others work on its output. The guid is the same
    for all transforms of a file. Unreadable files raise, or are left out with
    ``errors="warn"``.
    """
    if "noop" not in transforms:
        raise ValueError("a transform named noop is needed")
    schema = "guid string, transform_name string, input_filepath string, category string, filepath string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"

    def run(batches):
        for b in batches:
            rows = []
            for path, cat, struct in zip(b.column("filepath").to_pylist(), b.column("category").to_pylist(), b.column("image").to_pylist()):
                try:
                    base = transforms["noop"](from_spark_image(struct))
                except ValueError:
                    if errors == "raise":
                        raise
                    continue
                guid = f"{zlib.crc32((path or '').encode()):08x}{zlib.adler32((path or '').encode()):08x}"
                for k, f in transforms.items():
                    x = base if k == "noop" else f(base)
                    rows.append((guid, k, path, cat, f"{guid}/{k}.png", {"origin": path, "height": x.shape[0], "width": x.shape[1], "nChannels": 3, "mode": 16, "data": x[..., ::-1].tobytes()}))
            s = pa.schema([*[(c, pa.string()) for c in ("guid", "transform_name", "input_filepath", "category", "filepath")], ("image", pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())]))])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], s[i].type) for i in range(6)], schema=s)

    return images.select("filepath", F.col("category").cast("string").alias("category"), "image").mapInArrow(run, schema)


def watermark_transform(mark: np.ndarray, alpha: float = 1.0, size: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    return lambda image: watermark(image, mark, alpha, size)


def parallel_equals_sequential(images: DataFrame, hasher: ImageHash) -> bool:
    """Conformance: hashes do not depend on how the images are partitioned."""
    one = {tuple(r) for r in hash_images(images.coalesce(1), [hasher]).collect()}
    many = {tuple(r) for r in hash_images(images.repartition(4), [hasher]).collect()}
    return one == many


def variants_agree(image: np.ndarray, hasher: ImageHash) -> dict[str, float]:
    """Conformance: share of equal elements between both ways to hash variants."""
    direct = {k: hasher.compute(v) for k, v in isometric(image).items()}
    return {k: float(np.mean(v == direct[k])) for k, v in hasher.compute_isometric(image).items()}


def low_detail_image(n: int = 100) -> np.ndarray:
    """A black image with a faint ramp in one corner: little for a hash to hold on to."""
    ramp = np.minimum(np.arange(n), np.arange(n)[::-1]).astype(float)
    x = np.outer(ramp, ramp)
    x = (x * 255 / x.max()).astype(np.uint8)
    x[n // 2 :] = x[:, n // 2 :] = 0
    return np.repeat(x[..., None], 3, 2)


def hasher_integrity(spark: SparkSession, hasher: ImageHash, images: list[np.ndarray], near: float, variant_limit: float) -> None:
    """Conformance of a third-party hasher; what it breaks is an AssertionError.

    An image is at distance 0 from itself, also as a copy in other memory, and farther than
    ``near`` from the next one; hashes have the length and type that they promise and
    survive both text forms; the variants of each image agree with the hashes of the
    turned images up to ``variant_limit``; a plain image and one of low detail give
    a hash or None; and a distributed job gives the hashes of a local one.
    """
    from fingerlake.functions.codecs import decode, string_length
    from fingerlake.functions.distance import between

    if len(images) < 2:
        raise ValueError("at least two images are needed")
    vectors = [hasher.compute(x) for x in images]
    first = vectors[0]
    assert between(hasher.metric, first, hasher.compute(np.array(images[0], copy=True))) == 0, "an image is not at distance 0 from itself"
    assert between(hasher.metric, first, vectors[1]) > near, "two images are too near to each other"
    for v in vectors:
        assert v.shape == (hasher.length,), f"the hash has the shape {v.shape}, not {hasher.length}"
        assert v.dtype == np.dtype(hasher.dtype), f"the hash is of {v.dtype}, not {hasher.dtype}"
        for form in ("base64", "hex"):
            text = encode(v, hasher.dtype, form)
            assert len(text) == string_length(hasher.length, hasher.dtype, form), f"the {form} text has a wrong length"
            assert (decode(text, hasher.dtype, hasher.length, form) == v).all(), f"the hash does not survive {form}"
    for x in images:
        got = hasher.compute_isometric(x)
        for k, turned in isometric(x).items():
            assert between(hasher.metric, got[k], hasher.compute(turned)) <= variant_limit, f"variant {k} is off"
    for plain in (np.zeros_like(images[0]), low_detail_image()):
        v, q = hasher.compute_with_quality(plain)
        assert v is None or v.shape == (hasher.length,), "a plain image breaks the hash"
        assert 0 <= q <= 100, "the quality is not within 0 and 100"
    struct = lambda x: (None, *x.shape[:2], 3, 16, bytearray(x[..., ::-1].tobytes()))
    df = spark.createDataFrame([(str(i), struct(x)) for i, x in enumerate(images)], "filepath string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = {r.filepath: r.hash for r in hash_images(df.repartition(3), [hasher]).collect()}
    assert got == {str(i): encode(v, hasher.dtype) for i, v in enumerate(vectors)}, "a distributed job gives other hashes"
