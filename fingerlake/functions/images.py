"""Image hashes in numpy. Images are RGB arrays, height x width x 3, uint8."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

RGB = np.array([0.299, 0.587, 0.114])
BGR = RGB[::-1]


def gray(image: np.ndarray, weights: np.ndarray = RGB) -> np.ndarray:
    """Luma in 0..255, rounded; gray images pass."""
    if image.ndim == 2:
        return image
    return np.clip(np.rint(image[..., :3].astype(np.float64) @ weights), 0, 255).astype(np.uint8)


@lru_cache(maxsize=256)
def _area(n: int, m: int) -> np.ndarray:
    """m x n matrix of each source pixel's share in each target pixel."""
    step = n / m
    out = np.zeros((m, n))
    for i in range(m):
        lo, hi = i * step, (i + 1) * step
        for k in range(int(lo), min(n, math.ceil(hi))):
            out[i, k] = max(0.0, min(hi, k + 1) - max(lo, k))
    return out / out.sum(1, keepdims=True)


@lru_cache(maxsize=256)
def _linear(n: int, m: int) -> np.ndarray:
    out = np.zeros((m, n))
    for i in range(m):
        at = min(max((i + 0.5) * n / m - 0.5, 0), n - 1)
        k = min(int(at), n - 1)
        out[i, k] += 1 - (at - k)
        out[i, min(k + 1, n - 1)] += at - k
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages when shrinking, linear when growing; uint8 stays uint8."""
    h, w = image.shape[:2]
    a = (_area if height <= h else _linear)(h, height)
    b = (_area if width <= w else _linear)(w, width)
    x = image.astype(np.float64)
    # Halves are halves, whatever the products leave behind.
    out = np.round(np.einsum("ij,jk...,lk->il...", a, x, b, optimize=True), 9)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else out


def box_filter(image: np.ndarray, k: int) -> np.ndarray:
    """Mean over k x k with mirrored borders (the edge pixel not repeated)."""
    lo = k // 2
    p = np.pad(image.astype(np.float64), ((lo, k - 1 - lo), (lo, k - 1 - lo)), mode="reflect")
    s = np.cumsum(np.cumsum(np.pad(p, ((1, 0), (1, 0))), 0), 1)
    out = (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)
    return np.rint(out).astype(np.uint8) if image.dtype == np.uint8 else out


@lru_cache(maxsize=64)
def _dct(n: int) -> np.ndarray:
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    return 2 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def quality(image: np.ndarray) -> int:
    """0..100 by the sum of gradients of the 64 x 64 gray image."""
    g = resize(gray(image), 64, 64).astype(np.float64)
    dx, dy = np.abs(np.diff(g, axis=1)), np.abs(np.diff(g, axis=0))
    total = np.floor(dx * 100 / 255).sum() + np.floor(dy * 100 / 255).sum()
    return int(min(100, max(0, int(total / 90))))


DIHEDRAL = ("r0", "fv", "fh", "r180", "r90", "r90fv", "r90fh", "r270")


def isometric(image: np.ndarray) -> dict[str, np.ndarray]:
    """The eight rotations and reflections; fv flips rows, fh columns."""
    r90 = np.rot90(image)
    out = (image, image[::-1], image[:, ::-1], image[::-1, ::-1], r90, r90[::-1], r90[:, ::-1], np.rot90(image, 3))
    return {k: np.ascontiguousarray(v) for k, v in zip(DIHEDRAL, out)}


def isometric_dct(dct: np.ndarray, offset: int = 0) -> dict[str, np.ndarray]:
    """The same variants of an image's DCT block, which starts at ``offset``.

    Mirroring an axis negates that axis's odd frequencies; a quarter turn also
    transposes.
    """
    if offset < 0:
        raise ValueError("the frequency offset must not be negative")
    rows = (-1.0) ** (np.arange(dct.shape[0]) + offset)[:, None]
    cols = (-1.0) ** (np.arange(dct.shape[1]) + offset)[None, :]
    t = dct.T
    tr, tc = cols.T, rows.T
    return {"r0": dct, "fv": dct * rows, "fh": dct * cols, "r180": dct * rows * cols, "r90": t * tr, "r90fv": t, "r90fh": t * tr * tc, "r270": t * tc}


class ImageHash:
    """Base: ``compute(image)`` -> vector or None."""

    name = "hash"
    dtype = "bool"
    metric = "hamming"
    length = 0
    multiple = False

    def compute(self, image: np.ndarray) -> np.ndarray | None:
        raise NotImplementedError

    def compute_isometric(self, image: np.ndarray) -> dict[str, np.ndarray | None]:
        return {k: self.compute(v) for k, v in isometric(image).items()}

    def compute_isometric_from_hash(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        raise NotImplementedError(f"{self.name} cannot turn a hash")

    def compute_with_quality(self, image: np.ndarray) -> tuple[np.ndarray | None, int]:
        return self.compute(image), quality(image)


class AverageHash(ImageHash):
    name = "ahash"

    def __init__(self, size: int = 8):
        self.size, self.length = size, size * size

    def compute(self, image):
        # The channels are weighed in reverse, as stored hashes expect.
        g = resize(gray(image, BGR), self.size, self.size)
        return (g > g.mean()).ravel()

    def compute_isometric_from_hash(self, vector):
        return {k: v.ravel() for k, v in isometric(np.asarray(vector).reshape(self.size, self.size)).items()}

    def compute_isometric(self, image):
        return self.compute_isometric_from_hash(self.compute(image))


def falling(g: np.ndarray) -> np.ndarray:
    """1 where a pixel is brighter than its right neighbour, row by row."""
    g = g.astype(int)
    return (g[:, :-1] > g[:, 1:]).ravel()


class DHash(ImageHash):
    name = "dhash"

    def __init__(self, size: int = 8):
        self.size, self.length = size, size * size

    def compute(self, image):
        return falling(gray(resize(image, self.size, self.size + 1)))


class PHash(ImageHash):
    name = "phash"

    def __init__(self, size: int = 8, factor: int = 4, exclude_first: bool = False, shift: int = 0, smooth: bool = False):
        if size < 2:
            raise ValueError("the hash size must be at least 2")
        if shift < 0:
            raise ValueError("the frequency shift must not be negative")
        if shift + size > size * factor:
            raise ValueError("the frequency shift leaves too few frequencies")
        self.size, self.factor, self.exclude_first, self.shift, self.smooth = size, factor, exclude_first, shift, smooth
        self.length = size * size - bool(exclude_first)

    def dct(self, image: np.ndarray) -> np.ndarray:
        g = gray(image)
        n = self.size * self.factor
        if self.smooth:
            g = box_filter(g, round(n * 7 / 32))
        x = resize(g, n, n).astype(np.float64)
        d = _dct(n)
        out = (d @ x @ d.T)[self.shift : self.shift + self.size, self.shift : self.shift + self.size]
        # Exact zeros matter for the median; products leave dust behind.
        return np.round(out, 6)

    def finish(self, dct: np.ndarray) -> np.ndarray | None:
        v = dct.ravel()[int(self.exclude_first) :]
        return v >= np.median(v)

    def compute(self, image):
        return self.finish(self.dct(image))

    def compute_isometric(self, image):
        return {k: self.finish(v) for k, v in isometric_dct(self.dct(image), self.shift).items()}


class PHashF(PHash):
    name, dtype, metric = "phashf", "float32", "euclidean"

    def finish(self, dct):
        v = dct.ravel()[int(self.exclude_first) :]
        return None if not v.any() else v.astype(np.float32)


class PHashU8(PHash):
    name, dtype, metric = "phashu8", "uint8", "euclidean"

    def finish(self, dct):
        v = dct.ravel()[int(self.exclude_first) :]
        if not v.any():
            return None
        span = v.max() - v.min()
        return (255 * ((v - v.min()) / span)).astype(np.uint8) if span else np.zeros(len(v), np.uint8)


class WaveletHash(ImageHash):
    name = "wavelet"

    def __init__(self, size: int = 8, scale: int | None = None, mode: str = "haar"):
        if size < 1 or size & (size - 1):
            raise ValueError("the hash size must be a power of two")
        if scale is not None and (scale & (scale - 1) or scale < size):
            raise ValueError("the scale must be a power of two, at least the hash size")
        if mode != "haar":
            raise NotImplementedError("other wavelets than haar need a wavelet library")
        self.size, self.scale, self.length = size, scale, size * size

    def compute(self, image):
        h, w = image.shape[:2]
        scale = self.scale or max(1 << int(math.log2(min(h, w))), self.size)
        x = resize(gray(image, BGR), scale, scale) / 255.0
        # Removing the coarsest term subtracts the mean; a low band is block sums.
        x = x - x.mean()
        k = scale // self.size
        low = np.round(x.reshape(self.size, k, self.size, k).sum((1, 3)) / k, 9)
        return (low > np.median(low)).ravel()


def _pdq_dct() -> np.ndarray:
    k, i = np.meshgrid(np.arange(1, 17), np.arange(64), indexing="ij")
    return np.sqrt(2 / 64) * np.cos(np.pi / 128 * k * (2 * i + 1))


class PDQHashF(ImageHash):
    """The published PDQ algorithm's 16 x 16 DCT, before thresholding."""

    name, dtype, metric, length = "pdqf", "float32", "euclidean", 256

    def _block(self, image: np.ndarray) -> np.ndarray:
        g = (image[..., :3].astype(np.float64) @ RGB) if image.ndim == 3 else image.astype(np.float64)
        if max(g.shape) > 512:
            s = 512 / max(g.shape)
            g = resize(g, max(1, round(g.shape[0] * s)), max(1, round(g.shape[1] * s)))
        for _ in range(2):  # two box passes approximate a tent
            for axis in (0, 1):
                k = max(1, (g.shape[axis] + 127) // 128)
                lo = k // 2
                s = np.cumsum(np.insert(g, 0, 0, axis=axis), axis=axis)
                i = np.arange(g.shape[axis])
                a, b = np.clip(i - lo, 0, None), np.clip(i + k - lo, None, g.shape[axis])
                n = (b - a).reshape((-1, 1) if axis == 0 else (1, -1))
                g = (np.take(s, b, axis) - np.take(s, a, axis)) / n
        r = ((np.arange(64) + 0.5) * g.shape[0] / 64).astype(int)
        c = ((np.arange(64) + 0.5) * g.shape[1] / 64).astype(int)
        return g[np.ix_(r, c)]

    def coefficients(self, image: np.ndarray) -> np.ndarray:
        d = _pdq_dct()
        return d @ self._block(image) @ d.T

    def compute(self, image):
        return self.coefficients(image).ravel().astype(np.float32)

    def compute_with_quality(self, image):
        b = self._block(image)
        total = np.trunc(np.diff(b, axis=0) * 100 / 255).__abs__().sum() + np.trunc(np.diff(b, axis=1) * 100 / 255).__abs__().sum()
        return self.compute(image), int(min(100, total / 90))


class PDQHash(PDQHashF):
    name, dtype, metric = "pdq", "bool", "hamming"

    def compute(self, image):
        v = np.round(self.coefficients(image), 6).ravel()
        return v > np.median(v)

    def compute_isometric(self, image):
        out = {k: np.round(v, 6).ravel() for k, v in isometric_dct(self.coefficients(image), 1).items()}
        return {k: v > np.median(v) for k, v in out.items()}


class LibraryHash(ImageHash):
    """A hash that needs OpenCV's contributed image-hash module."""

    maker = ""

    def __init__(self):
        try:
            import cv2

            self._engine = getattr(cv2.img_hash, self.maker)
        except (ImportError, AttributeError) as e:
            raise RuntimeError(f"{self.name} needs OpenCV with its contributed modules") from e

    def compute(self, image):
        raw = self._engine(image[..., ::-1])
        return np.unpackbits(raw.ravel()).astype(bool) if self.dtype == "bool" else (raw.ravel() * 10000).astype(np.float32)


class MarrHildreth(LibraryHash):
    name, maker, length = "marrhildreth", "marrHildrethHash", 576


class BlockMean(LibraryHash):
    name, maker, length = "blockmean", "blockMeanHash", 968

    def compute(self, image):
        import cv2

        return np.unpackbits(cv2.img_hash.blockMeanHash(image[..., ::-1], mode=1).ravel()).astype(bool)


class ColorMoment(LibraryHash):
    name, maker, length, dtype, metric = "colormoment", "colorMomentHash", 42, "float32", "euclidean"


def unletterbox(image: np.ndarray, only_black: bool = False, min_fraction: float = 0.1, color_threshold: float = 2, min_side: int = 50, min_reduction: float = 0.02) -> tuple[int, int, int, int] | None:
    """(x1, x2, y1, y2) inside a plain border; None if what is left is too small.

    Works on gray values. The background is the commonest of the corners' (black if
    asked for); four different corners have none, and nothing is cropped. A row
    or column counts once more than ``min_fraction`` of its pixels differ from the
    background by more than ``color_threshold``; an image without such rows or columns has
    no content. Bounds that save no more than ``min_reduction`` of either side are the full ones.
    """
    if not 0 <= min_fraction <= 1 or not 0 <= min_reduction <= 1:
        raise ValueError("fractions lie between 0 and 1")
    g = gray(image.astype(np.uint8)).astype(np.int16)
    h, w = g.shape
    full = (0, w, 0, h)
    back = 0
    if not only_black:
        corners = [int(g[y, x]) for y, x in ((0, 0), (0, -1), (-1, 0), (-1, -1))]
        if len(set(corners)) == 4:
            return full
        back = max(corners, key=corners.count)
    content = np.abs(g - back) > color_threshold
    if content.all():
        return full
    rows, cols = np.flatnonzero(content.sum(1) > min_fraction * w), np.flatnonzero(content.sum(0) > min_fraction * h)
    if not len(rows) or not len(cols):
        return None
    y1, y2, x1, x2 = int(rows[0]), int(rows[-1]) + 1, int(cols[0]), int(cols[-1]) + 1
    if x2 - x1 >= w * (1 - min_reduction) and y2 - y1 >= h * (1 - min_reduction):
        return full
    if x2 - x1 < min_side or y2 - y1 < min_side:
        return None
    return (x1, x2, y1, y2)


def unletterbox_crop(image: np.ndarray, **options) -> np.ndarray | None:
    """The image inside its border, as a copy; None where there is none."""
    if not isinstance(image, np.ndarray):
        raise TypeError("an image array is needed")
    b = unletterbox(image, **options)
    return None if b is None else image[b[2] : b[3], b[0] : b[1]].copy()


def watermark(image: np.ndarray, mark: np.ndarray, alpha: float = 1.0, size: float = 1.0) -> np.ndarray:
    """``mark`` (RGBA) over the lower right corner, at ``size`` of the image."""
    h, w = image.shape[:2]
    s = size * min(h / mark.shape[0], w / mark.shape[1])
    mh, mw = max(1, int(mark.shape[0] * s)), max(1, int(mark.shape[1] * s))
    m = resize(mark, mh, mw).astype(np.float64)
    a = m[..., 3:4] / 255 * alpha
    out = image.copy()
    at = out[h - mh :, w - mw :]
    at[...] = np.rint(at * (1 - a) + m[..., :3] * a).astype(np.uint8)
    return out
