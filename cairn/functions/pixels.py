"""Image functions in NumPy over decoded pixels (height, width, 3; red first), and their Arrow batch forms.

Spark's ``image`` source decodes the files in the JVM; what built-in functions
can't express runs here, an image at a time within Arrow batches. Writing JPEG
or WebP needs a codec that isn't assumed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decoded(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Pixels of a row of the ``image`` source, which stores blue first; grey images get three equal channels."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma by ITU-R 601-2 in 16-bit fixed point."""
    r, g, b = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _cubic(x: np.ndarray) -> np.ndarray:
    x, a = np.abs(x), -0.5
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


def _box(x: np.ndarray) -> np.ndarray:
    return np.where((x > -0.5) & (x <= 0.5), 1.0, 0.0)


KERNELS = {"lanczos": (_lanczos, 3.0), "cubic": (_cubic, 2.0), "box": (_box, 0.5)}


@lru_cache(maxsize=64)
def _weights(n: int, out: int, kind: str) -> np.ndarray:
    kernel, support = KERNELS[kind]
    scale = max(n / out, 1.0)
    centre = (np.arange(out) + 0.5) * n / out
    w = kernel((np.arange(n) + 0.5 - centre[:, None]) / scale)
    lo = np.maximum((centre - support * scale + 0.5).astype(int), 0)
    hi = np.minimum((centre + support * scale + 0.5).astype(int), n)
    at = np.arange(n)
    w = np.where((at >= lo[:, None]) & (at < hi[:, None]), w, 0.0)
    return w / w.sum(1, keepdims=True)


def resize(pixels: np.ndarray, height: int, width: int, kind: str = "cubic") -> np.ndarray:
    """Separable resampling whose kernel widens when it shrinks; each pass is rounded to bytes."""
    to_bytes = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    across = to_bytes(np.tensordot(pixels.astype(np.float64), _weights(pixels.shape[1], width, kind), axes=(1, 1)))
    across = np.moveaxis(across, -1, 1)
    down = to_bytes(np.tensordot(across, _weights(pixels.shape[0], height, kind), axes=(0, 1)))
    return np.moveaxis(down, -1, 0).astype(np.uint8)


def difference_hash(pixels: np.ndarray, size: int = 8) -> int:
    """a bit for each pixel of the small grey image that is brighter than its right neighbour; unsigned."""
    small = resize(grey(pixels), size, size + 1, "lanczos").astype(int)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big")


def radial_energy(pixels: np.ndarray, bins: int = 32) -> np.ndarray:
    """mean log spectrum in rings around the zero frequency; rings without a frequency are 0."""
    spectrum = np.fft.fftshift(np.log1p(np.abs(np.fft.rfft2(pixels.mean(axis=2) / 255.0, norm="ortho"))), axes=0)
    h, w = spectrum.shape
    radius = np.minimum(np.hypot(np.linspace(-1, 1, h)[:, None] if h > 1 else np.full((1, 1), -1.0), np.linspace(0, 1, w)[None, :]), 1.0)
    ring = np.minimum((radius * bins).astype(int), bins - 1).ravel()
    n = np.bincount(ring, minlength=bins)
    return np.bincount(ring, spectrum.ravel(), bins) / np.maximum(n, 1)


def residuals(pixels: np.ndarray) -> np.ndarray:
    """differences to the right and lower neighbour and a Laplacian, zero outside, from [-1, 1] to [0, 1]."""
    g = np.pad(pixels.mean(axis=2) / 255.0, 1)
    mid, right, low = g[1:-1, 1:-1], g[1:-1, 2:], g[2:, 1:-1]
    edge = right + g[1:-1, :-2] + low + g[:-2, 1:-1]
    corner = g[:-2, :-2] + g[:-2, 2:] + g[2:, :-2] + g[2:, 2:]
    return (np.clip(np.stack([mid - right, mid - low, 2 * edge - 4 * mid - corner]), -1, 1) + 1) / 2


def normalised(pixels: np.ndarray) -> np.ndarray:
    """F8: channels first, by the fixed means and deviations of ImageNet."""
    mean, deviation = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    return ((pixels / 255.0 - mean) / deviation).transpose(2, 0, 1).astype(np.float32)


def token_occupancy(mask: np.ndarray, grid: tuple[int, int]) -> np.ndarray:
    """share of each cell of the token grid (height, width) that the grey mask covers, row by row."""
    return resize(mask, *grid, "box").ravel() / 255.0


def quality(pixels: np.ndarray) -> float:
    """P12 from pixels."""
    h, w = pixels.shape[:2]
    var = float(np.var(grey(pixels), dtype=np.float64))
    if min(h, w) < 16 or var < 1:
        return 0.0
    penalty = max(0.0, min(0.35, (max(w / h, h / w) - 2.5) * 0.15))
    return round(min(1.0, max(0.1, min(1.0, math.log1p(var) / 7.5) * (1 - penalty))), 4)


def _blend(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    return np.clip(np.rint(a + (b.astype(np.float64) - a) * share), 0, 255).astype(np.uint8)


def _blurred(pixels: np.ndarray, radius: float) -> np.ndarray:
    x = np.arange(-math.ceil(3 * radius), math.ceil(3 * radius) + 1)
    k = np.exp(-0.5 * (x / radius) ** 2)
    k /= k.sum()
    out, reach = pixels.astype(np.float64), len(x) // 2
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
        out = np.apply_along_axis(np.convolve, axis, padded, k, mode="valid")
    return np.rint(out).astype(np.uint8)


def _window(height: int, width: int, keep: float, draw: np.random.Generator, mask: np.ndarray | None, retention: float) -> tuple[int, int, int, int]:
    """a random window that keeps enough of the mask, else one around the mask's centre."""
    h, w = max(1, round(height * keep)), max(1, round(width * keep))
    area = int(mask.sum()) if mask is not None else 0
    for _ in range(16):
        top, left = int(draw.integers(0, height - h + 1)), int(draw.integers(0, width - w + 1))
        if not area or mask[top : top + h, left : left + w].sum() >= retention * area:
            return top, left, h, w
    ys, xs = np.nonzero(mask)
    clamp = lambda v, most: min(max(v, 0), most)
    return clamp(int(ys.mean()) - h // 2, height - h), clamp(int(xs.mean()) - w // 2, width - w), h, w


def transformed(pixels: np.ndarray, family: str, severity: float, seed: int, mask: np.ndarray | None = None, retention: float = 0.5) -> np.ndarray:
    """one transformation, drawn from ``seed``; the size stays. ``jpeg`` needs a codec and is refused, as unknown names are."""
    h, w = pixels.shape[:2]
    draw = np.random.default_rng(seed)
    if family == "blur":
        return _blurred(pixels, severity)
    if family == "resize":
        return resize(resize(pixels, max(1, round(h * severity)), max(1, round(w * severity))), h, w)
    if family == "noise":
        return np.rint(np.clip(pixels / 255.0 + draw.normal(0, severity, pixels.shape), 0, 1) * 255).astype(np.uint8)
    if family == "color":
        brightness, contrast, saturation = draw.uniform(1 - severity, 1 + severity, 3)
        out = _blend(np.zeros_like(pixels), pixels, brightness)
        out = _blend(np.full_like(out, int(grey(out).mean() + 0.5)), out, contrast)
        return _blend(np.repeat(grey(out)[:, :, None], 3, axis=2), out, saturation)
    if family == "crop":
        top, left, ch, cw = _window(h, w, severity, draw, mask > 0 if mask is not None else None, retention)
        return resize(pixels[top : top + ch, left : left + cw], h, w)
    raise ValueError(f"no such transformation: {family!r}")


def over_images(images: DataFrame, make: Callable[[np.ndarray], object], column: str, kind: str) -> DataFrame:
    """``path`` and ``make(pixels)`` of each row of the ``image`` source; null where an image couldn't be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, c, data in zip(*(b.column(n).to_pylist() for n in ("height", "width", "nChannels", "data")), strict=True):
                out.append(make(decoded(h, w, c, data)) if data and h > 0 and w > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, values_type)], names=["path", column])

    values_type = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[kind]
    flat = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInArrow(run, f"path string, {column} {kind}")


def difference_hashes(images: DataFrame) -> DataFrame:
    """F1 as a signed 64-bit number."""
    return over_images(images, lambda p: (h := difference_hash(p)) - (1 << 64 if h >> 63 else 0), "dhash", "long")


def radial_energies(images: DataFrame) -> DataFrame:
    return over_images(images, lambda p: radial_energy(p).tolist(), "energy", "array<double>")


def quality_scores(images: DataFrame) -> DataFrame:
    return over_images(images, quality, "quality", "double")
