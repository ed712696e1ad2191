"""Measures of one picture, as numpy over its tones (0 to 255) or its colours (blue, green, red)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stabilizers of the structural similarity, (0.01 * 255)^2 and (0.03 * 255)^2.
SSIM_C1, SSIM_C2 = 6.5025, 58.5225


def shrunk(grey: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over a grid of cells; where a cell is less than a pixel, that pixel."""
    y, x = (np.linspace(0, n, k + 1).astype(int) for n, k in zip(grey.shape, (rows, columns), strict=True))
    sums = np.add.reduceat(np.add.reduceat(grey, np.minimum(y[:-1], grey.shape[0] - 1), axis=0), np.minimum(x[:-1], grey.shape[1] - 1), axis=1)
    return sums / (np.maximum(1, np.diff(y))[:, None] * np.maximum(1, np.diff(x))[None, :])


def fitted(grey: np.ndarray, side: int) -> np.ndarray:
    """Whole tones of the picture brought to ``side`` along its longer edge."""
    scale = side / max(grey.shape)
    return np.rint(shrunk(grey, *(max(1, round(n * scale)) for n in grey.shape)))


def slopes(tones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of the neighbours to the right and left and of those below and above, for inner pixels."""
    if min(tones.shape) < 3:
        return np.zeros((0, 0)), np.zeros((0, 0))
    return tones[1:-1, 2:] - tones[1:-1, :-2], tones[2:, 1:-1] - tones[:-2, 1:-1]


def sharpness(tones: np.ndarray) -> tuple[float, float]:
    """Variance of the Laplacian: over the inner pixels, and the squared departures of the inner pixels by the whole area, both mean and count."""
    if min(tones.shape) < 3:
        return 0.0, 0.0
    inner = tones[:-2, 1:-1] + tones[2:, 1:-1] + tones[1:-1, :-2] + tones[1:-1, 2:] - 4 * tones[1:-1, 1:-1]
    return float(inner.var()), float(((inner - inner.sum() / tones.size) ** 2).sum() / tones.size)


def color_histogram(bgr: np.ndarray) -> np.ndarray:
    """Shares of 8 hues, 4 saturations and 2 values on 48 x 48 cells."""
    b, g, r = (np.rint(shrunk(bgr[:, :, k], 48, 48)) / 255 for k in range(3))
    top, span = np.maximum(np.maximum(r, g), b), np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    by = np.where(span > 0, span, 1)
    hue = np.select([span == 0, top == r, top == g], [0, (g - b) / by, (b - r) / by + 2], (r - g) / by + 4)
    degrees = np.floor(hue * 60 + 0.5) % 360
    bins = np.minimum(7, degrees // 45) * 8 + np.minimum(3, span / np.where(top > 0, top, 1) * 4 // 1) * 2 + np.minimum(1, top * 2 // 1)
    return np.bincount(bins.astype(int).ravel(), minlength=64) / bins.size


def edge_histogram(grey: np.ndarray) -> np.ndarray:
    """Shares of 32 directions, opposite ones together, of the slopes above 20 on 64 x 64 cells."""
    gx, gy = slopes(fitted_grid(grey))
    strong = np.hypot(gx, gy) > 20
    angle = np.degrees(np.arctan2(gy[strong], gx[strong]))
    bins = np.minimum(31, np.where(angle < 0, angle + 180, angle) / 180 * 32).astype(int)
    return np.bincount(bins, minlength=32) / max(1, len(bins))


def fitted_grid(grey: np.ndarray, side: int = 64) -> np.ndarray:
    """Whole tones on ``side`` x ``side`` cells, whatever the picture's shape."""
    return np.rint(shrunk(grey, side, side))


def document_tones(bgr: np.ndarray, grey: np.ndarray, side: int = 160) -> dict[str, float]:
    """What tells paper from other pictures: saturation of the mean colour, and on a small copy the shares of white, dark and edge pixels and of level to upright edges."""
    means = bgr.reshape(-1, 3).mean(axis=0)
    small = fitted(grey, side)
    inner, (gx, gy) = small[1:-1, 1:-1], map(np.abs, slopes(small))
    upright = int((gx > 20).sum())
    return {
        "saturation": float((means.max() - means.min()) / means.max()) if means.max() else 0.0,
        "white_ratio": float((inner > 210).sum() / small.size),
        "dark_ratio": float((inner < 50).sum() / small.size),
        "edge_density": float((gx + gy > 30).sum() / small.size),
        "hv_ratio": float((gy > 20).sum() / upright) if upright else 1.0,
    }


def glare(tones: np.ndarray) -> bool:
    """Whether over 15 % of one of 4 x 4 equal cells is white (240 and more). A rest at the right or below counts nowhere; pictures below 8 pixels have none."""
    h, w = (n // 4 for n in tones.shape)
    return min(tones.shape) >= 8 and bool(((tones[: 4 * h, : 4 * w] >= 240).reshape(4, h, 4, w).mean(axis=(1, 3)) > 0.15).any())


def page_outline(tones: np.ndarray) -> dict[str, float | int | bool]:
    """The rectangle between the first and the last row of strong edges, looked for from 3 % inside the picture's border every fourth row; its shape (long by short side), share of the area, and whether it can be a page or card."""
    height, width = tones.shape
    strong = np.zeros(tones.shape, dtype=bool)
    gx, gy = slopes(tones)
    if gx.size:
        strong[1:-1, 1:-1] = np.abs(gx) + np.abs(gy) > 35
    left, right, top, bottom = int(width * 0.03), int(width * 0.97), int(height * 0.03), int(height * 0.97)
    lined = strong[:, left:right:4].sum(axis=1) > (right - left) / 16
    upper, lower = np.arange(top, height / 2, 4, dtype=int), np.arange(min(bottom, height - 1), height / 2, -4, dtype=int)
    top = int(next(iter(upper[lined[upper]]), top))
    bottom = int(next(iter(lower[lined[lower]]), bottom))
    w, h = right - left, bottom - top
    ratio = max(w, h) / min(w, h) if min(w, h) > 0 else 1.0
    area = w * h / tones.size
    return {"left": left, "top": top, "right": right, "bottom": bottom, "ratio": ratio, "area": area, "page": area >= 0.15 and (1.2 <= ratio <= 1.85 or area >= 0.35)}


def _tones(x) -> np.ndarray:
    return np.frombuffer(x, np.uint8).astype(np.float64) if isinstance(x, bytes | bytearray) else np.asarray(x, dtype=np.float64)


def ssim_of(x: np.ndarray, y: np.ndarray) -> float:
    """Structural similarity from the moments of two grids of tones, within 0 and 1; 0 if their sizes differ or they are empty."""
    if x.shape != y.shape or not x.size:
        return 0.0
    mx, my = x.mean(), y.mean()
    both = (2 * mx * my + SSIM_C1) * (2 * ((x - mx) * (y - my)).mean() + SSIM_C2)
    return float(np.clip(both / ((mx * mx + my * my + SSIM_C1) * (x.var() + y.var() + SSIM_C2)), 0, 1))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two columns of grids, bytes or arrays of tones; null where either is null."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ssim_of(_tones(p), _tones(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return alike(a, b)
