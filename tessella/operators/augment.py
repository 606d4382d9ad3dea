"""Seeded augmentation and interpolated resizing of tiles, vectorised over Arrow batches.

Randomness comes from (seed, epoch, row key) alone, so results don't depend on partitions or reruns. Images are float HWC in [0, 1], masks are 0/1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MODES = ("nearest", "bilinear", "bicubic", "catmull-rom")
POLE = 3**0.5 - 2  # of the cubic B-spline's inverse filter
MARGIN = 12  # repeated edge samples on each side before that filter; its response has died down by then


def spline_coefficients(x: np.ndarray) -> np.ndarray:
    """The B-spline coefficients that interpolate x along its first axis, mirrored at the ends: one recursion forwards, one backwards."""
    n = len(x)
    if n == 1:
        return x.astype(np.float64)
    c = 6.0 * x
    power = POLE ** np.arange(n).reshape(-1, *[1] * (x.ndim - 1))
    inner = (power[1:-1] + power[1:-1][::-1] * power[n - 1]) * c[1:-1]
    c[0] = (c[0] + power[n - 1] * c[n - 1] + inner.sum(axis=0)) / (1 - power[n - 1] ** 2)
    for k in range(1, n):
        c[k] += POLE * c[k - 1]
    c[n - 1] = POLE / (POLE * POLE - 1) * (c[n - 1] + POLE * c[n - 2])
    for k in range(n - 2, -1, -1):
        c[k] = POLE * (c[k + 1] - c[k])
    return c


def _weights(at: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Source places and weights of an interpolation at fractional places."""
    if mode == "nearest":
        return np.floor(at + 0.5).astype(int)[:, None], np.ones((len(at), 1))
    low = np.floor(at).astype(int)
    t = at - low
    if mode == "bilinear":
        return low[:, None] + np.arange(2), np.stack([1 - t, t], axis=1)
    d = np.abs(t[:, None] - np.arange(-1, 3))
    if mode == "bicubic":
        near, far = 2 / 3 - d**2 + d**3 / 2, (2 - d) ** 3 / 6
    else:
        near, far = 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return low[:, None] + np.arange(-1, 3), np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def resize(image: np.ndarray, height: int, width: int, mode: str = "bicubic") -> np.ndarray:
    """H x W x C to another size: pixel centres map to pixel centres, edges repeat, no smoothing.

    bicubic is the cubic spline through all samples, cut off at the image's smallest and largest value; catmull-rom looks at four samples only.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    out = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        place, weight = _weights((np.arange(size) + 0.5) * n / size - 0.5, mode)
        if mode == "bicubic":
            widths = [(MARGIN, MARGIN) if k == axis else (0, 0) for k in range(out.ndim)]
            out = np.moveaxis(spline_coefficients(np.moveaxis(np.pad(out, widths, mode="edge"), axis, 0)), 0, axis)
            place, n = place + MARGIN, n + 2 * MARGIN
        picked = np.take(out, np.clip(place, 0, n - 1), axis=axis)
        shape = [1] * picked.ndim
        shape[axis], shape[axis + 1] = weight.shape
        out = (picked * weight.reshape(shape)).sum(axis=axis + 1)
    if mode == "bicubic" and image.size:
        out = np.clip(out, image.min(), image.max())
    return out.astype(np.float32)


def rotate(image: np.ndarray, degrees: float, order: int = 1) -> np.ndarray:
    """About the centre; what comes from outside is zero."""
    h, w = image.shape[:2]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = np.cos(a) * y - np.sin(a) * x + (h - 1) / 2, np.sin(a) * y + np.cos(a) * x + (w - 1) / 2
    padded = np.pad(image, ((1, 1), (1, 1), (0, 0)))
    corners = ((0, 0, 1.0),) if order == 0 else ((i, j, None) for i in (0, 1) for j in (0, 1))
    out = np.zeros(image.shape)
    for i, j, fixed in corners:
        iy, ix = (np.floor(sy + 0.5), np.floor(sx + 0.5)) if order == 0 else (np.floor(sy) + i, np.floor(sx) + j)
        weight = fixed if fixed else (1 - np.abs(sy - iy)) * (1 - np.abs(sx - ix))
        py, px = np.clip(iy + 1, 0, h + 1).astype(int), np.clip(ix + 1, 0, w + 1).astype(int)
        out += padded[py, px] * (weight if np.isscalar(weight) else weight[..., None])
    return out.astype(np.float32)


def shift_hsv(image: np.ndarray, hue: float, saturation: float, value: float) -> np.ndarray:
    """RGB in [0, 1] with hue turned (in turns), saturation and value shifted and clipped."""
    high, low = image.max(axis=-1), image.min(axis=-1)
    span = high - low
    safe = np.where(span > 0, span, 1)
    r, g, b = np.moveaxis(image, -1, 0)
    h = np.select([high == r, high == g], [(g - b) / safe % 6, (b - r) / safe + 2], (r - g) / safe + 4) / 6
    s = np.where(high > 0, span / np.where(high > 0, high, 1), 0)
    h, s, v = (h + hue) % 1, np.clip(s + saturation, 0, 1), np.clip(high + value, 0, 1)
    k = (np.array([5, 3, 1]) + h[..., None] * 6) % 6
    return (v[..., None] - v[..., None] * s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1)).astype(np.float32)


@dataclass(frozen=True)
class Plan:
    """Which steps may happen; a probability of zero leaves a step out."""

    flip_p: float = 0.5
    vflip_p: float | None = None  # None: as flip_p
    rotate_p: float = 0.5
    rotate_limit: float = 15.0
    crop: tuple[int, int] | None = None  # least and most side of a square crop that is scaled back to the tile's size
    brightness_p: float = 0.3
    brightness_limit: float = 0.2
    contrast_limit: float | None = None  # None: as brightness_limit
    hsv_p: float = 0.0
    hue_limit: float = 0.05
    seed: int = 0


def augmented(image: np.ndarray, mask: np.ndarray, plan: Plan, key: int, epoch: int) -> tuple[np.ndarray, np.ndarray]:
    """With crops: rotate, crop, flips, colours; else flips, rotate, colours. The mask follows the geometry and stays 0/1."""
    rng = np.random.default_rng([plan.seed, epoch, key & (2**63 - 1)])
    mask = mask[..., None]

    def flips(i: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for axis, p in ((1, plan.flip_p), (0, plan.flip_p if plan.vflip_p is None else plan.vflip_p)):
            if rng.random() < p:
                i, m = np.flip(i, axis), np.flip(m, axis)
        return i, m

    def turn(i: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if rng.random() < plan.rotate_p:
            a = rng.uniform(-plan.rotate_limit, plan.rotate_limit)
            return rotate(i, a), rotate(m, a, 0)
        return i, m

    def cut(i: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, w = i.shape[:2]
        n = int(rng.integers(min(plan.crop[0], h, w), min(plan.crop[1], h, w) + 1))
        y, x = int(rng.integers(0, h - n + 1)), int(rng.integers(0, w - n + 1))
        return cropped(i, y, x, n), cropped(m, y, x, n, "nearest")

    for step in (turn, cut, flips) if plan.crop else (flips, turn):
        image, mask = step(image, mask)
    if rng.random() < plan.brightness_p:
        contrast = plan.brightness_limit if plan.contrast_limit is None else plan.contrast_limit
        image = np.clip(image * (1 + rng.uniform(-1, 1) * contrast) + rng.uniform(-1, 1) * plan.brightness_limit, 0, 1)
    if rng.random() < plan.hsv_p:
        image = shift_hsv(image, *rng.uniform(-plan.hue_limit, plan.hue_limit, 3))
    return image.astype(np.float32), (mask[..., 0] >= 0.5).astype(np.float32)


def augment(tiles: DataFrame, plan: Plan, epoch: int) -> DataFrame:
    """tiles: (n, h, w, image array<float> HWC, mask array<float>); the same columns after augmentation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [augmented(np.asarray(r.image, np.float32).reshape(r.h, r.w, -1), np.asarray(r.mask, np.float32).reshape(r.h, r.w), plan, int(r.n), epoch) for r in pdf.itertuples()]
            yield pdf.assign(image=[i.ravel() for i, _ in done], mask=[m.ravel() for _, m in done])

    return tiles.select("n", "h", "w", "image", "mask").mapInPandas(run, "n long, h int, w int, image array<float>, mask array<float>")


def resize_tiles(tiles: DataFrame, height: int, width: int, mode: str = "bicubic") -> DataFrame:
    """tiles: (n, h, w, image); images of the new size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(image=[resize(np.asarray(r.image, np.float32).reshape(r.h, r.w, -1), height, width, mode).ravel() for r in pdf.itertuples()], h=height, w=width)

    return tiles.select("n", "h", "w", "image").mapInPandas(run, "n long, h int, w int, image array<float>")


def stepped(tiles: DataFrame, step: Callable[..., np.ndarray], *given: str) -> DataFrame:
    """tiles: (n, h, w, image array<float> HWC, and the columns `given`); images after step(image, *values of the row's given columns), which keeps their size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [np.asarray(i, np.float64).reshape(h, w, -1) for i, h, w in zip(pdf["image"], pdf["h"], pdf["w"], strict=True)]
            done = [step(i, *values) for i, *values in zip(images, *(pdf[c] for c in given), strict=True)] if given else [step(i) for i in images]
            yield pdf[["n", "h", "w"]].assign(image=[np.asarray(i, np.float32).ravel() for i in done])

    return tiles.select("n", "h", "w", "image", *given).mapInPandas(run, "n long, h int, w int, image array<float>")


def cropped(image: np.ndarray, y: int, x: int, side: int, mode: str = "bilinear") -> np.ndarray:
    """A square window scaled back to the image's size."""
    return resize(image[y : y + side, x : x + side], *image.shape[:2], mode)
