"""Polygons to masks, the union of a row's polygons, in Arrow batches, by one of two rules.

centres: a pixel is set where its centre, half a pixel from its edges, is inside even-odd.
outline: as drawing libraries fill, with the outline's own pixels. Points are cut to whole numbers and a pixel stands for the point of its number. In each row, pixels are set between every two crossings of edges, from the one nearest
to the left crossing to the one nearest to the right (halves go inwards; a span without a pixel takes the one to its right), an edge counting from its upper end to above its lower; besides, all level edges and all points are set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def filled(polygons: Sequence[Sequence[float]], height: int, width: int) -> np.ndarray:
    """H x W booleans; a polygon is x, y, x, y, ...; those of fewer than three points are passed over."""
    out = np.zeros((height, width), bool)
    for flat in polygons:
        points = np.asarray(flat, float)[: len(flat) // 2 * 2].reshape(-1, 2)
        if len(points) < 3:
            continue
        low, high = np.floor(points.min(axis=0)), np.ceil(points.max(axis=0))
        x0, y0 = (int(v) for v in np.clip(low, 0, (width, height)))
        x1, y1 = (int(v) for v in np.clip(high, 0, (width, height)))
        x, y = np.arange(x0, x1) + 0.5, (np.arange(y0, y1) + 0.5)[:, None]
        inside = np.zeros((y1 - y0, x1 - x0), bool)
        ends = np.concatenate([points[1:], points[:1]])
        sloped = points[:, 1] != ends[:, 1]
        a, b = points[sloped], ends[sloped]
        step = max(1, (1 << 16) // max(1, inside.size))  # so many edges at once
        for k in range(0, len(a), step):
            (ax, ay), (bx, by) = (e[k : k + step].T[..., None, None] for e in (a, b))
            inside ^= np.logical_xor.reduce(((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), axis=0)
        out[y0:y1, x0:x1] |= inside
    return out


def outlined(polygons: Sequence[Sequence[float]], height: int, width: int, most: int = 1 << 20) -> np.ndarray:
    """H x W booleans by the rule outline; crossings of `most` rows and edges at a time."""
    out = np.zeros((height, width), bool)
    steps = np.zeros((height, width + 1), np.int32)  # +1 where a span begins, -1 behind its end
    for flat in polygons:
        a = np.trunc(np.asarray(flat, float)[: len(flat) // 2 * 2].reshape(-1, 2)).astype(np.int64)
        if len(a) < 3:
            continue
        b = np.roll(a, -1, axis=0)
        seen = (a[:, 0] >= 0) & (a[:, 0] < width) & (a[:, 1] >= 0) & (a[:, 1] < height)
        out[a[seen, 1], a[seen, 0]] = True
        for (x0, y), (x1, _) in zip(a[a[:, 1] == b[:, 1]].tolist(), b[a[:, 1] == b[:, 1]].tolist(), strict=True):
            if 0 <= y < height:
                out[y, max(0, min(x0, x1)) : max(0, max(x0, x1) + 1)] = True
        sloped = a[:, 1] != b[:, 1]
        a, b = a[sloped], b[sloped]
        top, bottom = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
        if not len(a):
            continue
        first, last = max(0, int(top.min())), min(height, int(bottom.max()))
        slope = (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        each = max(1, most // len(a))
        for y0 in range(first, last, each):
            y = np.arange(y0, min(last, y0 + each))[:, None]
            x = np.where((y >= top) & (y < bottom), a[:, 0] + (y - a[:, 1]) * slope, np.inf)
            x.sort(axis=1)
            x = x[:, : np.isfinite(x).sum(axis=1).max(initial=0)]
            left, right = x[:, 0::2], x[:, 1::2]
            row, k = np.nonzero(np.isfinite(right))
            begin = np.floor(left[row, k] + 0.5)
            end = np.maximum(begin, np.ceil(right[row, k] - 0.5))
            np.add.at(steps, (row + y0, np.clip(begin, 0, width).astype(int)), 1)
            np.add.at(steps, (row + y0, np.clip(end + 1, 0, width).astype(int)), -1)
    return out | (np.cumsum(steps, axis=1)[:, :width] > 0)


def outlined_all(rows: Sequence[tuple[Sequence[Sequence[float]], int, int]], most: int = 1 << 20) -> list[np.ndarray]:
    """outlined() of many rows (polygons, height, width); small polygons of one canvas and number of points are filled together, `most` tests at a time."""
    out = [np.zeros((h, w), bool) for _, h, w in rows]
    alike: dict[tuple[int, int, int], list[tuple[int, Sequence[float]]]] = {}
    for i, (polygons, h, w) in enumerate(rows):
        for flat in polygons:
            alike.setdefault((h, w, len(flat) // 2), []).append((i, flat))
    for (h, w, n), items in alike.items():
        if n < 3 or h * w * n > 1 << 14:
            for i, flat in items:
                out[i] |= outlined([flat], h, w)
            continue
        y, xs = np.arange(h)[:, None], np.arange(w)
        step = max(1, most // (h * w * n))
        for k in range(0, len(items), step):
            part = items[k : k + step]
            a = np.trunc(np.array([flat[: 2 * n] for _, flat in part], float).reshape(len(part), 1, n, 2))
            b = np.roll(a, -1, axis=2)
            (ax, ay), (bx, by) = (np.moveaxis(e, -1, 0) for e in (a, b))
            level = ay == by
            crossed = ~level & (y >= np.minimum(ay, by)) & (y < np.maximum(ay, by))
            x = np.sort(np.where(crossed, ax + (y - ay) * ((bx - ax) / np.where(level, 1, by - ay)), np.inf), axis=2)
            begin = np.floor(x[..., 0 : n - n % 2 : 2] + 0.5)[..., None]
            end = np.maximum(begin, np.ceil(x[..., 1::2] - 0.5)[..., None])
            inside = ((xs >= begin) & (xs <= end)).any(axis=2)
            low, high = np.where(level, np.minimum(ax, bx), ax)[..., None], np.where(level, np.maximum(ax, bx), ax)[..., None]  # level edges, and the points of others
            inside |= ((y == ay)[..., None] & (xs >= low) & (xs <= high)).any(axis=2)
            for (i, _), found in zip(part, inside, strict=True):
                out[i] |= found
    return out


def filled_all(rows: Sequence[tuple[Sequence[Sequence[float]], int, int]], most: int = 1 << 20) -> list[np.ndarray]:
    """filled() of many rows (polygons, height, width); small polygons of one canvas and number of points are tested together, `most` tests at a time."""
    out = [np.zeros((h, w), bool) for _, h, w in rows]
    alike: dict[tuple[int, int, int], list[tuple[int, Sequence[float]]]] = {}
    for i, (polygons, h, w) in enumerate(rows):
        for flat in polygons:
            alike.setdefault((h, w, len(flat) // 2), []).append((i, flat))
    for (h, w, n), items in alike.items():
        if n < 3 or h * w * n > 1 << 14:
            for i, flat in items:
                out[i] |= filled([flat], h, w)
            continue
        x, y = np.arange(w) + 0.5, (np.arange(h) + 0.5)[:, None]
        step = max(1, most // (h * w * n))
        for k in range(0, len(items), step):
            part = items[k : k + step]
            a = np.array([flat[: 2 * n] for _, flat in part], float).reshape(len(part), n, 2)
            b = np.roll(a, -1, axis=1)
            ax, ay, bx, by = (e[..., c, None, None] for e in (a, b) for c in (0, 1))
            rise = np.where(by == ay, 1.0, by - ay)  # a level edge is never crossed
            inside = np.logical_xor.reduce(((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / rise + ax), axis=1)
            for (i, _), found in zip(part, inside, strict=True):
                out[i] |= found
    return out


def _of(pdf: pd.DataFrame, rule: str) -> list[np.ndarray]:
    rows = list(zip(pdf["polygons"], pdf["h"].tolist(), pdf["w"].tolist(), strict=True))
    return filled_all(rows) if rule == "centres" else outlined_all(rows)


RULES = ("centres", "outline")


def _known(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")


def masks(images: DataFrame, rule: str = "centres") -> DataFrame:
    """images: (n, h, w, polygons array<array<double>>); (n, h, w, mask array<float>) of zeros and ones."""
    _known(rule)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n": pdf["n"], "h": pdf["h"], "w": pdf["w"], "mask": [m.astype(np.float32).ravel() for m in _of(pdf, rule)]})

    return images.select("n", "h", "w", "polygons").mapInPandas(run, "n long, h int, w int, mask array<float>")


def covered(images: DataFrame, rule: str = "centres") -> DataFrame:
    """images: (n, h, w, polygons); (n, pixels, sx, sy): how many pixels are covered and the sums of their places."""
    _known(rule)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.nonzero(m) for m in _of(pdf, rule)]
            yield pd.DataFrame({"n": pdf["n"], "pixels": [len(y) for y, _ in found], "sx": [x.sum() for _, x in found], "sy": [y.sum() for y, _ in found]})

    return images.select("n", "h", "w", "polygons").mapInPandas(run, "n long, pixels long, sx long, sy long")
