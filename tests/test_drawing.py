"""Spline resizing and outline filling."""

import numpy as np
import pytest

from tessella.operators import augment, rasterize


def dense(n):
    """What the spline's samples are of its coefficients, mirrored at the ends."""
    a = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    a[0, 1] = a[-1, -2] = 2
    return a / 6


@pytest.mark.parametrize("n", [2, 3, 5, 40])
def test_coefficients_solve_the_spline_system(n):
    x = np.random.default_rng(n).standard_normal((n, 3, 2))
    assert np.allclose(np.linalg.solve(dense(n), x.reshape(n, -1)).reshape(x.shape), augment.spline_coefficients(x))
    assert np.allclose(augment.spline_coefficients(x[:1]), x[:1])


def test_splines_go_through_samples_and_keep_the_range():
    rng = np.random.default_rng(1)
    x = rng.random((7, 9, 3))
    assert np.allclose(augment.resize(x, 7, 9), x, atol=1e-6)
    big = augment.resize(x, 21, 27)
    assert np.allclose(big[1::3, 1::3], x, atol=1e-6)  # every third pixel centre is a sample's
    assert big.min() >= x.min() - 1e-6 and big.max() <= x.max() + 1e-6
    step = np.repeat([0.0, 1.0], 8)[None, :, None].repeat(4, 0)
    assert augment.resize(step, 8, 64).min() == 0.0 and augment.resize(step, 8, 64).max() == 1.0
    ramp = np.arange(30.0)[None, :, None]
    assert np.allclose(augment.resize(ramp, 1, 60)[0, 20:-20, 0], (np.arange(60) + 0.5)[20:-20] / 2 - 0.5, atol=1e-4)  # straight lines stay straight
    with pytest.raises(ValueError, match="unknown mode"):
        augment.resize(x, 3, 3, "lanczos")


def test_splines_against_a_dense_solve():
    x = np.random.default_rng(2).random((8, 1, 1))
    n, m = 8, 13
    padded = np.pad(x[:, 0, 0], augment.MARGIN, mode="edge")
    c = np.linalg.solve(dense(len(padded)), padded)
    b3 = lambda d: np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))
    at = (np.arange(m) + 0.5) * n / m - 0.5 + augment.MARGIN
    want = (b3(np.abs(at[:, None] - np.arange(len(c)))) * c).sum(axis=1)
    assert np.allclose(augment.resize(x, m, 1)[:, 0, 0], np.clip(want, x.min(), x.max()), atol=1e-6)


def art(*lines):
    return np.array([[c == "#" for c in line] for line in lines])


@pytest.mark.parametrize(
    ("polygon", "shape"),
    [
        ([1, 1, 4, 1, 4, 3, 1, 3], art("......", ".####.", ".####.", ".####.", "......")),  # both ends of a rectangle
        ([1, 1, 4, 1, 1, 4], art("......", ".####.", ".###..", ".##...", ".#....")),
        ([2, 0, 2, 4, 2, 2], art("..#...", "..#...", "..#...", "..#...", "..#...")),  # a line there and back
        ([1, 2, 4, 2, 2, 2], art("......", "......", ".####.", "......", "......")),
        ([3, 3, 3, 3, 3, 3], art("......", "......", "......", "...#..", "......")),  # a point
        ([-3, -3, 2, -3, 2, 2, -3, 2], art("###...", "###...", "###...", "......", "......")),  # cut off at the canvas
        ([4, 3, 99, 3, 99, 99, 4, 99], art("......", "......", "......", "....##", "....##")),
        ([0, 0, 4, 0, 4, 4, 0, 4, 0, 0, 1, 1, 1, 3, 3, 3, 3, 1, 1, 1], art("#####.", "#####.", "##.##.", "#####.", "#####.")),  # a hole, by even-odd
        ([1.9, 1.9, 4.9, 1.2, 4.1, 3.9, 1, 3.3], art("......", ".####.", ".####.", ".####.", "......")),  # points are cut to whole numbers
        ([1, 1, 2, 2], art(*["......"] * 5)),  # two points are no polygon
        ([0, 0, 1, 4, 0, 0], art("#.....", "#.....", ".#....", ".#....", ".#....")),  # halves of a thin one go to the right
    ],
)
def test_outlines(polygon, shape):
    got = rasterize.outlined([polygon], *shape.shape)
    assert np.array_equal(got, shape), got.astype(int)
    assert np.array_equal(rasterize.outlined_all([([polygon], *shape.shape)])[0], shape)


def test_outlines_against_a_plain_loop():
    rng = np.random.default_rng(4)
    for _ in range(60):
        polygons = [rng.integers(-6, 22, 2 * rng.integers(3, 8)).tolist() for _ in range(rng.integers(1, 4))]
        want = np.zeros((16, 14), bool)
        for p in polygons:
            points = list(zip(p[0::2], p[1::2]))
            edges = list(zip(points, points[1:] + points[:1]))
            pixels = set(points)
            for (ax, ay), (bx, by) in edges:
                if ay == by:
                    pixels |= {(x, ay) for x in range(min(ax, bx), max(ax, bx) + 1)}
            for y in range(-6, 22):
                xs = sorted(ax + (y - ay) * ((bx - ax) / (by - ay)) for (ax, ay), (bx, by) in edges if min(ay, by) <= y < max(ay, by))
                for lo, hi in zip(xs[0::2], xs[1::2]):
                    begin = int(np.floor(lo + 0.5))
                    pixels |= {(x, y) for x in range(begin, max(begin, int(np.ceil(hi - 0.5))) + 1)}
            for x, y in pixels:
                if 0 <= x < 14 and 0 <= y < 16:
                    want[y, x] = True
        assert np.array_equal(rasterize.outlined(polygons, 16, 14, most=50), want)
        assert np.array_equal(rasterize.outlined_all([([], 16, 14), (polygons, 16, 14), ([[1, 2]], 16, 14)], most=5000)[1], want)


def test_rules_are_known(spark):
    df = spark.createDataFrame([(1, 5, 6, [[1.0, 1.0, 4.0, 1.0, 4.0, 3.0, 1.0, 3.0]])], "n long, h int, w int, polygons array<array<double>>")
    assert [rasterize.covered(df, rule).first().pixels for rule in rasterize.RULES] == [6, 12]
    with pytest.raises(ValueError, match="unknown rule"):
        rasterize.masks(df, "other")
