"""Column functions on flat pixel arrays (row-major, channels last) and on tile grids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_unit(px: Column, integers: bool = True) -> Column:
    """Integer pixels become floats in [0, 1]; floating ones are only cast."""
    return F.transform(px, lambda x: (x / 255.0 if integers else x).cast("float"))


def binarize(px: Column, threshold: float = 0.5) -> Column:
    """1.0 from the threshold on (inclusive), else 0.0; NaN is 0.0."""
    return F.transform(px, lambda x: F.when(~F.isnan(x) & (x >= threshold), 1.0).otherwise(0.0))


def any_positive(px: Column, channels: int) -> Column:
    """One value for each pixel: 255 where any of its channels is positive, else 0."""
    at = F.sequence(F.lit(0), F.size(px) - 1, F.lit(channels))
    return F.transform(at, lambda i: F.when(F.exists(F.slice(px, i + 1, channels), lambda c: c > 0), 255).otherwise(0))


def _picked(px: Column, n: int, source) -> Column:
    """n pixels, pixel i being px[source(i)]."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(px, source(i)))


def _floor_div(i: Column, n: int) -> Column:
    return F.floor(i / n).cast("int")


def flip_horizontal(px: Column, height: int, width: int) -> Column:
    return _picked(px, height * width, lambda i: i - i % width + (width - 1) - i % width)


def flip_vertical(px: Column, height: int, width: int) -> Column:
    return _picked(px, height * width, lambda i: (height - 1 - _floor_div(i, width)) * width + i % width)


def transpose(px: Column, height: int, width: int) -> Column:
    return _picked(px, height * width, lambda i: (i % height) * width + _floor_div(i, height))


def channels_first(px: Column, height: int, width: int, channels: int) -> Column:
    """H x W x C to C x H x W."""
    plane = height * width
    return _picked(px, plane * channels, lambda i: (i % plane) * channels + _floor_div(i, plane))


def resize_nearest(px: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Nearest pixel, centres mapped to centres."""
    row = lambda i: F.least(F.floor((_floor_div(i, to_width) + 0.5) * height / to_height).cast("int"), F.lit(height - 1))
    col = lambda i: F.least(F.floor((i % to_width + 0.5) * width / to_width).cast("int"), F.lit(width - 1))
    return _picked(px, to_height * to_width, lambda i: row(i) * width + col(i))


def crop(px: Column, height: int, width: int, top: Column, left: Column, size: int) -> Column:
    """A size x size window, cut off at the border."""
    rows = F.sequence(top, F.least(top + size, F.lit(height)) - 1)
    wide = F.least(F.lit(size), width - left)
    return F.flatten(F.transform(rows, lambda r: F.slice(px, r * width + left + 1, wide)))


def brightness_contrast(px: Column, contrast: float, brightness: float) -> Column:
    """contrast * x + brightness, clipped to [0, 1]."""
    return F.transform(px, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * contrast + brightness)))


def tile_starts(dim: Column, tile: int) -> Column:
    """Starts of tiles that cover dim: multiples of tile, the last one moved back to end at the border; [0] where one tile does."""
    dim = dim.cast("int")
    more = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(dim - tile, F.lit(0)), F.lit(tile)), F.array(dim - tile)))
    return F.when(dim <= tile, F.array(F.lit(0))).otherwise(more)


def scale_width(base: Column, mult: Column) -> Column:
    """Channel count scaled and rounded (half to even) to a multiple of eight, eight at least."""
    return F.greatest(F.lit(8), (F.bround(base * mult / 8) * 8).cast("int"))


def repeated(px: Column, batch: int) -> Column:
    """A batch of one tile, so many times."""
    return F.flatten(F.array_repeat(px, batch))


def zeros(height: int, width: int, channels: int) -> Column:
    """A tile of zeros."""
    return F.array_repeat(F.lit(0.0).cast("float"), height * width * channels)
