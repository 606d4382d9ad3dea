"""Cutting images and masks into tiles at their own resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.tiles import tile_starts
from tessella.operators.pairing import numbered


def window(data: Column, width: Column, channels: Column | int, rows: tuple[Column, Column], columns: tuple[Column, Column]) -> Column:
    """Rows and columns (first, number) of a flat row-major array."""
    (top, n), (left, wide) = rows, columns
    return F.flatten(F.transform(F.sequence(top, top + n - 1), lambda y: F.slice(data, (y * width + left) * channels + 1, wide * channels)))


def cut_tiles(images: DataFrame, tile: int) -> DataFrame:
    """images: (n, h, w, c, image, mask), flat and channels last; (n, r, c0, tile_h, tile_w, c, image, mask) for every tile of the grid, cut off at the border.

    An image stays one row until its tiles are made, so it is decoded once; nothing is shuffled.
    """
    e = images.withColumn("r", F.explode(tile_starts(F.col("h"), tile))).withColumn("c0", F.explode(tile_starts(F.col("w"), tile)))
    tall, wide = F.least(F.lit(tile), F.col("h") - F.col("r")), F.least(F.lit(tile), F.col("w") - F.col("c0"))
    at = (F.col("r"), tall), (F.col("c0"), wide)
    return e.select("n", "r", "c0", tall.alias("tile_h"), wide.alias("tile_w"), "c", window(F.col("image"), F.col("w"), F.col("c"), *at).alias("image"), window(F.col("mask"), F.col("w"), 1, *at).alias("mask"))


def tile_index(tiles: DataFrame) -> DataFrame:
    """Adds tile_idx: 0, 1, ... over the whole set by image, row and column."""
    return numbered(tiles, [F.col("n"), F.col("r"), F.col("c0")], "tile_idx", start=0)
