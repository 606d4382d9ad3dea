"""What publishing staged assets would do, by their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def release_actions(staged: DataFrame, published: DataFrame) -> DataFrame:
    """Adds action to staged assets (asset, sha256): create where none of that name is published, keep where the published one has the same digest, else edit.

    published: (asset, sha256), a name once. Names that are published only are left alone. A null digest on either side is no evidence of equality.
    """
    there = published.select(F.col("asset").alias("_asset"), F.col("sha256").alias("_sha256"))
    action = F.when(F.col("_asset").isNull(), "create").when(F.col("sha256") == F.col("_sha256"), "keep").otherwise("edit")
    return staged.join(there, F.col("asset") == F.col("_asset"), "left").select(*staged.columns, action.alias("action"))


def manifest_line(asset: Column, size: Column, sha256: Column) -> Column:
    """A row of the manifest's table: name, millions of bytes, beginning of the digest."""
    return F.concat(F.lit("| `"), asset.cast("string"), F.lit("` | "), F.format_string("%.6f", size / 1e6), F.lit(" | `"), F.left(sha256, F.lit(16)), F.lit("…` |"))
