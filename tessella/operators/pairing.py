"""Building datasets: keys from names, pairs, membership, splits, numbering and batches."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.session import stored


def numeric_key(name: Column, prefix: str, extension: str) -> Column:
    """The digits of names such as train12.jpeg, NULL for any other name."""
    digits = F.regexp_extract(name, rf"^{prefix}([0-9]+)\.{extension}$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def string_key(name: Column, prefix: str, extensions: Sequence[str]) -> Column:
    """What is left of a name without prefix and extension (any case); NULL where either is missing."""
    key = F.regexp_extract(name, rf"^{prefix}(.+)\.(?i:{'|'.join(extensions)})$", 1)
    return F.when(key != "", key)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order; a partial aggregate, not a window."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(key, "_r.*")


def split_by_hash(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Adds split: the rows whose seeded digest ranks first are val, max(1, round half even) of them.

    The boundary digest is found by counts of digests' beginnings, 4,096 a step, until few rows share one; no row is numbered or moved.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.select(digest.alias("d"))
    prefix, left = "", None
    while True:
        counts = rows.where(F.col("d").startswith(prefix)).groupBy(F.substring("d", 1, len(prefix) + 3).alias("p")).count().collect()
        if left is None:
            n = sum(r["count"] for r in counts)
            left = min(n, max(1, round(n * fraction)))
            if n == 0:
                return df.withColumn("split", F.lit(None).cast("string"))
        for r in sorted(counts):
            prefix, size = r["p"], r["count"]
            if left <= size:
                break
            left -= size
        if size <= 10_000 or len(prefix) >= 32:
            break
    edge = rows.where(F.col("d").startswith(prefix)).orderBy("d").limit(left).agg(F.max("d")).first()[0]
    return df.withColumn("split", F.when(digest <= edge, "val").otherwise("train"))


def fixed_validation(rows: DataFrame, val: DataFrame) -> DataFrame:
    """All of rows as train and a given validation set as val, in place of a split."""
    return rows.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))


def split_exact(ids: list[int], fraction: float, seed: int) -> tuple[list[int], list[int]]:
    """(train, val) of a bounded id list, by the standard generator's shuffle."""
    order = sorted(ids)
    random.Random(seed).shuffle(order)
    n_val = max(1, round(len(order) * fraction))
    return sorted(order[n_val:]), sorted(order[:n_val])


def numbered(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Adds consecutive numbers in the given total order without gathering rows in one task.

    Rows are range-partitioned, sorted and written; each gets its place in its partition plus the sizes of the partitions before, which
    is one number for each partition. What is written stays the same whatever executors are lost; it goes with the scope (see session) that the call stands in.
    """
    rows, _ = stored(df.sort(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    out = rows.withColumn("_p", part).join(F.broadcast(base), "_p")
    return out.withColumn(name, F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1) + start).drop("_m", "_p", "_b")


BROADCAST_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint, where it has so few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int, total: str | None = None) -> DataFrame:
    """Adds batch: consecutive blocks of `size` rows in each group; with total, a column of that name with the group's rows.

    Rows are numbered over all groups and each group's first number is taken off, so a group may be larger than a task.
    """
    rows = numbered(df, [*map(F.col, keys), *order], "_k").withColumn("_g", F.struct(*keys))
    first = rows.groupBy("_g").agg(F.min("_k").alias("_first"), F.count("*").alias("_size"))
    out = rows.join(few(stored(first, "groups")[0]), "_g")
    out = out.withColumn("batch", F.floor((F.col("_k") - F.col("_first")) / size).cast("bigint"))
    return out.select(*df.columns, "batch", *([F.col("_size").alias(total)] if total else []))


def guarded(df: DataFrame, least: int, message: str) -> DataFrame:
    """df, or an error where it has fewer than `least` rows; only so many are read for that."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"{message}: {found} of {least}")
    return df
