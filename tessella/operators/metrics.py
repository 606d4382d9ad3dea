"""Confusion counts, the ratios built on them, losses as aggregates and latency statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators.pairing import BROADCAST_ROWS, few
from tessella.session import stored

EPS = 1e-6  # fixed value of the soft F1 loss


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hit(score: Column, threshold: float = 0.5) -> Column:
    """1 where the score reaches the threshold (inclusive); NaN and NULL never reach it."""
    return F.when(F.isnan(score) | score.isNull(), 0).when(score >= threshold, 1).otherwise(0)


def counts(pred: str, target: str) -> list[Column]:
    """Global tp, fp, fn of 0/1 columns; one partial/final aggregate. Empty input counts zero."""
    p, t = F.col(pred), F.col(target)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return [total(p * t).alias("tp"), total(p * (1 - t)).alias("fp"), total((1 - p) * t).alias("fn")]


def ratio(num: Column, den: Column) -> Column:
    """num/den, 0.0 where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and iou to a frame with tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn)}
    )


def iou_of_f1(f1: Column) -> Column:
    return f1 / (2 - f1)


def bce_with_logits(x: Column, z: Column) -> Column:
    """Mean binary cross-entropy of logits x and targets z, in the form that doesn't overflow."""
    return F.avg(F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x))))


def soft_f1_loss(x: Column, z: Column) -> Column:
    """1 - F1 of the probabilities themselves, with EPS on both sides of each ratio."""
    p = sigmoid(x)
    tp, fp, fn = F.sum(p * z), F.sum(p * (1 - z)), F.sum((1 - p) * z)
    return 1 - (2 * tp + EPS) / (2 * tp + fp + fn + EPS)


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted mean, 0.0 of nothing."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0))


WITHIN = 100_000  # rows of a bucket that one task may sort
STEPS = 1024  # buckets for each power of two


def magnitude(v: Column) -> Column:
    """A number that rises with v and is the same for values within about a thousandth of one another."""
    size = F.floor(F.log2(F.abs(v)) * STEPS).cast("long") + 1100 * STEPS
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v == F.lit(float("inf")), F.lit(1 << 39)).when(v == F.lit(float("-inf")), F.lit(-(1 << 39))).when(v > 0, size).when(v < 0, -size).otherwise(0)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation for each group.

    Values are counted by group and bucket, buckets being magnitudes; running counts say which bucket holds a wanted place, and where in it. Of buckets that aren't all one value, only those are read again: once more in finer buckets
    while one holds more than WITHIN rows, then in order. No value is sorted with those of other buckets, so no group or value is one task's.
    """
    v = F.col("_v").cast("double")
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_g"), F.col(value).alias("_v")).withColumn("_b", magnitude(v))

    def counted(some: DataFrame) -> DataFrame:
        return stored(some.groupBy("_g", "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "buckets")[0]

    buckets = counted(rows)
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = buckets.withColumns({"_before": before, "_all": F.sum("_n").over(group)})
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    sides = [F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), f(place(q)).cast("long").alias("k"), (place(q) - F.floor(place(q))).alias("frac")) for i, q in enumerate(at.values()) for s, f in enumerate((F.floor, F.ceil))]
    inside = F.filter(F.array(*sides), lambda x: (x["k"] >= F.col("_before")) & (x["k"] < F.col("_before") + F.col("_n")))
    wanted = places.withColumn("x", F.explode(inside)).select("_g", "_b", "_n", "_low", "_high", "x.i", "x.side", "x.frac", (F.col("x.k") - F.col("_before")).alias("_k"))
    known = lambda d: (F.col("_k") == 0) | (F.col("_k") == F.col("_n") - 1) | F.col("_low").eqNullSafe(F.col("_high"))
    ends = lambda d: d.where(known(d)).select("_g", "i", "side", "frac", F.when(F.col("_k") == 0, F.col("_low")).otherwise(F.col("_high")).alias("_v"))
    found, wanted = [ends(wanted)], wanted.where(~known(wanted))  # all of it from the table of buckets
    while (size := wanted.agg(F.max("_n"), F.count("*")).first())[0] is not None and size[0] > WITHIN:
        # finer: each bucket's own range in even steps
        own = few(wanted.select("_g", "_b", "_low", "_high").distinct())
        step = F.floor((v - F.col("_low")) / (F.col("_high") - F.col("_low")) * STEPS).cast("long")
        rows = rows.join(own, ["_g", "_b"]).select("_g", "_v", F.struct(F.col("_b").alias("parent"), F.coalesce(step, F.lit(0)).alias("step")).alias("_b"))
        finer = counted(rows)
        parent = Window.partitionBy("_g", "_parent").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        finer = finer.withColumn("_parent", F.col("_b.parent")).withColumn("_before", F.coalesce(F.sum("_n").over(parent), F.lit(0)))
        asked = wanted.select("_g", F.col("_b").alias("_parent"), "i", "side", "frac", "_k")
        hit = finer.join(asked, ["_g", "_parent"]).where("_k >= _before and _k < _before + _n").withColumn("_k", F.col("_k") - F.col("_before"))
        hit = hit.select("_g", "_b", "_n", "_low", "_high", "i", "side", "frac", "_k")
        found.append(ends(hit))
        wanted = stored(hit.where(~known(hit)), "wanted")[0]
    if size[0] is not None:
        asked = wanted.groupBy("_g", "_b").agg(F.collect_list(F.struct("_k", "i", "side", "frac")).alias("x"))
        own = rows.join(F.broadcast(asked) if size[1] <= BROADCAST_ROWS else asked, ["_g", "_b"])
        ranked = own.withColumn("_at", F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_v")) - 1)
        hit = ranked.withColumn("x", F.explode(F.filter("x", lambda x: x["_k"] == F.col("_at"))))
        found.append(hit.select("_g", "x.i", "x.side", "x.frac", "_v"))
    out = []
    for i, name in enumerate(at):
        a, b = (F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("_v"))) for side in (0, 1))
        out.append(F.when(a == b, a).otherwise(a + (b - a) * F.max(F.when(F.col("i") == i, F.col("frac")))).alias(name))
    return reduce(DataFrame.unionByName, found).groupBy("_g").agg(*out).select("_g.*", *at)


def latency_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """runs, min, mean, median and p90 of each group."""
    base = df.groupBy(*keys).agg(F.count(value).alias("runs"), F.min(value).alias("min_ms"), F.avg(value).alias("mean_ms"))
    return base.join(percentiles(df, keys, value, {"median_ms": 0.5, "p90_ms": 0.9}), list(keys))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every double column, so that summation order does not show."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})
