"""Training histories: best epochs, early stopping, learning-rate plateaus, pivots and carried-forward marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def epochs(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds epoch: 1, 2, ... in each run."""
    return df.withColumn("epoch", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def best_epoch(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """The first epoch with the largest metric of each run: one aggregate, no sort."""
    best = F.max_by(F.struct("epoch", metric), F.struct(F.col(metric), -F.col("epoch")))
    return df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def best_of_last_stage(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Of each run's last stage that has the metric, the first epoch with the largest one."""
    best = F.max_by(F.struct("stage", "epoch", metric), F.struct(F.col("stage"), F.col(metric), -F.col("epoch")))
    return df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def improvements(df: DataFrame, keys: Sequence[str], loss: str) -> DataFrame:
    """Adds best (so far, this epoch included), improved (strictly below all before) and since (epochs since then)."""
    run = Window.partitionBy(*keys).orderBy("epoch")
    before = F.min(loss).over(run.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("improved", before.isNull() | (F.col(loss) < before))
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"best": F.min(loss).over(run.rowsBetween(Window.unboundedPreceding, 0)), "since": F.col("epoch") - last})


def early_stop(df: DataFrame, keys: Sequence[str], loss: str, patience: int) -> DataFrame:
    """The epochs up to and with the one that reaches the patience."""
    df = improvements(df, keys, loss)
    stop = F.min(F.when(F.col("since") >= patience, F.col("epoch"))).over(Window.partitionBy(*keys))
    return df.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("epoch") <= F.col("stop")))


def plateau(df: DataFrame, keys: Sequence[str], loss: str, lr: float = 1e-3, factor: float = 0.1, patience: int = 2, threshold: float = 1e-4, least_change: float = 1e-8, stage: str | None = None, carry: bool = False) -> DataFrame:
    """(keys, [stage,] epoch, lr): the rate after each epoch; it falls once more than `patience` epochs haven't been below the best by the relative threshold.

    Where stages are named, each begins with a new best and count, and with the first rate again or, if `carry`, with the last one of the stage before.
    A fold over one run's ordered losses; a run is as long as a training, so its array is small.
    """
    names = [stage, "epoch"] if stage else ["epoch"]
    runs = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names, loss))).alias("l"))
    at = (lambda x: x[stage].cast("bigint")) if stage else (lambda x: F.lit(0).cast("bigint"))
    zero = F.struct(F.lit(None).cast("bigint").alias("stage"), F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(lr).alias("lr"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = ~s["stage"].eqNullSafe(at(x))
        best, count = F.when(new, F.lit(float("inf"))).otherwise(s["best"]), F.when(new, 0).otherwise(s["bad"])
        before = s["lr"] if carry else F.when(new, F.lit(lr)).otherwise(s["lr"])
        better = x[loss] < best * (1 - threshold)
        bad = F.when(better, 0).otherwise(count + 1)
        reduce_ = bad > patience
        lower = before * factor
        rate = F.when(reduce_ & (before - lower > least_change), lower).otherwise(before)
        return F.struct(at(x).alias("stage"), F.when(better, x[loss]).otherwise(best).alias("best"), F.when(reduce_, 0).otherwise(bad).alias("bad"), rate.alias("lr"), F.concat(s["out"], F.array(rate)).alias("out"))

    rates = F.aggregate("l", zero, step)["out"]
    pairs = F.arrays_zip(*[F.col(f"l.{n}").alias(n) for n in names], rates.alias("lr"))
    return runs.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def pivot_scalars(df: DataFrame, keys: Sequence[str], tags: Sequence[str], order: Sequence[str], digits: int = 5) -> DataFrame:
    """One column for each tag; the last value of a tag in a step wins."""
    last = [F.round(F.max_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.struct(*order))), digits).alias(t) for t in tags]
    return df.groupBy(*keys).agg(*last)


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], mark: str, default: Column) -> Column:
    """The last mark that isn't null up to each row."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(run), default)
