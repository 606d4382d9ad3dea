"""Weights from one library's layers to another's: axes permuted, layers zipped by their place.

Tensors are flat arrays in row order beside their shapes. Layers are counted on both sides without gathering either, so the zip is a join on numbers; what doesn't match is an error that names it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators.pairing import numbered


def permuted_shape(shape: Column, axes: Sequence[int]) -> Column:
    return F.array(*[F.get(shape, F.lit(a)) for a in axes])


def permuted(data: Column, shape: Column, axes: Sequence[int]) -> Column:
    """A tensor with its axes in another order: axis k of the result is axis axes[k] of data. An empty tensor stays empty."""
    if sorted(axes) != list(range(len(axes))):
        raise ValueError(f"no order of axes: {list(axes)}")
    size = [F.get(shape, F.lit(k)).cast("long") for k in range(len(axes))]
    product = lambda x: reduce(lambda a, b: a * b, x, F.lit(1).cast("long"))
    stride = [product(size[k + 1 :]) for k in range(len(axes))]
    behind = [product([size[a] for a in axes[k + 1 :]]) for k in range(len(axes))]

    def source(i: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.floor(i / behind[k]) % size[a] * stride[a] for k, a in enumerate(axes)])

    places = F.when(product(size) > 0, F.sequence(F.lit(0).cast("long"), product(size) - 1)).otherwise(F.array().cast("array<long>"))
    return F.transform(places, lambda i: F.get(data, source(i).cast("int")))


def checked(value: Column, right: Column, message: Column) -> Column:
    return F.when(right, value).otherwise(F.raise_error(message).cast("string"))


def zipped(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """(n, kind, shape, data, other): the n-th layer of each side by `order`, from 1.

    left: (order, kind, shape, data) with shapes as they should be; right: (order, kind, shape, other). Another number of layers, kind or shape is an error once the row is read.
    """
    a = numbered(left.select(order, "kind", "shape", "data"), [F.col(order)], "n").select("n", "kind", "shape", "data")
    b = numbered(right.select(order, F.col("kind").alias("_kind"), F.col("shape").alias("_shape"), "other"), [F.col(order)], "n").select("n", "_kind", "_shape", "other")
    both = a.join(b, "n", "full")
    name, text = F.concat(F.lit("layer "), F.col("n")), lambda c: F.coalesce(F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")), F.lit("none"))
    kind = checked(F.col("kind"), F.col("kind").isNotNull() & F.col("_kind").isNotNull(), F.concat(name, F.lit(" is on one side only")))
    kind = F.when(F.col("kind").isNull() | F.col("_kind").isNull() | (F.col("kind") == F.col("_kind")), kind).otherwise(F.raise_error(F.concat(name, F.lit(": "), "kind", F.lit(" and "), "_kind")).cast("string"))
    same = F.transform("shape", lambda x: x.cast("long")) == F.transform("_shape", lambda x: x.cast("long"))
    kind = F.when(F.col("kind").isNull() | F.col("_kind").isNull() | (F.col("kind") != F.col("_kind")) | same, kind).otherwise(F.raise_error(F.concat(name, F.lit(": shapes "), text(F.col("shape")), F.lit(" and "), text(F.col("_shape")))).cast("string"))
    return both.select("n", kind.alias("kind"), "shape", "data", "other")
