"""Static quantisation to eight bits: scale and zero point from ranges, rounding, and the error of the way there and back.

Activations become unsigned with a zero point, so that 0 is exact and the range, widened to hold 0, fits; weights become signed with scale alone. Halves round to even. Arithmetic is in doubles.

Defined results: a channel of nothing but zeros, or nulls, has the scale 1; nulls stay null and don't count; NaN and infinite values are an error of the data and give the ends of the range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators.pairing import few
from tessella.session import stored

# The smallest and largest number of each kind.
KINDS = {"uint8": (0, 255), "int8": (-127, 127)}


def ranges(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """(keys, low, high) of all elements of arrays; each array is reduced before the shuffle."""
    x = F.transform(values, lambda v: v.cast("double"))
    return df.groupBy(*keys).agg(F.min(F.array_min(x)).alias("low"), F.max(F.array_max(x)).alias("high"))


def scales(found: DataFrame, kind: str) -> DataFrame:
    """Adds scale and zero to (low, high)."""
    least, most = KINDS[kind]
    low, high = F.least(F.coalesce("low", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("high", F.lit(0.0)), F.lit(0.0))
    width = (high - low) / (most - least) if kind == "uint8" else F.greatest(-low, high) / most
    scale = F.when(width > 0, width).otherwise(F.lit(1.0))
    zero = F.greatest(F.lit(least), F.least(F.lit(most), F.rint(least - low / scale).cast("int"))) if kind == "uint8" else F.lit(0)
    return found.withColumns({"scale": scale, "zero": zero})


def quantised(values: Column, scale: Column, zero: Column, kind: str) -> Column:
    """The numbers of eight bits that stand for an array's elements."""
    least, most = KINDS[kind]
    return F.transform(values, lambda v: F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.rint(v.cast("double") / scale) + zero)).cast("int"))


def restored(codes: Column, scale: Column, zero: Column) -> Column:
    return F.transform(codes, lambda q: (q - zero) * scale)


def quantise(df: DataFrame, keys: Sequence[str], values: str, kind: str) -> DataFrame:
    """Adds scale, zero and codes to rows with an array, one range for each channel (keys)."""
    table, _ = stored(scales(ranges(df, keys, values), kind).withColumn("_g", F.struct(*keys)).select("_g", "scale", "zero"), "scales")
    return df.withColumn("_g", F.struct(*keys)).join(few(table), "_g").drop("_g").withColumn("codes", quantised(F.col(values), F.col("scale"), F.col("zero"), kind))


def errors(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """(keys, scale, zero, n, worst, mean_square) of quantised rows: what is lost on the way there and back."""
    off = F.zip_with(values, restored(F.col("codes"), F.col("scale"), F.col("zero")), lambda a, b: F.abs(a.cast("double") - b))
    rows = df.select(*keys, "scale", "zero", F.filter(off, lambda e: e.isNotNull()).alias("_off"))
    total = F.sum(F.aggregate("_off", F.lit(0.0), lambda a, e: a + e * e))
    n = F.sum(F.size("_off"))
    return rows.groupBy(*keys).agg(F.max("scale").alias("scale"), F.max("zero").alias("zero"), n.alias("n"), F.max(F.array_max("_off")).alias("worst"), F.try_divide(total, n).alias("mean_square"))
