"""The model contract: one NCHW input and output, a free batch axis, fixed channels, and a side that is 512 or free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract.
CHANNELS_IN, CHANNELS_OUT, SIDE = "3", "1", "512"


def _symbolic(dim: Column) -> Column:
    """A dimension's name, as against a number."""
    return ~dim.rlike("^-?[0-9]+$")


def broken_rules(inputs: Column, outputs: Column) -> Column:
    """The rules that a model breaks; inputs and outputs: array<array<string>>, each tensor's dimensions as numbers or names."""

    def shape(dims: Column, channels: str, name: str) -> list[Column]:
        at = lambda k: F.get(dims, F.lit(k))
        side = lambda k: (at(k) == SIDE) | _symbolic(at(k))
        four = F.size(dims) == 4
        return [F.when(~four, f"{name} rank"), F.when(four & ~_symbolic(at(0)), f"{name} batch"), F.when(four & (at(1) != channels), f"{name} channels"), F.when(four & ~(side(2) & side(3)), f"{name} side")]

    one = (F.size(inputs) == 1) & (F.size(outputs) == 1)
    rules = shape(F.get(inputs, F.lit(0)), CHANNELS_IN, "input") + shape(F.get(outputs, F.lit(0)), CHANNELS_OUT, "output")
    return F.when(one, F.array_compact(F.array(*rules))).otherwise(F.array(F.lit("one input and one output")))


def validated(models: DataFrame) -> DataFrame:
    """models: (name, inputs, outputs); the same, or an error that names the first broken rule once a model that breaks one is read."""
    found = broken_rules(F.col("inputs"), F.col("outputs"))
    checked = F.when(F.size(found) == 0, F.col("name")).otherwise(F.raise_error(F.concat(F.col("name"), F.lit(" breaks the contract: "), F.array_join(found, ", "))).cast("string"))
    return models.withColumn("name", checked)


def broken_graphs(signed: DataFrame) -> DataFrame:
    """signed: what sources.graphs.signatures or read_graphs give; adds broken, the rules that each model breaks, where bytes that can't be read break one of their own."""
    dims = lambda c: F.transform(c, lambda v: v["dims"])
    broken = broken_rules(dims(F.col("inputs")), dims(F.col("outputs")))
    return signed.withColumn("broken", F.when(F.col("error").isNotNull(), F.array(F.lit("readable"))).otherwise(broken))
