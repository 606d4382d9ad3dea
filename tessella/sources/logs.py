"""Training logs: text lines to epochs and to the final evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.operators import history as H
from tessella.sources import ranges

# The fields of an epoch line, in their order.
FIELDS = ("loss", "Precision", "Recall", "F1Score", "val_loss", "val_Precision", "val_Recall", "val_F1Score")
COLUMNS = ("loss", "precision", "recall", "f1", "val_loss", "val_precision", "val_recall", "val_f1")
# The grammar of an epoch line and of a number.
EPOCH = "(?<!val_)" + " - ".join(f"{f}: ([0-9.]+)" for f in FIELDS)
LR = "val_F1Score: [0-9.]+ - lr: ([0-9.eE+-]+)"
NUMBER = r"^[0-9.]+([eE][+-]?[0-9]+)?$"


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(run, pos, line): each file is a run, and lines keep their order. A file is read by ranges, so that a long one isn't one task's.

    Where pyarrow has no file system for the path, files are read whole.
    """
    if ranges.reachable(path):
        return ranges.numbered_lines(spark, path, glob).select(F.col("path").alias("run"), "pos", "line")
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("run"), F.posexplode(F.split("value", "\n")))
    return raw.select("run", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("line"))


def phases(lines: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Adds numbers, names, in_first and in_eval: what the evaluation blocks of a run hold.

    The first block begins behind the first "Evaluation on" line and ends with the line that brings its fourth number and fourth name, however many more such
    heads stand in between. What it gathered is kept, so each later block ends with its first line.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    run, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    head = F.col("line").contains("Evaluation on")
    tokens = F.split(F.trim("line"), r"\s+")
    rows = lines.withColumns({"_head": head, "_begun": F.coalesce(F.max(head).over(run), F.lit(False))})
    rows = rows.withColumn("_in", F.col("_begun") & ~F.col("_head"))
    rows = rows.withColumn("numbers", F.when(F.col("_in"), F.filter(tokens, lambda t: t.rlike(NUMBER))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("names", F.when(F.col("_in"), F.size(F.filter(tokens, lambda t: t.isin(*FIELDS[:4])))).otherwise(0))
    enough = (F.sum(F.size("numbers")).over(run) >= 4) & (F.sum("names").over(run) >= 4)
    rows = rows.withColumn("_enough", enough).withColumn("_end", F.min(F.when(F.col("_enough"), F.col(pos))).over(whole))
    first = F.col("_in") & (F.col("_end").isNull() | (F.col(pos) <= F.col("_end")))
    later = F.col("_in") & F.coalesce(F.lag("_head").over(order), F.lit(False))
    return rows.withColumns({"in_first": first, "in_eval": F.col("_head") | first | later, "whole": F.col("_end").isNotNull()}).drop("_head", "_begun", "_in", "_enough", "_end")


def epochs(lines: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """One row for each epoch line outside evaluation blocks: stage carried from the last mark (1 before any), epoch counted in the stage, the metrics, lr or NULL."""
    mark = F.when(F.col("line").contains("[stage1]"), 1).when(F.col("line").contains("[stage2]"), 2)
    rows = phases(lines, keys, pos).withColumn("mark", mark)
    rows = rows.withColumn("stage", H.carried(rows, keys, [pos], "mark", F.lit(1)).cast("bigint"))
    rows = rows.where(~F.col("in_eval") & F.col("line").contains("val_F1Score:") & F.col("line").rlike(EPOCH))
    rows = H.epochs(rows, [*keys, "stage"], [pos])
    metrics = [F.regexp_extract("line", EPOCH, k + 1).cast("double").alias(c) for k, c in enumerate(COLUMNS)]
    lr = F.regexp_extract("line", LR, 1)
    return rows.select(*keys, "stage", "epoch", *metrics, F.when(lr != "", lr.cast("double")).alias("lr"))


def evaluation(lines: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """The final scores of each run whose first evaluation block is whole: its first four numbers."""
    rows = phases(lines, keys, pos).where("in_first and whole")
    ordered = rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(pos, "numbers"))), lambda s: s["numbers"])).alias("n"))
    return ordered.select(*keys, *[F.get("n", F.lit(k)).cast("double").alias(c) for k, c in enumerate(COLUMNS[:4])])
