"""Writers: metrics as CSV with empty cells, splits as partitions, scalars as an append-only log, results as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions.tiles import any_positive
from tessella.operators.pairing import guarded, numbered

# The columns of the metrics file, in their order.
METRIC_COLUMNS = ("stage", "epoch", "loss", "precision", "recall", "f1", "val_loss", "val_precision", "val_recall", "val_f1", "lr")


def write_metrics_csv(history: DataFrame, path: str) -> None:
    """Fixed column order; NULL is an empty cell."""
    known = [F.col(c) if c in history.columns else F.lit(None).cast("double").alias(c) for c in METRIC_COLUMNS]
    history.select(*known).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_splits(pairs: DataFrame, path: str, splits: Sequence[str] = ("train", "val"), order: str = "n") -> None:
    """One partition for each split, its rows numbered 1..N in key order."""
    parts = [numbered(pairs.where(F.col("split") == s).withColumnRenamed(order, "key"), [F.col("key")], order) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def numbered_pairs(images: DataFrame, masks: DataFrame, channels: int = 1) -> DataFrame:
    """(n, key, image, mask): pairs by key, numbered 1..N in key order; the mask is 255 where any of its channels is positive."""
    found = guarded(images.select("key", "image").join(masks.select("key", "mask"), "key"), 1, "pairs")
    found = numbered(found, [F.col("key")], "n")
    return found.select("n", "key", "image", any_positive(F.col("mask"), channels).alias("mask"))


def write_pairs(images: DataFrame, masks: DataFrame, path: str, channels: int = 1) -> None:
    """The numbered pairs as a table; what they were made from stays as it is."""
    numbered_pairs(images, masks, channels).write.mode("overwrite").parquet(path)


def append_scalars(scalars: DataFrame, path: str) -> None:
    """Adds (run, stage, step, tag, value) rows to a log; readers see whole appends."""
    scalars.select("run", "stage", "step", "tag", "value").write.mode("append").partitionBy("run").parquet(path)


def write_results_json(results: DataFrame, path: str, key: str = "arch") -> None:
    """One JSON document for each row; only the partitions that are written are replaced, so a rerun of one key keeps the rest."""
    spark: SparkSession = results.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        results.write.mode("overwrite").partitionBy(key).json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
