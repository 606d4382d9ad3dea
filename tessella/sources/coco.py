"""Annotation documents in the COCO layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators.pairing import guarded, numbered
from tessella.operators.rasterize import masks

SCHEMA = "images array<struct<id: bigint, file_name: string, width: int, height: int>>, annotations array<struct<id: bigint, image_id: bigint, segmentation: string>>"


def read_coco(spark: SparkSession, path: str, allow_empty: bool = True, lines: bool = False) -> DataFrame:
    """(id, file_name, width, height, polygons): every image with the polygons of all its annotations, each of three points or more.

    A segmentation that isn't a list (a run-length mask) is an error. A file is one document; with lines, each line is one, so that files can be split. Ids hold over all documents.
    """
    doc = spark.read.schema(SCHEMA).option("multiLine", not lines).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    ann = doc.select(F.explode("annotations").alias("a")).select("a.*")
    is_list = F.substring(F.ltrim("segmentation"), 1, 1) == "["
    checked = F.when(is_list, F.col("segmentation")).otherwise(F.raise_error(F.concat(F.lit("annotation "), F.col("id").cast("string"), F.lit(" has no polygon list"))).cast("string"))
    polygons = F.filter(F.from_json(checked, "array<array<double>>"), lambda p: F.floor(F.size(p) / 2) >= 3)
    grouped = ann.select("image_id", "id", polygons.alias("p")).groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda s: s["p"])).alias("polygons"))
    out = images.join(grouped.withColumnRenamed("image_id", "id"), "id", "left" if allow_empty else "inner")
    return out.withColumn("polygons", F.coalesce("polygons", F.array().cast("array<array<double>>")))


def pairs(annotated: DataFrame, files: DataFrame, limit: int | None = None, seed: int = 0, rule: str = "centres") -> DataFrame:
    """(n, file_name, h, w, image, mask): numbered pairs of images and the masks of their polygons. files: (file_name, image); only images that are there count; rule: how polygons are filled (see rasterize).

    With a limit, so many are taken by a seeded digest of their ids; fewer than that is an error.
    """
    there = annotated.join(files.select("file_name"), "file_name", "left_semi")
    if limit is not None:
        there = guarded(there.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))).limit(limit), limit, "images on disk")
    there = numbered(there, [F.col("id")], "n").select("n", "file_name", F.col("height").alias("h"), F.col("width").alias("w"), "polygons")
    return there.select("n", "file_name").join(masks(there, rule), "n").join(files.select("file_name", "image"), "file_name").select("n", "file_name", "h", "w", "image", "mask")
