"""Queries over files that are first written from the given tables: pairs, sizes, digests, numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators import pairing as P
from tessella.plans.registry import register
from tessella.plans.tiling import digest
from tessella.session import new_path, spread, table
from tessella.sources import coco, images, logs, pairs, ranges, scalars, sinks


def number(prefix: str, extension: str):
    return P.numeric_key(ranges.name_of(F.col("path")), prefix, extension).alias("n")


@register(
    "pair_files",
    """WITH p AS (SELECT page_id AS n, coalesce(html, '') AS h, embedding AS e FROM pages JOIN embeddings ON page_id = vec_id)
    SELECT n, strlen(h) AS length, sha256(h) AS sha256, len(list_filter(e, lambda x: x > 0)) AS pixels,
           CAST(list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN e[i] > 0 THEN i ELSE 0 END)) AS BIGINT) AS weighted FROM p""",
)
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered files and masks written by the sink and read back: the files' digests by chunks, the masks' pixels from their GIFs."""
    path = new_path(spark, "pairs")
    source = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "embeddings"), F.col("page_id") == F.col("vec_id"))
    image = F.coalesce("html", F.lit("")).cast("binary")
    written = source.select(F.col("page_id").alias("n"), F.lit("html").alias("extension"), image.alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("mask"))
    pairs.write_pair_files(spread(written), path)
    files = ranges.digests(spark, f"{path}/train").select(number("train", "html"), "length", "sha256")
    masks = images.read_palette_masks(spark, f"{path}/mask").select(number("mask", "gif"), "data")
    weighted = F.aggregate(F.transform("data", lambda x, i: F.when(x > 0, i + 1).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    pixels = F.size(F.filter("data", lambda x: x > 0)).cast("long")
    return files.join(masks, "n").select("n", "length", "sha256", pixels.alias("pixels"), weighted.alias("weighted"))


@register("header_sizes", "SELECT vec_id AS n, CAST(2 ** (vec_id % 7) AS INTEGER) AS h, CAST(2 ** (6 - vec_id % 7) AS INTEGER) AS w FROM embeddings")
def header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights and widths from the headers of image files."""
    path = new_path(spark, "sizes")
    h = F.pow(F.lit(2), F.col("vec_id") % 7).cast("int")
    tiles = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.lit("bin").alias("extension"), F.lit("").cast("binary").alias("image"), h.alias("h"), (64 / h).cast("int").alias("w"), F.col("embedding").alias("mask"))
    pairs.write_pair_files(spread(tiles), path)
    return images.read_sizes(spark, f"{path}/mask").select(number("mask", "gif"), "h", "w")


@register(
    "numbered_log",
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id || ' ' || event_type AS line FROM events",
)
def numbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file for each user, read by ranges with the number of each line in its file."""
    path = new_path(spark, "logs")
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("value")
    rows = spread(table(spark, sf_dir, "events"), "user_id").sortWithinPartitions("user_id", "ts", "event_id")
    rows.select("user_id", line).write.partitionBy("user_id").text(path)
    found = ranges.numbered_lines(spark, path, "*.txt", chunk=1 << 14, recursive=True)
    return found.select(F.regexp_extract("path", "user_id=([0-9]+)/", 1).cast("long").alias("user_id"), "pos", "line")


def _drawn_pairs(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Embeddings as grey image files of 8 x 8 and masks of their positive values."""
    grey = F.transform("embedding", lambda x: F.floor(F.abs(x) * 255).cast("int") % 256)
    tiles = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), grey.alias("grey"), F.col("embedding").alias("mask"))

    def drawn(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            made = [pairs.grey_gif(np.array(g, np.uint8).reshape(8, 8)) for g in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), b.column(2)], ["n", "image", "mask"])

    made = spread(tiles).mapInArrow(drawn, "n long, image binary, mask array<float>")
    pairs.write_pair_files(made.withColumns({"extension": F.lit("gif"), "h": F.lit(8), "w": F.lit(8)}), path)


@register(
    "calibration_set",
    """WITH c AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY 'train' || vec_id || '.gif') AS k FROM embeddings),
    p AS (SELECT k, vec_id, i, CAST((CAST(floor(abs(embedding[i + 1]) * 255) AS INTEGER) % 256) / 255.0 AS FLOAT)::DOUBLE AS v FROM c, generate_series(0, 63) s(i) WHERE k <= 50)
    SELECT k, vec_id, 192::BIGINT AS n, round(max(v) FILTER (WHERE i = 0), 5) AS head, round(max(v) FILTER (WHERE i = 63), 5) AS tail, round(sum(v * (3 * (i + 1) + 192)), 4) AS weighted FROM p GROUP BY k, vec_id""",
)
def calibration_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty image files by name, decoded, scaled and with channels first: the limit is the operator's, and comes before anything is decoded."""
    path = new_path(spark, "calibration")
    _drawn_pairs(spark, sf_dir, path)
    found = images.calibration(spark, path, 50, 8, ["gif"])
    return found.select(F.col("n").alias("k"), number("train", "gif").alias("vec_id"), *digest(F.col("data"), 5))


@register(
    "evaluated_logs",
    """SELECT user_id, CAST(printf('%.4f', avg(value)) AS DOUBLE) AS loss, CAST(printf('%.4f', max(value) / 900) AS DOUBLE) AS "precision", CAST(printf('%.4f', min(value) / 7) AS DOUBLE) AS recall, CAST(printf('%.4f', avg(value) / 900) AS DOUBLE) AS f1 FROM events GROUP BY user_id""",
)
def evaluated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final scores of each run, from log files with an evaluation block that goes over several lines."""
    path, v = new_path(spark, "logs"), F.col("value")
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(v).alias("a"), (F.max(v) / 900).alias("b"), (F.min(v) / 7).alias("c"), (F.avg(v) / 900).alias("d"))
    lines = [F.lit("Epoch 1 of 1"), F.lit("Evaluation on the test set"), F.lit("     loss Precision"), F.format_string("%.4f %.4f", "a", "b"), F.lit("   Recall   F1Score"), F.format_string("%.4f %.4f", "c", "d"), F.lit("done in 3.5")]
    rows = spread(runs, "user_id").select("user_id", F.posexplode(F.array(*lines)).alias("pos", "value"))
    rows.sortWithinPartitions("user_id", "pos").select("user_id", "value").write.partitionBy("user_id").text(path)
    found = ranges.numbered_lines(spark, path, "*.txt", recursive=True)
    found = found.select(F.regexp_extract("path", "user_id=([0-9]+)/", 1).cast("long").alias("user_id"), "pos", "line")
    return logs.evaluation(found, ["user_id"], "pos")


@register(
    "annotation_documents",
    """WITH a AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 4 = 0 THEN [l_linenumber, l_suppkey, 3, 4] ELSE [l_linenumber, l_suppkey, 3, 4, l_partkey, 6] END AS p FROM lineitem),
    g AS (SELECT id, count(*) AS polygons, sum(list_sum(p)) AS total FROM a WHERE len(p) >= 6 GROUP BY id)
    SELECT o_orderkey AS id, 'im' || o_orderkey || '.tif' AS file_name, coalesce(polygons, 0) AS polygons, round(coalesce(total, 0)::DOUBLE, 6) AS total FROM orders LEFT JOIN g ON g.id = o_orderkey""",
)
def annotation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation documents, one for each customer and line, written and read back: images with the polygons of their annotations that have three points at least."""
    path = new_path(spark, "annotations")
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c = lambda *x: F.array(*[v.cast("double") if not isinstance(v, int) else F.lit(float(v)) for v in x])
    polygon = F.when(F.col("l_linenumber") % 4 == 0, c(F.col("l_linenumber"), F.col("l_suppkey"), 3, 4)).otherwise(c(F.col("l_linenumber"), F.col("l_suppkey"), 3, 4, F.col("l_partkey"), 6))
    images_ = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("im"), "o_orderkey", F.lit(".tif")).alias("file_name"), F.lit(20).alias("width"), F.lit(20).alias("height"))).alias("images"))
    notes = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.collect_list(F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), F.array(polygon).alias("segmentation"))).alias("annotations"))
    images_.join(notes, "o_custkey", "left").select(F.to_json(F.struct("images", F.coalesce("annotations", F.expr("cast(array() as array<struct<id: bigint, image_id: bigint, segmentation: array<array<double>>>>)")).alias("annotations"))).alias("value")).write.text(path)
    found = coco.read_coco(spark, path, lines=True)
    total = F.aggregate(F.flatten("polygons"), F.lit(0.0), lambda a, x: a + x)
    return found.select("id", "file_name", F.size("polygons").cast("long").alias("polygons"), F.round(total, 6).alias("total"))


@register(
    "written_splits",
    "SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, doc_id AS key, row_number() OVER (PARTITION BY doc_id % 5 = 0 ORDER BY doc_id) AS n, lang FROM documents",
)
def written_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits as partitions, each numbered in key order, written and read back."""
    path = new_path(spark, "splits")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "lang", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))
    sinks.write_splits(d, path)
    return spark.read.parquet(path).select("split", "key", "n", "lang")


def _history(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "history")
    e, v = table(spark, sf_dir, "events"), F.col("value")
    rows = e.select((F.col("event_id") % 2 + 1).cast("int").alias("stage"), F.col("event_id").cast("int").alias("epoch"), v.alias("loss"), F.when(F.col("event_id") % 3 > 0, v / 900).alias("val_f1"), F.when(F.col("event_id") % 5 > 0, v / 7).alias("lr"))
    sinks.write_metrics_csv(rows, path)
    return path


@register(
    "metrics_file",
    "SELECT event_id % 2 + 1 AS stage, event_id AS epoch, round(value, 6) AS loss, CAST(NULL AS DOUBLE) AS f1, round(CASE WHEN event_id % 3 > 0 THEN value / 900 END, 9) AS val_f1, round(CASE WHEN event_id % 5 > 0 THEN value / 7 END, 9) AS lr FROM events",
)
def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all epochs as a CSV file with empty cells, read back."""
    rows = spark.read.schema(scalars.CURVE).option("header", True).csv(_history(spark, sf_dir))
    return rows.select("stage", "epoch", F.round("loss", 6).alias("loss"), "f1", F.round("val_f1", 9).alias("val_f1"), F.round("lr", 9).alias("lr"))


@register("curve_file", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, round(value / 900, 4) AS f1 FROM events WHERE event_id % 2 = 1 AND event_id % 3 > 0")
def curve_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stage's curve from the metrics file, in the order of its epochs, empty cells left out."""
    return scalars.read_curve(spark, _history(spark, sf_dir), 2).select(F.posexplode("curve").alias("place", "f1")).withColumn("place", F.col("place").cast("long"))


@register("results_file", "SELECT event_type AS arch, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END * count(*) AS params, round(avg(value), 6) AS f1 FROM events GROUP BY event_type")
def results_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by model as JSON; the second run of one model takes its place and leaves the others."""
    path = new_path(spark, "results")
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arch")).agg(F.count("*").alias("params"), F.avg("value").alias("f1"))
    sinks.write_results_json(r, path)
    sinks.write_results_json(r.where("arch = 'view'").withColumn("params", F.col("params") * 2), path)
    return spark.read.json(path).select("arch", "params", F.round("f1", 6).alias("f1"))


@register("scalar_log", "SELECT 'run' || (user_id % 4) AS run, event_type AS tag, count(*) AS n, min(event_id) AS first_step, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def scalar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of scalars that is added to twice, read back by run and tag."""
    path = new_path(spark, "scalars")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("run"), F.col("user_id") % 4).alias("run"), F.lit(1).alias("stage"), F.col("event_id").alias("step"), F.col("event_type").alias("tag"), "value")
    sinks.append_scalars(e.where("step % 2 = 0"), path)
    sinks.append_scalars(e.where("step % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("run", "tag").agg(F.count("*").alias("n"), F.min("step").alias("first_step"), F.round(F.sum("value"), 4).alias("total"))


@register(
    "decoded_tiles",
    """SELECT vec_id AS n, 8 AS h, 8 AS w, 3 AS c, CAST(list_sum(list_transform(generate_series(1, 64), lambda i: (CAST(floor(abs(embedding[i]) * 255) AS INTEGER) % 256) * i)) AS BIGINT) AS weighted,
       len(list_filter(embedding, lambda x: x > 0)) AS lit FROM embeddings""",
)
def decoded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files and their masks decoded at their own resolution."""
    path = new_path(spark, "tiles")
    _drawn_pairs(spark, sf_dir, path)
    tiles = images.read_tiles(spark, f"{path}/train", "train", "gif")
    masks = images.masks(images.read_tiles(spark, f"{path}/mask", "mask", "gif"))
    first = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("data", i * F.col("c")) * (i + 1))
    weighted = F.aggregate(first, F.lit(0).cast("long"), lambda a, x: a + x)
    lit = masks.select("n", F.size(F.filter("data", lambda x: x > 0)).cast("long").alias("lit"))
    return tiles.select("n", "h", "w", "c", weighted.alias("weighted")).join(lit, "n")
