"""Queries that build datasets: numbered pairs, rasterised annotations, fixed validation sets, results read back, runs that may fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators import harness, pairing as P, rasterize
from tessella.plans.registry import register
from tessella.plans.tiling import digest
from tessella.session import spread, table
from tessella.sources import scalars, sinks


@register(
    "numbered_pairs",
    """WITH e AS (SELECT vec_id, embedding, (vec_id * 7919 % 100000)::VARCHAR AS key FROM embeddings),
    j AS (SELECT a.key, a.vec_id, b.embedding AS m FROM e a JOIN e b ON a.vec_id = b.vec_id - 1 AND a.vec_id % 2 = 0)
    SELECT row_number() OVER (ORDER BY key) AS pair, key, vec_id AS image_id, 16 AS n, round(CASE WHEN list_max(m[1:4]) > 0 THEN 255 ELSE 0 END::DOUBLE, 6) AS head, round(CASE WHEN list_max(m[61:64]) > 0 THEN 255 ELSE 0 END::DOUBLE, 6) AS tail,
           round(list_sum(list_transform(generate_series(1, 16), lambda i: CASE WHEN list_max(m[CAST(i * 4 - 3 AS INTEGER):CAST(i * 4 AS INTEGER)]) > 0 THEN 255.0::DOUBLE ELSE 0 END * i)), 4) AS weighted FROM j""",
)
def numbered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and masks by a string key, numbered in key order, masks 255 where any of four channels is positive."""
    e = table(spark, sf_dir, "embeddings")
    key = lambda i: (i * 7919 % 100000).cast("string").alias("key")
    images = e.where("vec_id % 2 = 0").select(key(F.col("vec_id")), F.col("vec_id").alias("image"))
    masks = e.where("vec_id % 2 = 1").select(key(F.col("vec_id") - 1), F.col("embedding").alias("mask"))
    out = sinks.numbered_pairs(images, masks, channels=4)
    return out.select(F.col("n").alias("pair"), "key", F.col("image").alias("image_id"), *digest(F.col("mask")))


@register(
    "coco_masks",
    """WITH a AS (SELECT l_orderkey AS n, l_linenumber AS x0, CAST(l_quantity AS INTEGER) % 10 AS y0 FROM lineitem),
    px AS (SELECT DISTINCT n, x, y FROM a, generate_series(0, 15) u(x), generate_series(0, 15) v(y) WHERE x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 3)
    SELECT n, count(*) AS pixels, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM px GROUP BY n""",
)
def coco_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of all images with annotations: rectangles grouped by image, rasterised and united on a canvas of 16 x 16."""
    x, y = F.col("l_linenumber").cast("double"), (F.col("l_quantity").cast("int") % 10).cast("double")
    polygon = F.array(x, y, x + 4, y, x + 4, y + 3, x, y + 3)
    grouped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("n"), polygon.alias("p")).groupBy("n").agg(F.collect_list("p").alias("polygons"))
    return rasterize.covered(grouped.select("n", F.lit(16).alias("h"), F.lit(16).alias("w"), "polygons"))


@register(
    "outline_masks",
    """WITH t AS (SELECT l_orderkey AS n, row_number() OVER () AS k, l_linenumber - 2 AS x0, CAST(l_quantity AS INTEGER) % 12 AS y0, l_partkey % 9 AS w, l_suppkey % 7 AS h FROM lineitem),
    e AS (SELECT n, k, [x0, y0, x0 + w, y0 + h] AS e FROM t UNION ALL SELECT n, k, [x0 + w, y0 + h, x0 - 3, y0 + 5] FROM t UNION ALL SELECT n, k, [x0 - 3, y0 + 5, x0, y0] FROM t),
    d AS (SELECT n, k, e[1] AS ax, e[2] AS ay, e[3] AS bx, e[4] AS b_y FROM e),
    c AS (SELECT n, k, y, ax + (y - ay) * (bx - ax)::DOUBLE / (b_y - ay) AS x FROM d, generate_series(0, 15) s(y) WHERE ay <> b_y AND y >= least(ay, b_y) AND y < greatest(ay, b_y)),
    o AS (SELECT n, k, y, x, lead(x) OVER w AS x2, row_number() OVER w AS r FROM c WINDOW w AS (PARTITION BY n, k, y ORDER BY x)),
    p AS (SELECT n, y, unnest(generate_series(CAST(floor(x + 0.5) AS BIGINT), CAST(greatest(floor(x + 0.5), ceil(x2 - 0.5)) AS BIGINT))) AS x FROM o WHERE r % 2 = 1
          UNION SELECT n, ay, ax FROM d UNION SELECT n, ay, unnest(generate_series(least(ax, bx), greatest(ax, bx))) FROM d WHERE ay = b_y),
    i AS (SELECT DISTINCT n FROM t)
    SELECT i.n, count(p.x) AS pixels, coalesce(sum(p.x), 0)::BIGINT AS sx, coalesce(sum(p.y), 0)::BIGINT AS sy FROM i LEFT JOIN p ON p.n = i.n AND p.x BETWEEN 0 AND 15 AND p.y BETWEEN 0 AND 15 GROUP BY i.n""",
)
def outline_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles, thin and degenerate ones too, partly outside a canvas of 16 x 16, filled with their outlines."""
    x, y = F.col("l_linenumber") - 2, F.col("l_quantity").cast("int") % 12
    w, h = F.col("l_partkey") % 9, F.col("l_suppkey") % 7
    polygon = F.array(*[c.cast("double") for c in (x, y, x + w, y + h, x - 3, y + 5)])
    grouped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("n"), polygon.alias("p")).groupBy("n").agg(F.collect_list("p").alias("polygons"))
    return rasterize.covered(spread(grouped.select("n", F.lit(16).alias("h"), F.lit(16).alias("w"), "polygons")), "outline")


@register("fixed_validation", "SELECT o_orderkey AS n, 'train' AS split FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'val' FROM orders WHERE o_orderstatus = 'F'")
def fixed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given validation set in place of a random split."""
    o = table(spark, sf_dir, "orders")
    side = lambda c: o.where(c).select(F.col("o_orderkey").alias("n"))
    return P.fixed_validation(side("o_orderstatus <> 'F'"), side("o_orderstatus = 'F'"))


@register(
    "results_rows",
    """SELECT event_type AS arch, count(*) AS params, round(avg(value), 6) AS f1, round(coalesce(max(value) FILTER (WHERE user_id < 5), avg(value)), 6) AS best FROM events GROUP BY event_type""",
)
def results_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results document, a map of architectures, back to rows; the best of the second stage's curve, else the final value."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("params"), F.struct(F.avg("value").alias("f1")).alias("metrics"), F.collect_list(F.when(F.col("user_id") < 5, F.col("value"))).alias("stage2_f1"))
    entries = F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("params", "metrics", "stage2_f1"))))
    r = scalars.results(e.agg(F.to_json(entries).alias("value")))
    return r.select("arch", "params", F.round("metrics.f1", 6).alias("f1"), F.round(F.coalesce(F.array_max("stage2_f1"), "metrics.f1"), 6).alias("best"))


@register(
    "isolated_runs",
    """SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN round(100.0::DOUBLE / (p_size % 5), 6) END AS result, CASE WHEN p_size % 5 = 0 THEN 'ZeroDivisionError: float division by zero' END AS error FROM part""",
)
def isolated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each row of which some fail; the others aren't touched."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).cast("double").alias("size"))
    return harness.attempted(p, "id", lambda row: 100.0 / row.size).withColumn("result", F.round("result", 6))
