"""Queries that pair, filter, split and number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators import pairing as P
from tessella.plans.registry import register
from tessella.session import table


@register("pair_inner", "SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey")
def pair_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderstatus")


NAMES = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'train' || doc_id || '.jpeg' WHEN doc_id % 3 = 1 THEN 'mask' || (doc_id - 1) || '.gif' ELSE 'notes' || doc_id || '.txt' END AS name FROM documents"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.concat(F.lit("train"), i, F.lit(".jpeg"))).when(i % 3 == 1, F.concat(F.lit("mask"), i - 1, F.lit(".gif"))).otherwise(F.concat(F.lit("notes"), i, F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


@register(
    "index_by_name",
    f"""WITH n AS ({NAMES}), i AS (SELECT CAST(regexp_extract(name, '^train([0-9]+)[.]jpeg$', 1) AS BIGINT) AS n, name AS image FROM n WHERE regexp_matches(name, '^train[0-9]+[.]jpeg$')),
    m AS (SELECT CAST(regexp_extract(name, '^mask([0-9]+)[.]gif$', 1) AS BIGINT) AS n, name AS mask FROM n WHERE regexp_matches(name, '^mask[0-9]+[.]gif$'))
    SELECT n, image, mask FROM i JOIN m USING (n)""",
)
def index_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names to numbered image and mask pairs."""
    n = names(spark, sf_dir)
    image = P.last_by_key(n.select(P.numeric_key(F.col("name"), "train", "jpeg").alias("n"), F.col("name").alias("image")), "n", "image")
    mask = P.last_by_key(n.select(P.numeric_key(F.col("name"), "mask", "gif").alias("n"), F.col("name").alias("mask")), "n", "mask")
    return image.join(mask, "n")


@register(
    "pair_string_key",
    """WITH k AS (SELECT p_partkey, p_name || '_' || (p_partkey // 2) AS key, p_partkey % 2 AS side FROM part)
    SELECT a.key, a.p_partkey AS image_part, b.p_partkey AS mask_part FROM k a JOIN k b ON a.key = b.key AND a.side = 0 AND b.side = 1""",
)
def pair_string_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the rest of the file name, whatever the extension's case."""
    p = table(spark, sf_dir, "part")
    half = F.floor(F.col("p_partkey") / 2)
    rest = F.concat_ws("_", "p_name", half)
    even = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("train_"), rest, F.when(half % 2 == 0, ".jpeg").otherwise(".JPG")).alias("f"), F.col("p_partkey").alias("image_part"))
    odd = p.where("p_partkey % 2 = 1").select(F.concat(F.lit("mask_"), rest, F.lit(".gif")).alias("f"), F.col("p_partkey").alias("mask_part"))
    left = even.select(P.string_key(F.col("f"), "train_", ["jpeg", "jpg"]).alias("key"), "image_part")
    return left.join(odd.select(P.string_key(F.col("f"), "mask_", ["gif"]).alias("key"), "mask_part"), "key")


@register("annotations_left", "SELECT c_custkey, count(o_orderkey) AS n_annotations, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), [])::VARCHAR AS annotations FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def annotations_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations grouped by image, empty where there are none; orders are grouped before the join."""
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    df = table(spark, sf_dir, "customer").select("c_custkey").join(grouped, "c_custkey", "left")
    text = F.concat(F.lit("["), F.concat_ws(", ", F.coalesce("l", F.array().cast("array<bigint>")).cast("array<string>")), F.lit("]"))
    return df.select("c_custkey", F.coalesce(F.size("l"), F.lit(0)).cast("bigint").alias("n_annotations"), text.alias("annotations"))


@register("ondisk_semi", "SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ondisk_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@register(
    "eligible_images",
    """SELECT d.doc_id FROM documents d WHERE d.n_chars > 0 AND (d.lang = 'en' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1))""",
)
def eligible_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On disk, and annotated or allowed to be empty."""
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "lang")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return d.where("lang = 'en'").select("doc_id").unionByName(d.where("lang <> 'en' or lang is null").select("doc_id").join(good, "doc_id", "left_semi"))


@register("done_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def done_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@register(
    "coco_group",
    """WITH f AS (SELECT o_orderkey AS image_id, l_linenumber AS id, l_quantity AS area FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT image_id, count(*) AS n, round(sum(area), 6) AS area, string_agg(id::VARCHAR, ',' ORDER BY id, area) AS ids FROM f GROUP BY image_id""",
)
def coco_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of an image as one list."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("area"))
    li = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id")), "image_id")
    g = li.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 6).alias("area"), F.sort_array(F.collect_list(F.struct("id", "area"))).alias("l"))
    return g.select("image_id", "n", "area", F.concat_ws(",", F.col("l.id").cast("array<string>")).alias("ids"))


@register(
    "split_hash",
    """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id)) AS r, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM d""",
)
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_by_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2, 7)


@register("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id) LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the first hundred by a seeded digest, as a distributed top-k."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(F.md5(F.concat_ws(":", F.lit("3"), F.col("doc_id").cast("string")))).limit(100)


@register("renumber", "SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS n, p_partkey, p_name FROM part")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return P.numbered(p, [F.col("p_name"), F.col("p_partkey")], "n").select("n", "p_partkey", "p_name")


@register(
    "batch_loader",
    """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('5:' || event_id)) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, k // 4 AS batch, sum(event_id)::BIGINT AS ids FROM r WHERE n <= 4 OR k // 4 < n // 4 GROUP BY 1, 2""",
)
def batch_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled batches of four; the last short one is dropped where there is more than one batch."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = P.batches(e, ["event_type"], [F.md5(F.concat_ws(":", F.lit("5"), F.col("event_id").cast("string")))], 4, total="n")
    return rows.where("n <= 4 or batch < floor(n / 4)").groupBy("event_type", "batch").agg(F.sum("event_id").alias("ids"))


@register("calibration_files", "SELECT url FROM pages ORDER BY url, page_id LIMIT 50")
def calibration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty names in order: the limit is the operator's, and comes before anything is decoded."""
    return table(spark, sf_dir, "pages").select("url", "page_id").orderBy("url", "page_id").limit(50).select("url")


@register(
    "union_stages",
    "SELECT 1 AS stage, event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT 2, event_id, value FROM events WHERE event_type = 'click'",
)
def union_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    side = lambda s, t: e.where(F.col("event_type") == t).select(F.lit(s).alias("stage"), "event_id", "value")
    return side(1, "view").unionByName(side(2, "click"))


@register("shared_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))
