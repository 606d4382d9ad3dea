"""Queries on pixels and tiles. An embedding of 64 values stands for an 8 x 8 tile with one channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import tiles as T
from tessella.operators import augment as A, metrics as M, rasterize, tiling
from tessella.plans.evaluation import PRF
from tessella.plans.registry import register
from tessella.session import table

SIDE = 8


def digest(px, digits: int = 6):
    """Checks of an array that depend on order: its length, first and last values and a weighted sum."""
    weighted = F.aggregate(F.transform(px, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return [F.size(px).cast("bigint").alias("n"), F.round(F.get(px, F.lit(0)).cast("double"), digits).alias("head"), F.round(F.element_at(px, -1).cast("double"), digits).alias("tail"), F.round(weighted, 4).alias("weighted")]


def _oracle(array: str) -> str:
    return f"""WITH a AS (SELECT vec_id, {array} AS px FROM embeddings)
    SELECT vec_id, len(px) AS n, round(px[1]::DOUBLE, 6) AS head, round(px[len(px)]::DOUBLE, 6) AS tail,
           round(list_sum(list_transform(generate_series(1, len(px)), lambda i: px[i]::DOUBLE * i)), 4) AS weighted FROM a"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _picked(source: str, n: int = SIDE * SIDE) -> str:
    return f"list_transform(generate_series(0, {n - 1}), lambda i: embedding[CAST({source} AS INTEGER) + 1])"


@register("px_normalize", _oracle("list_transform(list_transform(embedding, lambda x: CAST(floor(abs(x) * 255) AS INTEGER) % 256), lambda v: CAST(v / 255.0 AS FLOAT))"))
def px_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.transform("embedding", lambda x: F.floor(F.abs(x) * 255).cast("int") % 256)
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.to_unit(raw)))


@register("px_threshold", _oracle("list_transform(embedding, lambda x: CASE WHEN 1 / (1 + exp(-x::DOUBLE)) >= 0.5 THEN 1.0 ELSE 0.0 END)"))
def px_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    prob = F.transform("embedding", lambda x: M.sigmoid(x.cast("double")))
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.binarize(prob)))


@register("px_any_positive", _oracle("list_transform(generate_series(0, 15), lambda i: CASE WHEN embedding[i * 4 + 1] > 0 OR embedding[i * 4 + 2] > 0 OR embedding[i * 4 + 3] > 0 OR embedding[i * 4 + 4] > 0 THEN 255 ELSE 0 END)"))
def px_any_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.any_positive(F.col("embedding"), 4)))


@register("px_flip_horizontal", _oracle(_picked("(i // 8) * 8 + 7 - i % 8")))
def px_flip_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.flip_horizontal(F.col("embedding"), SIDE, SIDE)))


@register("px_flip_vertical", _oracle(_picked("(7 - i // 8) * 8 + i % 8")))
def px_flip_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.flip_vertical(F.col("embedding"), SIDE, SIDE)))


@register("px_transpose", _oracle(_picked("(i % 8) * 8 + i // 8")))
def px_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.transpose(F.col("embedding"), SIDE, SIDE)))


@register("px_channels_first", _oracle(_picked("(i % 16) * 4 + i // 16")))
def px_channels_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.channels_first(F.col("embedding"), 4, 4, 4)))


@register("px_resize_nearest", _oracle(_picked("least(7, floor((i // 5 + 0.5) * 8 / 5)) * 8 + least(7, floor((i % 5 + 0.5) * 8 / 5))", 25)))
def px_resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.resize_nearest(F.col("embedding"), SIDE, SIDE, 5, 5)))


@register("px_crop", _oracle("list_transform(generate_series(0, CAST(4 * least(4, 8 - vec_id % 6) - 1 AS BIGINT)), lambda i: embedding[CAST(((vec_id % 5) + i // least(4, 8 - vec_id % 6)) * 8 + vec_id % 6 + i % least(4, 8 - vec_id % 6) AS INTEGER) + 1])"))
def px_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four by four, cut off at the right border."""
    top, left = (F.col("vec_id") % 5).cast("int"), (F.col("vec_id") % 6).cast("int")
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.crop(F.col("embedding"), SIDE, SIDE, top, left, 4)))


@register("px_brightness_contrast", _oracle("list_transform(embedding, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x::DOUBLE * 1.5::DOUBLE + 0.1::DOUBLE)))"))
def px_brightness_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("embedding", lambda x: x.cast("double"))
    return _tiles(spark, sf_dir).select("vec_id", *digest(T.brightness_contrast(px, 1.5, 0.1)))


@register(
    "px_counts",
    """WITH p AS (SELECT a.label, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id),
    c AS (SELECT label, sum(CASE WHEN x >= 0 AND y >= 0.1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN x >= 0 AND y < 0.1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN x < 0 AND y >= 0.1 THEN 1 ELSE 0 END) AS fn FROM p GROUP BY label)
    SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def px_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel confusion of aligned tiles; each pair is counted in place, so no pixel becomes a row."""
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("truth"))
    pair = F.zip_with("embedding", "truth", lambda x, y: F.when(x >= 0, 2).otherwise(0) + F.when(y >= F.lit(0.1).cast("double"), 1).otherwise(0))
    count = lambda v: F.coalesce(F.sum(F.size(F.filter("z", lambda z: z == v))), F.lit(0)).cast("bigint")
    df = a.join(b, "vec_id").select("label", pair.alias("z")).groupBy("label").agg(count(3).alias("tp"), count(2).alias("fp"), count(1).alias("fn"))
    return M.rounded(M.prf(df).select("label", "tp", "fp", "fn", "f1"))


@register(
    "tile_starts",
    """WITH d AS (SELECT p_partkey, p_size * 40 AS dim FROM part)
    SELECT p_partkey, dim, CASE WHEN dim <= 512 THEN '0' ELSE array_to_string(list_distinct_sorted, ',') END AS starts
    FROM (SELECT *, list_sort(list_distinct(list_append(generate_series(0, greatest(dim - 512, 0), 512), CAST(dim - 512 AS BIGINT)))) AS list_distinct_sorted FROM d)""",
)
def tile_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.col("p_size") * 40
    starts = F.concat_ws(",", T.tile_starts(dim, 512).cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", dim.alias("dim"), starts.alias("starts"))


@register(
    "grid_tiles",
    """WITH d AS (SELECT p_partkey AS n, p_size * 40 AS h, (p_partkey % 30) * 60 + 100 AS w FROM part),
    s AS (SELECT n, h, w, CASE WHEN h <= 512 THEN [0] ELSE list_distinct(list_append(generate_series(0, h - 512, 512), CAST(h - 512 AS BIGINT))) END AS rows_,
                 CASE WHEN w <= 512 THEN [0] ELSE list_distinct(list_append(generate_series(0, w - 512, 512), CAST(w - 512 AS BIGINT))) END AS cols_ FROM d),
    e AS (SELECT n, h, w, r, unnest(cols_) AS c FROM (SELECT n, h, w, cols_, unnest(rows_) AS r FROM s))
    SELECT n, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CAST(least(512, h - r) AS BIGINT) AS tile_h, CAST(least(512, w - c) AS BIGINT) AS tile_w,
           row_number() OVER (PARTITION BY n ORDER BY r, c) - 1 AS tile_idx FROM e""",
)
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each tile of each image; tiles are numbered within their image, so nothing is shuffled."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), (F.col("p_size") * 40).alias("h"), ((F.col("p_partkey") % 30) * 60 + 100).cast("int").alias("w"))
    rows, cols = T.tile_starts(F.col("h"), 512), T.tile_starts(F.col("w"), 512)
    e = p.select("n", "h", "w", F.size(cols).alias("k"), cols.alias("cols"), F.posexplode(rows).alias("i", "r")).select("n", "h", "w", "k", "i", "r", F.posexplode("cols").alias("j", "c"))
    big = lambda c: c.cast("bigint")
    return e.select("n", big(F.col("r")).alias("r"), big(F.col("c")).alias("c"), big(F.least(F.lit(512), F.col("h") - F.col("r"))).alias("tile_h"), big(F.least(F.lit(512), F.col("w") - F.col("c"))).alias("tile_w"), big(F.col("i") * F.col("k") + F.col("j")).alias("tile_idx"))


@register(
    "polygon_mask",
    """WITH t AS (SELECT p_partkey AS id, p_size % 10 + 3 AS w, p_size % 7 + 3 AS h FROM part),
    px AS (SELECT id, w, h, x, y FROM t, generate_series(0, 15) a(x), generate_series(0, 15) b(y))
    SELECT id, count(*) AS pixels, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM px WHERE (x + 0.5) / w + (y + 0.5) / h < 1 OR (x + 0.5 > 10 AND x + 0.5 < 14 AND y + 0.5 > 2 AND y + 0.5 < 2 + h) GROUP BY id""",
)
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of each image's polygons (a triangle and a rectangle here) on a 16 x 16 canvas, pixel centres tested even-odd."""
    w, h = (F.col("p_size") % 10 + 3).cast("double"), (F.col("p_size") % 7 + 3).cast("double")
    z = F.lit(0.0)
    polygons = F.array(F.array(z, z, w, z, z, h), F.array(F.lit(10.0), F.lit(2.0), F.lit(14.0), F.lit(2.0), F.lit(14.0), h + 2, F.lit(10.0), h + 2), F.array(z, z, w, h))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.lit(16).alias("h"), F.lit(16).alias("w"), F.filter(polygons, lambda q: F.size(q) >= 6).alias("polygons"))
    return rasterize.covered(p).where("pixels > 0").withColumnRenamed("n", "id")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images with a mask of their positive pixels."""
    e = table(spark, sf_dir, "embeddings")
    mask = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float"))
    return e.select(F.col("vec_id").alias("n"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.lit(1).alias("c"), F.col("embedding").alias("image"), mask.alias("mask"))


@register(
    "onnx_score",
    f"""WITH p AS (SELECT vec_id, embedding, unnest(generate_series(0, 63)) AS i FROM embeddings), d(dy, dx) AS (SELECT a, b FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b)),
    l AS (SELECT vec_id, i, any_value(embedding[i + 1]) > 0 AS lit, sum(2.0::DOUBLE * embedding[i + 1 + 8 * dy + dx]::DOUBLE) AS x FROM p, d WHERE i // 8 + dy BETWEEN 0 AND 7 AND i % 8 + dx BETWEEN 0 AND 7 GROUP BY vec_id, i),
    c AS (SELECT vec_id AS n, count(*) FILTER (WHERE 1 / (1 + exp(-x)) >= 0.5 AND lit) AS tp, count(*) FILTER (WHERE 1 / (1 + exp(-x)) >= 0.5 AND NOT lit) AS fp, count(*) FILTER (WHERE NOT 1 / (1 + exp(-x)) >= 0.5 AND lit) AS fn FROM l GROUP BY vec_id)
    SELECT n, tp, fp, fn, {PRF} FROM c""",
)
def onnx_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles scored by a convolution model and counted against their masks."""
    import numpy as np

    from tessella.operators import scoring

    tiles = _images(spark, sf_dir)
    prob = scoring.score(tiles, scoring.small_model(np.full((3, 3), 2.0)))
    pair = F.zip_with("prob", "mask", lambda p, t: F.when(p >= 0.5, 2).otherwise(0) + F.when(t >= 0.5, 1).otherwise(0))
    count = lambda v: F.size(F.filter("z", lambda z: z == v)).cast("bigint")
    df = prob.join(tiles.select("n", "mask"), "n").select("n", pair.alias("z"))
    return M.rounded(M.prf(df.select("n", count(3).alias("tp"), count(2).alias("fp"), count(1).alias("fn"))))


def rgb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 4 x 4 images with three channels in [0, 1] and a mask."""
    e = table(spark, sf_dir, "embeddings")
    image = F.transform(F.slice("embedding", 1, 48), lambda x: M.sigmoid(x.cast("double") * 4).cast("float"))
    mask = F.transform(F.slice("embedding", 49, 16), lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float"))
    return e.select(F.col("vec_id").alias("n"), F.lit(4).alias("h"), F.lit(4).alias("w"), image.alias("image"), mask.alias("mask"))


@register("augment_tiles")
def augment_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile after one epoch's seeded augmentation: rotated, cropped, flipped, with colours shifted."""
    out = A.augment(rgb_images(spark, sf_dir), AUGMENTATION, epoch=1)
    return out.select(F.col("n").alias("tile"), *digest(F.col("image")), F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("lit"))


AUGMENTATION = A.Plan(crop=(2, 4), hsv_p=0.5, seed=7)


@register(
    "rotated_tiles",
    """WITH t AS (SELECT vec_id, embedding AS e, radians((vec_id % 25 - 12) * 7.5::DOUBLE) AS a FROM embeddings),
    p AS (SELECT vec_id, e, i, cos(a) * (i // 8 - 3.5) - sin(a) * (i % 8 - 3.5) + 3.5 AS sy, sin(a) * (i // 8 - 3.5) + cos(a) * (i % 8 - 3.5) + 3.5 AS sx FROM t, generate_series(0, 63) s(i)),
    c AS (SELECT vec_id, e, i, sy, sx, CAST(floor(sy) AS INTEGER) + dy AS y, CAST(floor(sx) AS INTEGER) + dx AS x FROM p, (VALUES (0), (1)) u(dy), (VALUES (0), (1)) v(dx)),
    v AS (SELECT vec_id, i, CAST(coalesce(sum(CASE WHEN y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 THEN (1 - abs(sy - y)) * (1 - abs(sx - x)) * e[y * 8 + x + 1]::DOUBLE END), 0) AS FLOAT)::DOUBLE AS v FROM c GROUP BY vec_id, i)
    SELECT vec_id AS tile, count(*) AS n, round(max(v) FILTER (WHERE i = 0), 4) AS head, round(max(v) FILTER (WHERE i = 63), 4) AS tail, round(sum(v * (i + 1)), 4) AS weighted FROM v GROUP BY vec_id""",
)
def rotated_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile turned by an angle that is given with it; what comes from outside is zero."""
    tiles = _images(spark, sf_dir).withColumn("degrees", (F.col("n") % 25 - 12) * 7.5)
    return _digest4(A.stepped(tiles, A.rotate, "degrees"))


def _digest4(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.col("n").alias("tile"), *digest(F.col("image"), 4))


@register(
    "cropped_tiles",
    """WITH t AS (SELECT vec_id, embedding AS e, vec_id % 7 + 2 AS n, vec_id % 3 * (6 - vec_id % 7) // 2 AS y0, vec_id % 2 * (6 - vec_id % 7) AS x0 FROM embeddings),
    g AS (SELECT vec_id, e, i, n, y0, x0, (i // 8 + 0.5::DOUBLE) * n / 8 - 0.5 AS y, (i % 8 + 0.5::DOUBLE) * n / 8 - 0.5 AS x FROM t, generate_series(0, 63) s(i)),
    c AS (SELECT vec_id, e, i, CASE WHEN dy = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END * CASE WHEN dx = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END AS weight,
          CAST((y0 + least(n - 1, greatest(0, floor(y) + dy))) * 8 + x0 + least(n - 1, greatest(0, floor(x) + dx)) + 1 AS INTEGER) AS place FROM g, (VALUES (0), (1)) u(dy), (VALUES (0), (1)) v(dx)),
    v AS (SELECT vec_id, i, CAST(sum(weight * e[place]::DOUBLE) AS FLOAT)::DOUBLE AS v FROM c GROUP BY vec_id, i)
    SELECT vec_id AS tile, count(*) AS n, round(max(v) FILTER (WHERE i = 0), 4) AS head, round(max(v) FILTER (WHERE i = 63), 4) AS tail, round(sum(v * (i + 1)), 4) AS weighted FROM v GROUP BY vec_id""",
)
def cropped_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given square window of every tile, scaled back to the tile's size."""
    i = F.col("n")
    left = 6 - i % 7
    tiles = _images(spark, sf_dir).withColumns({"side": (i % 7 + 2).cast("int"), "y": F.floor(i % 3 * left / 2).cast("int"), "x": (i % 2 * left).cast("int")})
    return _digest4(A.stepped(tiles, A.cropped, "y", "x", "side"))


@register(
    "coloured_tiles",
    """WITH t AS (SELECT vec_id, list_transform(embedding[1:48], lambda x: CAST(1 / (1 + exp(-(x::DOUBLE * 4))) AS FLOAT)::DOUBLE) AS e FROM embeddings),
    p AS (SELECT vec_id, i, e[i * 3 + 1] AS r, e[i * 3 + 2] AS g, e[i * 3 + 3] AS b FROM t, generate_series(0, 15) s(i)),
    m AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS d FROM p),
    h AS (SELECT vec_id, i, CASE WHEN d = 0 THEN 0 WHEN top = r THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS h, CASE WHEN top > 0 THEN d / top ELSE 0 END AS s, top AS v FROM m),
    n AS (SELECT vec_id, i, h + (vec_id % 11 - 5) * 0.07::DOUBLE AS h, least(1, greatest(0, s + (vec_id % 5 - 2) * 0.1::DOUBLE)) AS s, least(1, greatest(0, v + (vec_id % 3 - 1) * 0.15::DOUBLE)) AS v FROM h),
    f AS (SELECT vec_id, i, v, CAST(floor((h - floor(h)) * 6) AS INTEGER) % 6 AS k, v * (1 - s) AS p, v * (1 - s * ((h - floor(h)) * 6 - floor((h - floor(h)) * 6))) AS q, v * (1 - s * (1 - ((h - floor(h)) * 6 - floor((h - floor(h)) * 6)))) AS t FROM n),
    c AS (SELECT vec_id, i, unnest([0, 1, 2]) AS c, unnest(CASE k WHEN 0 THEN [v, t, p] WHEN 1 THEN [q, v, p] WHEN 2 THEN [p, v, t] WHEN 3 THEN [p, q, v] WHEN 4 THEN [t, p, v] ELSE [v, p, q] END)::FLOAT::DOUBLE AS x FROM f)
    SELECT vec_id AS tile, count(*) AS n, round(max(x) FILTER (WHERE i = 0 AND c = 0), 4) AS head, round(max(x) FILTER (WHERE i = 15 AND c = 2), 4) AS tail, round(sum(x * (i * 3 + c + 1)), 4) AS weighted FROM c GROUP BY vec_id""",
)
def coloured_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile with its hue turned and its saturation and value moved by amounts that are given with it."""
    i = F.col("n")
    tiles = rgb_images(spark, sf_dir).withColumns({"hue": (i % 11 - 5) * 0.07, "saturation": (i % 5 - 2) * 0.1, "value": (i % 3 - 1) * 0.15})
    return _digest4(A.stepped(tiles, A.shift_hsv, "hue", "saturation", "value"))


def _resized(taps: str, size: int) -> str:
    """SQL of an interpolated resize of 8 x 8 to size x size; taps: the weights' cases by the tap's place k and the fraction t."""
    return f"""WITH a AS (SELECT i, (i + 0.5::DOUBLE) * 8 / {size} - 0.5::DOUBLE AS place FROM generate_series(0, {size - 1}) s(i)),
    f AS (SELECT i, CAST(floor(place) AS INTEGER) AS low, place - floor(place) AS t FROM a),
    w AS (SELECT i, CAST(least(7, greatest(0, low + k)) AS INTEGER) AS src, {taps} AS weight FROM f, (VALUES (-1), (0), (1), (2)) v(k)),
    p AS (SELECT vec_id, y.i * {size} + x.i AS i, CAST(sum(y.weight * x.weight * embedding[y.src * 8 + x.src + 1]::DOUBLE) AS FLOAT)::DOUBLE AS v FROM embeddings, w y, w x GROUP BY 1, 2)
    SELECT vec_id AS tile, count(*) AS n, round(max(v) FILTER (WHERE i = 0), 4) AS head, round(max(v) FILTER (WHERE i = {size * size - 1}), 4) AS tail, round(sum(v * (i + 1)), 4) AS weighted FROM p GROUP BY vec_id"""


def _splined(size: int) -> str:
    """SQL of a cubic spline resize of 8 x 8: B-spline weights on coefficients, each of which is a sum of all samples (edges repeated) with the inverse filter's falling weights."""
    return f"""WITH a AS (SELECT i, (i + 0.5::DOUBLE) * 8 / {size} - 0.5::DOUBLE AS place FROM generate_series(0, {size - 1}) s(i)),
    f AS (SELECT i, CAST(floor(place) AS INTEGER) + k AS m, abs(place - floor(place) - k) AS d FROM a, (VALUES (-1), (0), (1), (2)) v(k)),
    t AS (SELECT i, CAST(least(7, greatest(0, m + j)) AS INTEGER) AS src, CASE WHEN d <= 1 THEN 2::DOUBLE / 3 - d ** 2 + d ** 3 / 2 WHEN d < 2 THEN (2 - d) ** 3 / 6 ELSE 0 END * sqrt(3::DOUBLE) * (sqrt(3::DOUBLE) - 2) ** abs(j) AS weight
          FROM f, generate_series(-40, 40) u(j)),
    w AS (SELECT i, src, sum(weight) AS weight FROM t GROUP BY i, src),
    p AS (SELECT vec_id, y.i * {size} + x.i AS i, sum(y.weight * x.weight * embedding[y.src * 8 + x.src + 1]::DOUBLE) AS v, list_min(any_value(embedding))::DOUBLE AS least, list_max(any_value(embedding))::DOUBLE AS most FROM embeddings, w y, w x GROUP BY 1, 2),
    q AS (SELECT vec_id, i, CAST(greatest(least, least(most, v)) AS FLOAT)::DOUBLE AS v FROM p)
    SELECT vec_id AS tile, count(*) AS n, round(max(v) FILTER (WHERE i = 0), 4) AS head, round(max(v) FILTER (WHERE i = {size * size - 1}), 4) AS tail, round(sum(v * (i + 1)), 4) AS weighted FROM q GROUP BY vec_id"""


@register("resize_bicubic", _splined(12))
def resize_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.resize_tiles(_images(spark, sf_dir), 12, 12).select(F.col("n").alias("tile"), *digest(F.col("image"), 4))


@register("resize_catmull_rom", _resized("CASE WHEN abs(t - k) <= 1 THEN 1.5::DOUBLE * abs(t - k) ** 3 - 2.5::DOUBLE * abs(t - k) ** 2 + 1 ELSE -0.5::DOUBLE * abs(t - k) ** 3 + 2.5::DOUBLE * abs(t - k) ** 2 - 4 * abs(t - k) + 2 END", 12))
def resize_catmull_rom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.resize_tiles(_images(spark, sf_dir), 12, 12, "catmull-rom").select(F.col("n").alias("tile"), *digest(F.col("image"), 4))


@register("resize_bilinear", _resized("CASE WHEN k = 0 THEN 1 - t WHEN k = 1 THEN t ELSE 0 END", 5))
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.resize_tiles(_images(spark, sf_dir), 5, 5, "bilinear").select(F.col("n").alias("tile"), *digest(F.col("image"), 4))


@register(
    "cut_tiles",
    """WITH t AS (SELECT vec_id AS tile, r, c0, embedding FROM embeddings, (VALUES (0), (3)) a(r), (VALUES (0), (3)) b(c0)),
    p AS (SELECT tile, r, c0, i, embedding[(r + i // 5) * 8 + c0 + i % 5 + 1]::DOUBLE AS v FROM t, generate_series(0, 24) s(i))
    SELECT tile, r, c0, 5 AS tile_h, 5 AS tile_w, count(*) AS n, round(max(v) FILTER (WHERE i = 0), 6) AS head, round(max(v) FILTER (WHERE i = 24), 6) AS tail, round(sum(v * (i + 1)), 4) AS weighted, sum(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS lit FROM p GROUP BY tile, r, c0""",
)
def cut_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and masks of 8 x 8 cut into tiles of 5 x 5, the last ones moved back to the border."""
    t = tiling.cut_tiles(_images(spark, sf_dir), 5)
    return t.select(F.col("n").alias("tile"), "r", "c0", "tile_h", "tile_w", *digest(F.col("image")), F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("lit"))


@register(
    "tile_order",
    """WITH d AS (SELECT p_partkey AS n, p_size * 40 AS h FROM part), s AS (SELECT n, unnest(CASE WHEN h <= 512 THEN [0] ELSE list_distinct(list_append(generate_series(0, h - 512, 512), CAST(h - 512 AS BIGINT))) END) AS r FROM d)
    SELECT n, CAST(r AS BIGINT) AS r, row_number() OVER (ORDER BY n, r) - 1 AS tile_idx FROM s""",
)
def tile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles numbered over the whole set, image by image, without gathering them in one task."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.explode(T.tile_starts(F.col("p_size") * 40, 512)).alias("r"), F.lit(0).alias("c0"))
    return tiling.tile_index(p).select("n", F.col("r").cast("bigint").alias("r"), "tile_idx")


@register("tile_batch", "SELECT vec_id AS tile, 64 * 3 AS n, round(embedding[1]::DOUBLE, 6) AS head, round(embedding[64]::DOUBLE, 6) AS tail, round(list_sum(list_transform(generate_series(1, 192), lambda i: embedding[CAST((i - 1) % 64 + 1 AS INTEGER)]::DOUBLE * i)), 4) AS weighted FROM embeddings")
def tile_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile as a batch of three."""
    return _tiles(spark, sf_dir).select(F.col("vec_id").alias("tile"), *digest(T.repeated(F.col("embedding"), 3)))
