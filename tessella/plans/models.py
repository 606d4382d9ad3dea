"""Queries on models as bytes: contract, parameters, names; several models in one pass; weights and their quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.functions import tiles as T
from tessella.operators import contract, layers, metrics as M, quantize, scoring
from tessella.plans.registry import register
from tessella.plans.releases import SHAPES
from tessella.plans.tiling import digest
from tessella.session import spread, table
from tessella.sources import graphs


def value(name: Column, dims: Column) -> Column:
    return F.struct(name.alias("name"), dims.alias("dims"))


NO_TENSORS = "cast(array() as array<struct<name: string, dims: array<bigint>>>)"


def declared_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, model): a model's bytes for each order, with shapes and names that follow from its number; every 17th is cut off."""
    k, s = F.col("o_orderkey"), F.lit
    dims = F.array(F.when(k % 3 == 0, "1").otherwise("batch"), F.when(k % 5 == 0, "4").otherwise("3"), F.when(k % 4 == 0, "256").when(k % 4 == 1, "h").otherwise("512"), s("512"))
    none = F.array().cast("array<struct<name: string, dims: array<string>>>")
    inputs = F.when(k % 13 == 0, none).otherwise(F.array(value(F.concat(s("x"), k), dims)))
    outputs = F.array(value(F.concat(s("y"), k), F.when(k % 7 == 0, F.array(s("batch"), s("1"), s("512"))).otherwise(F.array(s("batch"), s("1"), s("h"), s("w")))))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(k.alias("id"), inputs.alias("inputs"), outputs.alias("outputs"), F.expr(NO_TENSORS).alias("tensors"))
    cut = F.expr("substring(model, 1, octet_length(model) - 20)")
    return graphs.write_models(rows, "id").withColumn("model", F.when(F.col("id") % 17 == 0, cut).otherwise(F.col("model")))


@register(
    "contract_bytes",
    f"""WITH s AS ({SHAPES}), q AS (SELECT id, CASE WHEN id % 17 = 0 THEN ['readable'] WHEN len(i) <> 1 OR len(o) <> 1 THEN ['one input and one output'] ELSE list_filter([
      CASE WHEN len(i[1]) <> 4 THEN 'input rank' END, CASE WHEN regexp_matches(i[1][1], '^-?[0-9]+$') THEN 'input batch' END, CASE WHEN i[1][2] <> '3' THEN 'input channels' END,
      CASE WHEN i[1][3] <> '512' AND regexp_matches(i[1][3], '^-?[0-9]+$') THEN 'input side' END, CASE WHEN len(o[1]) <> 4 THEN 'output rank' END], lambda x: x IS NOT NULL) END AS rules FROM s)
    SELECT id, array_to_string(rules, ', ') AS broken FROM q""",
)
def contract_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that each model breaks, from its bytes."""
    found = contract.broken_graphs(graphs.signatures(declared_models(spark, sf_dir)))
    return found.select("id", F.array_join("broken", ", ").alias("broken"))


@register(
    "renamed_models",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN 'input' END AS input, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN 'output' END AS output,
       CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN 11 - 2 - 2 * length(o_orderkey::VARCHAR) END AS longer FROM orders""",
)
def renamed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and outputs under their fixed names; those that have none, or can't be read, have no new bytes."""
    before = declared_models(spark, sf_dir).withColumn("size", F.octet_length("model")).select("id", "size", "model")
    after = graphs.rename_io(before).withColumn("longer", F.octet_length("model") - F.col("size")).select("id", "longer", "model")
    name = lambda c: F.get(F.col(c), F.lit(0))["name"]
    return graphs.signatures(after).select("id", name("inputs").alias("input"), name("outputs").alias("output"), "longer")


BASES = (64, 128, 256, 512, 1024)


def network(mult: Column) -> Column:
    """The tensors of an encoder-decoder network of this width: two convolutions a level with norms behind them, transposed ones on the way up, and a head."""
    w = [T.scale_width(F.lit(b), mult).cast("long") for b in BASES]
    n = lambda *x: F.array(*[F.lit(v).cast("long") if isinstance(v, int) else v for v in x])
    tensor = lambda name, dims: F.struct(F.lit(name).alias("name"), dims.alias("dims"))

    def double(name: str, i: Column | int, o: Column) -> list[Column]:
        out = [tensor(f"{name}.{k}.conv", n(o, c, 3, 3)) for k, c in enumerate((i, o))]
        return out + [tensor(f"{name}.{k}.{p}", n(o)) for k in (0, 1) for p in ("scale", "shift")]

    down = [t for k, o in enumerate(w) for t in double(f"down{k}", w[k - 1] if k else 3, o)]
    up = [t for k in range(4) for t in [tensor(f"up{k}.conv", n(w[k + 1], w[k], 2, 2)), tensor(f"up{k}.bias", n(w[k])), *double(f"up{k}", 2 * w[k], w[k])]]
    return F.array(*down, *up, tensor("head.conv", n(1, w[0], 1, 1)), tensor("head.bias", n(1)))


@register(
    "width_params",
    """WITH m AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS mult FROM part), b(k, base) AS (VALUES (1, 64), (2, 128), (3, 256), (4, 512), (5, 1024)),
    w AS (SELECT p_partkey, k, CAST(greatest(8, round_even(base * mult / 8, 0) * 8) AS BIGINT) AS w FROM m, b),
    p AS (SELECT p_partkey, k, w, lag(w) OVER (PARTITION BY p_partkey ORDER BY k) AS prev, lead(w) OVER (PARTITION BY p_partkey ORDER BY k) AS next FROM w),
    q AS (SELECT p_partkey, k, w, 9 * coalesce(prev, 3) * w + 9 * w * w + 4 * w AS down, CASE WHEN next IS NULL THEN 0 ELSE 4 * next * w + w + 9 * (2 * w) * w + 9 * w * w + 4 * w END AS up, CASE WHEN k = 1 THEN w + 1 ELSE 0 END AS head FROM p)
    SELECT p_partkey, 64::BIGINT AS tensors, CAST(sum(down + up + head) AS BIGINT) AS params, max(w) AS widest, CAST(round(sum(down + up + head) / 1e6, 1) AS VARCHAR) || 'M' AS label FROM q GROUP BY p_partkey""",
)
def width_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the networks that parts of different sizes stand for, counted from their models' tensors."""
    none = F.array().cast("array<struct<name: string, dims: array<string>>>")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", none.alias("inputs"), none.alias("outputs"), network(F.col("p_size") / 50.0).alias("tensors"))
    found = graphs.signatures(graphs.write_models(rows, "p_partkey"))
    widest = F.array_max(F.transform("tensors", lambda t: F.get(t["dims"], F.lit(0))))
    found = found.select("p_partkey", F.size("tensors").cast("long").alias("tensors"), graphs.parameters(F.col("tensors")).alias("params"), widest.alias("widest"))
    return found.withColumn("label", F.concat(F.round(F.col("params") / 1e6, 1).cast("string"), F.lit("M")))


QUANTISED = """WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings), r AS (SELECT label, least(min(v), 0) AS low, greatest(max(v), 0) AS high FROM v GROUP BY label),
    s AS (SELECT label, {scale} AS scale, {zero} AS zero FROM (SELECT *, (high - low) / 255 AS width FROM r)),
    q AS (SELECT label, scale, zero, v, greatest({least}, least({most}, round_even(v / scale, 0) + zero)) AS q FROM v JOIN s USING (label))
    SELECT label, round(any_value(scale), 9) AS scale, CAST(any_value(zero) AS INTEGER) AS zero, count(*) AS n, round(max(abs(v - (q - zero) * scale)), 9) AS worst, round(avg((v - (q - zero) * scale) ** 2), 12) AS mean_square FROM q GROUP BY label"""


def _quantised(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = quantize.errors(quantize.quantise(table(spark, sf_dir, "embeddings").select("label", "embedding"), ["label"], "embedding", kind), ["label"], "embedding")
    return df.select("label", F.round("scale", 9).alias("scale"), "zero", F.col("n").cast("long").alias("n"), F.round("worst", 9).alias("worst"), F.round("mean_square", 12).alias("mean_square"))


@register("quantised_activations", QUANTISED.format(scale="width", zero="greatest(0, least(255, round_even(-low / width, 0)))", least=0, most=255))
def quantised_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned eight bits with a zero point for each channel, and what is lost by them."""
    return _quantised(spark, sf_dir, "uint8")


@register("quantised_weights", QUANTISED.format(scale="greatest(-low, high) / 127", zero="0", least=-127, most=127))
def quantised_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed eight bits for each channel, and what is lost by them."""
    return _quantised(spark, sf_dir, "int8")


@register(
    "layer_zip",
    """WITH a AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, embedding FROM embeddings),
    p AS (SELECT n, vec_id, j, embedding[CAST((j % 2) * 32 + (j // 2 % 8) * 4 + (j // 16 % 2) * 2 + j // 32 + 1 AS INTEGER)]::DOUBLE AS v FROM a, generate_series(0, 63) s(j))
    SELECT n AS layer, vec_id AS other, count(*) AS n, round(max(v) FILTER (WHERE j = 0), 6) AS head, round(max(v) FILTER (WHERE j = 63), 6) AS tail, round(sum(v * (j + 1)), 4) AS weighted FROM p GROUP BY 1, 2""",
)
def layer_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convolution weights, (out, in, height, width) of 2 x 8 x 2 x 2, in the other library's order of axes, beside its layers by their place."""
    e, axes, kind = table(spark, sf_dir, "embeddings"), (3, 2, 1, 0), F.when(F.col("vec_id") % 3 == 0, "conv").otherwise("transposed")
    shape = F.array(*map(F.lit, (2, 8, 2, 2)))
    left = e.select("vec_id", kind.alias("kind"), layers.permuted_shape(shape, axes).alias("shape"), layers.permuted(F.col("embedding"), shape, axes).alias("data"))
    right = e.select("vec_id", kind.alias("kind"), F.array(*map(F.lit, (2, 2, 8, 2))).alias("shape"), F.col("vec_id").alias("other"))
    return layers.zipped(left, right, "vec_id").where("kind is not null").select(F.col("n").alias("layer"), "other", *digest(F.col("data")))


@register(
    "scored_by_models",
    """WITH m AS (SELECT r_name AS name, max(n_nationkey) AS version FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_regionkey <> 3 GROUP BY r_name),
    t AS (SELECT vec_id, embedding, r_name AS name FROM embeddings JOIN region ON vec_id % 5 = r_regionkey),
    p AS (SELECT vec_id, name, embedding, unnest(generate_series(0, 63)) AS i FROM t), d(dy, dx) AS (SELECT a, b FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b)),
    l AS (SELECT vec_id, name, i, sum(embedding[i + 1 + 8 * dy + dx]::DOUBLE) AS x FROM p, d WHERE i // 8 + dy BETWEEN 0 AND 7 AND i % 8 + dx BETWEEN 0 AND 7 GROUP BY 1, 2, 3)
    SELECT name, vec_id AS n, version, CASE WHEN version IS NULL THEN 'no model' WHEN version % 5 = 0 THEN 'failed' END AS error, CASE WHEN version % 5 > 0 THEN round(sum(1 / (1 + exp(-x * version / 10.0))), 1) END AS total FROM l LEFT JOIN m USING (name) GROUP BY 1, 2, 3""",
)
def scored_by_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of several models in one pass, each by the newest version of its own; one name has none, and models whose bytes are cut off fail without stopping the others."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")

    def build(version: int) -> bytes:
        import numpy as np

        model = scoring.small_model(np.full((3, 3), version / 10))
        return model if version % 5 else model[:-30]

    known = nations.join(regions.where("r_regionkey <> 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.col("n_nationkey").alias("version"))
    models = known.withColumn("model", F.udf(build, "binary")("version"))
    tiles = table(spark, sf_dir, "embeddings").join(regions, F.col("vec_id") % 5 == F.col("r_regionkey"))
    tiles = tiles.select(F.col("r_name").alias("name"), F.col("vec_id").alias("n"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), F.col("embedding").alias("image"))
    found = scoring.score_many(tiles, scoring.newest(models))
    total = F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)
    error = F.when(F.col("error") == "no model", F.col("error")).when(F.col("error").isNotNull(), "failed")
    return found.select("name", "n", "version", error.alias("error"), F.round(total, 1).alias("total"))
