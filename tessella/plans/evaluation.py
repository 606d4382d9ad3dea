"""Queries on scores, losses and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.operators import metrics as M, pairing as P
from tessella.plans.registry import register
from tessella.session import table

LOGIT = "(n_chars - 500) / 250.0"
PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision",
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
    round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS iou"""
SCORED = f"""SELECT documents.doc_id, lang, source, {LOGIT} AS x, quality AS t,
    CASE WHEN 1 / (1 + exp(-{LOGIT})) >= 0.5 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)"""
COUNTS = "CAST(sum(p * t) AS BIGINT) AS tp, CAST(sum(p * (1 - t)) AS BIGINT) AS fp, CAST(sum((1 - p) * t) AS BIGINT) AS fn"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    x = F.expr("(n_chars - 500) / 250.0D")
    return docs.select("doc_id", "lang", "source", x.alias("x"), F.col("quality").alias("t"), M.hit(M.sigmoid(x)).alias("p"))


@register("eval_micro_prf", f"WITH s AS ({SCORED}), c AS (SELECT {COUNTS} FROM s) SELECT tp, fp, fn, {PRF} FROM c")
def eval_micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.prf(scored(spark, sf_dir).agg(*M.counts("p", "t"))))


@register("eval_by_group", f"WITH s AS ({SCORED}), c AS (SELECT lang, source, {COUNTS} FROM s GROUP BY lang, source) SELECT lang, source, tp, fp, fn, {PRF} FROM c")
def eval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.prf(scored(spark, sf_dir).groupBy("lang", "source").agg(*M.counts("p", "t"))))


@register("iou_from_f1", f"WITH s AS ({SCORED}), c AS (SELECT lang, {COUNTS} FROM s GROUP BY lang), r AS (SELECT lang, {PRF}, 2 * tp / (2 * tp + fp + fn) AS full_f1 FROM c) SELECT lang, round(full_f1 / (2 - full_f1), 6) AS iou_from_f1, iou FROM r")
def iou_from_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.prf(scored(spark, sf_dir).groupBy("lang").agg(*M.counts("p", "t")))
    return M.rounded(df.select("lang", M.iou_of_f1(F.col("f1")).alias("iou_from_f1"), "iou"))


@register("bce_loss", f"WITH s AS ({SCORED}) SELECT lang, round(avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))), 6) AS bce FROM s GROUP BY lang")
def bce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(scored(spark, sf_dir).groupBy("lang").agg(M.bce_with_logits(F.col("x"), F.col("t")).alias("bce")))


SOFT = "sum(s * t) AS tp, sum(s * (1 - t)) AS fp, sum((1 - s) * t) AS fn"


@register(
    "soft_f1_loss",
    f"""WITH s AS ({SCORED}), q AS (SELECT lang, x, t, 1 / (1 + exp(-x)) AS s FROM s),
    c AS (SELECT lang, {SOFT}, avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) AS bce FROM q GROUP BY lang)
    SELECT lang, round(1 - (2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS soft_f1_loss,
           round(bce + 1 - (2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS total_loss FROM c""",
)
def soft_f1_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = M.soft_f1_loss(F.col("x"), F.col("t"))
    df = scored(spark, sf_dir).groupBy("lang").agg(soft.alias("soft_f1_loss"), (M.bce_with_logits(F.col("x"), F.col("t")) + soft).alias("total_loss"))
    return M.rounded(df)


@register(
    "weighted_batch_loss",
    f"""WITH s AS ({SCORED}), b AS (SELECT lang, x, t, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 4 AS batch, 1 / (1 + exp(-x)) AS s FROM s),
    l AS (SELECT lang, batch, count(*) AS n, {SOFT}, avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) AS bce FROM b GROUP BY lang, batch),
    m AS (SELECT lang, n, bce + 1 - (2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6) AS loss FROM l)
    SELECT lang, count(*) AS batches, round(sum(loss * n) / sum(n), 6) AS weighted_loss, round(avg(loss), 6) AS epoch_mean_loss FROM m GROUP BY lang""",
)
def weighted_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four in id order; the evaluation mean weighs batches by their size, the training mean doesn't."""
    rows = P.batches(scored(spark, sf_dir), ["lang"], [F.col("doc_id")], 4)
    x, t = F.col("x"), F.col("t")
    losses = rows.groupBy("lang", "batch").agg(F.count("*").alias("n"), (M.bce_with_logits(x, t) + M.soft_f1_loss(x, t)).alias("loss"))
    df = losses.groupBy("lang").agg(F.count("*").alias("batches"), M.weighted_mean("loss", "n").alias("weighted_loss"), F.coalesce(F.avg("loss"), F.lit(0.0)).alias("epoch_mean_loss"))
    return M.rounded(df)


@register(
    "latency_stats",
    """SELECT event_type, count(value) AS runs, min(value) AS min_ms, round(avg(value), 6) AS mean_ms,
    round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.9), 6) AS p90_ms FROM events GROUP BY event_type""",
)
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.latency_stats(table(spark, sf_dir, "events"), ["event_type"], "value"))


@register(
    "speedup_vs_base",
    """WITH m AS (SELECT user_id % 4 AS batch, event_type, quantile_cont(value, 0.5) AS ms FROM events GROUP BY 1, 2),
    b AS (SELECT batch, ms FROM m WHERE event_type = 'view')
    SELECT m.batch, m.event_type, round(m.ms, 6) AS ms, round(coalesce(b.ms, m.ms) / m.ms, 6) AS speedup, round((m.batch + 1) / (m.ms / 1000), 6) AS throughput
    FROM m LEFT JOIN b ON m.batch = b.batch""",
)
def speedup_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median latency of each kind against the base kind of the same batch, itself where there is none."""
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("batch"), "event_type", "value")
    med = M.percentiles(ev, ["batch", "event_type"], "value", {"ms": 0.5})
    base = med.where("event_type = 'view'").select("batch", F.col("ms").alias("base"))
    df = med.join(base, "batch", "left")
    return M.rounded(df.select("batch", "event_type", "ms", (F.coalesce("base", "ms") / F.col("ms")).alias("speedup"), ((F.col("batch") + 1) / (F.col("ms") / 1000)).alias("throughput")))


@register(
    "delta_vs_first",
    """WITH m AS (SELECT event_type, avg(value) AS v, min(event_id) AS first_id FROM events GROUP BY event_type)
    SELECT event_type, round(v - arg_min(v, first_id) OVER (), 6) AS delta, round(v / arg_min(v, first_id) OVER (), 6) AS factor FROM m""",
)
def delta_vs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference to the kind seen first; the reference row is one aggregate row, joined to every kind."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.min("event_id").alias("first_id"))
    base = m.agg(F.min_by("v", "first_id").alias("base"))
    df = m.join(F.broadcast(base))
    return M.rounded(df.select("event_type", (F.col("v") - F.col("base")).alias("delta"), (F.col("v") / F.col("base")).alias("factor")))


@register(
    "max_abs_diff",
    """WITH d AS (SELECT a.label, abs(unnest(a.embedding)::DOUBLE - unnest(b.embedding)::DOUBLE) AS d FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id)
    SELECT label, round(max(d), 6) AS max_diff, max(d) <= 2e-4 AS within FROM d GROUP BY label""",
)
def max_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest element-wise difference of vectors paired by consecutive ids."""
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    diff = F.array_max(F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return M.rounded(a.join(b, "vec_id").groupBy("label").agg(F.max(diff).alias("max_diff")).withColumn("within", F.col("max_diff") <= 2e-4))


@register(
    "calibration_min_max",
    "SELECT label, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label",
)
def calibration_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of all activations; each vector is reduced before the shuffle."""
    e = table(spark, sf_dir, "embeddings")
    return M.rounded(e.groupBy("label").agg(F.min(F.array_min("embedding")).cast("double").alias("low"), F.max(F.array_max("embedding")).cast("double").alias("high")))


@register(
    "running_best_by_day",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, min(value) AS v FROM events GROUP BY 1, 2)
    SELECT event_type, day, v, min(v) OVER (PARTITION BY event_type ORDER BY day) AS best FROM d""",
)
def running_best_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.min("value").alias("v"))
    return d.withColumn("best", F.min("v").over(Window.partitionBy("event_type").orderBy("day")))
