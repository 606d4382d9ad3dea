"""Queries on histories: the events of a user stand for the epochs of a run, their values for losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators import history as H
from tessella.operators.pairing import numbered
from tessella.plans.registry import register
from tessella.session import table

RUN = "SELECT user_id, event_id, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events"
IMPROVED = f"""r AS ({RUN}), b AS (SELECT *, min(loss) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    min(loss) OVER (PARTITION BY user_id ORDER BY epoch) AS best FROM r), i AS (SELECT *, prev IS NULL OR loss < prev AS improved FROM b),
    s AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS since FROM i)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("value").alias("loss"))
    return H.epochs(ev, ["user_id"], ["ts", "event_id"]).drop("ts")


@register("best_epoch", f"WITH r AS ({RUN}) SELECT user_id, epoch, loss FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY loss DESC, epoch) AS k FROM r) WHERE k = 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.best_epoch(runs(spark, sf_dir), ["user_id"], "loss")


@register("running_best", f"WITH {IMPROVED} SELECT user_id, epoch, best, improved, since FROM s")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.improvements(runs(spark, sf_dir), ["user_id"], "loss").select("user_id", "epoch", "best", "improved", "since")


@register("early_stop", f"WITH {IMPROVED}, e AS (SELECT *, min(CASE WHEN since >= 5 THEN epoch END) OVER (PARTITION BY user_id) AS stop FROM s) SELECT user_id, epoch, loss, improved FROM e WHERE stop IS NULL OR epoch <= stop")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.early_stop(runs(spark, sf_dir), ["user_id"], "loss", 5).select("user_id", "epoch", "loss", "improved")


@register("best_checkpoint", f"WITH r AS ({RUN}) SELECT user_id, min(loss) AS val_loss, arg_min(epoch, (loss, epoch)) AS epoch FROM r GROUP BY user_id")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoint that stays: written whenever the loss falls, so the first of the least."""
    r = runs(spark, sf_dir)
    return r.groupBy("user_id").agg(F.min("loss").alias("val_loss"), F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"))


@register(
    "plateau_lr",
    f"""WITH RECURSIVE r AS ({RUN}), f AS (
      SELECT user_id, epoch, CASE WHEN loss < 'inf'::DOUBLE THEN loss ELSE 'inf'::DOUBLE END AS best, 0 AS bad, 1e-3::DOUBLE AS lr FROM r WHERE epoch = 1
      UNION ALL
      SELECT user_id, epoch, best, CASE WHEN bad > 2 THEN 0 ELSE bad END, CASE WHEN bad > 2 AND lr - lr * 0.1::DOUBLE > 1e-8 THEN lr * 0.1::DOUBLE ELSE lr END FROM (
        SELECT r.user_id, r.epoch, CASE WHEN r.loss < f.best * (1 - 1e-4) THEN r.loss ELSE f.best END AS best,
               CASE WHEN r.loss < f.best * (1 - 1e-4) THEN 0 ELSE f.bad + 1 END AS bad, f.lr FROM f JOIN r ON r.user_id = f.user_id AND r.epoch = f.epoch + 1))
    SELECT user_id, epoch, round(lr, 12) AS lr FROM f""",
)
def plateau_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.plateau(runs(spark, sf_dir), ["user_id"], "loss").withColumn("lr", F.round("lr", 12))


STAGED = f"r AS (SELECT *, CASE WHEN epoch <= 20 THEN 1 ELSE 2 END AS stage FROM ({RUN}))"


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose first twenty epochs are a stage of their own; epochs go on counting."""
    return runs(spark, sf_dir).withColumn("stage", F.when(F.col("epoch") <= 20, 1).otherwise(2).cast("bigint"))


def _stage_lr(start: str) -> str:
    """SQL of the plateau rule with a new best and count in each stage; start: the rate a later stage begins with."""
    return f"""WITH RECURSIVE {STAGED}, f AS (
      SELECT user_id, epoch, CAST(1 AS BIGINT) AS stage, loss AS best, 0 AS bad, 1e-3::DOUBLE AS lr FROM r WHERE epoch = 1
      UNION ALL
      SELECT user_id, epoch, stage, best, CASE WHEN bad > 2 THEN 0 ELSE bad END, CASE WHEN bad > 2 AND lr - lr * 0.1::DOUBLE > 1e-8 THEN lr * 0.1::DOUBLE ELSE lr END FROM (
        SELECT r.user_id, r.epoch, CAST(r.stage AS BIGINT) AS stage, CASE WHEN r.stage <> f.stage OR r.loss < f.best * (1 - 1e-4) THEN r.loss ELSE f.best END AS best,
               CASE WHEN r.stage <> f.stage OR r.loss < f.best * (1 - 1e-4) THEN 0 ELSE f.bad + 1 END AS bad, CASE WHEN r.stage <> f.stage THEN {start} ELSE f.lr END AS lr FROM f JOIN r ON r.user_id = f.user_id AND r.epoch = f.epoch + 1))
    SELECT user_id, stage, epoch, round(lr, 12) AS lr FROM f"""


@register("stage_lr_reset", _stage_lr("1e-3::DOUBLE"))
def stage_lr_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.plateau(staged(spark, sf_dir), ["user_id"], "loss", stage="stage").withColumn("lr", F.round("lr", 12))


@register("stage_lr_carried", _stage_lr("f.lr"))
def stage_lr_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.plateau(staged(spark, sf_dir), ["user_id"], "loss", stage="stage", carry=True).withColumn("lr", F.round("lr", 12))


@register("best_of_last_stage", f"WITH {STAGED} SELECT user_id, CAST(stage AS BIGINT) AS stage, epoch, loss FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stage DESC, loss DESC, epoch) AS k FROM r) WHERE k = 1")
def best_of_last_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.best_of_last_stage(staged(spark, sf_dir), ["user_id"], "loss")


@register(
    "scalar_pivot",
    """WITH p AS (SELECT user_id AS step, round(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view'), 5) AS "view", round(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click'), 5) AS click,
    round(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase'), 5) AS purchase FROM events GROUP BY user_id)
    SELECT row_number() OVER (ORDER BY step) AS epoch, step, "view", click, purchase FROM p""",
)
def scalar_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide scalars by step; epochs are numbered after the pivot, over one row a step."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("step"), F.col("event_type").alias("tag"), "value", "ts", "event_id")
    wide = H.pivot_scalars(ev, ["step"], ["view", "click", "purchase"], ["ts", "event_id"])
    return numbered(wide, [F.col("step")], "epoch").select("epoch", *wide.columns)


MARKED = "SELECT conv_id, turn, role, length(text) AS n, CASE WHEN role = 'user' THEN turn + 1 END AS mark FROM conversations"


@register("ffill_stage", f"WITH m AS ({MARKED}) SELECT conv_id, turn, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS stage FROM m")
def ffill_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = marked(spark, sf_dir)
    return c.select("conv_id", "turn", H.carried(c, ["conv_id"], ["turn"], "mark", F.lit(1)).alias("stage"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("turn") + 1).alias("mark"))


@register(
    "stage_epoch",
    f"""WITH m AS ({MARKED}), s AS (SELECT conv_id, turn, role, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS stage FROM m)
    SELECT conv_id, turn, stage, row_number() OVER (PARTITION BY conv_id, stage ORDER BY turn) AS epoch FROM s WHERE role <> 'system'""",
)
def stage_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs counted in each stage, in log order."""
    c = marked(spark, sf_dir)
    c = c.withColumn("stage", H.carried(c, ["conv_id"], ["turn"], "mark", F.lit(1))).where("role <> 'system'")
    return H.epochs(c, ["conv_id", "stage"], ["turn"]).select("conv_id", "turn", "stage", "epoch")


@register("distinct_stages", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id")
def distinct_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("role"))).alias("roles"))


@register(
    "curve_ends",
    f"""WITH r AS ({RUN}) SELECT user_id, round(arg_max(loss, epoch), 4) AS last_value, round(arg_min(loss, epoch), 4) AS first_value,
    round(coalesce(max(loss) FILTER (WHERE epoch > 60), arg_max(loss, epoch)), 4) AS best_late FROM r GROUP BY user_id""",
)
def curve_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last, first and best-late values of a curve; the last one where there is no late part."""
    last = F.max_by("loss", "epoch")
    df = runs(spark, sf_dir).groupBy("user_id").agg(last.alias("last_value"), F.min_by("loss", "epoch").alias("first_value"), F.coalesce(F.max(F.when(F.col("epoch") > 60, F.col("loss"))), last).alias("best_late"))
    return df.select("user_id", *[F.round(c, 4).alias(c) for c in ("last_value", "first_value", "best_late")])
