"""Queries on reports, model contracts and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import text as X
from tessella.operators import contract, metrics as M, reports as R
from tessella.operators.releases import manifest_line, release_actions
from tessella.plans.registry import register
from tessella.session import table

TABLE = "'|' || repeat('---|', {n}) || chr(10) || string_agg({line}, chr(10) ORDER BY {order})"


def _report(source: str, titles: list[str], cells: list[str], order: str, head: str = "") -> str:
    """SQL of a Markdown table."""
    line = "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"
    top = "".join(f"'{h}' || chr(10) || " for h in ([head] if head else []))
    return f"{source} SELECT {top}'| {' | '.join(titles)} |' || chr(10) || " + TABLE.format(n=len(titles), line=line, order=order) + " AS report FROM r"


def _or_dash(x: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', {x}), '—')"


KINDS = [(1, "view"), (2, "click"), (3, "absent"), (4, "purchase")]
MODELS = [
    "Model", "Params", "Best val F1", "Final val F1", "Test F1", "Test P", "Test R", "Train (min)",
]


@register(
    "report_architectures",
    _report(
        """WITH a(pos, arch) AS (VALUES (1, 'view'), (2, 'click'), (3, 'absent'), (4, 'purchase')),
        m AS (SELECT event_type AS arch, count(*) * 1000 AS params, max(value) FILTER (WHERE user_id < 3) / 7 AS s2, avg(value) / 7 AS f1, avg(value) / 3 AS p, CASE WHEN event_type <> 'click' THEN avg(value) / 9 END AS t FROM events GROUP BY event_type),
        r AS (SELECT * FROM a LEFT JOIN m USING (arch))""",
        MODELS,
        ["arch", "coalesce(printf('%.3fM', params / 1e6), '—')", "CASE WHEN f1 IS NULL THEN '(failed)' ELSE " + _or_dash("coalesce(s2, f1)", 4) + " END", _or_dash("f1", 4), _or_dash("t", 4), _or_dash("p", 4), _or_dash("t", 4), _or_dash("p", 3)],
        "pos",
        "# Comparison",
    ),
)
def report_architectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of models beside their results: the best of the second stage, else the final score; dashes where there is nothing."""
    v = F.avg("value")
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arch")).agg(
        (F.count("*") * 1000).alias("params"), (F.max(F.when(F.col("user_id") < 3, F.col("value"))) / 7).alias("s2"), (v / 7).alias("f1"), (v / 3).alias("p"), F.when(F.col("arch") != "click", v / 9).alias("t"),
    )
    r = spark.createDataFrame(KINDS, "pos int, arch string").join(m, "arch", "left")
    n4 = lambda c: R.number(F.col(c), 4)
    best = F.when(F.col("f1").isNull(), "(failed)").otherwise(R.number(F.coalesce("s2", "f1"), 4))
    cells = [F.col("arch"), R.number(F.col("params") / 1e6, 3, after="M"), best, n4("f1"), n4("t"), n4("p"), n4("t"), R.number(F.col("p"), 3)]
    return R.markdown(r, dict(zip(MODELS, cells, strict=True)), ["pos"], ["# Comparison"])


LATENCY = ["Model", "b1 median (ms)", "b1 p90", "speedup", "b4 median", "F1", "dF1", "MB"]
BATCHED = "SELECT event_type, user_id % 2 AS b, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1, 2"


@register(
    "report_latency",
    _report(
        f"""WITH m AS ({BATCHED}), s AS (SELECT event_type, avg(value) / 900 AS f1, count(*) AS n, min(event_id) AS pos FROM events GROUP BY event_type),
        j AS (SELECT s.*, a.med, a.p90, b.med AS b4 FROM s JOIN m a ON a.event_type = s.event_type AND a.b = 1 LEFT JOIN m b ON b.event_type = s.event_type AND b.b = 0),
        r AS (SELECT *, arg_min(med, pos) OVER () AS base, arg_min(f1, pos) OVER () AS base_f1 FROM j)""",
        LATENCY,
        ["event_type", "printf('%.4f', med)", "printf('%.4f', p90)", "printf('%.2fx', base / med)", _or_dash("b4", 4), "printf('%.4f', f1)", "printf('%+.4f', f1 - base_f1)", "printf('%.3f', n / 1e3)"],
        "pos",
    ),
)
def report_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and p90 of batch 1, the median of batch 4, speedup and difference against the model seen first."""
    ev = table(spark, sf_dir, "events").withColumn("b", F.col("user_id") % 2)
    m = M.percentiles(ev, ["event_type", "b"], "value", {"med": 0.5, "p90": 0.9})
    one, four = m.where("b = 1").drop("b"), m.where("b = 0").select("event_type", F.col("med").alias("b4"))
    s = ev.groupBy("event_type").agg((F.avg("value") / 900).alias("f1"), F.count("*").alias("n"), F.min("event_id").alias("pos"))
    j = s.join(one, "event_type").join(four, "event_type", "left")
    base = j.agg(F.min_by("med", "pos").alias("base"), F.min_by("f1", "pos").alias("base_f1"))  # one row
    j = j.join(F.broadcast(base))
    n4 = lambda c: R.number(F.col(c), 4)
    cells = [F.col("event_type"), n4("med"), n4("p90"), R.number(F.col("base") / F.col("med"), 2, after="x"), n4("b4"), n4("f1"), R.signed(F.col("f1") - F.col("base_f1"), 4), R.number(F.col("n") / 1e3, 3)]
    return R.markdown(j, dict(zip(LATENCY, cells, strict=True)), ["pos"])


THROUGHPUT = ["width", "dtype", "batch", "median (ms)", "p90", "img/s", "speedup"]


@register(
    "report_throughput",
    _report(
        """WITH m AS (SELECT event_type AS kind, user_id % 3 AS w, user_id % 2 + 1 AS b, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1, 2, 3),
        r AS (SELECT m.*, coalesce(x.med, m.med) / m.med AS sp FROM m LEFT JOIN m x ON x.w = 0 AND x.kind = 'view' AND x.b = m.b)""",
        THROUGHPUT,
        ["w", "kind", "b", "printf('%.4f', med)", "printf('%.4f', p90)", "printf('%.3f', b / (med / 1000))", "printf('%.2fx', sp)"],
        "w, kind, b",
    ),
)
def report_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency, throughput and speedup against the base width and kind of the same batch, itself where there is none."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("w"), (F.col("user_id") % 2 + 1).alias("b"), "value")
    m = M.percentiles(ev, ["w", "kind", "b"], "value", {"med": 0.5, "p90": 0.9})
    m = m.join(m.where("w = 0 and kind = 'view'").select("b", F.col("med").alias("base")), "b", "left")
    n4 = lambda c: R.number(F.col(c), 4)
    cells = [F.col("w").cast("string"), F.col("kind"), F.col("b").cast("string"), n4("med"), n4("p90"), R.number(F.col("b") / (F.col("med") / 1000), 3), R.number(F.coalesce("base", "med") / F.col("med"), 2, after="x")]
    return R.markdown(m, dict(zip(THROUGHPUT, cells, strict=True)), ["w", "kind", "b"])


ABLATION = ["variant", "resolution", "F1", "P", "R"]


@register(
    "report_ablation",
    _report("WITH r AS (SELECT event_type AS v, user_id % 2 AS s, avg(value) / 900 AS f1, max(value) / 900 AS p, CASE WHEN event_type <> 'view' THEN min(value) / 7 END AS q FROM events GROUP BY 1, 2)", ABLATION, ["v", "CASE WHEN s = 0 THEN '256x256' ELSE '512x512' END", _or_dash("f1", 4), _or_dash("p", 4), _or_dash("q", 4)], "v, s DESC"),
)
def report_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model at two resolutions, the larger first."""
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("v"), (F.col("user_id") % 2).alias("s")).agg((F.avg("value") / 900).alias("f1"), (F.max("value") / 900).alias("p"), F.when(F.col("v") != "view", F.min("value") / 7).alias("q"))
    cells = [F.col("v"), F.when(F.col("s") == 0, "256x256").otherwise("512x512"), *[R.number(F.col(c), 4) for c in ("f1", "p", "q")]]
    return R.markdown(r, dict(zip(ABLATION, cells, strict=True)), ["v", -F.col("s")])


SHAPES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN [] ELSE [[CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE 'batch' END, CASE WHEN o_orderkey % 5 = 0 THEN '4' ELSE '3' END, CASE o_orderkey % 4 WHEN 0 THEN '256' WHEN 1 THEN 'h' ELSE '512' END, '512']] END AS i,
    [CASE WHEN o_orderkey % 7 = 0 THEN ['batch', '1', '512'] ELSE ['batch', '1', 'h', 'w'] END] AS o FROM orders"""


@register(
    "model_contract",
    f"""WITH s AS ({SHAPES}), q AS (SELECT id, CASE WHEN len(i) <> 1 OR len(o) <> 1 THEN ['one input and one output'] ELSE list_filter([
      CASE WHEN len(i[1]) <> 4 THEN 'input rank' END, CASE WHEN regexp_matches(i[1][1], '^-?[0-9]+$') THEN 'input batch' END, CASE WHEN i[1][2] <> '3' THEN 'input channels' END,
      CASE WHEN i[1][3] <> '512' AND regexp_matches(i[1][3], '^-?[0-9]+$') THEN 'input side' END, CASE WHEN len(o[1]) <> 4 THEN 'output rank' END], lambda x: x IS NOT NULL) END AS rules FROM s)
    SELECT id, array_to_string(rules, ', ') AS broken FROM q""",
)
def model_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared model with the rules of the contract that it breaks."""
    k, s = F.col("o_orderkey"), lambda x: F.lit(x)
    dims = F.array(F.when(k % 3 == 0, "1").otherwise("batch"), F.when(k % 5 == 0, "4").otherwise("3"), F.when(k % 4 == 0, "256").when(k % 4 == 1, "h").otherwise("512"), s("512"))
    inputs = F.when(k % 13 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(dims))
    outputs = F.array(F.when(k % 7 == 0, F.array(s("batch"), s("1"), s("512"))).otherwise(F.array(s("batch"), s("1"), s("h"), s("w"))))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(contract.broken_rules(inputs, outputs), ", ").alias("broken"))


@register("asset_names", "SELECT p_partkey, 'model_' || p_brand || '_512' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '_fp16' ELSE '_int8' END || '.onnx' AS asset FROM part")
def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of converted files: the source's without its suffix, the precision, the new extension."""
    source = F.concat(F.lit("model_"), "p_brand", F.lit("_512"), F.when(F.col("p_size") % 2 == 0, ".hdf5").otherwise(""))
    kind = F.element_at(F.array(F.lit(""), F.lit("fp16"), F.lit("int8")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.asset_name(X.without_suffix(source, ".hdf5"), kind, "onnx").alias("asset"))


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "release_plan",
    f"""WITH s AS (SELECT doc_id, sha256(text) AS d, n_chars FROM documents), l AS (SELECT doc_id, sha256({LOWERED}) AS d FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT s.doc_id, CASE WHEN l.doc_id IS NULL THEN 'create' WHEN l.d = s.d THEN 'keep' ELSE 'edit' END AS action,
           '| `' || s.doc_id || '` | ' || printf('%.6f', n_chars / 1e6) || ' | `' || substr(s.d, 1, 16) || '…` |' AS line FROM s LEFT JOIN l ON l.doc_id = s.doc_id""",
)
def release_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What publishing would do with each staged asset beside an earlier release of some, in lower case, and its manifest line; a dry run by nature, as nothing is sent."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset"), "text", "n_chars")
    staged = d.select("asset", F.sha2("text", 256).alias("sha256"), "n_chars")
    released = d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset")).distinct(), "asset", "left_semi").select("asset", F.expr(f"sha2({LOWERED}, 256)").alias("sha256"))
    found = release_actions(staged, released)
    return found.select(F.col("asset").alias("doc_id"), "action", manifest_line(F.col("asset"), F.col("n_chars"), F.col("sha256")).alias("line"))


SCORES = "SELECT event_type, count(*) AS n, avg(value) / 900 AS f1, max(value) / 900 AS p, min(value) / 7 AS r, CASE WHEN event_type <> 'view' THEN avg(value) / 3 END AS loss FROM events GROUP BY event_type"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), (F.avg(v) / 900).alias("f1"), (F.max(v) / 900).alias("p"), (F.min(v) / 7).alias("r"), F.when(F.col("event_type") != "view", F.avg(v) / 3).alias("loss"),
        F.sort_array(F.collect_list(F.when(F.col("user_id") == 1, F.struct("event_id", "value"))))["value"].alias("curve"),
    )


def _metrics(names: list[tuple[str, str]]) -> str:
    """SQL of a table of metrics."""
    return "'| metric | value |' || chr(10) || '|--------|------:|'" + "".join(f" || chr(10) || '| {n} | ' || {_or_dash(c, 4)} || ' |'" for n, c in names)


TESTED = [("f1", "f1"), ("precision", "p"), ("recall", "r"), ("loss", "loss")]


@register(
    "report_test",
    f"""WITH s AS ({SCORES}) SELECT event_type AS arch, '# Test results' || chr(10) || chr(10) || '**data:** held out' || chr(10) || '**tiles:** ' || n || chr(10) || '**arch:** ' || event_type || chr(10) || chr(10) || {_metrics(TESTED)} AS report FROM s""",
)
def report_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on each model's held-out test."""
    head = R.facts({"data": F.lit("held out"), "tiles": F.col("n"), "arch": F.col("event_type")})
    body = R.metric_table({name: F.col(c) for name, c in TESTED})
    return scores(spark, sf_dir).select(F.col("event_type").alias("arch"), R.sections(F.lit("Test results"), {"": F.concat_ws("\n\n", head, body)}).alias("report"))


@register(
    "report_model",
    f"""WITH s AS ({SCORES}), c AS (SELECT event_type, string_agg(printf('%.4f', value), ', ' ORDER BY event_id) AS c FROM events WHERE user_id = 1 GROUP BY event_type)
    SELECT s.event_type AS arch, '# ' || s.event_type || chr(10) || chr(10) || '**parameters:** ' || format('{{:,}}', n * 1000) || chr(10) || '**minutes:** ' || printf('%.1f', r) || chr(10) || chr(10)
        || '## Final metrics' || chr(10) || chr(10) || {_metrics(TESTED)}
        || CASE WHEN loss IS NULL THEN '' ELSE chr(10) || chr(10) || '## Held-out test' || chr(10) || chr(10) || {_metrics(TESTED[:3])} END
        || chr(10) || chr(10) || '## F1 of each epoch' || chr(10) || chr(10) || '[' || coalesce(c.c, '') || ']' AS report FROM s LEFT JOIN c ON c.event_type = s.event_type""",
)
def report_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on each model: its facts, final metrics, the held-out test where there was one, and its curve."""
    head = R.facts({"parameters": F.format_string("%,d", F.col("n") * 1000), "minutes": R.number(F.col("r"), 1)})
    test = F.when(F.col("loss").isNotNull(), R.metric_table({name: F.col(c) for name, c in TESTED[:3]}))
    parts = {"": head, "Final metrics": R.metric_table({name: F.col(c) for name, c in TESTED}), "Held-out test": test, "F1 of each epoch": R.curve(F.col("curve"))}
    return scores(spark, sf_dir).select(F.col("event_type").alias("arch"), R.sections(F.col("event_type"), parts).alias("report"))
