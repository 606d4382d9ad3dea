"""Queries on logs, manifests, schemas and comparison reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import text as X
from tessella.operators.scoring import provider_list
from tessella.plans.registry import register
from tessella.session import table
from tessella.sources import logs


@register("log_regex", r"SELECT doc_id, CAST(regexp_extract(text, '([0-9]+)', 1) AS VARCHAR) AS first_number, length(regexp_extract(text, '^([^\n]*)', 1)) AS first_line FROM documents WHERE contains(text, 'the') AND regexp_matches(text, '[0-9]+')")
def log_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that contain a word and match a pattern, with its groups."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").contains("the") & F.col("text").rlike("[0-9]+"))
    return d.select("doc_id", F.regexp_extract("text", "([0-9]+)", 1).alias("first_number"), F.length(F.regexp_extract("text", "^([^\\n]*)", 1)).cast("bigint").alias("first_line"))


LINES = """SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value AS v, event_type,
    CASE WHEN event_type = 'signup' THEN 2 WHEN event_type = 'error' THEN 1 END AS mark FROM events"""


@register(
    "training_log",
    f"""WITH l AS ({LINES}), s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS stage FROM l)
    SELECT run, CAST(stage AS BIGINT) AS stage, row_number() OVER (PARTITION BY run, stage ORDER BY pos) AS epoch, v AS loss, round(v / 2, 3) AS val_f1, CASE WHEN event_type = 'click' THEN 0.001::DOUBLE END AS lr
    FROM s WHERE event_type IN ('view', 'click')""",
)
def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of many runs to one row an epoch: stage marks carried forward, epochs counted in each stage."""
    ev = table(spark, sf_dir, "events")
    num = lambda c: F.format_string("%.3f", c)
    v = F.col("value")
    line = (
        F.when(F.col("event_type") == "signup", "[stage2] fine-tuning").when(F.col("event_type") == "error", "[stage1] training").when(
            F.col("event_type").isin("view", "click"),
            F.concat(
                F.lit("8/8 - 1s - loss: "), F.format_string("%.2f", v), F.lit(" - Precision: 0.5 - Recall: 0.5 - F1Score: 0.5 - val_loss: 1.0 - val_Precision: 0.5 - val_Recall: 0.5 - val_F1Score: "), F.round(v / 2, 3).cast("string"),
                F.when(F.col("event_type") == "click", " - lr: 0.001").otherwise(""),
            ),
        ).otherwise("saving a checkpoint")
    )
    lines = ev.select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("pos"), line.alias("line"))
    return logs.epochs(lines, ["run"], "pos").select("run", "stage", "epoch", "loss", "val_f1", "lr")


@register(
    "comparison_report",
    """WITH a(pos, arch) AS (VALUES (1, 'view'), (2, 'click'), (3, 'absent')), r AS (SELECT event_type, avg(value) / 100 AS f1, max(value) FILTER (WHERE user_id < 3) / 1000 AS best2 FROM events GROUP BY event_type)
    SELECT pos, arch, coalesce(printf('%.4f', coalesce(best2, f1)), '—') AS best, CASE WHEN f1 IS NULL THEN '(failed)' ELSE 'ok' END AS status FROM a LEFT JOIN r ON arch = event_type""",
)
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of architectures drives the rows; what has no result is reported as failed."""
    archs = spark.createDataFrame([(1, "view"), (2, "click"), (3, "absent")], "pos int, arch string")
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arch")).agg((F.avg("value") / 100).alias("f1"), (F.max(F.when(F.col("user_id") < 3, F.col("value"))) / 1000).alias("best2"))
    df = archs.join(r, "arch", "left")
    return df.select("pos", "arch", X.fixed4(F.coalesce("best2", "f1")).alias("best"), F.when(F.col("f1").isNull(), "(failed)").otherwise("ok").alias("status"))


@register(
    "markdown_report",
    """WITH r AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
    SELECT '| kind | n | min | max |' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' | ' || printf('%.2f', lo) || ' | ' || printf('%.2f', hi) || ' |', chr(10) ORDER BY event_type) AS report FROM r""",
)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table as text; only its few aggregated rows are gathered."""
    r = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    row = F.format_string("| %s | %d | %.2f | %.2f |", "event_type", "n", "lo", "hi")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_type", row.alias("row")))), lambda s: s["row"])
    return r.agg(F.concat_ws("\n", F.lit("| kind | n | min | max |"), rows).alias("report"))


@register(
    "manifest_first_seen",
    """WITH d AS (SELECT source, min(doc_id) AS first_id, count(*) AS n, sum(n_chars) AS chars, max(sha256(text)) AS digest FROM documents GROUP BY source)
    SELECT row_number() OVER (ORDER BY first_id) AS pos, source, n, CAST(chars AS BIGINT) AS chars, round(chars / 1e6, 3) AS size_mb, substr(digest, 1, 16) AS digest FROM d""",
)
def manifest_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order they were first seen, with totals and a short digest."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max(F.sha2("text", 256)).alias("digest"))
    return d.select(F.row_number().over(Window.orderBy("first_id")).cast("bigint").alias("pos"), "source", "n", "chars", F.round(F.col("chars") / 1e6, 3).alias("size_mb"), F.left("digest", F.lit(16)).alias("digest"))


@register("staged_totals", "SELECT count(*) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, CAST(count(DISTINCT sha256(html)) AS BIGINT) AS different FROM pages")
def staged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.octet_length("html").cast("bigint").alias("size"), F.sha2("html", 256).alias("digest"))
    each = p.groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return each.agg(F.sum("n").alias("files"), F.sum("size").alias("bytes"), F.count("*").alias("different"))


@register("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k BIGINT")
    return table(spark, sf_dir, "events").select("event_type", props["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@register("json_rows", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS doc FROM part""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("doc"))


@register(
    "contract_violations",
    """WITH v AS (SELECT vec_id, unnest([CASE WHEN len(embedding) <> 64 THEN 'length' END, CASE WHEN label IS NULL OR label < 0 OR label > 7 THEN 'label' END, CASE WHEN list_max(list_transform(embedding, lambda x: abs(x))) > 0.4 THEN 'range' END]) AS rule FROM embeddings)
    SELECT rule, count(*) AS n, min(vec_id) AS first_id FROM v WHERE rule IS NOT NULL GROUP BY rule""",
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of a tensor schema, counted with its first example."""
    e = table(spark, sf_dir, "embeddings")
    rules = {"length": F.size("embedding") != 64, "label": F.col("label").isNull() | ~F.col("label").between(0, 7), "range": F.exists("embedding", lambda x: F.abs(x) > F.lit(0.4).cast("double"))}
    found = F.array_compact(F.array(*[F.when(c, r) for r, c in rules.items()]))
    return e.select("vec_id", F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@register("truthy_settings", "SELECT event_type, count(*) FILTER (WHERE lower(trim(s)) IN ('1', 'true', 'yes', 'on')) AS n FROM (SELECT event_type, CASE user_id % 5 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'off' WHEN 2 THEN 'Yes' WHEN 3 THEN '' END AS s FROM events) GROUP BY event_type")
def truthy_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.element_at(F.array(F.lit(" TRUE "), F.lit("off"), F.lit("Yes"), F.lit(""), F.lit(None).cast("string")), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_type", X.truthy(s).cast("bigint").alias("on")).groupBy("event_type").agg(F.sum("on").alias("n"))


@register("none_or_value", "SELECT p_partkey, CASE WHEN lower(p_type) IN ('none', 'economy') OR p_name = '' THEN NULL ELSE p_type END AS kind FROM part")
def none_or_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option whose word for "none" becomes NULL."""
    kind = F.when(F.lower("p_type") == "economy", "None").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.none_or(kind).alias("kind"))


@register(
    "name_parts",
    """SELECT o_orderkey, 'run' || o_custkey AS run, o_orderpriority AS label, 'models/' || o_orderkey || '.onnx' AS path, o_orderkey || '.onnx' AS file FROM orders""",
)
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time suffixes, label=path pairs and base names."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("run"), "o_custkey", F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), "o_orderkey")
    pair = F.concat("o_orderpriority", F.lit("=models/"), "o_orderkey", F.lit(".onnx"))
    return o.select("o_orderkey", X.without_time(name).alias("run"), X.label_of(pair).alias("label"), X.path_of(pair).alias("path"), X.label_of(X.path_of(pair)).alias("file"))


@register(
    "provider_order",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'A,B' WHEN event_type = 'error' THEN 'CPUExecutionProvider' WHEN user_id % 3 = 1 THEN 'CUDAExecutionProvider,CPUExecutionProvider' WHEN event_type = 'view' THEN 'CoreMLExecutionProvider,CPUExecutionProvider' ELSE 'CPUExecutionProvider' END AS providers FROM events""",
)
def provider_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit list wins, then the CPU switch, then what is there."""
    user, kind = F.col("user_id") % 3, F.col("event_type")
    order = provider_list(F.when(user == 0, " A, ,B"), F.when(kind == "error", " Yes"), user == 1, kind == "view")
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", order).alias("providers"))
