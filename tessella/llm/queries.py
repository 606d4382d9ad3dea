"""The registered queries of this folder: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import lexical, merge_dropout, warc
from tessella.llm.embeddings import near_duplicates
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.hard_negatives import hard_negatives
from tessella.llm.html import extract
from tessella.llm.online_packing import online_pack
from tessella.llm.packing import pack
from tessella.llm.simhash import simhash_groups
from tessella.llm.substring import substring_dedup
from tessella.llm.token_files import token_files
from tessella.llm.toxicity import score
from tessella.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages"))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return merge_dropout.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one, as the contract has it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), "id % 50 = 0")


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return online_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_embedding_near_dedup, op4_substring_dedup, op5_simhash_near_dedup, op6_warc, op7_merge_dropout, op8_html_extraction, op9_token_files, op10_best_fit_packing, op11_hard_negatives, op12_online_packing, op13_lexical_search)}


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def oracle_sql() -> dict[str, str]:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op2_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({lowered}) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, text_sha256
            FROM d WINDOW g AS (PARTITION BY text_sha256)
        """,
        "op3_embedding_near_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), l AS (
                SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
                ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
            ), r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.vec_id),
            c AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
            SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.root, vec_id) AS component_id, vec_id = coalesce(c.root, vec_id) AS kept
            FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
        """,
        "op6_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
            q AS (SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
            FROM q
        """,
        "op11_hard_negatives": """
            WITH v AS (
                SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
                FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
            ), p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
            SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank,
                   n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
            FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
            QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 3
        """,
        "op13_lexical_search": rf"""
            WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({lowered}, '{TERM}') AS ts FROM documents),
            i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({lowered}, '{TERM}')) AS ts FROM benchmark),
            s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
            wanted AS (SELECT DISTINCT unnest(ts) AS t FROM i),
            f AS (SELECT k, any_value(doc_id) AS doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT k, doc_id, unnest(ts) AS t, len(ts) AS n FROM d) JOIN wanted USING (t) GROUP BY k, t),
            w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t),
            r AS (SELECT q, item_id, k, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
                  FROM (SELECT q, item_id, unnest(ts) AS t FROM i) JOIN f USING (t) JOIN w USING (t), s GROUP BY q, item_id, k, doc_id),
            p AS (SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
            SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM p WHERE rank <= 50
        """,
    }
