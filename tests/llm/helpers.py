from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS).repartition(3)


def strange(df):
    """The same rows with extra columns whose names operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("_id", "fp", "key", "bucket", "kept", "node", "root", "score")})


def roots(n, links):
    """The smallest connected number of each of n."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]
