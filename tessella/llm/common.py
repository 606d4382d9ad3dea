"""What the text operators share: sessions, shared folders, Arrow text buffers and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.session import new_path, remove, scope, shared_dir, stored  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, to 2,000 rows and 8 MB.

    Frames are lazy and read this when they run, so every operator sets the same bounds and whichever was called last makes no difference.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets into them; nulls are empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def find(parent: dict[int, int], x: int) -> int:
    root = x
    while (p := parent[root]) != root:
        root = p
    while (p := parent[x]) != root:
        parent[x], x = root, p
    return root


def unite(parent: dict[int, int], x: int, y: int) -> None:
    """Joins the trees of x and y; the smaller root stays."""
    a, b = find(parent, parent.setdefault(x, x)), find(parent, parent.setdefault(y, y))
    if a != b:
        parent[max(a, b)] = min(a, b)


PAIR = "node long, root long"


def _forest(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Edges to (node, smallest connected node), each node once for every `most` edges read."""

    def flush() -> pa.RecordBatch:
        nodes = [n for n in parent if parent[n] != n]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(parent, n) for n in nodes], pa.int64())], ["node", "root"])

    parent: dict[int, int] = {}
    seen = 0
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            unite(parent, x, y)
        seen += b.num_rows
        if seen >= most:
            yield flush()
            parent, seen = {}, 0
    yield flush()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (two long columns, any order, repeats allowed).

    Returns (node, root) for every node that has a smaller node in its component; root is the component's
    smallest node. Nodes that are their own root, and nulls, don't appear. Each round contracts the edges of every
    partition to a forest, then links each node's larger neighbours to its smallest one and each node's smaller
    neighbours to the smallest of them, until only stars are left; a round's edges are a table in the
    shared folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(_forest, PAIR)
    e, path = stored(e, "edges")
    for _ in range(rounds):
        ends = e.select("node", F.lit(1).alias("c"), F.lit(0).alias("r")).unionAll(e.select("root", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("c").alias("c"), F.max("r").alias("r")).where("c > 1 or (c = 1 and r = 1)").isEmpty():
            return e
        both = e.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(e.select("root", "node"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(low, "node").where("root > m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        e, old = stored(small.unionAll(low.select("node", F.col("m").alias("root"))).mapInArrow(_forest, PAIR), "edges"), path
        e, path = e
        remove(spark, old)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
