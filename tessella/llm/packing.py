"""Conflict-constrained best-fit packing of documents into training sequences of a fixed number of words.

Every document costs its words plus one for its end mark. A document of more than a sequence is cut into whole sequences and a rest.
Rows are dealt into shards of about `shard_rows` by a hash of their id and number, so that copies spread too and a shard's work is bounded whatever the
input; inside a shard, pieces go by falling length into the tightest bin that takes them: bins are
ordered by what they have left, and the successor search goes on from the first one large enough until one is
compatible. Each bin carries a bitmap of its sources and one of its duplicate clusters; a piece fits
only where its cluster isn't and its source is there fewer than `per_source` times (one bitmap for each time).
The cluster is a column of the caller's or, by default, the hash of the text with A-Z lowered, so exact copies.

Defined results: null and empty texts cost one word; a null source is a source, a null cluster conflicts with nothing; rows with a null doc_id
and repeated rows are packed like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from tessella.llm.common import stored, tune, utf8

CAPACITY, PER_SOURCE, SHARD_ROWS = 2048, 2, 4000


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin) of bins that aren't full
        self.sources: list[list[int]] = []  # per bin: bitmap k has the sources that are there more than k times
        self.clusters: list[int] = []
        self.residual: list[int] = []

    def fits(self, b: int, source: int, cluster: int) -> bool:
        """source and cluster are single bits, cluster 0 for none."""
        return not (self.clusters[b] & cluster or self.sources[b][-1] & source)

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) of the tightest compatible bin, or of a new one."""
        i = bisect_left(self.order, (length, -1))
        while i < len(self.order) and not self.fits(self.order[i][1], source, cluster):
            i += 1
        if i < len(self.order):
            b = self.order.pop(i)[1]
        else:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        offset = self.capacity - self.residual[b]
        self.residual[b] -= length
        self.clusters[b] |= cluster
        for k, seen in enumerate(self.sources[b]):
            if not seen & source:
                self.sources[b][k] |= source
                break
        if self.residual[b]:
            insort(self.order, (self.residual[b], b))
        return b, offset


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Adds bin and bin_offset; pieces: doc_id, piece, start, length, source, cluster, turn."""
    pieces = pieces.sort_values(["length", "turn", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
    source = {s: 1 << i for i, s in enumerate(pieces["source"].drop_duplicates())}
    counts = pieces["cluster"].value_counts()
    cluster = {c: 1 << i for i, c in enumerate(counts.index[counts > 1])}  # one that is alone conflicts with nothing
    bins = Bins(capacity, per_source)
    at = [bins.put(n, source[s], cluster.get(c, 0)) for n, s, c in zip(pieces["length"].tolist(), pieces["source"].tolist(), pieces["cluster"].tolist(), strict=True)]
    return pieces.assign(bin=[b for b, _ in at], bin_offset=[o for _, o in at])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = utf8(b.column(2))
        raw = data.tobytes()
        texts = [raw[x:y].lower() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        hashes = [xxh3_64_intdigest(t) for t in texts]
        words = [len(t.split()) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.array([h - (1 << 64) if h >> 63 else h for h in hashes], pa.int64())], ["doc_id", "source", "words", "copy"])


OUT = "doc_id long, piece int, start long, length long, source string, cluster long, row long, shard long, bin long, bin_offset long"


def pack(docs: DataFrame, cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece of each document: (doc_id, piece, start, length, source, cluster, bin_id, bin_offset), in words."""
    tune(docs.sparkSession)
    ids, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    if cluster is None:
        rows = docs.select(ids, F.col("source").cast("string"), text).mapInArrow(_measured, "doc_id long, source string, words long, copy long")
    else:
        words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
        rows = docs.select(ids.alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("words"), F.col(cluster).cast("long").alias("copy"))
    rows, _ = stored(rows.withColumn("row", F.monotonically_increasing_id()), "lengths")  # fixed once written
    shards = max(1, math.ceil(rows.count() / shard_rows))
    cost = F.col("words") + 1
    rows = rows.select("doc_id", F.coalesce("source", F.lit("\0")).alias("source"), F.col("copy").alias("cluster"), "row", cost.alias("cost"), F.xxhash64("doc_id", "copy").alias("turn"))
    last = F.greatest(F.lit(0), F.floor((F.col("cost") - 1) / capacity)).cast("int")
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("cost") - start).alias("length"), "source", "cluster", "row", "turn", F.pmod(F.xxhash64("turn", "row"), F.lit(shards)).alias("shard"))
    whole = F.col("length") == capacity  # a piece that fills its bin has nothing to share
    alone = pieces.where(whole).withColumns({"bin": F.lit(-1).cast("long"), "bin_offset": F.lit(0).cast("long")})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf, capacity, per_source).drop(columns="turn")

    packed = pieces.where(~whole).groupBy("shard").applyInPandas(one, OUT).unionByName(alone.drop("turn"))
    bin_id = F.when(F.col("bin") < 0, F.concat_ws("-", F.lit("w"), "row", "piece")).otherwise(F.concat_ws("-", F.lit("s"), "shard", "bin"))
    return packed.select("doc_id", "piece", "start", "length", F.nullif("source", F.lit("\0")).alias("source"), "cluster", bin_id.alias("bin_id"), "bin_offset")
