"""Exact deduplication: static binary-fuse filters over immutable snapshots, exact buckets behind them.

A snapshot is what earlier batches left: one row for each distinct digest (digest, key, bucket, keep_id, group_size)
and one binary-fuse filter for each bucket of keys. Filters never change; a new batch gets its own. Digests of an
incoming batch are first grouped among themselves, so that a text copied a million times is one row from then on,
then screened by the filter of their bucket. What the filter lets through is joined with the snapshot's exact
bucket by digest and its bytes are compared with those of the stored text.

Defined results: a null text counts as empty; a null doc_id is a document like any other and never wins against an id
(a group of null ids only has a null keep_id); one row of each group stays, so of several rows with the winning id (or of null ids only) just one is
kept, whichever; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm.common import fresh, lower_az, partitions, stored, tune, utf8

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """MurmurHash3's finaliser, over uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A three-wise binary-fuse filter with 8-bit fingerprints (Graf and Lemire, 2022): about 9 bits a key, no false negatives."""

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix64(keys + np.uint64(seed))
            first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        inside = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & inside)
        third = (first + np.uint64(2 * segment)) ^ (h & inside)
        print_ = ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)
        return np.stack([first, second, third]).astype(np.int64), print_

    @classmethod
    def build(cls, keys: np.ndarray, attempts: int = 100) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, np.int64).view(np.uint64))
        n = len(keys)
        segment = min(1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)), 1 << 18)
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, -(-round(n * factor) // segment) - 2)
        for seed in range(1, attempts):
            at, print_ = cls._places(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1), segment, segments)
            order = cls._peel(at, n, (segments + 2) * segment)
            if order is None:
                segments += seed % 4 == 0
                continue
            slots = np.zeros((segments + 2) * segment, np.uint8)
            for key, slot in reversed(order):
                slots[slot] = 0
                slots[slot] = print_[key] ^ slots[at[0, key]] ^ slots[at[1, key]] ^ slots[at[2, key]]
            return cls(seed, segment, segments, slots)
        raise RuntimeError(f"no binary-fuse filter over {n} keys in {attempts} attempts")

    @staticmethod
    def _peel(at: np.ndarray, n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, their slots): each key alone in its slot once the rounds before it are gone."""
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        out, left, front = [], n, np.flatnonzero(count == 1)
        while len(front):
            keys, first = np.unique(owner[front], return_index=True)
            out.append((keys, front[first]))
            left -= len(keys)
            touched = at[:, keys]
            np.subtract.at(count, touched.ravel(), 1)
            np.bitwise_xor.at(owner, touched.ravel(), np.tile(keys, 3))
            front = np.unique(touched)
            front = front[count[front] == 1]
        return None if left else out

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.int64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, print_ = self._places(np.asarray(keys, np.int64).view(np.uint64), self.seed * 0x9E3779B97F4A7C15 & (2**64 - 1), self.segment, self.segments)
        s = self.slots
        return (s[at[0]] ^ s[at[1]] ^ s[at[2]]) == print_


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = utf8(b.column(1))
        raw = data.tobytes()
        hexes = [hashlib.sha256(raw[x:y].lower()).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexes, pa.string())], ["doc_id", "text_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every row; bytes.lower() lowers A-Z only."""
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests, "doc_id long, text_sha256 string")


def grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """One row for each digest of a batch: its largest id, the row that has it, and its size; partial sums before the shuffle."""
    key = F.xxhash64("text_sha256")
    groups = rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size"))
    groups = groups.select("text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")
    return groups.withColumns({"key": key, "bucket": F.pmod(key, F.lit(buckets)).cast("int")})


FILTER = "bucket int, seed int, segment int, segments int, slots binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = BinaryFuse.build(pdf["key"].to_numpy())
    return pd.DataFrame([[pdf["bucket"].iloc[0], f.seed, f.segment, f.segments, f.slots.tobytes()]], columns=["bucket", "seed", "segment", "segments", "slots"])


def filters(snapshot: DataFrame) -> DataFrame:
    """The filter of every bucket of a snapshot."""
    return snapshot.select("bucket", "key").groupBy("bucket").applyInPandas(_build, FILTER)


def _screen(batch: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
    if len(batch) and len(filt):
        r = filt.iloc[0]
        f = BinaryFuse(int(r["seed"]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["slots"], np.uint8))
        batch = batch[f.contains(batch["key"].to_numpy())]
    else:
        batch = batch.iloc[:0]
    return batch[["text_sha256", "keep_id"]]


def screen(batch: DataFrame, filt: DataFrame) -> DataFrame:
    """The batch's groups that their bucket's filter lets through."""
    left = batch.select("bucket", "key", "text_sha256", F.col("keep_id")).groupBy("bucket")
    return left.cogroup(filt.groupBy("bucket")).applyInPandas(_screen, "text_sha256 string, keep_id long")


def same_bytes(docs: DataFrame, positives: DataFrame, snapshot: DataFrame, broadcast_rows: int = 250_000) -> DataFrame:
    """Digests that are both in the batch's positives and in the snapshot's exact bucket and whose two texts are equal byte by byte.

    Texts are fetched for the two representatives only, by id and digest. Those (about 80 bytes each) are broadcast up to
    broadcast_rows, else joined by a shuffle.
    """
    hit = positives.join(snapshot.select("text_sha256", F.col("keep_id").alias("old_id")), "text_sha256")
    hit, _ = stored(hit, "positives")
    ids = hit.select("text_sha256", F.explode(F.array("keep_id", "old_id")).alias("doc_id")).distinct().withColumnRenamed("text_sha256", "digest")
    few = hit.count() <= broadcast_rows
    if few:
        ids = F.broadcast(ids)
    # Rows of other ids go before anything is hashed; an id that has many texts meets each of them once.
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    who = hit.select(F.explode(F.array("keep_id", "old_id")).alias("who")).distinct()
    raw = raw.join(F.broadcast(who) if few else who, raw["doc_id"].eqNullSafe(who["who"]), "left_semi")
    raw = raw.select("doc_id", lower_az(F.col("text")).alias("low")).withColumn("sha", F.coalesce(F.sha2("low", 256), F.lit("")))  # never null, so no filter on it is put before the join
    seen = raw.join(ids, raw["doc_id"].eqNullSafe(ids["doc_id"]) & (raw["sha"] == ids["digest"]))
    seen = seen.groupBy("digest").agg(F.min("low").alias("a"), F.max("low").alias("b"))
    return seen.where("a = b").select(F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, keys_a_bucket: int = 100_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    There are as many buckets as shuffle partitions, and more where a bucket would have over keys_a_bucket keys. Half of the rows, by a hash of their id, are the first batch: they become the snapshot. The others are the
    incoming batch that is screened against it. The result doesn't depend on that cut.
    """
    rows, _ = stored(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")  # numbers are fixed once written
    buckets = max(partitions(docs.sparkSession), math.ceil(rows.count() / keys_a_bucket))
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    snapshot, _ = stored(grouped(rows.where(early), buckets), "snapshot")
    batch = grouped(rows.where(~early), buckets)
    positives = screen(batch, filters(snapshot))
    both = same_bytes(docs, positives, snapshot)
    sides = snapshot.withColumn("early", F.lit(True)).unionByName(batch.withColumn("early", F.lit(False)))
    sides = sides.join(both.withColumn("same", F.lit(True)), "text_sha256", "left")
    # Groups met in both batches are one; equal digests of different bytes stay apart.
    side = F.when(F.col("same"), F.lit(None).cast("boolean")).otherwise(F.col("early"))
    groups = sides.groupBy("text_sha256", side.alias("side")).agg(F.max(F.struct("keep_id", "keep_row")).alias("top"), F.sum("group_size").alias("group_size"))
    groups = groups.where("group_size > 1").select("text_sha256", "side", "top.keep_id", "top.keep_row", "group_size")
    rows = rows.withColumn("early", early)
    on = (rows["text_sha256"] == groups["text_sha256"]) & (groups["side"].isNull() | (groups["side"] == rows["early"]))
    out = rows.join(groups, on, "left").select(
        rows["doc_id"], F.when(groups["group_size"].isNull(), rows["doc_id"]).otherwise(groups["keep_id"]).alias("keep_id"),
        F.coalesce(groups["group_size"], F.lit(1)).cast("long").alias("group_size"), F.coalesce(groups["keep_row"] == rows["row"], F.lit(True)).alias("kept"), rows["text_sha256"],
    )
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _with_digest(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            raw = data.tobytes()
            hexes = [hashlib.sha256(raw[x:y].lower()).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hexes, pa.string())], [*b.schema.names, name])

    return run


def drop_copies(docs: DataFrame, broadcast_rows: int = 250_000) -> DataFrame:
    """The rows of docs that stay, one for each distinct text. Those that go (about 80 bytes each) are broadcast up to broadcast_rows, else joined by a shuffle."""
    groups, _ = stored(exact_dedup(docs).where("not kept").select("doc_id", "text_sha256", "keep_id"), "copies")
    id_, sha, own = fresh(docs, "id"), fresh(docs, "sha"), fresh(docs, "digest")
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = groups.where(~winner).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct()
    if groups.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.StringType())])
    rows = docs.mapInArrow(_with_digest(own), schema)
    out = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)), "left_anti")
    out = out if groups.where(winner).isEmpty() else out.dropDuplicates(["doc_id", own])
    return out.drop(own)
