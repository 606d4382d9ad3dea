"""Hard negatives by a distributed nearest-neighbour join over a Voronoi partition.

Vectors become integers, floor(scale * x). With one more component, sqrt(M^2 - |x|^2) for rows (M: the largest norm) and 0 for anchors, which are also
stretched to the norm M, a higher inner product is a smaller distance. Every row and anchor belongs to the nearest of some pivots, which are fitted on at most SAMPLE rows.

Both searches, for each anchor's positives (rows of its label) and for the negatives in the window of scores that each positive sets, go the same way. (1) Anchors are joined with the rows
of their own cell, which gives a score that the k-th result reaches at least. (2) That score and the window become distances; from them, the anchors' largest distances to their pivots and the pivots'
distances follow, for each group of anchors and each cell, the distances to its pivot that a row of the cell must have to be of use to the group (triangle inequality); a row is copied to these groups only. (3) Each
group is joined exactly, in integers, with its rows, cut into slices of about SLICE rows, and the slices' results are merged. Bounds have slack for rounding; scores have none.

Groups are cells that lie together, for about GROUP anchors each; one with more is dealt out by a hash of the id. So a task holds about GROUP anchors and a batch of rows,
whatever a label, a cell or a group of copies holds. What stays quadratic is the arithmetic of anchors with rows that the bounds can't tell apart.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part, nor do vectors whose squared integer norm exceeds 2^56 (scores stay in 64 bits so); a shorter
vector counts as filled up with zeros; rows that repeat a vec_id count once, the one with the smallest label, then vector; labels of other types than integers are known by a hash of theirs; equal scores go by the
smaller vec_id; an anchor without positives or without negatives has no rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessella.llm.common import partitions, stored, tune

SAMPLE, PIVOTS, GROUP, SLICE = 4096, 512, 256, 2048
BROADCAST_ROWS = 200_000
NORM = float(1 << 56)
EDGE = 1 << 60  # beyond all scores


def _scaled(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, label, vector as 32-bit integers, dimensions, squared norm) of the rows that take part."""
        for b in batches:
            keep, out, dims, norms = [], [], [], []
            for k, (i, label, x) in enumerate(zip(b.column(0), b.column(1), b.column(2), strict=True)):
                if not (i.is_valid and label.is_valid and x.is_valid) or x.values.null_count:
                    continue
                v = np.floor(x.values.to_numpy(zero_copy_only=False) * scale)
                norm = float(v @ v)
                if norm <= NORM:  # false for NaN as well
                    keep.append(k)
                    out.append(v.astype("<i4").tobytes())
                    dims.append(len(v))
                    norms.append(norm)
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())], ["id", "label", "v", "dim", "norm"])

    return run


def integers(values: list[bytes], dim: int) -> np.ndarray:
    """Rows of `dim` integers."""
    return np.frombuffer(b"".join(v.ljust(4 * dim, b"\0") for v in values), "<i4").reshape(len(values), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, in doubles where they hold them."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Space:
    """Pivots in the space with one more component, and how rows and anchors get there."""

    def __init__(self, sample: list[bytes], dim: int, norm: float, pivots: int):
        self.dim, self.norm = dim, norm
        x = self.rows(sample)
        rng = np.random.default_rng(11)
        self.pivots = x[rng.choice(len(x), min(pivots, len(x)), replace=False)]
        for _ in range(4):
            near, _ = self.nearest(x)
            sums, n = np.zeros_like(self.pivots), np.bincount(near, minlength=len(self.pivots))
            np.add.at(sums, near, x)
            self.pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.pivots)
        self.between = np.stack([np.sqrt(((self.pivots - p) ** 2).sum(1)) for p in self.pivots])
        self.slack = 1e-6 * max(norm, 1.0)

    def rows(self, values: list[bytes]) -> np.ndarray:
        x = integers(values, self.dim).astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]])

    def stretch(self, x: np.ndarray) -> np.ndarray:
        """What anchors are multiplied by; 0 for the zero vector."""
        size = np.sqrt((x * x).sum(1))
        return np.where(size > 0, self.norm / np.maximum(size, 1e-300), 0.0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of each row."""
        cell = np.argmin((self.pivots * self.pivots).sum(1) - 2 * (x @ self.pivots.T), axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))

    def regions(self, n: int) -> np.ndarray:
        """The pivots' region, of at most n: a coarser partition, by the same rule."""
        n = min(n, len(self.pivots))
        cores = [0]
        while len(cores) < n:  # farthest first
            cores.append(int(np.argmax(self.between[cores].min(0))))
        return np.argmin(self.between[cores], axis=0)


def _celled(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, r = space.nearest(space.rows(b.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(r)], ["id", "label", "v", "cell", "r"])

    return run


def _anchored(space: Space):
    """Adds cell, distance to the pivot and stretch to anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b.column(2).to_pylist(), space.dim).astype(np.float64)
                s = space.stretch(x)
                cell, r = space.nearest(np.hstack([x * s[:, None], np.zeros((len(x), 1))]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(r), pa.array(s)], [*b.schema.names, "cell", "r", "stretch"])

    return run


class Scan:
    """The k best rows of each window of each anchor of one group, over all rows that pass by. An anchor is (id, label, v, lows, highs)."""

    def __init__(self, anchors: list[tuple], dim: int, k: int, same: bool):
        self.dim, self.k, self.same = dim, k, same
        self.anchors = anchors
        self.ids, self.labels = (np.array([a[c] for a in anchors], np.int64) for c in (0, 1))
        self.v = integers([a[2] for a in anchors], dim)
        self.window = [(n, w, lo, hi) for n, a in enumerate(anchors) for w, (lo, hi) in enumerate(zip(a[3], a[4], strict=True))]
        self.of = np.array([x[0] for x in self.window], np.int64)
        self.low, self.high = (np.array([x[c] for x in self.window], np.int64) for c in (2, 3))
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.window]

    def feed(self, ids: np.ndarray, labels: np.ndarray, values: list[bytes]) -> None:
        s = products(self.v, integers(values, self.dim))
        fits = (self.labels[:, None] == labels) == self.same
        fits &= self.ids[:, None] != ids
        low = np.array([max(lo, f[-1][0]) if len(f := self.found[n]) == self.k else lo for n, lo in enumerate(self.low)])
        for lo in range(0, len(self.window), 512):
            part = slice(lo, lo + 512)
            own = s[self.of[part]]
            ok = (own >= low[part, None]) & (own <= self.high[part, None]) & fits[self.of[part]]
            n, j = np.nonzero(ok)
            if not len(n):
                continue
            at = np.flatnonzero(np.diff(n, prepend=-1))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(n)], strict=True):
                w, cols = int(n[a]), j[a:b]
                score, who = own[w, cols], ids[cols]
                if len(cols) > 4 * self.k:
                    edge = np.partition(score, len(score) - self.k)[-self.k]
                    keep = score >= edge
                    score, who = score[keep], who[keep]
                new = {(int(x), int(i)) for x, i in zip(score, who, strict=True)} | set(self.found[lo + w])
                self.found[lo + w] = sorted(new, key=lambda x: (-x[0], x[1]))[: self.k]

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [(self.anchors[n][0], w, i, s) for (n, w, _, _), f in zip(self.window, self.found, strict=True) for s, i in f]


FOUND = "anchor long, w int, id long, score long"
SENT = ["g", "slice", "kind", "id", "label", "v", "lows", "highs"]


def _joined(dim: int, k: int, same: bool):
    """Over rows sorted by (g, slice, kind): a slice's anchors (kind 0), then its rows."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["anchor", "w", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, scan = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            slices = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            edges = [0, *(n for n in range(1, len(slices)) if slices[n] != slices[n - 1]), len(slices)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(lo, hi - lo)
                if slices[lo][:2] != at:
                    if scan:
                        yield out(scan.rows())
                    at, anchors, scan = slices[lo][:2], [], None
                if slices[lo][2] == 0:
                    anchors += list(zip(*(part.column(c).to_pylist() for c in range(3, 8)), strict=True))
                elif anchors:
                    scan = scan or Scan(anchors, dim, k, same)
                    scan.feed(part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_pylist())
        if scan:
            yield out(scan.rows())

    return run


def join(rows: DataFrame, anchors: DataFrame, needs: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """(anchor, w, id, score): the k best rows of each anchor's windows.

    rows: (id, label, v, cell, r); anchors: (g, id, label, v, lows, highs); needs: (g, cell, low, high, label): group g wants the rows of the cell whose r is in [low, high], and of the label where that isn't null.
    """
    spark = rows.sparkSession
    needs, _ = stored(needs, "needs")
    few = needs.count() <= BROADCAST_ROWS

    def dealt(frame: DataFrame, extra: DataFrame) -> DataFrame:
        side = F.broadcast(extra) if few else extra
        on = (frame["cell"] == side["of"]) & (frame["r"] >= side["low"]) & (frame["r"] <= side["high"])
        if same:
            on &= frame["label"] == side["need"]
        return frame.join(side, on)

    wanted = needs.select("g", F.col("cell").alias("of"), "low", "high", F.col("label").alias("need"))
    sizes = dealt(rows.select("label", "cell", "r"), wanted).groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SLICE)).cast("int").alias("slices"))
    sizes, _ = stored(sizes, "slices")
    nothing = F.lit(None).cast("array<long>")
    sent = dealt(rows, wanted.join(F.broadcast(sizes) if few else sizes, "g")).select("g", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), "id", rows["label"], "v", nothing.alias("lows"), nothing.alias("highs"))
    own = anchors.join(F.broadcast(sizes) if few else sizes, "g").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("kind", F.lit(0)).select(*SENT)
    dealt_out = own.unionByName(sent).repartition(partitions(spark), "g", "slice").sortWithinPartitions("g", "slice", "kind")
    found = dealt_out.mapInArrow(_joined(dim, k, same), FOUND)
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def grouped(anchors: DataFrame, space: Space, region: np.ndarray, by_label: bool) -> DataFrame:
    """Adds g, the anchors' group: their region, and their label where by_label; more than GROUP anchors are dealt out by a hash."""
    spark = anchors.sparkSession
    own = F.element_at(F.array(*[F.lit(int(x)) for x in region]), F.col("cell") + 1)
    keys = ["region", "label"] if by_label else ["region"]
    anchors = anchors.withColumn("region", own)
    many = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    out = anchors.join(many, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    name = [F.col("region"), F.col("part"), *([F.col("label")] if by_label else [])]
    return out.withColumn("g", F.concat_ws("/", *[c.cast("string") for c in name])).drop("region", "parts", "part")


def _ranges(space: Space):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """pdf: one group's cells with reach (most of r + distance bound) and gap (least of inner distance - r)."""
        between = space.between[pdf["cell"].to_numpy()]
        reach, gap = pdf["reach"].to_numpy()[:, None] + space.slack, pdf["gap"].to_numpy()[:, None] - space.slack
        low = np.maximum(between - reach, gap - between)
        high = between + reach
        low = np.where(low <= high, low, np.inf).min(0)
        high = high.max(0)
        cell = np.flatnonzero(low <= high)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "cell": cell.astype(np.int32), "low": low[cell], "high": high[cell], "label": pdf["label"].iloc[0]})

    return run


NEEDS = "g string, cell int, low double, high double, label long"


def needed(anchors: DataFrame, space: Space, by_label: bool) -> DataFrame:
    """needs of join() from anchors with g, cell, r, far and near (squared distances that results may have at most and at least)."""
    far, near = F.sqrt(F.greatest(F.lit(0.0), "far")), F.sqrt(F.greatest(F.lit(0.0), "near"))
    label = F.first("label") if by_label else F.lit(None).cast("long")
    stats = anchors.groupBy("g", "cell").agg(F.max(F.col("r") + far).alias("reach"), F.min(near - F.col("r")).alias("gap"), label.alias("label"))
    return stats.groupBy("g").applyInPandas(_ranges(space), NEEDS)


def squared(space: Space, score: Column) -> Column:
    """The squared distance that belongs to an inner product with the anchor."""
    own = F.when(F.col("stretch") > 0, space.norm**2).otherwise(0.0)
    return own + F.lit(space.norm**2) - 2 * F.col("stretch") * score.cast("double")


def top_rows(rows: DataFrame, anchors: DataFrame, space: Space, k: int, same: bool, groups: int) -> DataFrame:
    """(anchor, w, id, score, n): anchors with lows and highs per window; n counts from 1."""
    region = space.regions(groups)
    # within the own cell first: what the k-th best reaches at least
    home, _ = stored(grouped(anchors, space, np.arange(len(space.pivots)), same), "anchors")
    needs = home.groupBy("g", "cell").agg(F.lit(0.0).alias("low"), F.lit(math.inf).alias("high"), (F.first("label") if same else F.lit(None).cast("long")).alias("label"))
    least = join(rows, home.select("g", "id", "label", "v", "lows", "highs"), needs.select("g", "cell", "low", "high", "label"), space.dim, k, same)
    least = least.where(F.col("n") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("least"))
    known = anchors.join(least.withColumnRenamed("anchor", "id"), "id", "left")
    known = known.withColumn("lows", F.transform("lows", lambda lo, w: F.coalesce(F.try_element_at("least", w), lo)))
    bounds = known.withColumns({"far": F.array_max(F.transform("lows", lambda s: squared(space, s))), "near": F.array_min(F.transform("highs", lambda s: squared(space, s)))})
    bounds, _ = stored(grouped(bounds.drop("least"), space, region, same), "anchors")
    return join(rows, bounds.select("g", "id", "label", "v", "lows", "highs"), needed(bounds, space, same), space.dim, k, same)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, pivots: int | None = None) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels with low % to high % of that score.

    vectors: (vec_id, embedding, label); anchor: a condition on the column id, which is vec_id.
    """
    spark = vectors.sparkSession
    tune(spark)
    label = F.col("label")
    if not isinstance(vectors.schema["label"].dataType, T.IntegralType):
        label = F.when(label.isNotNull(), F.xxhash64(label))
    source = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = source.mapInArrow(_scaled(scale), "id long, label long, v binary, dim int, norm double")
    rows, _ = stored(whole.groupBy("id").agg(F.min(F.struct("label", "v", "dim", "norm")).alias("x")).select("id", "x.*"), "integers")
    n, marks, dim, norm = rows.agg(F.count("*"), F.count_if(F.expr(anchor)), F.max("dim"), F.max("norm")).first()
    if not marks:
        return spark.createDataFrame([], OUT)
    limit = max(8, (1 << 22) // max(1, dim))  # so that pivots and sample take 32 MB at most
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, limit)).select("v").collect()]
    space = Space(sample, dim, math.sqrt(norm), pivots or max(8, min(PIVOTS, limit, math.isqrt(n) // 4)))
    rows, _ = stored(rows.select("id", "label", "v").mapInArrow(_celled(space), "id long, label long, v binary, cell int, r double"), "cells")
    marked = rows.where(anchor).select("id", "label", "v").mapInArrow(_anchored(space), "id long, label long, v binary, cell int, r double, stretch double")
    marked, _ = stored(marked, "anchors")
    most = marked.groupBy("label").count().agg(F.max("count")).first()[0]

    everything = marked.withColumns({"lows": F.array(F.lit(-EDGE).cast("long")), "highs": F.array(F.lit(EDGE).cast("long"))})
    near, _ = stored(top_rows(rows, everything, space, positives, True, -(-most // GROUP)), "positives")
    scores = near.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_set("score")).alias("scores"))
    down = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))  # noqa: E731  rounding down
    window = lambda s: F.struct((-down(-low * s)).alias("low"), down(high * s).alias("high"), s.alias("score"))
    windows = scores.select("id", F.filter(F.transform("scores", window), lambda x: x["low"] <= x["high"]).alias("x")).where(F.size("x") > 0)
    windows, _ = stored(windows.select("id", F.col("x.low").alias("lows"), F.col("x.high").alias("highs"), F.col("x.score").alias("scores")), "windows")
    hard = top_rows(rows, marked.join(windows.select("id", "lows", "highs"), "id"), space, negatives, False, -(-marks // GROUP))
    hard = hard.select("anchor", "w", F.col("n").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = windows.select(F.col("id").alias("anchor"), F.posexplode("scores").alias("w", "positive_score"))
    found = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(named, ["anchor", "positive_score"]).join(hard, ["anchor", "w"])
    return found.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
