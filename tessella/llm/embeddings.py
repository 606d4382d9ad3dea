"""Near-duplicate embeddings: sorted projection passes, exact cosines, components, exact link counts.

Equal vectors of one label are one class from the first shuffle on. In each pass every class gets a key, the signs of its products
with that pass's random directions one after another, seen from the label's mean; classes are ordered by label and key, cut into even ranges, and each is compared with
the `window` next ones, over the edges of ranges too. Near vectors agree in most signs, so they are neighbours in some pass with a probability that
grows with the passes. Each label has as many as it needs for a recall of RECALL of lone pairs at the threshold; that follows from its size and from how crowded it is, measured on a sample of
SAMPLE vectors a label (see `crowding`). Labels so crowded that they would need more than MOST passes are compared whole, in pairs of blocks, which finds every link. Pairs with a cosine (double precision) of `threshold` or more are united across all
passes. Within each component, pairs are then compared in blocks of at most `block` classes a side, so that n_links counts
the links of a group of copies that is larger than any window as well.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with nothing and
are their own component; vectors of different lengths don't link; labels of any type count as equal where their values are; a null vec_id is returned with no links and a null component; rows repeated with
one vec_id and vector count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from xxhash import xxh3_128_digest

from tessella.llm.common import components, find, partitions, stored, tune, unite

THRESHOLD, PASSES, DIRECTIONS, WINDOW, BLOCK, RECALL = 0.93, 16, 30, 16, 1024, 0.999
SAMPLE, MOST, WHOLE_BLOCK, BROADCAST_ROWS = 256, 160, 8192, 200_000


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that bring a lone pair at the threshold within the window of one another with the wanted probability, among n vectors of spread directions.

    The pair has to agree in the leading log2(n / window) signs of some pass.
    """
    if n <= window or threshold >= 1:
        return 1
    met = (1 - math.acos(threshold) / math.pi) ** math.ceil(math.log2(n / window))
    return math.ceil(math.log(1 - recall) / math.log(1 - met)) if met < 1 else 1


def _dense(column: pa.Array, kind: str) -> list[bytes | None]:
    """Each vector's bytes; None where it can't be compared."""
    out: list[bytes | None] = []
    for x in column:
        v = None if not x.is_valid else x.values
        if v is None or not len(v) or v.null_count:
            out.append(None)
            continue
        a = v.to_numpy(zero_copy_only=False).astype(kind)
        out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
    return out


def _keyed(kind: str, with_vector: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, vec = b.column(1).to_pylist(), _dense(b.column(2), kind)
            vec = [None if n is None or i is None else v for i, n, v in zip(b.column(0).to_pylist(), label, vec, strict=True)]
            key = [None if v is None else xxh3_128_digest(v, seed=n & (2**64 - 1)) for n, v in zip(label, vec, strict=True)]
            cols, names = [b.column(0), pa.array(key, pa.binary())], ["vec_id", "key"]
            if with_vector:
                cols, names = [*cols, b.column(1), pa.array(vec, pa.binary())], [*names, "label", "v"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def directions(pass_: int, dim: int) -> np.ndarray:
    return np.random.default_rng([0xE3B, pass_, dim]).standard_normal((dim, DIRECTIONS))


def matrix(values: np.ndarray | list, kind: str) -> np.ndarray:
    """Unit rows in double precision; all of one length."""
    x = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def needed_passes(n: float, near: float, other: float, window: int = WINDOW, recall: float = RECALL) -> float:
    """Passes for the wanted recall of a pair that agrees in a sign with probability `near`, among n vectors that agree with it with probability `other`."""
    if n <= window or near >= 1:
        return 1
    if other >= 1 or near <= 0:
        return math.inf
    met = near ** math.ceil(math.log(n / window) / -math.log(other))
    return math.ceil(math.log(1 - recall) / math.log1p(-met)) if met > 1e-12 else math.inf


def crowding(x: np.ndarray, mean: np.ndarray, n: int, threshold: float, window: int, fractions: tuple[float, ...] = (1.0, 0.3, 0.1, 0.03)) -> float:
    """Passes that a label needs. x: a sample of its unit vectors; mean: the mean of all n.

    Seen from the mean, a pair at the threshold lies closer together, and others further apart. The others that a vector has to be told from are all, or the nearest part of them where they lie in crowds
    of their own; the most demanding part counts. Those that would link anyway don't.
    """
    from_mean = x - mean
    size = np.sqrt(np.einsum("ij,ij->i", from_mean, from_mean))
    spread = float(np.mean(size**2))
    if len(x) < 3 or spread <= (1 - threshold) / 2:  # all of them link
        return 1
    near = 1 - math.acos(max(-1.0, 1 - (1 - threshold) / spread)) / math.pi
    cos = (from_mean @ from_mean.T) / np.maximum(size[:, None] * size, 1e-300)
    cos[(x @ x.T >= threshold) | np.eye(len(x), dtype=bool)] = np.nan
    angle = np.sort(np.arccos(np.clip(cos, -1, 1)), axis=1)  # the nearest first, NaN last
    found = 1.0
    for f in fractions:
        some = angle[:, : max(1, int(f * (len(x) - 1)))]
        if np.isfinite(some).any():
            found = max(found, needed_passes(f * n, near, 1 - float(np.nanmean(some)) / math.pi, window))
    return found


def _sums(kind: str, most: int = 5000):
    """(label, dim, n, sum of the unit vectors): one row for each label that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tobytes() for v in held.values()], pa.binary())], ["label", "dim", "n", "total"])
            held.clear()
            return out

        for b in batches:
            label, v = b.column(0).to_numpy(), b.column(1).to_pylist()
            size = np.array([len(x) for x in v], np.int64)
            for key in {*zip(label.tolist(), size.tolist(), strict=True)}:
                rows = np.flatnonzero((label == key[0]) & (size == key[1]))
                n, total = held.get(key, (0, 0.0))
                held[key] = n + len(rows), total + matrix([v[i] for i in rows], kind).sum(axis=0)
            if len(held) > most:
                yield flush()
        yield flush()

    return run


def planned(classes: DataFrame, kind: str, threshold: float, window: int, least: int, most: int = MOST) -> DataFrame:
    """(label, dim, passes, mean): what each label needs; passes is 0 where it is compared whole. classes: (id, label, v)."""

    def plan(sums: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        if not len(sums):
            return pd.DataFrame({"label": [], "dim": [], "passes": [], "mean": []})
        n = int(sums["n"].sum())
        mean = np.sum([np.frombuffer(t) for t in sums["total"]], axis=0) / n
        need = crowding(matrix(sample["v"].tolist(), kind), mean, n, threshold, window) if len(sample) and n > window else 1
        return pd.DataFrame({"label": sums["label"].iloc[:1], "dim": sums["dim"].iloc[:1], "passes": [0 if need > most else max(least, int(need))], "mean": [mean.tobytes()]})

    dim = F.octet_length("v").cast("int")
    rows = classes.select("label", dim.alias("dim"), "v", F.row_number().over(Window.partitionBy("label", dim).orderBy(F.xxhash64("id"), "id")).alias("k")).where(F.col("k") <= SAMPLE).drop("k")
    sums = classes.select("label", "v").mapInArrow(_sums(kind), "label long, dim int, n long, total binary")
    return sums.groupBy("label", "dim").cogroup(rows.groupBy("label", "dim")).applyInPandas(plan, "label long, dim int, passes int, mean binary")


def _projected(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pass, label, dim, sort key, id, v) of each class in each of its label's passes; batches: id, label, v, passes, mean."""
        for b in batches:
            v, mean = b.column(2).to_pylist(), b.column(4).to_pylist()
            size, passes = np.array([len(x) for x in v], np.int64), b.column(3).to_numpy()
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = matrix([v[i] for i in rows], kind) - np.frombuffer(b"".join(mean[i] for i in rows)).reshape(len(rows), -1)
                for p in range(passes[rows].max()):
                    own = passes[rows] > p
                    part = b.take(pa.array(rows[own]))
                    bits = (x[own] @ directions(p, x.shape[1]) > 0).astype(np.int64)
                    key = bits @ (1 << np.arange(DIRECTIONS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, p, np.int32)), part.column(1), pa.array(np.full(part.num_rows, dim, np.int32)), pa.array(key), part.column(0), part.column(2)], ["p", "label", "dim", "key", "id", "v"])

    return run


def least_connected(near: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 256) -> np.ndarray:
    """(node, smallest id that it is connected with) of the ids of rows, then of columns; near: which row links with which column."""
    low, high = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        before = low.sum() + high.sum()
        for lo in range(0, len(a), chunk):
            part = near[lo : lo + chunk]
            low[lo : lo + chunk] = np.minimum(low[lo : lo + chunk], np.where(part, high, top).min(axis=1))
            high = np.minimum(high, np.where(part, low[lo : lo + chunk, None], top).min(axis=0))
        if low.sum() + high.sum() == before:
            return np.stack([np.concatenate([a, b]), np.concatenate([low, high])])


def _whole(kind: str, threshold: float, chunk: int = 1024):
    """Over rows sorted by (label, dim, i, j): each member of two facing blocks that has links, and the smallest id that links between the blocks connect it with."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            side, ids = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            v = [y for x in held for y in x[2]]
            a, b = np.flatnonzero(side == last[2]), np.flatnonzero(side == last[3])
            out = np.zeros((2, 0), np.int64)
            if len(a) and len(b):
                x, y = matrix([v[k] for k in a], kind), matrix([v[k] for k in b], kind)
                near = np.concatenate([x[lo : lo + chunk] @ y.T >= threshold for lo in range(0, len(a), chunk)])
                near &= ids[a][:, None] != ids[b]
                row, col = near.any(axis=1), near.any(axis=0)
                if row.any():
                    out = least_connected(near[row][:, col], ids[a][row], ids[b][col])
                    out = out[:, out[0] != out[1]]
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"])

        held: list[tuple] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(k).to_numpy() for k in range(4)]
            edge = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            v = b.column(6).to_pylist()
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows], strict=True):
                if (it := tuple(k[lo] for k in keys)) != last:
                    if held:
                        yield done()
                    held, last = [], it
                held.append((b.column(4).to_numpy()[lo:hi], b.column(5).to_numpy()[lo:hi], v[lo:hi]))
        if held:
            yield done()

    return scan


def whole_links(members: DataFrame, kind: str, threshold: float, block: int = WHOLE_BLOCK) -> DataFrame:
    """(a, b): links that connect what the links of whole labels connect. members: (id, label, v)."""
    dim = F.octet_length("v").cast("int")
    rows, _ = stored(members.select("id", "label", dim.alias("dim"), "v"), "crowded")
    sizes = rows.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("cut"))
    rows = rows.join(sizes, ["label", "dim"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    rows = rows.select("label", "dim", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "v")
    order = ["label", "dim", "i", "j"]
    return rows.repartition(partitions(members.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_whole(kind, threshold), "a long, b long")


EDGES = ["a", "b", "p", "label", "dim", "key", "id", "v"]
EDGE_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
DEALT = "p int, label long, dim int, key long, id long, v binary"


def _windows(kind: str, window: int, threshold: float, chunk: int = 8192):
    """Links among neighbours of sorted rows; pairs that are already connected within a chunk are left out."""

    def links(run: np.ndarray, ids: np.ndarray, v: list, dims: np.ndarray) -> pa.RecordBatch:
        parent: dict[int, int] = {}
        out = []
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x, r, i = matrix([v[k] for k in rows], kind), run[rows], ids[rows]
            for d in range(1, min(window, len(rows) - 1) + 1):
                same = np.flatnonzero(r[:-d] == r[d:])
                near = same[np.einsum("ij,ij->i", x[same], x[same + d]) >= threshold]
                for a, b in zip(i[near].tolist(), i[near + d].tolist(), strict=True):
                    if a not in parent or b not in parent or find(parent, a) != find(parent, b):
                        unite(parent, a, b)
                        out.append((a, b))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def linked(held: tuple) -> pa.RecordBatch:
        p, label, dim, _, ids, v = held
        run = np.concatenate([[0], np.cumsum((p[1:] != p[:-1]) | (label[1:] != label[:-1]) | (dim[1:] != dim[:-1]))])
        pairs = links(run, ids, v, dim)
        return pa.RecordBatch.from_arrays([*pairs.columns, *(pa.nulls(pairs.num_rows, t) for t in EDGE_TYPES)], EDGES)

    def edge(rows: list[tuple]) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(EDGE_TYPES))], EDGES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b) of links, then the first and last `window` rows of the range (a and b null)."""
        held: list[tuple] = []
        size = 0
        first: list[tuple] | None = None

        def joined() -> tuple:
            return *(np.concatenate([x[k] for x in held]) for k in range(5)), [y for x in held for y in x[5]]

        for b in batches:
            if not b.num_rows:
                continue
            held.append((*(b.column(k).to_numpy(zero_copy_only=False) for k in range(5)), b.column(5).to_pylist()))
            size += b.num_rows
            if size >= chunk:
                whole = joined()
                yield linked(whole)
                first = list(zip(*(x[:window] for x in whole), strict=True)) if first is None else first
                held = [tuple(x[-window:] for x in whole)]
                size = len(held[0][0])
        if held:
            whole = joined()
            yield linked(whole)
            if first is None:
                n = len(whole[0])
                yield edge([tuple(x[i] for x in whole) for i in sorted({*range(min(window, n)), *range(max(0, n - window), n)})])
            else:
                yield edge(first + list(zip(*(x[-window:] for x in whole), strict=True)))

    return scan


def _counted(kind: str, threshold: float):
    """Over rows sorted by (root, i, j): links of each member of a block with those of the facing block."""

    def block(i: int, j: int, side: np.ndarray, ids: np.ndarray, v: list, copies: np.ndarray) -> list[np.ndarray]:
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        x, y = matrix([v[k] for k in a], kind), matrix([v[k] for k in b], kind)
        near = x @ y.T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            return [np.stack([ids[a], near @ copies[b]])]
        return [np.stack([ids[a], near @ copies[b]]), np.stack([ids[b], copies[a] @ near])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> None:
            side, ids, copies = (np.concatenate([x[k] for x in held]) for k in (0, 1, 3))
            v = [y for x in held for y in x[2]]
            sizes = {len(y) for y in v}
            if len(sizes) == 1 and (side == last[1]).any() and (side == last[2]).any():
                out.extend(block(last[1], last[2], side, ids, v, copies))

        held: list[tuple] = []
        out: list[np.ndarray] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            root, i, j, side, ids, copies = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 6))
            v = b.column(5).to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
                if (it := (root[lo], i[lo], j[lo])) != last:
                    if held:
                        done()
                    held, last = [], it
                held.append((side[lo:hi], ids[lo:hi], v[lo:hi], copies[lo:hi]))
            if out:
                x = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["id", "n"])
                out = []
        if held:
            done()
        x = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["id", "n"])

    return scan


def link_counts(members: DataFrame, kind: str, threshold: float, block: int) -> DataFrame:
    """(id, n): how many vectors outside its class each class links with. members: (root, id, v, copies)."""
    spark = members.sparkSession
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    cut = F.ceil(F.col("size") / block).cast("int")
    rows = members.join(sizes, "root").withColumn("cut", cut).withColumn("side", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    rows = rows.select("root", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "v", "copies")
    rows = rows.repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return rows.mapInArrow(_counted(kind, threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def window_links(dealt: DataFrame, kind: str, window: int, threshold: float) -> DataFrame:
    """(a, b): links among neighbours in the order of the rows. The rows beside the edges of ranges, 2 * window a range, are compared once more in one task."""
    order = ["p", "label", "dim", "key", "id"]
    dealt = dealt.repartitionByRange(partitions(dealt.sparkSession), *order).sortWithinPartitions(*order)
    found, _ = stored(dealt.mapInArrow(_windows(kind, window, threshold), f"a long, b long, {DEALT}"), "links")
    edges = found.where("a is null").select(*order, "v").repartition(1).sortWithinPartitions(*order)
    across = edges.mapInArrow(_windows(kind, window, threshold), f"a long, b long, {DEALT}")
    return found.unionAll(across).where("a is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; vectors: (vec_id, embedding, label). passes: at least so many."""
    spark = vectors.sparkSession
    tune(spark)
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    label = F.col("label")
    if not isinstance(vectors.schema["label"].dataType, T.IntegralType):  # other labels are known by a hash of theirs
        label = F.when(label.isNotNull(), F.xxhash64(label))
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("embedding"))
    rows, _ = stored(source.mapInArrow(_keyed(kind, False), "vec_id long, key binary"), "vectors")
    whole = source.mapInArrow(_keyed(kind, True), "vec_id long, key binary, label long, v binary").where("key is not null")
    found = whole.groupBy("key").agg(F.min("vec_id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"))
    copies = rows.where("key is not null").distinct().groupBy("key").agg(F.count("*").alias("copies"))
    classes, _ = stored(found.join(copies, "key"), "classes")

    plan, _ = stored(planned(classes.select("id", "label", "v"), kind, threshold, window, passes), "passes")
    few = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = plan.withColumnsRenamed({"label": "_label", "dim": "_dim"})
    ready = classes.select("id", "label", "v").join(F.broadcast(side) if few else side, (F.col("label") == F.col("_label")) & (F.octet_length("v") == F.col("_dim"))).select("id", "label", "v", "passes", "mean")
    links = window_links(ready.where("passes > 0").mapInArrow(_projected(kind), DEALT), kind, window, threshold)
    if not plan.where("passes = 0").isEmpty():
        links = links.unionAll(whole_links(ready.where("passes = 0").select("id", "label", "v"), kind, threshold))
    roots = components(links)

    named = classes.join(roots, classes["id"] == roots["node"], "left").select("key", "id", "v", "copies", F.coalesce("root", "id").alias("root"))
    large = named.join(roots.select("root").distinct(), "root", "left_semi").select("root", "id", "v", "copies")
    counts, _ = stored(link_counts(large, kind, threshold, block), "counts")
    named = named.select("key", "id", "copies", F.col("root").alias("component_id")).join(counts, "id", "left")
    named = named.select("key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = rows.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
