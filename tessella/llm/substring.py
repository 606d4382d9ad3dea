"""Substring dedup: paragraph MinHash banding, exact Jaccard verification, removal by components.

A paragraph is a line of at least `min_words` words. Copies that agree in all their words (A-Z lowered, white space ignored) are one
row from the first shuffle on. The five-word shingles of each distinct paragraph give a MinHash signature, cut into bands
that are tuned for the wanted recall. Paragraphs that meet in a band are compared with the most frequent one of their bucket, the
likely original of its variants, which links a group of any size by as many comparisons as it has members; then all pairs of one bucket
that are still in different components are compared too, so no colliding pair is left out: in buckets of at most SMALL members one by one, in
larger ones by an exact prefix-filtered join inside the task that holds the bucket, which never makes rows of its pairs. Links need an exact Jaccard similarity
of the shingle sets of `threshold` or more. In each component the occurrence with the smallest (doc_id, position) stays; the others are removed.

A passage need not be a line: what the lines leave is dealt again as paragraphs that begin at every word and have PASSAGE words (A-Z lowered, any white space,
line breaks ignored). Their MinHash is the least of their GRAM-word shingles, one band of one row: equal paragraphs are bound to share it whatever stands around them
(recall 1), and neighbouring ones mostly have the same, so a text has few such anchors. Around anchors that
occur twice in the corpus every paragraph is verified by its words. Of each the
occurrence with the smallest (doc_id, text hash, position) stays; the words of the others go, except those that the staying one has itself.
Passages within other text whose edits are fewer than PASSAGE words apart are not found; lines are found up to the Jaccard threshold.

Defined results: null and empty texts have no paragraphs and stay as they are; rows with a null doc_id are left
alone and compared with nothing; rows with one doc_id and one text count once, those with other texts are documents of their own; a document may lose all its text and then stays with an empty
one; a text is read in pieces cut at line breaks, a long line in pieces cut at blanks, of which the numbers of its words (40 bytes each) stay in memory; an empty table gives an empty result; extra columns are carried by `drop_passages` and ignored by `passages`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128, xxh3_128_digest

from tessella.llm.common import components, find, fresh, partitions, remove, stored, tune, unite, utf8
from tessella.llm.toxicity import powers

SHINGLE, MIN_WORDS, THRESHOLD = 5, 20, 0.8
PIECE = 1 << 20
SMALL = 16
PASSAGE, GRAM = 51, 26
NEAR = PASSAGE - GRAM + 1
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def tune_bands(threshold: float = THRESHOLD, recall: float = 0.999, rows: int = 4) -> tuple[int, int]:
    """(bands, rows): as many bands of so many rows as find a pair at the threshold with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


BANDS, ROWS = tune_bands()
_rng = np.random.default_rng(0x5EED)
_mul = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_add = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def line_blocks(column: pa.Array, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first line numbers, bytes, offsets) in blocks of about `size` bytes; a long text is cut between lines."""
    data, at = utf8(column)
    i, n = 0, len(column)
    while i < n:
        if at[i + 1] - at[i] > size:
            raw, lo, line = data[at[i] : at[i + 1]], 0, 0
            breaks = np.flatnonzero(raw == 10)
            while lo < len(raw):
                k = np.searchsorted(breaks, lo + size)
                hi = int(breaks[min(k, len(breaks) - 1)]) + 1 if len(breaks) and breaks[-1] >= lo else len(raw)
                if k >= len(breaks):
                    hi = len(raw)
                yield np.array([i]), np.array([line]), raw[lo:hi], np.array([0, hi - lo])
                line, lo = line + int(np.count_nonzero(raw[lo:hi] == 10)), hi
            i += 1
            continue
        j = i + 1
        while j < n and at[j + 1] - at[i] <= size:
            j += 1
        yield np.arange(i, j), np.zeros(j - i, np.int64), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def blank_cuts(data: np.ndarray, size: int) -> list[int]:
    """Offsets 0, ..., len(data) about `size` apart, each but the last at white space."""
    out = [0]
    while len(data) - out[-1] > size:
        at, step = out[-1] + size, 4096
        while at < len(data):
            blank = np.flatnonzero(_space[data[at : at + step]])
            if len(blank):
                at += int(blank[0])
                break
            at, step = at + step, 2 * step
        out.append(min(at, len(data)))
    return [*out, len(data)] if out[-1] < len(data) else out


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, starts, stops, hashes) of the words of texts that begin and end at the offsets.

    A word's hash has nothing to do with its place, so one long text is read in pieces.
    """
    if len(at) == 2 and len(data) > 2 * PIECE:
        cuts = blank_cuts(data, PIECE)
        parts = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            low, starts, stops, word = word_hashes_of(data[lo:hi], np.array([0, hi - lo]))
            parts.append((low, starts + lo, stops + lo, word))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return word_hashes_of(data, at)


def word_hashes_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = _lower[data]
    inside = ~_space[low]
    head = np.zeros(len(low) + 1, bool)
    head[at] = True
    prev = np.concatenate([[False], inside[:-1]]) if len(low) else inside
    starts = np.flatnonzero(inside & (head[:-1] | ~prev))
    stops = np.flatnonzero(inside & (head[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 if len(low) else starts
    up, down = powers(len(low) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low + np.uint64(1)) * up[: len(low)], dtype=np.uint64)])
        return low, starts, stops, (sums[stops] - sums[starts]) * down[starts]


def words_digest(low: np.ndarray) -> bytes:
    """XXH3 of the words, a space between any two."""
    if len(low) <= 2 * PIECE:
        return xxh3_128_digest(b" ".join(low.tobytes().split()))
    h, cuts, gap = xxh3_128(), blank_cuts(low, PIECE), b""
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if words := b" ".join(low[lo:hi].tobytes().split()):
            h.update(gap + words)
            gap = b" "
    return h.digest()


class Lines:
    """The long lines of a block: row, position, byte span, and the hashes of their shingles."""

    def __init__(self, rows: np.ndarray, first: np.ndarray, data: np.ndarray, at: np.ndarray, min_words: int):
        self.low, starts, stops, word = word_hashes(data, at)
        self.starts, low = starts, self.low
        breaks = np.flatnonzero(low == 10)
        doc = np.searchsorted(at, starts, "right") - 1
        line = np.searchsorted(breaks, starts) + doc  # a new number after every break and every text
        edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(line))
        long = ends - edge >= min_words
        self.w0, self.w1 = edge[long], ends[long]
        d = doc[self.w0]
        self.row, self.pos = rows[d], first[d] + np.searchsorted(breaks, starts[self.w0]) - np.searchsorted(breaks, at[d])
        self.span = np.stack([starts[self.w0], stops[self.w1 - 1]], axis=1) if len(self.w0) else np.zeros((0, 2), np.int64)
        with np.errstate(over="ignore"):
            n = max(0, len(word) - SHINGLE + 1)
            h = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                h = (h ^ word[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
        self.hashes = h

    def keys(self) -> list[bytes]:
        if len(self.low) > 2 * PIECE or not len(self.span):
            return [words_digest(self.low[a:b]) for a, b in self.span.tolist()]
        low, keep = self.low.copy(), ~_space[self.low]
        gap = self.starts[1:] - 1  # white space before a word, or another text's last byte
        gap = gap[~keep[gap]]
        low[gap], keep[gap] = 32, True
        at = np.concatenate([[0], np.cumsum(keep)])[self.span]
        text = low[keep].tobytes()  # all words, a space between any two of a line
        return [xxh3_128_digest(text[a:b]) for a, b in at.tolist()]

    def shingles(self, i: int) -> np.ndarray:
        return np.unique(self.hashes[self.w0[i] : self.w1[i] - SHINGLE + 1])

    def distinct(self) -> list[int]:
        """How many different shingles each line has."""
        if len(self.hashes) > PIECE:
            return [len(self.shingles(i)) for i in range(len(self.w0))]
        hashes = self.hashes.tolist()
        return [len(set(hashes[a:b])) for a, b in zip(self.w0.tolist(), (self.w1 - SHINGLE + 1).tolist(), strict=True)]

    def bands(self) -> np.ndarray:
        """(lines, BANDS) band hashes of the MinHash signatures."""
        if not len(self.w0):
            return np.zeros((0, BANDS), np.int64)
        sizes = self.w1 - self.w0 - SHINGLE + 1
        if len(sizes) == 1 and sizes[0] > PIECE:
            return self.long_bands()
        out = np.zeros((len(sizes), BANDS), np.uint64)
        cut = np.cumsum(sizes) - sizes
        h = self.hashes[np.repeat(self.w0 - cut, sizes) + np.arange(sizes.sum())]
        mixed = np.empty_like(h)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                np.multiply(h, _mul[k], out=mixed)
                mixed += _add[k]
                least = np.minimum.reduceat(mixed, cut) >> np.uint64(20)
                out[:, k // ROWS] = (out[:, k // ROWS] ^ least) * np.uint64(0xC4CEB9FE1A85EC53)
                out[:, k // ROWS] ^= out[:, k // ROWS] >> np.uint64(29)
        return out.view(np.int64)

    def long_bands(self) -> np.ndarray:
        """The same of one long line, a piece of its shingles at a time."""
        least = np.full(BANDS * ROWS, ~np.uint64(0))
        out = np.zeros((1, BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(self.w0[0], self.w1[0] - SHINGLE + 1, PIECE):
                h = self.hashes[lo : min(lo + PIECE, self.w1[0] - SHINGLE + 1)]
                for k in range(BANDS * ROWS):
                    least[k] = min(least[k], ((h * _mul[k] + _add[k]) >> np.uint64(20)).min())
            for k in range(BANDS * ROWS):
                out[:, k // ROWS] = (out[:, k // ROWS] ^ least[k]) * np.uint64(0xC4CEB9FE1A85EC53)
                out[:, k // ROWS] ^= out[:, k // ROWS] >> np.uint64(29)
        return out.view(np.int64)


PARAGRAPH = "doc_id long, tag long, pos int, key binary"


def _paragraphs(min_words: int, banded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in line_blocks(b.column(2)):
                lines = Lines(*block, min_words)
                if not len(lines.row):
                    continue
                columns = [pa.array(ids[lines.row], pa.int64()), pa.array(tags[lines.row], pa.int64()), pa.array(lines.pos, pa.int32()), pa.array(lines.keys(), pa.binary())]
                names = ["doc_id", "tag", "pos", "key"]
                if banded:
                    bands, step = lines.bands().astype("<i8").tobytes(), 8 * BANDS
                    columns += [pa.array([bands[i * step : (i + 1) * step] for i in range(len(lines.row))], pa.binary()), pa.array(lines.distinct(), pa.int32())]
                    names += ["bands", "size"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, banded: bool = False) -> DataFrame:
    """(doc_id, tag, pos, key) of every long line of every row with an id, and its band hashes and number of shingles if banded; tag is a hash of the row's text."""
    tune(docs.sparkSession)
    return tagged(docs).mapInArrow(_paragraphs(min_words, banded), PARAGRAPH + ", bands binary, size int" * banded)


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text) of the rows with an id."""
    text = F.col("text").cast("string")
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, id) of each band of each paragraph; the hash takes in the band's number."""
    for b in batches:
        bands = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
        with np.errstate(over="ignore"):
            bands = (bands ^ np.arange(BANDS, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        yield pa.RecordBatch.from_arrays([pa.array(bands.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["hash", "id"])


def _runs(batches: Iterator[pa.RecordBatch], first: int = 1) -> Iterator[list[np.ndarray]]:
    """The columns of each run of an equal first one, over sorted input; lone rows are passed over."""
    held: list[list[np.ndarray]] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        stops = np.append(starts[1:], b.num_rows)
        worth = stops - starts > 1
        worth[[0, -1]] = True
        for lo, hi in zip(starts[worth].tolist(), stops[worth].tolist(), strict=True):
            if (it := cols[0][lo]) != last:
                if sum(len(x[0]) for x in held) > 1:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, last = [], it
            held.append([c[lo:hi] for k, c in enumerate(cols) if k >= first])
    if sum(len(x[0]) for x in held) > 1:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets with two members or more."""
    held, size = [], 0
    for hash_, ids in _runs(batches, first=0):
        held.append((hash_, ids))
        size += len(ids)
        if size >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["hash", "id"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["hash", "id"])


def _scan(pairs_of, threshold: float):
    """Over runs (ids, copies, sizes, roots): the pairs that pairs_of gives, smaller id second, in batches without repeats."""

    def run(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for ids, copies, sizes, roots in _runs(batches):
            ids, at = np.unique(ids, return_index=True)
            for a, b in pairs_of(ids, copies[at], sizes[at], roots[at]) if len(ids) > 1 else ():
                n, m = sizes[at][a], sizes[at][b]
                b = ids[b[np.minimum(n, m) >= threshold * np.maximum(n, m)]]
                parts.append(np.stack([np.maximum(b, ids[a]), np.minimum(b, ids[a])], axis=1))
                size += len(b)
                if size > most:
                    yield _pairs(parts)
                    parts, size = [], 0
        yield _pairs(parts)

    return run


def _star(ids: np.ndarray, copies: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The most frequent member with all of other components."""
    c = int(np.argmax(copies))
    yield c, np.flatnonzero(roots != roots[c])


def _across(ids: np.ndarray, copies: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every pair of different components, in small buckets."""
    if len(ids) <= SMALL:
        for i in range(len(ids) - 1):
            yield i, i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, id, root) of the members of larger buckets that hold more than one component."""
    for hash_, ids, _, _, roots in _runs(batches, first=0):
        ids, at = np.unique(ids, return_index=True)
        if len(ids) > SMALL and (roots[at] != roots[at][0]).any():
            yield pa.RecordBatch.from_arrays([pa.array(hash_[at]), pa.array(ids), pa.array(roots[at])], ["hash", "id", "root"])


def similar(sets: list[np.ndarray], roots: list[int], threshold: float) -> list[tuple[int, int]]:
    """Places of a spanning set of the pairs of different roots whose Jaccard similarity reaches the threshold; exact.

    By size, each set is looked up in an index of the smaller ones by its rarest shingles: |x| - ceil(t |x|) + 1 of them on the looking
    side and |y| - ceil(2t/(1+t) |y|) + 1 on the index's are bound to share one (Xiao et al., 2008).
    """
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    ranked = [np.sort(rank[np.searchsorted(values, s)]) for s in sets]
    index: dict[int, dict[int, list[int]]] = {}
    parent: dict[int, int] = {r: r for r in roots}
    out = []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        x, n = ranked[i], len(sets[i])
        tried: set[int] = set()
        for token in x[: n - math.ceil(threshold * n - 1e-9) + 1].tolist():
            for root, places in index.get(token, {}).items():
                for j in places:
                    if find(parent, root) == find(parent, roots[i]):
                        break
                    if j in tried or len(sets[j]) < threshold * n:
                        continue
                    tried.add(j)
                    if jaccard(sets[i], sets[j]) >= threshold:
                        out.append((i, j))
                        unite(parent, roots[i], root)
        for token in x[: n - math.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1].tolist():
            index.setdefault(token, {}).setdefault(roots[i], []).append(i)
    return out


def _joined(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside larger buckets, over rows (hash, id, root, shingles)."""
        for ids, roots, raw in _runs(batches):
            found = similar([np.frombuffer(x, "<u8") for x in raw], roots.tolist(), threshold)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[i]) for i, _ in found], pa.int64()), pa.array([int(ids[j]) for _, j in found], pa.int64())], ["a", "b"])

    return run


def _sets(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, shingle hashes) of the wanted lines of each text."""
        for b in batches:
            want = [dict(zip(p, i, strict=True)) for p, i in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            for block in line_blocks(b.column(0)):
                lines = Lines(*block, min_words)
                found = [(want[r][p], lines.shingles(k).astype("<u8").tobytes()) for k, (r, p) in enumerate(zip(lines.row.tolist(), lines.pos.tolist(), strict=True)) if p in want[r]]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["id", "shingles"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n, m = len(x), len(y)
                keep.append(min(n, m) >= threshold * max(n, m) and jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= threshold)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def shingle_sets(ids: DataFrame, homes: DataFrame, docs: DataFrame, min_words: int, broadcast_rows: int = 300_000) -> tuple[DataFrame, str]:
    """(id, shingles) of the wanted ids, as a table and its path. homes: (id, doc_id, tag, pos).

    The wanted lines are fetched from their documents. Their places (about 30 bytes each) are broadcast up to
    broadcast_rows, else joined by a shuffle.
    """
    want = homes.join(ids, "id").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("pos", "id")).alias("l")).select("doc_id", "tag", "l.pos", "l.id")
    want, path = stored(want, "wanted")
    if want.select(F.coalesce(F.sum(F.size("id")), F.lit(0))).first()[0] <= broadcast_rows:
        want = F.broadcast(want)
    rows = tagged(docs).join(want, ["doc_id", "tag"])
    out = stored(rows.select("text", "pos", "id").mapInArrow(_sets(min_words), "id long, shingles binary").dropDuplicates(["id"]), "sets")
    remove(docs.sparkSession, path)
    return out


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verified(threshold), "a long, b long")


def passages(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tag, pos, stays, home_doc, home_pos) of every long line that occurs more than once, near copies included."""
    spark = docs.sparkSession
    full, wide = stored(paragraphs(docs, min_words, banded=True), "banded")
    here = ["doc_id", "tag", "pos"]
    reps = full.groupBy("key").agg(F.min(F.struct(*here)).alias("home"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.count("*").alias("copies"))
    reps, banded = stored(reps.select(F.monotonically_increasing_id().alias("id"), "key", "home.*", "bands", "copies", "size"), "distinct")
    rows, _ = stored(full.select(*here, "key"), "paragraphs")  # without the bands, which are most of it
    remove(spark, wide)
    dealt = reps.select("id", "bands").mapInArrow(_spread, "hash long, id long")

    def buckets(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition(partitions(spark), "hash").sortWithinPartitions("hash").select("hash", "id", *more)

    def pairs(step) -> tuple[DataFrame, str]:
        return stored(buckets(named, "copies", "size", "root").mapInArrow(_scan(step, threshold), "a long, b long").distinct(), "pairs")

    ends = F.explode(F.array("a", "b")).alias("id")
    met, shared = stored(buckets(dealt).mapInArrow(_shared, "hash long, id long"), "shared")
    reps, _ = stored(reps.drop("bands"), "places")  # what is used of them from here on
    remove(spark, banded)
    homes = reps.select("id", *here)
    dealt = met.join(reps.select("id", "copies", "size"), "id")
    named = dealt.withColumn("root", F.col("id"))
    stars, done = pairs(_star)
    sets, more = shingle_sets(stars.select(ends).distinct(), homes, docs, min_words)
    links, starred = stored(verified(stars, sets, threshold), "links")
    for path in (done, more):
        remove(spark, path)

    named = dealt.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    few, done = pairs(_across)
    mixed, larger = stored(buckets(named, "copies", "size", "root").mapInArrow(_mixed, "hash long, id long, root long"), "mixed")
    remove(spark, shared)
    sets, more = shingle_sets(few.select(ends).unionAll(mixed.select("id")).distinct(), homes, docs, min_words)
    many = buckets(mixed.join(sets, "id"), "root", "shingles").mapInArrow(_joined(threshold), "a long, b long")
    links, all_ = stored(links.unionAll(verified(few, sets, threshold)).unionAll(many), "links")
    roots = components(links)
    for path in (done, larger, more, starred, all_):
        remove(spark, path)
    named = reps.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", *here, F.coalesce("root", "id").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(*here)).alias("home"), F.count("*").alias("n"))
    named = named.select("key", "root").join(first, "root").select("key", "home", "n")
    counts = rows.select("key", *here).distinct().groupBy("key").agg(F.count("*").alias("copies"))
    named = named.join(counts, "key").where("n > 1 or copies > 1").select("key", "home")
    stays = F.struct(*here) == F.col("home")
    return rows.select("key", *here).distinct().join(named, "key").select(*here, stays.alias("stays"), F.col("home.doc_id").alias("home_doc"), F.col("home.pos").alias("home_pos"))


def _without(text, gone):
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))


def removals(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, tag, n_repeated, removed, home_docs): positions of the lines that go and the documents where they stay.

    Repeated lines (12 bytes each) are broadcast to the texts up to broadcast_rows, else joined by a shuffle.
    """
    found = passages(docs, min_words, threshold)
    gone = F.when(~F.col("stays"), F.col("pos"))
    out = found.groupBy("doc_id", "tag").agg(F.count("*").alias("n_repeated"), F.array_sort(F.collect_list(gone)).alias("removed"), F.array_sort(F.collect_set(F.when(~F.col("stays"), F.col("home_doc")))).alias("home_docs"))
    return sided(out, "removals", "n_repeated", broadcast_rows)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of x[i : i + width] for every i that has so many."""
    pick, have = np.minimum if least else np.maximum, 1
    while 2 * have <= width:
        x, have = pick(x[:-have], x[have:]), 2 * have
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the shingles of GRAM words that are the least of NEAR neighbours in one text."""
    if len(word) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(word) + 1)
    with np.errstate(over="ignore"):
        mixed = (word ^ word >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up[: len(word)], dtype=np.uint64)])
        n = len(word) - GRAM + 1
        h = (sums[GRAM:] - sums[:n]) * down[:n]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
        h = (h ^ h >> np.uint64(29)) | np.uint64(1)
    least = _sliding(h, NEAR, True)
    least[doc[: len(least)] != doc[PASSAGE - 1 :]] = 0
    none = np.zeros(NEAR - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([none, least, none]), NEAR, False) == h)
    return at, h[at]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, pos, hash) of the anchors of each text, which is read in pieces that overlap by PASSAGE words."""

    def batch(b: pa.RecordBatch, row: np.ndarray, pos: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        who = b.select([0, 1]).take(pa.array(row))
        return pa.RecordBatch.from_arrays([*who.columns, pa.array(pos, pa.int32()), pa.array(h.view(np.int64))], ["doc_id", "tag", "pos", "hash"])

    for b in batches:
        data, at = utf8(b.column(2))
        i = 0
        while i < b.num_rows:
            j = i + 1
            while j < b.num_rows and at[j + 1] - at[i] <= PIECE:
                j += 1
            if at[j] - at[i] <= PIECE:
                _, starts, _, word = word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
                doc = np.searchsorted(at[i : j + 1] - at[i], starts, "right") - 1
                where, h = anchors(word, doc)
                yield batch(b, i + doc[where], where - np.searchsorted(doc, doc[where]), h)
            else:
                raw, lo, first, size = data[at[i] : at[j]], 0, 0, PIECE
                while True:
                    stop = lo + size
                    while stop < len(raw) and not _space[raw[stop]]:
                        stop += 1
                    part = raw[lo:stop]
                    _, starts, _, word = word_hashes(part, np.array([0, len(part)]))
                    where, h = anchors(word, np.zeros(len(word), np.int64))
                    yield batch(b, np.full(len(where), i), first + where, h)
                    if stop >= len(raw):
                        break
                    if len(starts) <= 2 * PASSAGE:
                        size *= 2
                        continue
                    lo, first, size = lo + int(starts[-PASSAGE]), first + len(starts) - PASSAGE, PIECE
            i = j


def stretches(raw: np.ndarray, found: list[int], most: int = 100_000) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(first word, words, windows by word from there) around these anchors: a text whole, of a long one the parts that its windows touch."""
    near = np.asarray(found, np.int64)[:, None] - np.arange(NEAR)
    if len(raw) <= 2 * PIECE:
        words = raw.tobytes().lower().split()
        yield 0, words, np.unique(near[(near >= 0) & (near <= len(words) - PASSAGE)]).tolist()
        return
    _, starts, stops, _ = word_hashes(raw, np.array([0, len(raw)]))
    near = np.unique(near[(near >= 0) & (near <= len(starts) - PASSAGE)])
    cuts = np.flatnonzero((np.diff(near) > PASSAGE) | (near[1:] // most > near[:-1] // most)) + 1
    for part in np.split(near, cuts) if len(near) else ():
        first, last = int(part[0]), int(part[-1]) + PASSAGE - 1
        yield first, raw[starts[first] : stops[last]].tobytes().lower().split(), (part - first).tolist()


def _windowed(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, tag, pos) of every window of PASSAGE words around the given anchors of each text."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["key", "doc_id", "tag", "pos"])

    rows: list[tuple] = []
    for b in batches:
        data, at = utf8(b.column(2))
        for i, (doc_id, tag, found) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
            raw = data[at[i] : at[i + 1]]
            for first, words, windows in stretches(raw, found):
                text, starts = b" ".join(words), [0, *accumulate(len(w) + 1 for w in words)]
                for w in windows:
                    rows.append((xxh3_128_digest(text[starts[w] : starts[w + PASSAGE] - 1]), doc_id, tag, first + w))
                    if len(rows) >= most:
                        yield batch(rows)
                        rows = []
    yield batch(rows)


_word = re.compile(r"[^\t-\r ]+")


def kept_pieces(text: str, gone: list[tuple[int, int | None]]) -> tuple[list[int], list[int], int]:
    """(starts, lengths, words cut): the pieces of text, in characters, that stay when the windows at these words go.

    gone: (first word, first word of the window that stays, if that is in the same text). A cut takes the blanks behind it; a line break
    inside it stays where it parts two lines.
    """
    spans = np.fromiter((x for m in _word.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    cut = np.zeros(len(spans), bool)
    for p, own in gone:
        cut[p if own is None else max(p, own + PASSAGE) : p + PASSAGE] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))).reshape(-1, 2).tolist()
    pieces, at = [], 0
    for a, z in edges:
        lo, hi = int(spans[a, 0]), int(spans[z - 1, 1])
        while hi < len(text) and text[hi] in " \t":
            hi += 1
        pieces.append((at, lo - at))
        broken = text.find("\n", lo, hi)
        if broken >= 0 and lo and text[lo - 1] != "\n" and hi < len(text) and text[hi] != "\n":
            pieces.append((broken, 1))
        at = hi
    pieces = [p for p in [*pieces, (at, len(text) - at)] if p[1]]
    return [p for p, _ in pieces], [n for _, n in pieces], int(cut.sum())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        kept = [kept_pieces(t, list(zip(p, o, strict=True))) for t, p, o in zip(cols[2], cols[3], cols[4], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.select([0, 1]).columns, pa.array([k[0] for k in kept], pa.list_(pa.int32())), pa.array([k[1] for k in kept], pa.list_(pa.int32())), pa.array([k[2] for k in kept], pa.int64()), b.column(5)], ["doc_id", "tag", "at", "len", "n_cut", "cut_homes"])


def sided(df: DataFrame, name: str, size: str, most: int) -> DataFrame:
    """df as a table that is broadcast where the sum of size over its rows is at most `most`."""
    df, _ = stored(df, name)
    return F.broadcast(df) if df.select(F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()[0] <= most else df


def embedded(rows: DataFrame, broadcast_rows: int = 300_000, broadcast_hashes: int = 1_000_000) -> DataFrame:
    """(doc_id, tag, n_shared, at, len, n_cut, cut_homes) of the texts that hold embedded passages which occur elsewhere too; at is null where nothing is cut.

    rows: (doc_id, tag, text), a stored table; equal (doc_id, tag) are one text. n_shared counts the passages, those that stay included.
    Places (20 to 40 bytes each) are broadcast up to broadcast_rows, anchors (8 bytes) up to broadcast_hashes, else joined by a shuffle;
    the texts that hold wanted anchors are then a table of their own.
    """
    who = ["doc_id", "tag"]

    rows = rows.where("doc_id is not null and text is not null")
    if not rows.groupBy(*who).count().where("count > 1").isEmpty():
        rows, _ = stored(rows.dropDuplicates(who), "texts")
    # Anchors and windows are made twice, for counting and for what is found twice; that costs less than keeping them all.
    found = rows.select(*who, "text").mapInArrow(_anchored, "doc_id long, tag long, pos int, hash long")
    twice, _ = stored(found.groupBy("hash").count().where("count > 1").select("hash"), "twice")
    if twice.count() <= broadcast_hashes:
        twice = F.broadcast(twice)
    want, _ = stored(found.join(twice, "hash").groupBy(*who).agg(F.collect_set("pos").alias("found")), "wanted")
    if want.select(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0] <= broadcast_rows:
        held = rows.join(F.broadcast(want), who).select(*who, "text", "found")
    else:  # the texts are shuffled once here; from there on only those that hold an anchor are read
        held, _ = stored(rows.join(want, who).select(*who, "text", "found"), "held")
        rows = held
    windows = held.mapInArrow(_windowed, "key binary, doc_id long, tag long, pos int")
    here = F.struct("doc_id", "tag", "pos")
    homes = windows.groupBy("key").agg(F.min(here).alias("home"), F.count("*").alias("n")).where("n > 1").select("key", "home")
    homes = sided(homes, "homes", "1", broadcast_rows)
    own = F.when((F.col("home.doc_id") == F.col("doc_id")) & (F.col("home.tag") == F.col("tag")), F.col("home.pos"))
    goes = here != F.col("home")
    again = windows.join(homes, "key").select(*who, "pos", F.when(goes, F.struct("pos", own.alias("own"))).alias("cut"), F.when(goes, F.col("home.doc_id")).alias("home_doc"))
    gone = again.groupBy(*who).agg(F.sort_array(F.collect_list("pos")).alias("all"), F.collect_list("cut").alias("w"), F.array_sort(F.collect_set("home_doc")).alias("cut_homes"))
    breaks = F.filter("all", lambda p, i: (i == 0) | (p - F.get("all", i - 1) > 1))  # where a run of shared windows begins
    gone = sided(gone.select(*who, F.size(breaks).cast("long").alias("n_shared"), "w.pos", "w.own", "cut_homes"), "gone", "size(pos)", broadcast_rows)
    pieces = rows.join(gone.where(F.size("pos") > 0), who).select(*who, "text", "pos", "own", "cut_homes").mapInArrow(_pieces, "doc_id long, tag long, at array<int>, len array<int>, n_cut long, cut_homes array<long>")
    pieces = sided(pieces, "pieces", "1 + size(at)", broadcast_rows)
    return sided(gone.select(*who, "n_shared").join(pieces, who, "left"), "embedded", "1 + coalesce(size(at), 0)", broadcast_rows)


def _kept(text, at, len_):
    parts = F.transform(F.arrays_zip(at.alias("at"), len_.alias("len")), lambda p: F.substring(text, p["at"] + 1, p["len"]))
    return F.when(at.isNull(), text).otherwise(F.array_join(parts, ""))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_repeated, n_removed, removed, home_docs, text, n_cut): every row of docs with its text after removal.

    n_repeated: paragraphs of the row, lines and embedded ones, that occur elsewhere as well, whether they stay here or not; n_removed, removed: lines that go, by
    number; n_cut: words of embedded passages that go; home_docs: where the removed ones stay.
    """
    who = ["doc_id", "tag"]
    text = F.col("text").cast("string")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")).join(removals(docs), who, "left")
    none = F.array().cast("array<int>")
    out = out.select(
        "doc_id", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"), F.coalesce("home_docs", F.array().cast("array<bigint>")).alias("home_docs"), _without(F.col("text"), F.col("removed")).alias("text"),
    )
    out, _ = stored(out.withColumn("tag", F.xxhash64("text")), "lines-left")
    out = out.join(embedded(out), who, "left")
    homes = F.when(F.col("cut_homes").isNull(), F.col("home_docs")).otherwise(F.array_sort(F.array_union("home_docs", "cut_homes")))
    n_repeated = F.col("n_repeated") + F.coalesce("n_shared", F.lit(0))
    return out.select("doc_id", n_repeated.alias("n_repeated"), "n_removed", "removed", homes.alias("home_docs"), _kept(F.col("text"), F.col("at"), F.col("len")).alias("text"), F.coalesce("n_cut", F.lit(0)).cast("long").alias("n_cut"))


def drop_passages(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages taken out of text, and n_chars (where it exists) following it."""
    id_, gone, cut_, tag, at, len_ = (fresh(docs, c) for c in ("cut_id", "cut", "was_cut", "cut_tag", "cut_at", "cut_len"))
    text = F.col("text").cast("string")
    cut = removals(docs).where(F.size("removed") > 0).select(F.col("doc_id").alias(id_), F.col("tag").alias(tag), F.col("removed").alias(gone))
    out = docs.join(cut, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64(text) == F.col(tag)), "left").drop(tag)
    text = _without(text, F.col(gone))
    out, _ = stored(out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.col(id_).isNotNull().alias(cut_), F.xxhash64(text).alias(tag)), "lines-left")
    more = embedded(out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(tag).alias("tag"), "text")).where("at is not null")
    more = more.select(F.col("doc_id").alias(id_), F.col("tag").alias(f"{tag}_"), F.col("at").alias(at), F.col("len").alias(len_))
    out = out.join(more, (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(tag) == F.col(f"{tag}_")), "left")
    left = fresh(docs, "text_left")
    out = out.withColumn(left, _kept(F.col("text"), F.col(at), F.col(len_)))
    columns = [F.col(left).alias(c) if c == "text" else F.when(F.col(cut_) | F.col(id_).isNotNull(), F.length(left)).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return out.select(*columns)
