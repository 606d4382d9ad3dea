"""SimHash near-duplicates: 64-bit fingerprints of three-word shingles, linked at three or fewer differing bits.

Each fingerprint has a row in a pivot table, its Hamming distances to sixteen reference fingerprints; by the triangle inequality a pair whose rows
differ by more than three in any column can't be linked. Candidates come from pivot distances and agreeing blocks of bits together: of five blocks, two are equal
in any linked pair, so every fingerprint is dealt out under ten masked copies of itself, each of them with its distance to one of the pivots in
cells of CELL; a fingerprint so near the end of its cell that a linked one may be in the next goes to that too. Inside a bucket rows are ordered by the first column of the
table, pairs are discarded by the largest difference of any column, and the survivors are verified bit by bit. Buckets of more
than `most` fingerprints go on to eight blocks of which five agree, then to sixteen of which thirteen agree, which
leaves 12 free bits and so at most 4096 different fingerprints: no bucket is ever compared beyond that size and no pair is lost.

Defined results: null and empty texts have fingerprint zero and link with one another and with any fingerprint of three bits or
fewer; rows with a null doc_id are returned with a fingerprint and a null component; repeated rows
are returned as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from tessella.llm.common import components, find, fresh, partitions, stored, tune, unite, utf8

BITS, PIVOTS, RADIUS, CELL = 64, 16, 3, 8
LEVELS = ((5, 2), (8, 5), (16, 13))


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of the lower-cased text, in blocks."""
    ws = text.lower().split()
    if not ws:
        return
    joined, lengths = b" ".join(ws), [len(w) + 1 for w in ws]
    if len(ws) < words:
        yield np.array([xxh64_intdigest(joined, seed)], np.uint64)
        return
    starts = [0, *accumulate(lengths)]
    n = len(ws) - words + 1
    for at in range(0, n, block):
        stop = min(n, at + block)
        yield np.fromiter((xxh64_intdigest(joined[x : y - 1], seed) for x, y in zip(starts[at:stop], starts[at + words : stop + words], strict=True)), np.uint64, stop - at)


def bit_counts(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits (lowest first) is set in hashes[at[i]:at[i+1]]."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.stack([bits[x:y].sum(0, dtype=np.int32) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])


def fingerprint(text: bytes) -> int:
    return voted(shingle_hashes(text))


def voted(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of all the blocks of one text."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in blocks:
        counts += bit_counts(h, np.array([0, len(h)]))[0]
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], chunk: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Texts of one block of shingles are counted together, longer ones by themselves."""
    for b in batches:
        data, at = utf8(b.column(1))
        raw, out = data.tobytes(), np.zeros(b.num_rows, np.uint64)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def count(held: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
            ns = np.array([len(h) for _, h in held])
            set_ = bit_counts(np.concatenate([h for _, h in held]), np.concatenate([[0], np.cumsum(ns)])) * 2 > ns[:, None]
            out[[i for i, _ in held]] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]

        for i in range(b.num_rows):
            text = raw[at[i] : at[i + 1]]
            if len(text) > 1 << 18:
                out[i] = fingerprint(text)
                continue
            blocks = list(shingle_hashes(text))
            if len(blocks) > 1:
                out[i] = voted(blocks)
                continue
            for h in blocks:
                held.append((i, h))
                size += len(h)
            if size > chunk:
                count(held, out)
                held, size = [], 0
        if held:
            count(held, out)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64), pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(blocks: int, agree: int) -> list[int]:
    """One mask for each choice of `agree` of so many blocks of the 64 bits, as signed longs."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(parts, agree))]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random words."""
    return np.random.default_rng(0x51A4A5).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_cells(fp: Column, pivot: int) -> list[Column]:
    """The cell of a fingerprint's distance to a pivot, and the next one where a linked fingerprint may lie there (else null)."""
    word = int(pivots()[pivot % PIVOTS].view(np.int64))
    distance = F.bit_count(fp.bitwiseXOR(F.lit(word)))
    cell = F.floor(distance / CELL).cast("int")
    return [cell, F.when(distance % CELL >= CELL - RADIUS, cell + 1)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int16)


def linked_pairs(ids: np.ndarray, fps: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning set of the links among rows of equal run (contiguous): pairs already connected aren't compared again."""
    table = pivot_table(fps)
    order = np.lexsort((table[:, 0], run))
    ids, fps, run, table = ids[order], fps[order], run[order], table[order]
    parent: dict[int, int] = {}
    label = np.arange(len(ids))
    out, live, d = [], np.arange(len(ids)), 1
    while len(live := live[live + d < len(ids)]):
        # Sorted by the first pivot: beyond a distance of radius in it, no later row of the run can be linked.
        live = live[(run[live] == run[live + d]) & (table[live + d, 0] - table[live, 0] <= radius)]
        i = live[label[live] != label[live + d]]
        for c in range(1, table.shape[1]):
            i = i[np.abs(table[i, c] - table[i + d, c]) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        for x, y in zip(i.tolist(), (i + d).tolist(), strict=True):
            if x not in parent or y not in parent or find(parent, x) != find(parent, y):
                unite(parent, x, y)
                out.append((int(ids[x]), int(ids[y])))
        if len(i):
            for x in parent:
                label[x] = find(parent, x)
        d += 1
    return out


LINK = "a long, b long, fp long"


def _buckets(most: int, chunk: int = 200_000):
    """Over rows sorted by (mask, key): links inside runs of at most `most` rows, and the members (b null) of larger runs."""

    def batch(a: np.ndarray, b: np.ndarray | None, fp: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if fp is None else pa.array(fp, pa.int64())], ["a", "b", "fp"])

    def links(runs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, fps = (np.concatenate(x) for x in zip(*runs, strict=True))
        run = np.repeat(np.arange(len(runs)), [len(x) for x, _ in runs])
        pairs = np.array(linked_pairs(ids, fps.view(np.uint64), run), np.int64).reshape(-1, 2)
        return batch(pairs[:, 0], pairs[:, 1], None)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, np.ndarray]] = []  # whole runs to compare
        now: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the run that may go on
        last, size, held = None, 0, 0

        def close() -> None:
            nonlocal held, now
            if 1 < size <= most:
                done.append(tuple(np.concatenate(x) for x in zip(*now, strict=True)))
                held += size
            now = []

        for b in batches:
            if not b.num_rows:
                continue
            mask, key, ids, fps = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], b.num_rows)
            worth = stops - starts > 1  # a lone row inside a batch has no partner
            worth[[0, -1]] = True
            for lo, hi in zip(starts[worth].tolist(), stops[worth].tolist(), strict=True):
                if (it := (mask[lo], key[lo])) != last:
                    close()
                    last, size = it, 0
                    if held >= chunk:
                        yield links(done)
                        done, held = [], 0
                size += hi - lo
                now.append((ids[lo:hi], fps[lo:hi]))
                if size > most:
                    yield batch(np.concatenate([x for x, _ in now]), None, np.concatenate([x for _, x in now]))
                    now = []
        close()
        if done:
            yield links(done)

    return search


def candidate_links(reps: DataFrame, most: int = 4096) -> DataFrame:
    """(a, b): links that span every component of the fingerprint graph; reps: (id, fp), each fp once."""
    spark = reps.sparkSession
    left, found = reps, None
    for blocks, agree in LEVELS:
        last = (blocks, agree) == LEVELS[-1]
        # mask: which blocks and which cell of the pivot that goes with them
        keys = [F.when(cell.isNotNull(), F.struct((cell + 16 * i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))) for i, m in enumerate(masks(blocks, agree)) for cell in pivot_cells(F.col("fp"), i)]
        rows = left.select("id", "fp", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.mask", "k.key", "id", "fp")
        rows = rows.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key")
        links, _ = stored(rows.mapInArrow(_buckets(1 << 13 if last else most), LINK), "links")
        hot = links.where("b is null")
        now = links.where("b is not null").select("a", "b")
        found = now if found is None else found.unionAll(now)
        if last or hot.isEmpty():
            return found
        left = hot.select(F.col("a").alias("id"), "fp").distinct()
    return found


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    rows, _ = stored(fingerprints(docs), "fingerprints")
    reps, _ = stored(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "reps")
    roots = components(candidate_links(reps))
    label = reps.join(roots, reps["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    out = rows.join(label, "fp", "left")
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents that are the smallest id of their group, and those without an id. The ids that go (8 bytes) are broadcast up to broadcast_rows, else joined by a shuffle."""
    gone = fresh(docs, "gone")
    copies, _ = stored(simhash_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "near-copies")
    if copies.count() <= broadcast_rows:
        copies = F.broadcast(copies)
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
