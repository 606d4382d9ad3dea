"""Ranked lexical search: an inverted treap for each term, traversed together.

A first scan counts, in every document, its terms and how often those of the items occur; from that table come the corpus' figures (documents, terms, and documents of each term). A
second scan takes that table in shards of at most POSTINGS postings. A shard's treap of a term has its documents in search order and their impacts, the part of a score that the
term's weight multiplies, in heap order: the root of any range of documents has the range's largest impact. For an item, the ranges of all its terms' treaps are cut in step, at the document of the root that
weighs most, best range first; a range is dropped where its roots' weighted impacts add up to less than the k-th best score so far, and read off at once where it holds few postings.
Only each task's k best of an item are shuffled. Items are taken in blocks of about ITEM_BYTES bytes of text, one pair of scans a block.

A term is a run of characters other than ASCII ones that are neither letter nor digit, with A-Z lowered. Scores are 64-bit integers (see `impacts` and `weight`).

Defined results: null and empty texts have no terms, and neither find nor are found; a null doc_id ranks after all others of its score; repeated rows of documents are documents of
their own, and each row of items, repeated ones too, gets its own results; texts of any length are read in pieces; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessella.llm.common import stored, tune, utf8

TOP, POSTINGS, LEAF, ITEM_BYTES, PIECE = 50, 400_000, 1024, 2 << 20, 1 << 20
#: Bytes of terms to themselves, A-Z lowered, all others to a space; every byte of a character beyond ASCII belongs to a term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LAST = (1 << 63) - 1  # stands for a null doc_id in the order


def terms(folded: bytes) -> Iterator[list[bytes]]:
    """The terms of a folded text, some at a time."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if at + PIECE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            folded = data.tobytes().translate(FOLD)
            n, known, often, ends = [], [], [], [0]
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                found, size = Counter(), 0
                for some in terms(folded[lo:hi]):
                    found.update(map(vocabulary.get, some))
                    size += len(some)
                found.pop(None, None)
                n.append(size)
                known.extend(found.keys())
                often.extend(found.values())
                ends.append(len(known))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((known, pa.int32()), (often, pa.int64()))]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied by; tf and n: of its occurrences and of all terms in each document."""
    wide = int(n.max(initial=0)) * 50 * documents >= 1 << 62 or int(tf.max(initial=0)) >= 1 << 33
    tf, n = (tf.astype(object), n.astype(object)) if wide else (tf, n)
    m = 50 + 50 * n * documents // total
    return (1_000_000_000 * tf // (1000 * tf + 20 * m)).astype(np.int64)


class Treaps:
    """The treaps of one shard, one after another in arrays: docs (places in the shard), impacts, and each node's children."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        """Postings in the order of term, then doc."""
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        self.span = dict(zip(term[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True), strict=True))
        self.doc_array, self.impact_array = doc, impact
        self.doc, self.impact = doc.tolist(), impact.tolist()
        self.left, self.right = [-1] * len(term), [-1] * len(term)
        self.root = {t: self.built(*span) for t, span in self.span.items()}

    def built(self, start: int, end: int) -> int:
        """Links the postings of one term; gives the root. Of equal impacts, the smaller doc is above."""
        impact, left, right = self.impact, self.left, self.right
        path: list[int] = []  # from the root down the right side
        for i in range(start, end):
            v, below = impact[i], -1
            while path and impact[path[-1]] < v:
                below = path.pop()
            left[i] = below
            if path:
                right[path[-1]] = i
            path.append(i)
        return path[0]

    def search(self, query: list[tuple[int, int]], best: list[tuple[int, int, int]], ids: list[int], shard: int, top: int) -> None:
        """Adds to best, a heap of (score, -doc_id, -shard), what belongs to the top; query: (term, weight)."""
        doc, impact, left, right = self.doc, self.impact, self.left, self.right
        some = [(w, self.root[t], *self.span[t]) for t, w in query if t in self.root and w > 0]
        todo = [(-sum(w * impact[r] for w, r, _, _ in some), 0, some)] if some else []
        made = 0

        def take(score: int, d: int) -> None:
            if len(best) < top:
                heappush(best, (score, -ids[d], -shard))
            elif score >= best[0][0]:
                heappushpop(best, (score, -ids[d], -shard))

        while todo:
            bound, _, nodes = heappop(todo)
            if len(best) == top and -bound < best[0][0]:
                break  # and so are all others
            if sum(b - a for _, _, a, b in nodes) <= LEAF:
                for d, score in zip(*self.read(nodes), strict=True):
                    take(score, d)
                continue
            _, r, _, _ = max(nodes, key=lambda x: x[0] * impact[x[1]])
            d, score = doc[r], 0
            sides: tuple[list, list] = [], []
            bounds = [0, 0]
            for w, r, a, b in nodes:
                x = y = bisect_left(doc, d, a, b)
                if x < b and doc[x] == d:
                    score += w * impact[x]
                    y = x + 1
                if x > a:
                    at = r
                    while at >= x:
                        at = left[at]
                    sides[0].append((w, at, a, x))
                    bounds[0] += w * impact[at]
                if y < b:
                    while r < y:
                        r = right[r]
                    sides[1].append((w, r, y, b))
                    bounds[1] += w * impact[r]
            take(score, d)
            for side, bound in zip(sides, bounds, strict=True):
                if side and (len(best) < top or bound >= best[0][0]):
                    made += 1
                    heappush(todo, (-bound, made, side))

    def read(self, nodes: list[tuple[int, int, int, int]]) -> tuple[list[int], list[int]]:
        """(docs, scores) of all documents of a range."""
        docs = np.concatenate([self.doc_array[a:b] for _, _, a, b in nodes])
        low = int(docs.min())
        scores = np.zeros(int(docs.max()) - low + 1, np.int64)
        np.add.at(scores, docs - low, np.concatenate([w * self.impact_array[a:b] for w, _, a, b in nodes]))
        found = np.flatnonzero(scores)
        return (found + low).tolist(), scores[found].tolist()


def _ranked(queries: dict[int, list[tuple[int, int]]], documents: int, total: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int, int]]] = {q: [] for q in queries}
        held: list[pa.RecordBatch] = []
        size = shard = 0

        def done() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["doc_id"].fill_null(LAST).to_numpy()
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            lengths = rows["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            term, tf = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            doc, n = np.repeat(place, lengths), np.repeat(rows["n"].to_numpy(), lengths)
            by = np.lexsort((doc, term))
            treaps = Treaps(term[by], doc[by], impacts(tf, n, documents, total)[by])
            names = ids[order].tolist()
            for q, query in queries.items():
                treaps.search(query, best[q], names, shard, top)

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                postings = len(part.column(2).flatten())
                if held and size + postings > POSTINGS:
                    done()
                    held, size, shard = [], 0, shard + 1
                held.append(part)
                size += postings
        if size:
            done()
        out = [(q, None if d == -LAST else -d, s) for q, found in best.items() for s, d, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["q", "doc_id", "score"])

    return run


def _block(docs: DataFrame, items: list[tuple], first: int, top: int) -> DataFrame:
    """(q, doc_id, score): each task's best of each item; items: (item_id, folded text)."""
    vocabulary: dict[bytes, int] = {}
    wanted = [sorted({vocabulary.setdefault(t, len(vocabulary)) for some in terms(text) for t in some}) for _, text in items]
    table, _ = stored(docs.mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"), "term-counts")
    documents, total = table.agg(F.count("*"), F.sum("n")).first()
    df = {r[0]: r[1] for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # as many as the items' terms at most
    queries = {first + k: [(t, weight(documents, df[t])) for t in own if t in df] for k, own in enumerate(wanted)}
    return table.where(F.size("terms") > 0).mapInArrow(_ranked(queries, documents, total or 1, top), "q long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text), the documents (doc_id, text) with the highest scores above 0."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.select(F.sum(F.octet_length("text") + 16).cast("long")).first()[0] or 0
    blocks = -(-size // item_bytes)
    found, first, names = [], 0, []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text.encode("utf-8", "replace").translate(FOLD)) for r in own.collect()]
        if not rows:
            continue
        found.append(_block(docs, rows, first, top))
        names.append(spark.createDataFrame([(first + k, r[0]) for k, r in enumerate(rows)], f"q long, item_id {items.schema['item_id'].dataType.simpleString()}"))
        first += len(rows)
    if not found:
        return items.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = union(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(union(names), "q").select("item_id", "rank", "doc_id", "score")
