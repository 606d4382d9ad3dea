"""Bounded-space online packing: documents' token ids into sequences of a fixed length, as they come.

Each partition keeps at most `windows` open windows. What comes takes the tightest window that holds it whole; where none does, and no more may be opened, the fullest is filled up with the
beginning and emitted, and the rest is tried again (without cutting, it is emitted as it is). Documents of a sequence or more begin with whole sequences. At the end of a partition its open
windows are merged until less than one sequence is left. These leftovers, one a partition, are merged in the same way by FAN partitions a task, round by round, until one is left,
which goes into sequences whose lengths are powers of two, so that they need no padding either. Emitted pieces never move again and are written once; only leftovers, at most a
sequence of ids a partition, are shuffled.

Defined results: null and empty texts are their end mark alone; a null doc_id is packed like others; repeated rows are packed as often as they occur;
texts of any length are tokenised in parts; an empty table gives an empty result; extra columns are ignored. Which documents meet in a sequence depends on how the table is split, not what a piece holds.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import stored, tune
from tessella.llm.tokens import encoder

CAPACITY, WINDOWS, FAN = 2048, 32, 256
TASK, ROUND = 32, 56  # bits of a sequence_id below the number of its task, and below that of the merging round


class Piece(NamedTuple):
    """Ids of one document from `start` on."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


def head_and_rest(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first n ids of pieces in a row, and the others."""
    head, at = [], 0
    for k, p in enumerate(pieces):
        if at + len(p.ids) > n:
            cut = n - at
            rest = [p._replace(start=p.start + cut, ids=p.ids[cut:]), *pieces[k + 1 :]]
            return ([*head, p._replace(ids=p.ids[:cut])] if cut else head), rest
        head.append(p)
        at += len(p.ids)
    return head, []


class Windows:
    """The open windows of one partition; full ones go to `out` with their number."""

    def __init__(self, first: int, capacity: int = CAPACITY, windows: int = WINDOWS, cut: bool = True):
        self.next, self.capacity, self.most, self.cut = first, capacity, windows, cut
        self.open: dict[int, list[Piece]] = {}
        self.order: list[tuple[int, int]] = []  # (residual, window)
        self.out: list[tuple[int, list[Piece]]] = []

    def emit(self, pieces: list[Piece]) -> None:
        self.out.append((self.next, pieces))
        self.next += 1

    def put(self, k: int, pieces: list[Piece], size: int) -> None:
        """Adds pieces to the window at place k of the order."""
        residual, w = self.order.pop(k)
        self.open[w].extend(pieces)
        if residual == size:
            self.emit(self.open.pop(w))
        else:
            insort(self.order, (residual - size, w))

    def start(self, pieces: list[Piece], size: int) -> None:
        w = self.next
        self.next += 1
        self.open[w] = list(pieces)
        insort(self.order, (self.capacity - size, w))

    def place(self, pieces: list[Piece]) -> None:
        size = sum(len(p.ids) for p in pieces)
        while size >= self.capacity:
            head, pieces = head_and_rest(pieces, self.capacity)
            self.emit(head)
            size -= self.capacity
        while size:
            k = bisect_left(self.order, (size, -1))
            if k < len(self.order):
                return self.put(k, pieces, size)
            if len(self.open) < self.most:
                return self.start(pieces, size)
            residual, w = self.order[0]
            if not self.cut:
                self.order.pop(0)
                self.emit(self.open.pop(w))
                return self.start(pieces, size)
            head, pieces = head_and_rest(pieces, residual)
            self.put(0, head, residual)
            size -= residual

    def merge(self) -> list[Piece]:
        """Merges the open windows: the fullest takes the largest that fits into it, or, where none does, the beginning of the emptiest. Less than a sequence is left."""
        left = sorted((self.capacity - residual, w) for residual, w in self.order)
        self.order = []
        while len(left) > 1:
            size, w = left.pop()
            while size < self.capacity and left:
                k = bisect_left(left, (self.capacity - size + 1, -1)) - 1
                if k >= 0:
                    more, other = left.pop(k)
                    self.open[w].extend(self.open.pop(other))
                else:
                    more, (whole, other) = self.capacity - size, left.pop(0)
                    head, self.open[other] = head_and_rest(self.open[other], more)
                    self.open[w].extend(head)
                    insort(left, (whole - more, other))
                size += more
            if size == self.capacity:
                self.emit(self.open.pop(w))
            else:
                insort(left, (size, w))
        return self.open.pop(left[0][1]) if left else []

    def last(self, pieces: list[Piece]) -> None:
        """What is left of everything, in sequences of falling powers of two."""
        size = sum(len(p.ids) for p in pieces)
        while size:
            n = 1 << size.bit_length() - 1
            head, pieces = head_and_rest(pieces, n)
            self.emit(head)
            size -= n


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
TYPES = [pa.int64()] * 7 + [pa.binary()]


def rows_of(sequences: list[tuple[int, list[Piece]]], keep_ids: bool = False) -> list[tuple]:
    out = []
    for number, pieces in sequences:
        offset = 0
        for p in pieces:
            raw = np.ascontiguousarray(p.ids, "<u4").data
            out.append((p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, number, offset, bytes(raw) if keep_ids else None))
            offset += len(p.ids)
    return out


def _packed(vocabulary: str, end: int, capacity: int, windows: int, cut: bool):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TYPES)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        w = Windows(TaskContext.get().partitionId() << TASK, capacity, windows, cut)
        for b in batches:
            ids, at = code.encode(b.column(1))
            for doc_id, lo, hi in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                whole = np.empty(hi - lo + 1, np.uint32)
                whole[:-1], whole[-1] = ids[lo:hi], end
                w.place([Piece(doc_id, 0, whole, len(whole))])
            yield batch(rows_of(w.out))
            w.out = []
        if left := w.merge() if cut else []:
            yield batch(rows_of([(w.next, left)], keep_ids=True))
        yield batch(rows_of([*w.out, *((n, w.open[n]) for _, n in w.order)]))

    return run


def _merged(round_: int, last: bool, capacity: int, windows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = Windows(round_ << ROUND | int(pdf["shard"].iloc[0]) << TASK, capacity, windows)
        pdf = pdf.sort_values(["sequence_id", "offset"])
        for _, own in pdf.groupby("sequence_id", sort=True):
            ids = [None if pd.isna(i) else int(i) for i in own["doc_id"]]
            w.place([Piece(i, int(s), np.frombuffer(x, "<u4"), int(n)) for i, s, x, n in zip(ids, own["start"], own["ids"], own["doc_tokens"], strict=True)])
        left = w.merge()
        if last:
            w.last(left)
            left = []
        rows = rows_of(w.out) + rows_of([(w.next, left)], keep_ids=True)
        out = pd.DataFrame(rows, columns=NAMES)
        return out.astype({"doc_id": "Int64"})

    return run


def online_pack(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY, windows: int = WINDOWS, cut: bool = True) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). vocabulary: the file of a tokenizers tokenizer; cut: whether documents may be cut to fill a sequence."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done, _ = stored(rows.mapInArrow(_packed(vocabulary, end, capacity, windows, cut), SCHEMA), "packed")
    out, open_, round_ = done.where("ids is null"), done.where("ids is not null"), 0
    while (top := open_.agg(F.max("sequence_id")).first()[0]) is not None:
        shards = ((top >> TASK & (1 << ROUND - TASK) - 1) // FAN) + 1
        round_ += 1
        shard = F.floor(F.shiftright("sequence_id", TASK).bitwiseAND((1 << ROUND - TASK) - 1) / FAN).cast("long")
        merged = open_.withColumn("shard", shard).groupBy("shard").applyInPandas(_merged(round_, shards == 1, capacity, windows), SCHEMA)
        merged, _ = stored(merged, "packed")
        out = out.unionByName(merged.where("ids is null"))
        open_ = merged.where("ids is not null")
    return out.drop("ids")
