"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the set of hashed words, word beginnings of four and five bytes (inflected forms share them), adjacent word pairs and
pairs with one word between them, over the whole text. A word is a run of ASCII letters, digits and bytes above 127; A-Z are
lowered. FTRL keeps one adaptive rate for each coordinate and an L1 term that leaves most weights at zero, so
the model is a short (index, weight) list, bounded by the hash space, that is broadcast for scoring.

Training reads a bounded sample of labelled rows: at most `most_positive` and `most_negative` documents, the first by a
hash of doc_id, `epochs` times over in a new order each. Scoring reads every row, in Arrow batches, without a shuffle.

Defined results: null and empty texts get the model's score of no features; a null doc_id is scored and never used for
training; labels that repeat or contradict count as toxic if any row says so, null labels are ignored; without any label the
model is empty and every score 0.5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import stored, tune, utf8

SPACE = 1 << 22  # hash space, so the bound of the model
PIECE = 1 << 20  # bytes of text hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_fold = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalnum() or _b > 127:
        _fold[_b] = ord(chr(_b).lower()) if _b < 128 else _b
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE), b)])) for b in (BASE, BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def spread(x: np.ndarray, salt: int) -> np.ndarray:
    """Index in the hash space of a 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(64 - 22)).astype(np.int64)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, index) of the features of texts data[at[i]:at[i+1]], repeats included."""
    low = _fold[data]
    inside = low > 0
    first = np.zeros(len(data), bool)
    first[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & (first | ~np.concatenate([[False], inside[:-1]])))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [True]])
    stops = np.flatnonzero(inside & (last | ~np.concatenate([inside[1:], [False]]))) + 1
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(low)], dtype=np.uint64)])
        hashed = lambda s, e: (sums[e] - sums[s]) * down[s]
        word = hashed(starts, stops)
        text = np.searchsorted(at, starts, "right") - 1
        found = [(text, spread(word, 1))]
        for n in (4, 5):
            found.append((text, spread(hashed(starts, np.minimum(starts + n, stops)), n)))
        for gap, salt in ((1, 17), (2, 31)):
            same = np.flatnonzero(text[:-gap] == text[gap:])
            found.append((text[same], spread(word[same] * np.uint64(0x100000001B3) ^ word[same + gap], salt)))
    return np.concatenate([t for t, _ in found]), np.concatenate([i for _, i in found])


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Stretches of a long text that together hold all its features: each starts three words before the last one's end."""
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + size)
        if stop < len(raw) and (cut := raw.rfind(b" ", at + 1, stop)) > at:
            stop = cut
        yield raw[at:stop]
        if stop == len(raw):
            return
        back = stop
        for _ in range(3):
            if (b := raw.rfind(b" ", at + 1, back)) < 0:
                back = stop
                break
            back = b
        at = back if back > at else stop


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of a text column in blocks of about PIECE bytes; a long text is several entries of one row."""
    data, at = utf8(column)
    i, n = 0, len(column)
    while i < n:
        if at[i + 1] - at[i] > PIECE:
            for p in pieces(data[at[i] : at[i + 1]].tobytes()):
                yield np.array([i]), np.frombuffer(p, np.uint8), np.array([0, len(p)])
            i += 1
            continue
        j = i + 1
        while j < n and at[j + 1] - at[i] <= PIECE:
            j += 1
        yield np.arange(i, j), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) over binary features of a hashed space; the bias has no L1 term."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float, size: int = SPACE):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bz = self.bn = 0.0

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.bz / ((self.beta + self.bn**0.5) / self.alpha + self.l2)

    def learn(self, idx: np.ndarray, label: int) -> None:
        w, b = self.weights(idx), self.bias
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        step = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / self.alpha
        self.z[idx] += g - step * w
        self.n[idx] += g * g
        self.bz += g - ((self.bn + g * g) ** 0.5 - self.bn**0.5) / self.alpha * b
        self.bn += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        idx = np.flatnonzero(np.abs(self.z) > self.l1)
        return idx, self.weights(idx)


def _trained(alpha: float, beta: float, l1: float, l2: float):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(alpha, beta, l1, l2)
        for b in batches:
            labels = b.column("toxic").to_pylist()
            held: dict[int, list[np.ndarray]] = {}
            for rows, data, at in blocks(b.column("text")):
                text, idx = features(data, at)
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(len(rows) + 1))
                for k, row in enumerate(rows.tolist()):
                    held.setdefault(row, []).append(np.unique(idx[order[cut[k] : cut[k + 1]]]))
            for row, label in enumerate(labels):
                found = held.get(row, [np.zeros(0, np.int64)])
                model.learn(found[0] if len(found) == 1 else np.unique(np.concatenate(found)), label)
        idx, w = model.model()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(idx, -1), pa.int64()), pa.array(np.append(w, model.bias))], ["idx", "weight"])

    return train


def train(docs: DataFrame, labels: DataFrame, learnable: Column, most_positive: int = 3072, most_negative: int = 3072, epochs: int = 4, alpha: float = 3.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.01) -> pd.DataFrame:
    """The model as (idx, weight) rows, idx -1 being the bias; learnable: condition on doc_id."""
    tune(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    turn = F.xxhash64("doc_id", F.lit(11))
    some = [known.where(F.col("toxic") == y).orderBy(turn, "doc_id").limit(n) for y, n in ((1, most_positive), (0, most_negative))]
    sample, _ = stored(some[0].unionAll(some[1]), "sample")  # ids and labels only, of a stated size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))  # one row an id, however often it occurs
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    rows = rows.repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"), "doc_id", "text").select("text", "toxic")
    return rows.mapInArrow(_trained(alpha, beta, l1, l2), "idx long, weight double").toPandas()


def scored(b: pa.RecordBatch, model) -> np.ndarray:
    """The score of every row of a batch that has a text column."""
    dense, bias = model
    total = np.full(b.num_rows, bias)
    long: dict[int, list[np.ndarray]] = {}
    for rows, data, at in blocks(b.column("text")):
        text, i = features(data, at)
        hit = np.flatnonzero(dense[i])
        both = np.unique(rows[text[hit]] * SPACE + i[hit])
        if len(rows) == 1:
            long.setdefault(int(rows[0]), []).append(both)
        else:
            total += np.bincount(both // SPACE, dense[both % SPACE], b.num_rows)
    for row, found in long.items():
        total[row] += dense[np.unique(np.concatenate(found)) % SPACE].sum()
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _unpacked(sent) -> tuple[np.ndarray, float]:
    idx, w, bias = sent.value
    dense = np.zeros(SPACE)
    dense[idx] = w
    return dense, bias


def _scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unpacked(sent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scored(b, model))], ["doc_id", "score"])

    return run


def _clean(sent, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unpacked(sent)
        for b in batches:
            yield b.filter(pa.array(scored(b, model) < threshold))

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame):
    """The broadcast model learnt from the labels of rows that are not held out."""
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    bias = model.loc[model["idx"] == -1, "weight"].sum()
    model = model[model["idx"] >= 0]
    return docs.sparkSession.sparkContext.broadcast((model["idx"].to_numpy(), model["weight"].to_numpy(), float(bias)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = fitted(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_scores(sent), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that aren't predicted toxic, filtered as they are scanned."""
    return docs.mapInArrow(_clean(fitted(docs, labels), threshold), docs.schema)
