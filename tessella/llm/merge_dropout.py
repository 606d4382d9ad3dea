"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is a BPE model with byte fallback; its own normaliser is not applied, so that decoding gives the text back byte by
byte. Encoding keeps an agenda of candidate merges, best score first, leftmost first. A candidate that is taken from it
is skipped for good if a hash keyed by (seed, doc_id, number of the stretch in the text, the candidate's place in the stretch) falls under `dropout`; later
merges may bring its characters together in another way. So each occurrence of a word is cut by its own draws, and always in the same way in a
rerun, whatever the partitions. With dropout 0 the ids are those
of the sentencepiece library under an identity normaliser.

No piece but runs of spaces has a space after its first character, and none has a line break beside another one, so stretches
between them are encoded by themselves, many at a time: as draws depend on the candidate alone, each is drawn when it comes up, and what is not skipped waits for its
turn. A step takes the best candidate of every stretch that still has one, over arrays of a million characters; stretches of more than LONG characters have agendas of their own.

Defined results: null and empty texts have no ids and decode to an empty text; the character that stands for the space is written as bytes, so it
survives too; texts of any length are taken in parts cut between stretches; a null doc_id is a key like any other; repeated rows give equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tessella.llm.common import tune

DROPOUT, SEED = 0.1, 7
SPACE = "▁"
WORD = (1 << 64) - 1
MIX = 0xD6E8FEB86659FD93
PLACE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LONG, NONE, NEVER = 48, 1 << 25, (1 << 31) - 1  # NONE: above all ranks, so that ranks * LONG fit into 31 bits


def drawn(key: int, place: int) -> int:
    """A 64-bit draw for one candidate of one occurrence."""
    x = (key ^ place) * MIX & WORD
    x = (x ^ x >> 32) * MIX & WORD
    return x ^ x >> 32


def drawn_all(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """drawn() of arrays."""
    with np.errstate(over="ignore"):
        x = (keys ^ places) * np.uint64(MIX)
        x = (x ^ x >> np.uint64(32)) * np.uint64(MIX)
        return x ^ x >> np.uint64(32)


class Pairs:
    """Two symbols to the rank of their merge and the piece that it makes: open addressing in arrays, looked up for many pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(8, (8 * len(pairs)).bit_length())
        self.keys, self.ranks, self.pieces = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        left, at = np.arange(len(keys)), self.place(keys)
        ranks, pieces = np.array([*pairs.values()], np.int32).reshape(-1, 2).T
        while len(left):
            free, first = np.unique(at[left], return_index=True)  # of those that want one slot, the first gets it if it is free
            taken = self.keys[free] >= 0
            put = left[first[~taken]]
            self.keys[at[put]], self.ranks[at[put]], self.pieces[at[put]] = keys[put], ranks[put], pieces[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (1 << self.bits) - 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of the merges, NONE where there is none; slots of the table)."""
        keys = a.astype(np.int64) << 32 | b
        at = self.place(keys)
        found = self.keys[at]
        off = np.flatnonzero((found != keys) & (found >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (1 << self.bits) - 1
            found[off] = now = self.keys[at[off]]
            off = off[(now != keys[off]) & (now >= 0)]
        return np.where(found == keys, self.ranks[at], NONE), at


class MergeDropout:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        fixed = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.ids = {lib.id_to_piece(i): i for i in range(n) if i not in fixed}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.raw = [b"" if i in fixed else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        if any(SPACE in p[1:] and p.strip(SPACE) or "\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("a piece of this model crosses a space or a line break; stretches can't be encoded by themselves")
        self.limit, self.seed = min(int(dropout * 2**64), WORD), seed
        longer = [p for p in self.ids if len(p) > 1]
        ranks = {s: r for r, s in enumerate(sorted({-self.score[p] for p in longer}))}
        # Symbols: pieces by their ids, then characters that only stand in pieces; character 0 of the table is one that never merges.
        symbols = self.ids | {c: n + k for k, c in enumerate(sorted({c for p in longer for c in p} - self.ids.keys()))}
        self.none, self.pieces_end = n + len(symbols), n
        self.symbol = np.full(0x110000, self.none, np.int32)
        for c, i in symbols.items():
            if len(c) == 1 and c != SPACE:
                self.symbol[ord(c)] = i
        self.symbol[ord(" ")] = symbols.get(SPACE, self.none)
        self.piece = np.zeros(len(ranks), np.int32)
        pairs, seen = {}, set()
        for p in longer:
            rank = ranks[-self.score[p]]
            self.piece[rank] = -1 if rank in seen else self.ids[p]  # -1: several pieces have this score
            seen.add(rank)
            for k in range(1, len(p)):
                if (u := symbols.get(p[:k])) is not None and (v := symbols.get(p[k:])) is not None:
                    pairs[u, v] = rank, self.ids[p]
        self.pairs, self.bytes_of = Pairs(pairs), np.array(self.byte, np.uint32)

    def pieces(self, stretch: str, skip: Callable[[int], bool]) -> list[int]:
        """The ids of one stretch; skip is asked for the place of each candidate whose turn comes."""
        text = [SPACE if c == " " else "" if c == SPACE else c for c in stretch]  # the mark itself never merges
        n = len(text)
        symbol, before, after = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        score, agenda = self.score, []
        for i in range(n - 1):
            if (s := score.get(text[i] + text[i + 1])) is not None and text[i] and text[i + 1]:
                agenda.append((-s, i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            if not symbol[i] or not symbol[j] or after[i] != j or len(symbol[i]) + len(symbol[j]) != size:
                continue  # one of the two has gone into another merge
            if skip((i * PLACE[0] + j * PLACE[1] + size * PLACE[2]) & WORD):
                continue
            symbol[i] += symbol[j]
            symbol[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if symbol[k] and (s := score.get(symbol[i] + symbol[k])) is not None:
                    heappush(agenda, (-s, i, k, len(symbol[i]) + len(symbol[k])))
            h = before[i]
            if h >= 0 and symbol[h] and (s := score.get(symbol[h] + symbol[i])) is not None:
                heappush(agenda, (-s, h, i, len(symbol[h]) + len(symbol[i])))
        out, i = [], 0
        while i < n:
            if (p := self.ids.get(symbol[i])) is not None:
                out.append(p)
            else:
                out.extend(self.byte[b] for b in (symbol[i] or stretch[i]).encode())
            i = after[i]
        return out

    def keyed(self, stretch: str, key: int) -> list[int]:
        """The ids of one occurrence by an agenda of its own."""
        return self.pieces(stretch, lambda place: drawn(key, place) < self.limit)

    def values(self, left: np.ndarray, right: np.ndarray, place: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """rank * LONG + i of the candidates of these symbols, NEVER where there is none or it is skipped; place: (i, j, size) in the stretch."""
        rank, _ = self.pairs.find(left, right)
        out = np.where(rank < NONE, rank * LONG + place[0], NEVER).astype(np.int32)
        if self.limit and len(live := np.flatnonzero(out < NEVER)):
            with np.errstate(over="ignore"):
                where = sum(x[live].astype(np.uint64) * np.uint64(m) for x, m in zip(place, PLACE, strict=True))
            out[live[drawn_all(keys[live], where) < np.uint64(self.limit)]] = NEVER
        return out

    def merged(self, symbol: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        """Merges the symbols of stretches of LONG characters at most, in place; -1 where a symbol has gone into the one before it."""
        after = np.arange(1, len(symbol) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        widths = [2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, LONG]
        for low, high in zip([1, *widths], widths, strict=False):
            some = np.flatnonzero((size > low) & (size <= high))
            s, key = start[some].astype(np.int32), keys[some]
            end = s + size[some].astype(np.int32)
            value = np.full((high - 1, len(s)), NEVER, np.int32)
            for i in range(high - 1):
                has = np.flatnonzero(s + i + 1 < end)
                at, one = s[has] + i, np.full(len(has), i)
                value[i, has] = self.values(symbol[at], symbol[at + 1], (one, one + 1, np.full(len(has), 2)), key[has])
            while len(s):
                best = value.min(axis=0)
                live = best < NEVER
                if not live.all():
                    s, end, key, best, value = s[live], end[live], key[live], best[live], value[:, live]
                    if not len(s):
                        break
                column = np.arange(len(s))
                i = best % LONG
                at = s + i
                right = after[at]
                next_ = after[right]
                piece = self.piece[best // LONG]
                if len(tied := np.flatnonzero(piece < 0)):
                    piece[tied] = self.pairs.pieces[self.pairs.find(symbol[at[tied]], symbol[right[tied]])[1]]
                symbol[at], symbol[right] = piece, -1
                after[at] = next_
                value[np.minimum(right - s, high - 2), column] = NEVER
                value[i, column] = NEVER
                inner = np.flatnonzero(next_ < end)
                a, n = at[inner], next_[inner]
                before[n] = a
                value[i[inner], inner] = self.values(symbol[a], symbol[n], (i[inner], n - s[inner], after[n] - a), key[inner])
                inner = np.flatnonzero(at > s)
                a = at[inner]
                h = before[a]
                value[h - s[inner], inner] = self.values(symbol[h], symbol[a], (h - s[inner], i[inner], after[a] - h), key[inner])

    def part(self, code: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids that begin at each character) of characters that are whole stretches."""
        symbol = self.symbol[code]
        self.merged(symbol, start, size, key)
        long = np.flatnonzero(size > LONG)
        own = {}
        for k in long.tolist():
            own[int(start[k])] = np.array(self.keyed(code[start[k] : start[k] + size[k]].astype("<u4").tobytes().decode("utf-32-le"), int(key[k])), np.uint32)
            symbol[start[k] : start[k] + size[k]] = -1
        other = symbol >= self.pieces_end
        count = (symbol >= 0).astype(np.int64)
        chars = code[other]
        count[other] = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        for at, ids in own.items():
            count[at] = len(ids)
        out = np.repeat(symbol.astype(np.uint32), count)
        if len(chars):
            raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            out[np.repeat(other, count)] = self.bytes_of[raw]
        if own:
            ends = np.cumsum(count)
            for at, ids in own.items():
                out[ends[at] - len(ids) : ends[at]] = ids
        return out, count

    def encode_many(self, texts: list[str], doc_ids: list[int | None], part: int = 1 << 20) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        code = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le"), "<u4")
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(size)
        first = ends - size
        docs = np.array([xxh64_intdigest(f"{self.seed}:{d}") for d in doc_ids], np.uint64)
        # A stretch begins at a text's start, at a line break and behind it, and where spaces begin.
        cut = np.zeros(len(code), bool)
        blank, line = code == 32, code == 10
        cut[first[size > 0]] = True
        cut |= line
        cut[1:] |= line[:-1] | blank[1:] & ~blank[:-1]
        starts = np.flatnonzero(cut)
        of = np.searchsorted(ends, starts, "right")
        number = np.arange(len(starts)) - np.searchsorted(starts, first)[of]
        keys = drawn_all(docs[of], number.astype(np.uint64))
        length = np.diff(np.append(starts, len(code)))
        ids, counts, at = [], [], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + part)))
            a, b = int(starts[at]), int(starts[to]) if to < len(starts) else len(code)
            got, count = self.part(code[a:b], starts[at:to] - a, length[at:to], keys[at:to])
            ids.append(got)
            counts.append(np.add.reduceat(count, starts[at:to] - a))
            at = to
        if not ids:
            return [b""] * len(texts)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        flat = np.concatenate(ids).astype("<u4")
        lo, hi = total[np.searchsorted(starts, first)], total[np.searchsorted(starts, ends)]
        return [flat[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]

    def encode(self, text: str, doc_id: int | None) -> bytes:
        return self.encode_many([text], [doc_id])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:]


@lru_cache(maxsize=2)
def shared(path: str, dropout: float = DROPOUT, seed: int = SEED) -> MergeDropout:
    """One coder for all tasks of a worker."""
    return MergeDropout(path, dropout, seed)


def _encoded(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared(path, dropout, seed)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode_many([t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist())]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) of every row; model: the file of a sentencepiece BPE model."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encoded(model, dropout, seed), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared(path)
        for b in batches:
            texts = [coder.decode(np.array(x.values if x.is_valid else [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, text string")


def _digested(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared(path, dropout, seed)
        for b in batches:
            out = []
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for d, t, raw in zip(ids, texts, coder.encode_many([t or "" for t in texts], ids), strict=True):
                back = coder.decode(np.frombuffer(raw, "<u4"))
                out.append((d, len(raw) // 4, zlib.crc32(raw), back == (t or "").encode()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["doc_id", "n_tokens", "ids_crc32", "lossless"])

    return run


def digests(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, lossless): every row encoded, its ids decoded again and compared with the text."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_digested(model, dropout, seed), "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")
