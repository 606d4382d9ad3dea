"""Token ids of many texts at once, exactly those of the tokenizers library.

A byte-level tokenizer of this kind cuts before a space that a word follows, on both sides of line breaks and between a letter and a punctuation mark behind it. So a batch's bytes are cut there with array
operations into items: words with the space before them, marks, and runs of white space. Arrow numbers the distinct items; each new one is given to the library once (Latin words to its BPE model, as its pattern leaves them whole) and its ids are remembered, and the ids of all texts are
gathered from that memory. Places where white space of other kinds stands beside a space or line break are not cut. Texts that hold an added token are given to the library whole.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tessella.llm.common import utf8

MOST = 1_000_000  # remembered items of a worker, the newer and the older half
LONGEST = 256  # bytes of an item that is remembered beyond its batch
PART = 8 << 20  # bytes that are worked on at a time
LEADS = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))  # bytes that wide white space may begin with
KIND = np.zeros(256, np.uint8)  # 0: no white space, 1: space or line break, 2: white space or control character of another kind
KIND[:32], KIND[[0x20, 0x0A]] = 2, 1
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
TWO = np.zeros(256, bool)  # first bytes of Latin letters from U+00C0 to U+023F
TWO[0xC3:0xC9] = True
MARK = np.zeros(256, bool)  # ASCII that is neither letter, digit, white space nor control character
MARK[0x21:0x7F] = ~LETTER[0x21:0x7F]
MARK[0x30:0x3A] = False
#: A word of Latin letters up to U+023F, perhaps with a space before it.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+")
_others = iter(range(256, 324))
#: The character that byte-level models see for each byte.
SEEN = "".join(chr(x if 0x21 <= x < 0x7F or 0xA1 <= x < 0xAD or x > 0xAD else next(_others)) for x in range(256))


def _wide_spaces(data: np.ndarray, kind: np.ndarray) -> None:
    """Marks the bytes of white space beyond ASCII."""
    at = np.flatnonzero(LEADS[data])
    if not len(at):
        return
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    three |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    for found, n in ((at[two], 2), (at[three], 3)):
        for k in range(n):
            kind[found + k] = 2


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all items, which items are white space inside a text, which are white space at its end); at: the texts' n+1 offsets."""
    n = len(data)
    kind = KIND[data]
    _wide_spaces(data, kind)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    white = kind == 1
    first = white & (edge[:n] | np.concatenate([[True], ~white[:-1]]))
    last = white & (edge[1:] | np.concatenate([~white[1:], [True]]))
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    around = np.concatenate([[0], kind, [0]])
    clean = (edge[lo] | (around[lo] == 0)) & (edge[hi] | (around[np.minimum(hi + 1, n + 1)] == 0))
    lo, hi = lo[clean], hi[clean]
    end = edge[hi]
    hi = hi - ((data[hi - 1] == 0x20) & ~end)  # a last space goes with the word after it
    mark = edge.copy()
    mark[lo] = mark[hi] = True
    at = np.flatnonzero(MARK[data])
    at = at[at > 0]
    before, last = data[at - 2], data[at - 1]
    mark[at[LETTER[last] | TWO[before] & ((before != 0xC3) | (last != 0x97) & (last != 0xB7))]] = True  # not after the signs of times and division
    starts = np.flatnonzero(mark[:n])
    held = hi > lo
    inner, final = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    inner[lo[held & ~end]] = True
    final[lo[held & end]] = True
    return starts, inner[starts], final[starts]


def parts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The texts' edges, each once, and places in texts of more than PART bytes where ids may be cut: before a space between two ASCII letters or digits."""
    out = [np.unique(at)]
    for k in np.flatnonzero(np.diff(at) > PART).tolist():
        own = data[at[k] : at[k + 1]]
        word = (own >= 0x30) & (own <= 0x39) | (own >= 0x41) & (own <= 0x5A) | (own >= 0x61) & (own <= 0x7A)
        places = np.flatnonzero((own[1:-1] == 0x20) & word[:-2] & word[2:]) + 1
        last = -PART
        for step in range(PART // 2, len(own), PART // 2):
            i = int(np.searchsorted(places, step))
            if i < len(places) and places[i] > last:
                last = int(places[i])
                out.append(np.array([at[k] + last]))
    return np.unique(np.concatenate(out))


class Encoder:
    """A tokenizer with its memory of items: item -> slot, whose ids are pool[first[slot] : first[slot + 1]]."""

    def __init__(self, path: str, most: int = MOST):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.most = most
        own = json.loads(self.lib.to_str())
        pre, bpe = own["pre_tokenizer"] or {}, own["model"]
        plain = (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space"), own["normalizer"], own["post_processor"]) == ("ByteLevel", True, False, None, None)
        #: The BPE model, where its ids of a word are the library's.
        self.model = self.lib.model if plain and bpe["type"] == "BPE" and not bpe["dropout"] else None
        self.feed = self.whole("\n")
        self.clear()
        self.turn()

    def turn(self) -> None:
        """Begins a new memory and keeps the last one, so that items in use stay known."""
        self.older, self.older_pool, self.older_first = self.slots, self.pool, self.first
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.spaces: dict[tuple[bytes, str], int] = {}
        self.pool, self.first, self.used, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def put(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Takes the ids of len(sizes) new slots; gives the first one."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + len(sizes) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[self.count + 1 : self.count + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.count = self.used + len(ids), self.count + len(sizes)
        return self.count - len(sizes)

    def learn(self, items: list[bytes]) -> list[int]:
        """Slots of items that stand for themselves: many in one call of the library, a line break after each, where they hold none."""
        out = [-1] * len(items)
        if self.model:
            words = [k for k, x in enumerate(items) if WORD.fullmatch(x)]
            text, _ = charmap_decode(b"\n".join(items[k] for k in words), "strict", SEEN)
            found = [[t.id for t in self.model.tokenize(x)] for x in text.split(SEEN[10])] if words else []
            slot = self.put(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
            for n, k in enumerate(words):
                out[k] = slot + n
        plain = [k for k, x in enumerate(items) if out[k] < 0 and len(self.feed) == 1 and x and b"\n" not in x and KIND[x[0]] != 2 and KIND[x[-1]] == 0 and x[0] < 0xC2 and x[-1] < 0x80]
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            ids = np.array(self.lib.encode_batch_fast([b"".join(items[k] + b"\n" for k in part).decode() + "x"], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.feed[0])
            if len(ends) != len(part):
                continue  # one by one, then
            keep = np.ones(len(ids), bool)
            keep[ends] = False
            keep[ends[-1] :] = False
            slot = self.put(ids[keep], np.diff(np.concatenate([[-1], ends])) - 1)
            for n, k in enumerate(part):
                out[k] = slot + n
        rest = [k for k, s in enumerate(out) if s < 0]
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            found = [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast([items[k].decode("utf-8", "replace") for k in part], add_special_tokens=False)]
            slot = self.put(np.concatenate(found), np.array([len(x) for x in found]))
            for n, k in enumerate(part):
                out[k] = slot + n
        return out

    def run(self, space: bytes, after: str) -> int:
        """The slot of white space inside a text: its ids before a word, which differ from those at the end."""
        ids = self.whole(space.decode() + after)[: -len(self.whole(after))]
        return self.put(np.array(ids, np.uint32), np.array([len(ids)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n+1 offsets of the texts' ids."""
        data, at = utf8(texts)
        if len(data) <= PART:
            return self.coded(data, at)
        marks = parts(data, at)  # texts' edges, and places inside long ones
        ids, ends, lo = [], [np.zeros(1, np.int64)], 0
        while lo < len(marks) - 1:
            hi = max(lo + 1, int(np.searchsorted(marks, marks[lo] + PART, "right")) - 1)
            own = marks[lo : hi + 1]
            found, to = self.coded(data[own[0] : own[-1]], own - own[0])
            ids.append(found)
            ends.append(to[1:] + ends[-1][-1])
            lo = hi
        return np.concatenate(ids), np.concatenate(ends)[np.searchsorted(marks, at)]

    def coded(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes() if self.added else b""
        if any(w in raw for w in self.added):
            return self.apart([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        starts, inner, final = cut(data, at)
        if len(self.slots) > self.most // 2 or self.used > 4 * self.most:
            self.turn()
        offsets = np.append(starts, len(data))
        wide = len(data) >= 1 << 31
        items = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = items.dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        slot_of = np.fromiter((self.slots.get(x, -1) for x in names), np.int64, len(names))
        used = np.zeros(len(names), bool)
        used[code[~inner]] = True  # those that only stand inside texts as white space have slots of their own
        new = np.flatnonzero((slot_of < 0) & used)
        if len(new) and self.older:
            was = np.fromiter((self.older.get(names[k], -1) for k in new.tolist()), np.int64, len(new))
            kept, was, new = new[was >= 0], was[was >= 0], new[was < 0]
            sizes = self.older_first[was + 1] - self.older_first[was]
            skip = np.repeat(self.older_first[was] - (np.cumsum(sizes) - sizes), sizes)
            slot_of[kept] = np.arange(len(kept)) + self.put(self.older_pool[skip + np.arange(len(skip))], sizes)
            self.slots.update(zip((names[k] for k in kept.tolist()), slot_of[kept].tolist(), strict=True))
        if len(new):
            fresh = [names[k] for k in new.tolist()]
            got = self.learn(fresh)
            slot_of[new] = got
            self.slots.update((x, s) for x, s in zip(fresh, got, strict=True) if len(x) <= LONGEST)
        slot = slot_of[code]
        if inner.any():
            then = data[offsets[1:][inner]] == 0x20  # a word with a space before it follows
            spaces, which = np.unique(2 * code[inner].astype(np.int64) + then, return_inverse=True)
            slot[inner] = np.array([self.space(names[k >> 1], " x" if k & 1 else "x") for k in spaces.tolist()])[which]
        sizes = self.first[slot + 1] - self.first[slot]
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        ids = self.pool[np.repeat(self.first[slot] - (ends - sizes), sizes) + np.arange(total)]
        before = np.append(np.searchsorted(starts, at[:-1]), len(starts))  # items before each text
        return ids, np.concatenate([[0], ends])[before]

    def apart(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """coded() where some texts hold added tokens; those go to the library."""
        own = [any(w in t for w in self.added) for t in texts]
        rest = [b"" if x else t for t, x in zip(texts, own, strict=True)]
        ids, at = self.coded(np.frombuffer(b"".join(rest), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in rest])]).astype(np.int64))
        out = [np.array(self.whole(t.decode("utf-8", "replace")), np.uint32) if x else ids[lo:hi] for t, x, lo, hi in zip(texts, own, at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def space(self, space: bytes, after: str) -> int:
        if (found := self.spaces.get((space, after))) is None:
            found = self.run(space, after)
            if len(space) <= LONGEST:
                self.spaces[space, after] = found
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary; workers are used again."""
    return Encoder(path)
