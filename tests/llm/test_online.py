"""Token ids of many texts at once, and online packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from helpers import docs, strange
from tessella.llm import online_packing, tokens

vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")

ALPHABET = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "é", "日", "'s", "12", "!?", "<|endoftext|>", "\x00", "\x1f", " \n", "\x85"]


def plain(text):
    return tokens.encoder(vocabulary).whole(text or "")


def test_ids_are_the_librarys_whatever_the_white_space():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(14))) for _ in range(6000)] + [None, "", "\0 ", "\0\n x"]
    code = tokens.Encoder(vocabulary, most=500)  # so that its memory is cleared on the way
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        ids, at = code.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(t) for t in part]


def test_items_in_use_stay_known_when_the_memory_is_full(monkeypatch):
    learnt, learn = [], tokens.Encoder.learn
    monkeypatch.setattr(tokens.Encoder, "learn", lambda self, items: (learnt.extend(items), learn(self, items))[1])
    code = tokens.Encoder(vocabulary, most=60)
    for k in range(20):
        text = " ".join(["always here", *(f"w{chr(97 + k)}{chr(97 + j)}x" for j in range(20)), "always\n here"])
        ids, _ = code.encode(pa.array([text]))
        assert ids.tolist() == plain(text)
    assert learnt.count(b" always") == 1 and len(code.slots) + len(code.older) < 120



def test_words_are_remembered_without_the_marks_behind_them():
    code = tokens.Encoder(vocabulary)
    text = "beta beta. beta, straße straße; straße! 2×! 3÷. it's 'tis beta.gamma"
    ids, _ = code.encode(pa.array([text], pa.string()))
    assert ids.tolist() == plain(text)
    assert {b"beta", b" beta", b".", b",", " straße".encode(), b";", b"!"} < code.slots.keys()
    assert not {b" beta.", b" beta,", " straße;".encode(), " straße!".encode()} & code.slots.keys()
    letters = [chr(c) for c in range(0xA0, 0x260)]
    texts = [a + x + m + b for x in letters for a in ("", " ", "a") for m in (".", "'", "'s") for b in ("", "x", " é")]
    ids, at = code.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(t) for t in texts]


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "PART", 300)
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("abcé,") for _ in range(rnd.randrange(1, 9))) for _ in range(n)) for n in (0, 900, 3, 0, 5000, 40)] + ["x" * 5000, None, "\n" * 2000, "a b " * 900]
    ids, at = tokens.Encoder(vocabulary).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(t) for t in texts]


def whole(df, texts, capacity=2048, powers=True):
    """Checks that the pieces put every document together again and that sequences have no gaps; gives their lengths."""
    rows = df.collect()
    want = {i: np.array([*plain(t), 1], "<u4") for i, t in texts.items()}
    seen = dict.fromkeys(want, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.start == seen[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in want.items()}
    sizes = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    if powers:
        short = [n for n in sizes.values() if n < capacity]
        assert max(sizes.values(), default=0) <= capacity and len(set(short)) == len(short) and all(n & n - 1 == 0 for n in short)
    return sizes


@pytest.mark.parametrize("fan", [2, 256])
def test_pieces_put_documents_together(spark, monkeypatch, fan):
    monkeypatch.setattr(online_packing, "FAN", fan)
    rnd = random.Random(fan)
    texts = {i: " ".join(rnd.choice(["tree", "blatt", "año", "x"]) for _ in range(rnd.choice([0, 5, 300, 900, 6000]))) for i in range(60)}
    texts |= {None: None, 60: "", 61: " \n\n "}
    df = strange(docs(spark, list(texts.items()))).repartition(7)
    out = online_packing.online_pack(df, vocabulary)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole(out, texts)


def test_windows_are_bounded_and_tight():
    ids = lambda n: np.zeros(n, np.uint32)
    for cut in (True, False):
        w, rnd, total = online_packing.Windows(0, 100, 4, cut), random.Random(1), 0
        for i in range(500):
            n = rnd.randrange(1, 130)
            room = sorted(r for r, _ in w.order)
            w.place([online_packing.Piece(i, 0, ids(n), n)])
            total += n
            assert len(w.open) <= 4
            fits = [r for r in room if r >= n]
            if n < 100 and fits:  # the tightest one took it
                room.remove(fits[0])
                assert sorted(r for r, _ in w.order) == sorted([*room, *([fits[0] - n] if fits[0] > n else [])])
        if cut:
            assert all(sum(len(p.ids) for p in s) == 100 for _, s in w.out)
            left = w.merge()
            assert sum(len(p.ids) for _, s in w.out for p in s) + sum(len(p.ids) for p in left) == total and sum(len(p.ids) for p in left) < 100


def test_whole_documents_where_asked(spark):
    texts = {i: "a " * (i * 37 % 700) for i in range(40)}
    out = online_packing.online_pack(docs(spark, list(texts.items())), vocabulary, cut=False, windows=4)
    whole(out, texts, powers=False)
    assert out.where("doc_tokens <= 2048 and length < doc_tokens").count() == 0


def test_repeated_rows_and_no_rows(spark):
    twice = docs(spark, [(1, "one text")] * 3)
    rows = online_packing.online_pack(twice, vocabulary).collect()
    assert sum(r.length for r in rows) == 3 * (len(plain("one text")) + 1)
    assert online_packing.online_pack(docs(spark, []), vocabulary).count() == 0


def test_many_rows_of_one_id_go_over_several_files(spark):
    from pyspark.sql import functions as F

    from tessella.llm import common, token_files

    rows = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 3).alias("text"))
    path = common.new_path(spark, "tokens")
    token_files.write(rows, path, vocabulary)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("length").collect()
    sizes = sorted(r.length for r in files if r.length)
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[0]
    read = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in read] == [None] * 10_000 + [7] * 10_000
    assert all(b.start == a.start + a.n_tokens for a, b in zip(read, read[1:]))


def test_one_row_of_a_labelled_id_is_learnt_from(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessella.llm import toxicity

    d = docs(spark, [(0, f"text {k % 4}") for k in range(3000)] + [(k, f"other {k}") for k in range(1, 9)])
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(9)], "doc_id long, quality int, toxic int")
    seen, kind = [], type(d)
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: seen.append(self.count()) or run(self, *a, **b))
    toxicity.train(d, labels, F.lit(True), epochs=4)
    assert seen == [4 * 9]
