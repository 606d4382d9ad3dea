"""Lexical search and hard negatives beside plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import docs, strange
from tessella.llm import hard_negatives as H, lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, top):
    """[(item, rank, doc_id, score)] with Python's integers; rows and items: (id, text)."""
    found = [(i, Counter(t), len(t)) for i, t in ((i, plain_terms(t)) for i, t in rows) if t]
    n, total = len(found), sum(x for _, _, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in found:
            m = 100 - 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus(rnd, n):
    words = ["Baum", "tree", "ÉTÉ", "été", "日本", "x1", "a-b", "it's", *(f"w{i}" for i in range(60))]
    return [(i, rnd.choice([" ", "\n", ", "]).join(rnd.choices(words, [1 / (k + 1) for k in range(len(words))], k=rnd.choice([0, 1, 3, 20, 80])))) for i in range(n)]


@pytest.mark.parametrize(("postings", "leaf", "piece"), [(400_000, 1024, 1 << 20), (150, 1, 7), (60, 8, 30)])
def test_search_against_brute_force(spark, monkeypatch, postings, leaf, piece):
    for name, value in (("POSTINGS", postings), ("LEAF", leaf), ("PIECE", piece)):
        monkeypatch.setattr(L, name, value)
    rnd = random.Random(postings)
    rows = corpus(rnd, 300) + [(None, "tree w1"), (301, None), (302, ""), (303, "w1 tree"), (303, "w1 tree"), (304, " ".join(f"w{i % 50}" for i in range(5000)))]
    items = [(0, "Tree baum w1 w2 w3 w3"), (1, "été ÉTÉ 日本"), (2, None), (3, "nothing at all"), (4, "w7"), (4, "w7"), (None, "X1 a-b IT'S")] + [(10 + k, " ".join(f"w{rnd.randrange(60)}" for _ in range(12))) for k in range(10)]
    asked = strange(spark.createDataFrame(items, "item_id long, text string"))
    out = L.search(strange(docs(spark, rows)).repartition(5), asked, top=7, item_bytes=200)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(out) == plain_search(rows, items, 7)


def test_search_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert L.search(docs(spark, []), some).collect() == []
    assert L.search(docs(spark, [(1, "...")]), some).collect() == []
    assert L.search(docs(spark, [(1, "a")]), none).collect() == []


def test_treaps_are_in_both_orders():
    rng = np.random.default_rng(3)
    term = np.sort(rng.integers(0, 9, 400))
    doc = np.concatenate([np.sort(rng.choice(1000, n, replace=False)) for n in np.unique(term, return_counts=True)[1]])
    t = L.Treaps(term, doc, rng.integers(0, 30, 400))

    def walk(at, low, high, most):
        if at < 0:
            return 0
        assert low < t.doc[at] < high and t.impact[at] <= most
        return 1 + walk(t.left[at], low, t.doc[at], t.impact[at]) + walk(t.right[at], t.doc[at], high, t.impact[at])

    assert all(walk(t.root[k], -1, 10**6, 10**9) == b - a for k, (a, b) in t.span.items())


def test_search_prunes(monkeypatch):
    """Documents that hold both rare terms are found without a look at most of the common one's postings."""
    monkeypatch.setattr(L, "LEAF", 4)
    n = 3000
    term = np.concatenate([np.zeros(n, np.int64), np.ones(30, np.int64)])
    doc = np.concatenate([np.arange(n), np.arange(0, n, 100)])
    t = L.Treaps(term, doc, np.concatenate([np.full(n, 5), np.full(30, 900)]))
    looked = []
    monkeypatch.setattr(L.Treaps, "read", lambda self, nodes, read=L.Treaps.read: looked.append(sum(b - a for _, _, a, b in nodes)) or read(self, nodes))
    best = []
    t.search([(0, 1), (1, 10)], best, list(range(n)), 0, 10)
    assert sorted(-d for _, d, _ in best) == list(range(0, 1000, 100)) and sum(looked) < n / 4


# ---- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows, every, scale=256, positives=5, negatives=3, low=50, high=95):
    one = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(scale * float(c)) for c in v]
        key = (label, np.array(x, "<i4").tobytes())
        if i not in one or key < one[i][2]:
            one[i] = (x, label, key)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (x, label, _) in one.items():
        if a % every:
            continue
        scores = [(-dot(x, y), i, m) for i, (y, m, _) in one.items() if i != a]
        same, other = sorted(s for s in scores if s[2] == label)[:positives], sorted(s for s in scores if s[2] != label)
        for s, p, _ in same:
            fits = [(t, i) for t, i, _ in other if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("group", "slice_", "few"), [(256, 2048, 10**6), (4, 20, 0)])
def test_negatives_against_brute_force(spark, monkeypatch, group, slice_, few):
    for name, value in (("GROUP", group), ("SLICE", slice_), ("BROADCAST_ROWS", few)):
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(group)
    centres = rng.standard_normal((6, 8))
    rows = []
    for i in range(320):
        v = centres[rng.integers(6)] + rng.standard_normal(8) * rng.choice([0.05, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([0.3, 1, 4])], int(rng.choice([0, 0, 0, 1, 2]))))
    for i in range(320, 360):  # a group of copies, with labels of their own
        rows.append((i, rows[0][1], i % 2))
    rows += [(400, None, 1), (410, [1.0, None], 1), (420, [float("nan")] * 8, 1), (430, [float("inf")] * 8, 1), (440, rows[3][1], None), (None, rows[3][1], 1), (450, [0.0] * 8, 1), (460, [], 2), (470, [1.0, 2.0], 0), (480, rows[5][1], 7), (10, rows[10][1], 9), (20, rows[7][1], rows[20][2]), (30, rows[30][1], rows[30][2])]
    df = strange(spark.createDataFrame(rows, VECTORS)).repartition(5)
    assert mined(H.hard_negatives(df, "id % 10 = 0", pivots=7)) == plain_negatives(rows, 10)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert H.hard_negatives(none, "id % 10 = 0").collect() == []
    assert H.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], VECTORS), "id % 10 = 0").collect() == []
    assert H.hard_negatives(spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 1)], VECTORS), "id % 10 = 0").collect() == []


def test_labels_of_other_types(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(4)], i % 3) for i in range(60)]
    named = [(i, v, "abc"[m]) for i, v, m in rows]
    df = spark.createDataFrame(named, "vec_id int, embedding array<double>, label string")
    assert mined(H.hard_negatives(df, "id % 10 = 0")) == plain_negatives(rows, 10)


def test_bounds_leave_rows_out(spark):
    """Anchors of one far cluster need the rows of few cells only."""
    rng = np.random.default_rng(2)
    centres = np.eye(6) * 10
    x = np.concatenate([c + rng.standard_normal((200, 6)) * 0.1 for c in centres])
    values = [np.floor(256 * v).astype("<i4").tobytes() for v in x]
    space = H.Space(values, 6, float(np.sqrt((np.floor(256 * x) ** 2).sum(1).max())), 24)
    cell, r = space.nearest(space.rows(values))
    anchors = spark.createDataFrame([("g", int(cell[k]), float(r[k]), float(400**2), 0.0, 1) for k in range(0, 200, 20)], "g string, cell int, r double, far double, near double, label long")
    wanted = {n.cell: (n.low, n.high) for n in H.needed(anchors, space, False).collect()}
    sent = [k for k in range(len(x)) if cell[k] in wanted and wanted[cell[k]][0] <= r[k] <= wanted[cell[k]][1]]
    assert set(range(200)) <= set(sent) and len(sent) < 400
