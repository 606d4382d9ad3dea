import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from helpers import docs, roots, strange
from tessella.llm import embeddings, exact_dedup, simhash, substring
from tessella.llm.common import components, stored

ODD = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (4, "a B"), (5, "É"), (6, "é"), (7, "x " * 50_000), (8, "X " * 50_000), (9, "a b "), (None, "a b"), (None, "lonely")]


def test_fuse_filter_has_every_key_and_few_others():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 30_000):
        keys = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
        f = exact_dedup.BinaryFuse.build(keys)
        assert f.contains(keys).all()
        assert f.contains(rng.integers(-(2**63), 2**63, 20_000, dtype=np.int64)).mean() < 0.01
        assert n < 10_000 or len(f.slots) < 1.3 * n


def test_exact_groups(spark):
    out = {}
    for r in exact_dedup.exact_dedup(strange(docs(spark, ODD))).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(ODD)
    assert (out[1][0].keep_id, out[2][0].keep_id, out[1][0].group_size) == (2, 2, 2)
    assert {r.keep_id for i in (3, 4) for r in out[i]} == {4} and out[3][0].group_size == 4
    assert sorted(r.kept for r in out[4]) == [False, True] and not out[3][0].kept
    assert out[5][0].kept and out[6][0].kept and out[9][0].kept
    assert out[7][0].keep_id == 8
    assert {(r.keep_id, r.kept) for r in out[None]} == {(4, False), (None, True)}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, ODD)).count() == 7
    nulls = docs(spark, [(None, t) for t in ("a", "A", None)] * 400 + [(7, f"t{i}") for i in range(300)] * 2)
    got = exact_dedup.exact_dedup(nulls)
    assert Counter((r.group_size, r.keep_id, r.kept) for r in got.collect()) == {(800, None, True): 1, (800, None, False): 799, (400, None, True): 1, (400, None, False): 399, (2, 7, True): 300, (2, 7, False): 300}
    assert Counter((r.text or "").lower() for r in exact_dedup.drop_copies(nulls).collect()) == Counter({"a": 1, "": 1} | {f"t{i}": 1 for i in range(300)})


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab") * rng.randint(0, 3)) for i in range(300)]
    best, size = {}, Counter()
    for i, t in rows:
        best[t.lower()], size[t.lower()] = max(best.get(t.lower(), i), i), size[t.lower()] + 1
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert got == {i: (best[t.lower()], size[t.lower()]) for i, t in rows}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 400)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(350)]
    want = roots(900, links)
    df = spark.createDataFrame([(b, a) for a, b in links] + links[:50] + [(7, 7)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: r for i, r in enumerate(want) if r != i}
    assert components(df.where("a < 0")).count() == 0


def _fingerprint(text):
    from xxhash import xxh64_intdigest

    ws = text.encode().lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << k for k in range(64) if 2 * sum(xxh64_intdigest(s, 42) >> k & 1 for s in shingles) > len(shingles))


def test_simhash_against_brute_force(spark):
    rng = random.Random(7)
    base = ["w%d" % rng.randrange(500) for _ in range(300)]
    rows = [(i, t) for i, t in ODD if i != 7]
    for i in range(20, 140):
        words = list(base if i % 2 else [str(rng.randrange(9999)) for _ in range(40)])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "new%d" % i
        rows.append((i, " ".join(words)))
    fps = [_fingerprint(t or "") for _, t in rows]
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    known.sort(key=lambda k: rows[k][0])
    root = roots(len(known), [(a, b) for a in range(len(known)) for b in range(a) if (fps[known[a]] ^ fps[known[b]]).bit_count() <= 3])
    want = Counter((rows[k][0], f"{fps[k]:016x}", rows[known[r]][0]) for k, r in zip(known, root, strict=True))
    want.update((None, f"{fps[k]:016x}", None) for k, (i, _) in enumerate(rows) if i is None)
    got = Counter(map(tuple, simhash.simhash_groups(strange(docs(spark, rows))).collect()))
    assert got == want
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_simhash_large_buckets_go_on_to_finer_ones(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64) | np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64), rng.integers(0, 1 << 64, 40, dtype=np.uint64)]))
    reps = spark.createDataFrame([(i, int(f.view(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r.node: r.root for r in components(simhash.candidate_links(reps, most=3)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_pivots_never_lose_a_pair():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    assert np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max() <= 3


def _vectors(rng):
    rows = [(1, None, 0), (2, [0.0, 0.0, 0.0, 0.0], 0), (3, [1.0, None, 0.0, 0.0], 0), (4, [float("nan"), 1.0, 0.0, 0.0], 0), (5, [1.0, 2.0, 3.0, 4.0], None), (6, [], 0), (7, [1.0, 0.0], 0), (8, [1.0, 0.0], 0)]
    centres = rng.standard_normal((12, 4))
    for i in range(10, 250):
        rows.append((i, (centres[i % 12] + 0.1 * rng.standard_normal(4)).tolist(), i % 3))
    rows += [(i, [3.0, 1.0, 0.0, 2.0], 1) for i in range(250, 290)]
    rows.append((289, [3.0, 1.0, 0.0, 2.0], 1))
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_against_brute_force(spark, kind):
    rows = _vectors(np.random.default_rng(11))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(5)
    dtype = np.float32 if kind == "float" else np.float64
    seen = {i: (np.array(v, dtype).astype(float), n) for i, v, n in rows if v and None not in v and n is not None and np.isfinite(v).all() and any(v)}
    ids = sorted(seen)
    near = lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] / np.sqrt(a[0] @ a[0]) / np.sqrt(b[0] @ b[0]) >= 0.93
    links = [(a, b) for a in range(len(ids)) for b in range(a) if near(seen[ids[a]], seen[ids[b]])]
    root, degree = roots(len(ids), links), Counter(x for pair in links for x in pair)
    want = Counter()
    for i, _, _ in rows:
        k = ids.index(i) if i in seen else None
        want[(i, degree[k] if k is not None else 0, ids[root[k]] if k is not None else i)] += 1
    got = embeddings.near_duplicates(df.withColumn("key", df.vec_id), block=16).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def _lines(rng, n):
    return " ".join("w%d" % rng.randrange(3000) for _ in range(n))


def test_passages_against_brute_force(spark):
    rng = random.Random(13)
    shared = [_lines(rng, n) for n in (25, 55, 60, 80)]
    rows = [(1, None), (2, ""), (3, "short line\nshort line"), (None, shared[0])]
    for i in range(10, 90):
        lines = [_lines(rng, rng.randrange(3, 40)) for _ in range(3)]
        if i % 2:
            words = rng.choice(shared).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(50)
            lines.insert(rng.randrange(3), "  " + " ".join(words).upper() if i % 3 else " ".join(words))
        rows.append((i, "\n".join(lines)))
    found = [(i, p, x.lower().split()) for i, t in sorted((r for r in rows if r[0] and r[1]), key=lambda r: r[0]) for p, x in enumerate(t.split("\n")) if len(x.split()) >= 20]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, _, w in found]
    root = roots(len(found), [(a, b) for a in range(len(found)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    gone = {}
    for k, (i, p, _) in enumerate(found):
        if root[k] != k:
            gone.setdefault(i, []).append(p)
    got = {r.doc_id: r for r in substring.substring_dedup(strange(docs(spark, rows))).collect() if r.doc_id}
    assert {i: list(r.removed) for i, r in got.items() if r.n_removed} == gone
    for i, t in rows:
        if i and t is not None:
            assert got[i].text == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ()))
    assert got[1].text is None
    kept = substring.drop_passages(strange(docs(spark, rows)))
    assert kept.count() == len(rows) and kept.where("doc_id > 9 and n_chars <> length(text)").count() == 0
    assert substring.substring_dedup(docs(spark, [])).count() == 0


def test_similar_sets_against_brute_force():
    rng = np.random.default_rng(17)
    base = rng.integers(0, 1 << 60, (4, 60))
    sets = [np.unique(np.concatenate([b[rng.random(60) > 0.08], rng.integers(0, 1 << 60, rng.integers(0, 8))])).astype("<u8") for b in base[rng.integers(0, 4, 150)]]
    want = roots(150, [(a, b) for a in range(150) for b in range(a) if substring.jaccard(sets[a], sets[b]) >= 0.8])
    assert roots(150, substring.similar(sets, list(range(150)), 0.8)) == want


def test_bands_reach_their_recall():
    bands, rows = substring.tune_bands(0.8, 0.999, 4)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_long_texts_are_cut_between_lines():
    import pyarrow as pa

    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(400))
    whole = substring.Lines(*next(substring.line_blocks(pa.array([text]))), 20)
    parts = [substring.Lines(*b, 20) for b in substring.line_blocks(pa.array(["a b", text]), size=5000)]
    assert [k for p in parts for k in p.keys()] == whole.keys()
    assert np.concatenate([p.pos for p in parts]).tolist() == whole.pos.tolist() == list(range(400))
    assert (np.concatenate([p.bands() for p in parts]) == whole.bands()).all()


def test_paragraphs_are_made_once(spark, monkeypatch):
    calls, made = [], substring.paragraphs
    monkeypatch.setattr(substring, "paragraphs", lambda *a, **k: (calls.append(1), made(*a, **k))[1])
    line = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"{line}\nother"), (2, f"x\n{line}"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.pos, r.stays) for r in substring.passages(df).collect()) == [(1, 0, True), (2, 1, False)]
    assert len(calls) == 1
    texts = ["a  b\tc " * 30 + "\n" + "x y " * 20, "w" * 3 + " q" * 40, "Q" + " q" * 40, "A b\x0bc\x0cd\r" * 25, " ".join(f"é{i % 7}" for i in range(60)), " " * 9 + "z " * 25 + "\n\n" + "z " * 25]
    lines = substring.Lines(*next(substring.line_blocks(pa.array(texts))), 20)
    assert len(lines.span) == 8
    assert lines.keys() == [substring.words_digest(lines.low[a:b]) for a, b in lines.span.tolist()]
    assert lines.distinct() == [len(lines.shingles(i)) for i in range(8)]


def test_passages_inside_longer_lines(spark):
    rng = random.Random(29)
    p, q = _lines(rng, 53), _lines(rng, 50)
    a, b, c = _lines(rng, 40), _lines(rng, 37), _lines(rng, 45)
    wrapped = "\n".join(" ".join(p.split()[k : k + 9]) for k in range(0, 53, 9))
    rows = [(1, f"é {a} {p} {b}"), (2, f"top\n{c} É {p.upper()} {a[:90]}\nend"), (3, f"head\n{wrapped}\ntail"), (4, f"{b[:70]} {q}"), (5, f"{q} {c[:80]}"), (6, "x " * 400), (None, p), (7, None)]
    got = {r.doc_id: r for r in substring.substring_dedup(strange(docs(spark, rows))).collect()}
    want = dict(rows) | {2: f"top\n{c} É {a[:90]}\nend", 3: "head\n\ntail", 6: "x " * 51}
    assert {i: r.text for i, r in got.items()} == want
    assert {i: r.n_cut for i, r in got.items() if r.n_cut} == {2: 53, 3: 53, 6: 349} and got[2].home_docs == [1]
    assert {i: r.n_repeated for i, r in got.items() if r.n_repeated} == {1: 1, 2: 1, 3: 1, 6: 1}
    kept = substring.drop_passages(strange(docs(spark, rows))).collect()
    assert {r.doc_id: r.text for r in kept} == want and all(r.n_chars == len(r.text or "") for r in kept)


def test_passages_by_shuffles_come_out_as_by_broadcasts(spark):
    rng = random.Random(47)
    p, q = _lines(rng, 60), _lines(rng, 55)
    texts = [f"{_lines(rng, 30)} {x} {_lines(rng, 20)}" for x in (p, q, p, "", q, p, f"{p} {q}", "")]
    df = docs(spark, [*enumerate(texts), (8, p), (9, None), (None, p)])
    rows, _ = stored(substring.tagged(df), "texts")
    by = {}
    for most in (0, 1_000):
        by[most] = [{(r.doc_id, *map(str, r)) for r in x.collect()} for x in (substring.embedded(rows, most, most), substring.removals(df, broadcast_rows=most))]
    assert by[0] == by[1_000] and {r[0] for r in by[0][0]} == {0, 1, 2, 4, 5, 6, 8}


def test_anchors_are_the_same_in_pieces_and_in_any_surroundings():
    import pyarrow as pa

    rng = random.Random(31)
    p = _lines(rng, 51)
    long = _lines(rng, 400_000)
    texts = [f"{_lines(rng, 30)} {p} {_lines(rng, 9)}", p, f"{long[:1_060_000]} {p} {long[1_060_000:]}"]
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array(texts)], ["doc_id", "tag", "text"])
    got = {}
    for x in substring._anchored(iter([b])):
        for i, _, pos, h in zip(*(c.to_pylist() for c in x.columns), strict=True):
            got.setdefault(i, {})[pos] = h
    inside = set(got[2].values())
    assert inside and all(inside & set(got[i].values()) for i in (1, 3))
    words = np.array([hash(w) & (1 << 63) - 1 for w in texts[2].split()], np.uint64)
    assert max(np.diff(sorted(got[3]))) <= substring.NEAR and len(got[3]) < len(words) / 8


def test_simhash_of_a_text_of_more_shingles_than_a_block():
    import pyarrow as pa

    rng = random.Random(37)
    texts = ["a b", " ".join(rng.choice("abcdefgh") for _ in range(100_000)), " ".join(rng.choice("xyz") for _ in range(65_538)) + " q", "c d"]
    b = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])
    got = pa.Table.from_batches(simhash._fingerprints(iter([b])))["fp"].to_numpy().view(np.uint64).tolist()
    assert got == [_fingerprint(t) for t in texts]


def test_neighbours_meet_over_the_edges_of_ranges(spark):
    rows = [(0, 0, 2, i, i, bytearray(np.array([1, i * 1e-6], "<f8").tobytes())) for i in range(60)]
    dealt = spark.createDataFrame(rows, embeddings.DEALT).repartition(3)
    got = {r.node: r.root for r in components(embeddings.window_links(dealt, "<f8", 1, 0.93)).collect()}
    assert got == dict.fromkeys(range(1, 60), 0)


def test_lone_pairs_are_found_in_a_label_of_100_000(spark):
    import pyarrow as pa

    rng = np.random.default_rng(41)
    n, pairs, dim = 100_000, 600, 32
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((pairs, dim))
    off -= np.einsum("ij,ij->i", off, x[:pairs])[:, None] * x[:pairs]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.931, 0.935, pairs)[:, None]
    x[n - pairs :] = cos * x[:pairs] + np.sqrt(1 - cos**2) * off
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float32)), dim).cast(pa.list_(pa.float32())), "label": pa.array(np.zeros(n, np.int32))})
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.createDataFrame(table)).where("vec_id <> component_id").collect()}
    found = sum(got.get(n - pairs + i) == i for i in range(pairs))
    print(f"recall {found / pairs:.4f} of {pairs} pairs")
    assert found >= 0.995 * pairs


def test_rows_of_one_id_and_other_texts_lose_only_their_own(spark):
    rng = random.Random(43)
    a, b, c = (_lines(rng, 30) for _ in range(3))
    rows = [(1, a), (5, f"{a}\n{b}"), (5, f"{c}\nkept"), (5, f"{c}\nkept")]
    got = Counter((r.doc_id, r.text) for r in substring.substring_dedup(docs(spark, rows)).collect())
    assert got == {(1, a): 1, (5, b): 1, (5, f"{c}\nkept"): 2}
    assert Counter((r.doc_id, r.text) for r in substring.drop_passages(docs(spark, rows)).collect()) == got


def test_pivot_cells_lose_no_pair(spark):
    rng = np.random.default_rng(67)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    df = spark.createDataFrame([(int(x.view(np.int64)), int(y.view(np.int64))) for x, y in zip(a, b, strict=True)], "x long, y long")
    for p in (0, 7, 20):
        one, two = (F.array_compact(F.array(*simhash.pivot_cells(F.col(c), p))) for c in "xy")
        assert df.where(~F.arrays_overlap(one, two)).count() == 0


def test_labels_of_other_types(spark):
    rows = [(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.7), (3, [1.0, 0.0], 1.7), (4, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label double")
    for d in (df, df.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))):
        assert {r.vec_id: r.component_id for r in embeddings.near_duplicates(d).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def crowded(rng, n, pairs, c, dim=64):
    """n unit vectors whose mean cosine is c, of which the last `pairs` have a cosine of about 0.935 with the first ones."""
    base = rng.standard_normal(dim)
    base /= np.linalg.norm(base)
    z = rng.standard_normal((n, dim)).astype(np.float32)
    z -= np.outer(z @ base, base)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    off = rng.standard_normal((pairs, dim))
    off -= np.outer(off @ base, base)
    off -= np.einsum("ij,ij->i", off, z[:pairs])[:, None] * z[:pairs]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    inner = (0.935 - c) / (1 - c)
    z[n - pairs :] = inner * z[:pairs] + np.sqrt(1 - inner**2) * off
    return (np.sqrt(c) * base + np.sqrt(1 - c) * z).astype(np.float32)


def lone_recall(spark, x, pairs):
    import pyarrow as pa

    n, dim = x.shape
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32())), "label": pa.array(np.zeros(n, np.int32))})
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.createDataFrame(table)).where("vec_id <> component_id").collect()}
    return sum(got.get(n - pairs + i) == i for i in range(pairs)) / pairs


@pytest.mark.parametrize(("c", "most"), [(0.5, 160), (0.7, 160), (0.85, 160), (0.85, 10**6)])
def test_lone_pairs_are_found_in_crowded_labels(spark, monkeypatch, c, most):
    """By passes where these are affordable (0.85: 200 and more, for the last case), else whole."""
    monkeypatch.setattr(embeddings.planned, "__defaults__", (most,))
    x = crowded(np.random.default_rng(43), 4000, 150, c)
    assert lone_recall(spark, x, 150) >= 0.98


def test_whole_labels_in_blocks(spark):
    """Every link, over several blocks, of lone pairs, chains and a large group; labels and lengths apart."""
    rng = np.random.default_rng(44)
    x = rng.standard_normal((300, 6))
    x[200:260] = x[0] + 0.01 * rng.standard_normal((60, 6))
    x[260:] = x[1:41] + 0.05 * rng.standard_normal((40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, i % 2, bytearray(v.tobytes())) for i, v in enumerate(x)] + [(300, 0, bytearray(x[0, :5].tobytes()))]
    df = spark.createDataFrame(rows, "id long, label long, v binary")
    links = [(i, j) for i in range(300) for j in range(i) if i % 2 == j % 2 and x[i] @ x[j] >= 0.93]
    got = {r.node: r.root for r in components(embeddings.whole_links(df, "<f8", 0.93, block=32)).collect()}
    assert got == {i: r for i, r in enumerate(roots(300, links)) if i != r}


def test_a_long_line_is_read_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(71)
    words = np.array([f"w{i}" for i in range(40_000)])
    line = " ".join(words[rng.integers(0, 40_000, 700_000)].tolist())
    blocks = [substring.Lines(*b, 20) for b in substring.line_blocks(pa.array([line]))]
    raw = np.frombuffer(line.encode(), np.uint8)
    with monkeypatch.context() as m:
        m.setattr(substring, "PIECE", 1 << 40)
        whole = substring.Lines(np.array([0]), np.array([0]), raw, np.array([0, len(raw)]), 20)
        assert len(blocks) == 1 and whole.keys() == blocks[0].keys() and whole.distinct() == blocks[0].distinct()
        assert (blocks[0].long_bands() == whole.bands()).all()
    found, all_ = [3, 40, 120_000, 120_030, 699_999], line.encode().split()
    got = {first + w: part[w : w + substring.PASSAGE] for first, part, windows in substring.stretches(raw, found) for w in windows}
    assert got == {w: all_[w : w + substring.PASSAGE] for p in found for w in range(max(0, p - substring.NEAR + 1), min(p, len(all_) - substring.PASSAGE) + 1)}

    passage = " ".join(line.split()[400_000:400_060])
    rows = [(1, line), (2, line.upper()), (3, f"before it {passage} and after"), (4, "x" * (5 << 20) + " y"), (5, None)]
    out = {r.doc_id: r for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == line and out[2].text == "" and out[4].text == rows[3][1] and out[5].text is None
    assert out[3].text.split() == "before it and after".split() and out[3].home_docs == [1] and out[3].n_cut == 60
