import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, sf, tmp_path):
    from tessella.llm import simhash, substring, toxicity
    from tessella.session import table

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    bad = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id not in bad}
    last = {}
    for i, r in sorted(rows.items()):
        last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)] = i
    rows = {i: rows[i] for i in last.values()}
    fps = {i: simhash.fingerprint(r.text.encode()) for i, r in rows.items()}
    group = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for i in rows:
            for j in rows:
                if group[j] < group[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    group[i], changed = group[j], True
    rows = {i: r for i, r in rows.items() if group[i] == i}

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    at = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != names[-1]:
            assert out.columns == docs.columns
        out.write.parquet(path := f"{tmp_path}/{name}")
        at = spark.read.parquet(path)
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in at.select("doc_id").collect()} == set(rows)
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in at.collect()}
    assert set(texts) == set(rows)
    seen = set()
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            words = tuple(line.lower().split())
            if len(words) >= substring.MIN_WORDS:
                assert words not in seen
                seen.add(words)
    held = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        for k in range(len(words) - substring.PASSAGE + 1):
            assert held.setdefault(tuple(words[k : k + substring.PASSAGE]), i) == i  # no passage of so many words is left in two documents
    packed = at.groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(t.split()) + 1 for i, t in texts.items()}
    total = at.groupBy("bin_id").sum("length").collect()
    assert max(r[1] for r in total) <= 2048


def test_run_reads_what_it_wrote(spark, sf):
    assert pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "source", "cluster", "bin_id", "bin_offset"]


def test_runs_delete_their_own_tables_only(spark, sf, tmp_path, monkeypatch):
    """Results that wait to be read, of this thread and of another one, survive a run; the run's own tables are gone."""
    import os
    from threading import Thread

    from helpers import docs
    from tessella import session
    from tessella.llm import exact_dedup, packing, simhash, substring, toxicity
    from tessella.session import table

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    d = docs(spark, [(i, f"text number {i % 5} " * 30) for i in range(20)])
    made = [exact_dedup.exact_dedup, simhash.simhash_groups, substring.substring_dedup, packing.pack]
    lazy = [(f(d), n) for f, n in zip(made, (20, 20, 20, 20), strict=True)] + [(toxicity.score(d, table(spark, sf, "labels")), 20)]
    other = []
    thread = Thread(target=lambda: other.append(exact_dedup.exact_dedup(d)))
    before = set(os.listdir(tmp_path))
    thread.start()
    pipeline.run(spark, sf)
    thread.join()
    kept = {x for x in os.listdir(tmp_path) if "pipeline" in x}
    assert len(kept) == 1  # the last stage's result
    assert all(df.count() >= n for df, n in lazy) and other[0].count() == 20
    left = len(set(os.listdir(tmp_path)) - before - kept)
    exact_dedup.exact_dedup(d)
    assert len(set(os.listdir(tmp_path)) - before - kept) == 2 * left  # nothing of the run but what the thread's operator wrote


def test_stages_on_strange_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns and no rows at all."""
    from helpers import docs, strange

    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, None), (None, "lost and found"), (1, None), (2, ""), (3, "Some text here"), (3, "Some text here"), (4, "some TEXT here"), (5, long), (6, long + " end"), (7, "one\ntwo", None)]
    spark.createDataFrame([(3, 1, None), (None, 0, 1), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n, df in enumerate((strange(docs(spark, rows)), docs(spark, []))):
        at = df
        for name, stage in pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "best_fit_packing":
                assert out.columns == df.columns
            out.write.parquet(path := f"{tmp_path}/{n}-{name}")
            at = spark.read.parquet(path)
            if name == "exact_dedup" and not n:
                assert sorted(((r.doc_id, r.text) for r in at.collect()), key=repr) == sorted([(None, "lost and found"), (2, ""), (4, "some TEXT here"), (5, long), (6, long + " end"), (7, "one\ntwo")], key=repr)
            if name == "simhash_near_dedup" and not n:
                assert {r.doc_id for r in at.collect()} == {None, 2, 4, 5, 7}
        assert (at.count() > 0) == (not n)
