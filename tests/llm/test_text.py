import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, strange
from tessella.llm.common import new_path
from tessella.llm import html, merge_dropout, mixcoder, packing, token_files, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_word_features_are_those_of_the_words():
    def plain(text):
        words, out = [], set()
        for c in text.encode().lower():
            if chr(c).isascii() and chr(c).isalnum() or c > 127:
                words[-1:] = [words[-1] + bytes([c])] if words else [bytes([c])]
            elif not words or words[-1]:
                words.append(b"")
        words = [w for w in words if w]
        for k, w in enumerate(words):
            out |= {(1, w), (4, w[:4]), (5, w[:5])} | {(g, w, words[k + g]) for g in (1, 2) if k + g < len(words)}
        return out

    texts = ["", "One two, three one", "É-clair 42 x", "one two", "a"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    text, idx = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), at)
    assert [len(set(idx[text == i])) for i in range(5)] == [len(plain(t)) for t in texts]


def test_pieces_of_a_long_text_hold_all_features():
    raw = " ".join(f"w{i % 777}" for i in range(20_000)).encode()
    one = lambda b: set(toxicity.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[1])
    assert set().union(*(one(p) for p in toxicity.pieces(raw, 5000))) == one(raw)


def _toxic(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(200)]
    rows, labels = [(-1, None), (-2, ""), (None, "scumbag w1")], []
    for i in range(900):
        t = rng.choices(words, k=30)
        if bad := i % 5 == 0:
            t[rng.randrange(30)] = rng.choice(["scumbag", "scumbags", "moronic"])
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (5, None, None), (10, 1, 0)]
    return strange(docs(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_rows_that_were_held_out(spark):
    df, labels = _toxic(spark)
    out = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert len(out) == df.count()
    held = [i for i in range(900) if out[i].held_out]
    assert held == [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i].predicted == (i % 5 == 0) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values()) and not out[None].held_out
    kept = {r.doc_id for r in toxicity.drop_toxic(df, labels).collect()}
    assert kept == {i for i, r in out.items() if not r.predicted}
    assert {r.score for r in toxicity.score(df, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score(df.limit(0), labels).count() == 0


NASTY = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_archives(spark):
    big = "é" * 700 + NASTY * 30
    rows = [(1, "u1", big), (2, "u 2\r\nX: y", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (7, "", ""), (None, "n", big), (8, "u8", NASTY), (8, "u8", NASTY)]
    pages = strange(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)
    got = Counter(map(tuple, warc.archive(spark, pages).collect()))
    import hashlib

    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i in (1, 2)
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert got == want
    assert warc.archive(spark, pages.limit(0)).count() == 0
    long = spark.createDataFrame([(i, "u" * 200_000 if i % 2 else "http://h/" + NASTY * 900, "p" * 1_100_000 if i == 4 else f"text {i} {NASTY}" * 40) for i in range(12)], "page_id long, url string, html string").repartition(2)
    warc.write(long, path := new_path(spark, "long"), file_bytes=1_000_000)
    back = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert all(back[r.page_id].payload.decode() == r.html and back[r.page_id].url == r.url.replace("\r\n", "").replace(" ", "") for r in long.collect()) and len(back) == 12
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(files) > 2 and max(r.length for r in files) < 2_500_000
    warc.write(pages, path := new_path(spark, "test"))
    whole = Counter(map(tuple, warc.read(spark, path).collect()))
    assert len(whole) == 9 and {r[2]: r[6] for r in whole if r[6]}[len(NASTY)].decode() == NASTY
    for options in ({"broadcast_records": 3}, {"broadcast_records": 3, "most_groups": 1}):
        assert Counter(map(tuple, warc.read(spark, path, **options).collect())) == whole


def test_chains_reject_magic_inside_payloads(spark, tmp_path):
    rng = random.Random(2)
    raw, starts = b"", []
    for _ in range(300):
        body = b"x" * rng.randrange(50) + NASTY.encode() * rng.randrange(4)
        starts.append(len(raw))
        raw += b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    found = []
    at = raw.find(b"WARC/1.")
    while at >= 0:
        head, body = warc.candidate(raw, at)
        found.append((at, at + head + body + 4))
        at = raw.find(b"WARC/1.", at + 1)
    keep, whole = warc.chain(np.array([a for a, _ in found]), np.array([n for _, n in found]), len(raw))
    assert whole and [a for (a, _), k in zip(found, keep, strict=True) if k] == starts and len(found) > 300
    assert not warc.chain(np.array([0]), np.array([10]), 20)[1]


def test_dropout_free_ids_are_the_librarys_and_all_decode():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, some = merge_dropout.MergeDropout(path, 0.0), merge_dropout.MergeDropout(path, 0.3)
    texts = ["", "a", "The internationalization of things", "  two  spaces ", "line\n\nbreaks \n", "\ttab", "日本 𝔘 é", "<s> </s> <unk>", "x" * 500]
    for t in texts:
        ids = np.frombuffer(plain.encode(t, 1), "<u4")
        assert ids.tolist() == lib.encode(t)
        for d in range(8):
            assert some.decode(np.frombuffer(some.encode(t, d), "<u4")) == t.encode()
    assert some.decode(np.frombuffer(some.encode("▁ a▁b", 1), "<u4")).decode() == "▁ a▁b"
    assert len({some.encode("internationalization of everything", d) for d in range(20)}) > 1
    assert some.encode("Again and again", 5) == merge_dropout.MergeDropout(path, 0.3).encode("Again and again", 5)


def test_dropout_frames(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x▁y\n")]
    df = strange(docs(spark, rows))
    back = merge_dropout.decode(merge_dropout.encode(df, path), path).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)
    out = merge_dropout.digests(df, path).collect()
    assert all(r.lossless for r in out) and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert merge_dropout.digests(df.limit(0), path).count() == 0


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li>More</ul></nav><div class='ad-box ad'>Buy</div><script>var x='</p>';</script>{}<div id=comments><p>first!</p></div><form><p>mail</p></form><aside>side</aside><footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>T &amp; U</h1><p><b>one\n  two<br><p>three&nbsp;four</p></article>", "T & U\none two\nthree four"),
        ("<main><div class='cookie-notice'>ok</div><p>a<p>b <i>c</i>d</main>", "a\nb cd"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
        ("<article></article>", ""),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<div class=post><h2>Head</h2><p>plain</p></div>", "Head\nplain"),
    ],
)
def test_main_text(spark, body, text):
    pages = spark.createDataFrame([(1, "http://h.org/a", PAGE.replace("{}", body) if "cut off" not in body else "<body><nav>n</nav>" + body)], "page_id long, url string, html string")
    row = html.extract(strange(pages)).first()
    assert (row.text, row.n_chars) == (text, len(text))


def test_main_text_without_regions(spark):
    long = lambda i: f"Sentence number {i} of an article that goes on for quite a while, as they do."
    page = lambda i: f"<body><div class=x><p>All rights of this great and famous site are reserved for ever.</p></div><div class=y><h2>Title {i}</h2><p>{long(i)}</p><p>{long(i + 100)}</p></div><div class=z><a href=/>One of the many links that are here for you</a></div></body>"
    pages = spark.createDataFrame([(i, "http://Plain.org/x", page(i)) for i in range(6)] + [(9, None, None), (10, "?", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages, broadcast_hosts=0).collect()}
    assert got == {i: f"Title {i}\n{long(i)}\n{long(i + 100)}" for i in range(6)} | {9: "", 10: ""}
    assert html.extract(pages.limit(0)).count() == 0


def test_wrappers_generalise():
    a = html.expression(html.Page("<ul><li>x</ul><p>one</p>").tree)
    b = html.expression(html.Page("<ul><li>x<li>y</ul><h2>new</h2><p>one</p><p>two</p>").tree)
    assert html.merged(a, b) == [["1", ["ul", [["+", ["li", [["1", "#"]]]]]]], ["?", ["h2", [["1", "#"]]]], ["+", ["p", [["1", "#"]]]]]
    assert html.merged(b, a) == html.merged(a, b)


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65536, 300), np.full(500, 7), np.zeros(0, int), np.tile([1, 2, 3, 50000], 100), np.minimum(rng.geometric(0.01, 400), 65535), np.array([65535])]
    codes = mixcoder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, mixcoder.decode(codes, [len(b) for b in blocks]), strict=True))
    assert len(codes[1]) < 100 and len(codes[3]) < 200
    assert codes == [mixcoder.encode([b])[0] for b in blocks]  # blocks don't know of each other


def test_the_coder_learns_many_ids_at_a_time(monkeypatch):
    calls, learn = [], mixcoder.Model.learn
    monkeypatch.setattr(mixcoder.Model, "learn", lambda self, *a: (calls.append(1), learn(self, *a))[1])
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 31, 32, 33, 63, 65, 127, 129, 500, 1023, 1025, 3071, 3073, 4095, 4096, 4097, 6145, 8200, 0, 4096]
    blocks = [np.minimum(rng.zipf(1.2, n), 65535) if n % 2 else rng.integers(0, 1 + n, n) for n in sizes] + [np.zeros(5000, int), np.full(4096, 65535)]
    codes = mixcoder.encode(blocks)
    assert 0 < len(calls) <= max(sizes) / mixcoder.GROUP + 8
    assert all((a == b).all() for a, b in zip(blocks, mixcoder.decode(codes, [len(b) for b in blocks]), strict=True))
    assert all(codes[k] == mixcoder.encode([blocks[k]])[0] for k in (3, 12, 16, 19, 20))
    assert len(codes[-1]) < 400 and len(codes[-2]) < 400


def test_a_block_is_coded_in_several_lanes_of_one_model(monkeypatch):
    steps, take = [], mixcoder._Reader.take
    monkeypatch.setattr(mixcoder._Reader, "take", lambda self, *a: (steps.append(1), take(self, *a))[1])
    rng = np.random.default_rng(5)
    blocks = [np.minimum(rng.zipf(1.3, n), 65535) for n in (4096, 4095, 9, 8, 7, 1, 0, 4096)] + [np.tile(rng.integers(0, 65536, 300), 13)]
    codes = mixcoder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, mixcoder.decode(codes, [len(b) for b in blocks]), strict=True))
    assert 0 < len(steps) <= 4096 / 4  # a step of all lanes was one id of each block
    assert codes == [mixcoder.encode([b])[0] for b in blocks]
    assert len(codes[-1]) < 2200  # what one lane has seen, the others know


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(5, "Hello  world \n x"), (1, None), (2, ""), (3, "a b\nc d <|endoftext|> don't"), (4, "x<|endoftext|>y <|endoftext|>\n<|endoftext|>"), (3, "a b"), (None, "null id"), (9, "word " * 5000), (7, "  x \t y\n"), (8, "日本 é ")]
    got = [tuple(r) for r in token_files.token_files(strange(docs(spark, rows)), path).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_files(docs(spark, []), path).count() == 0


def test_damaged_blocks_are_found():
    w = token_files.BlockWriter(block=10)
    for d in (1, None, 3):
        w.add(d, np.arange(25, dtype=np.uint32))
    raw = b"".join(b + token_files.SYNC.encode() for b in w.ready(last=True))
    assert [(d, i.tolist()) for d, i in token_files.documents(raw)] == [(d, list(range(25))) for d in (1, None, 3)]
    for at in (0, 30, len(raw) // 2, len(raw) - 1):
        with pytest.raises(ValueError):
            list(token_files.documents(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]))


def test_packing_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w%d" % (i if i % 7 else 0)] * (30 if i % 7 == 0 else rng.randrange(0, 120))), f"s{min(3, rng.randrange(9))}" if i % 11 else None) for i in range(400)]
    rows += [(None, "lost"), (500, None), (501, "long " * 1000), (501, "long " * 1000)]
    out = [r.asDict() for r in packing.pack(strange(docs(spark, rows)), capacity=100, per_source=2, shard_rows=150).collect()]
    bins, words = {}, Counter()
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
        words[r["doc_id"]] += r["length"]
    assert words == Counter({i: 0 for i in ()}) + sum((Counter({i: len((t or "").split()) + 1}) for i, t, *_ in rows), Counter())
    for inside in bins.values():
        inside.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in inside] == [sum(x["length"] for x in inside[:k]) for k in range(len(inside))]
        assert sum(r["length"] for r in inside) <= 100
        assert max(Counter(r["source"] for r in inside).values()) <= 2 and max(Counter(r["cluster"] for r in inside).values()) == 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_tightest_compatible_bin():
    rng = random.Random(6)
    bins, plain = packing.Bins(50, 1), []
    for _ in range(500):
        n, s, c = rng.randrange(1, 50), 1 << rng.randrange(6), rng.choice([0, 1, 2, 4, 8])
        fit = [(left, b) for b, (left, ss, cs) in enumerate(plain) if left >= n and not ss & s and not cs & c]
        b, offset = bins.put(n, s, c)
        if fit:
            assert b == min(fit)[1]
        else:
            assert b == len(plain)
            plain.append([50, 0, 0])
        assert offset == 50 - plain[b][0]
        plain[b] = [plain[b][0] - n, plain[b][1] | s, plain[b][2] | c]


def test_short_and_long_texts_measure_alike(spark):
    rows = [(1, " a  b\tc \n"), (2, "x" * 200_000 + " y"), (3, "")]
    out = {r.doc_id: r.length for r in packing.pack(docs(spark, rows)).collect()}
    assert out == {1: 4, 2: 3, 3: 1} and math.isfinite(sum(out.values()))
    by_column = packing.pack(docs(spark, rows).selectExpr("*", "doc_id as mine"), cluster="mine")
    assert {r.doc_id: r.length for r in by_column.collect()} == out
    assert pa.__version__


def test_main_text_on_hosts_of_two_templates(spark):
    long = lambda i: f"Sentence number {i} of an article that goes on for quite a while, as they do."
    article = lambda i: f"<body><article><p>{long(i)}</p></article><p>{long(i + 50)}</p></body>"
    content = lambda i: f"<body><div class=content><p>{long(i)}</p></div></body>"
    plain = lambda i: f"<body><div class=y><p>{long(i)}</p><ul><li>item {i}</li><li>item {i + 1}</li></ul><h2>Head</h2><table><tr><td>{i}</td></tr></table></div><div class=z><a href=/>more</a></div></body>"
    rows, want = [], {}
    for k, url in enumerate(["http://two.org/x", None, "odd"]):
        for i in range(4):
            for j, (page, text) in enumerate([(article, long(i)), (content, long(i)), (plain, f"{long(i)}\nitem {i}\nitem {i + 1}\nHead\n{i}")]):
                rows.append((100 * k + 10 * i + j, url, page(i)))
                want[100 * k + 10 * i + j] = text
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for hosts in (0, 20_000):
        assert {r.page_id: r.text for r in html.extract(pages, broadcast_hosts=hosts).collect()} == want


def test_fixed_slots_of_a_region_go_by_the_wrapper(spark):
    page = lambda i, note="Tell your friends about this": f"<body><article><h1>T{i}</h1><div class=x9><p>{note}</p></div><p>prose {i}</p><h4>Same</h4>{'<blockquote>rare</blockquote>' if i % 3 == 0 else ''}</article></body>"
    rows = [(i, "http://many.org/x", page(i)) for i in range(12)] + [(20 + i, "http://few.org/x", page(i)) for i in range(2)] + [(30 + i, "http://copies.org/x", page(1)) for i in range(5)]
    rows += [(40 + i, "http://vary.org/x", page(i, f"note {i}")) for i in range(1, 6)]
    # a standing heading beside what varies is text (as "Ingredients" would be); the note in a box of its own isn't
    text = lambda i, *notes: "\n".join([f"T{i}", *notes, f"prose {i}", "Same", *(["rare"] if i % 3 == 0 else [])])
    want = {i: text(i) for i in range(12)} | {20 + i: text(i, "Tell your friends about this") for i in range(2)}
    want |= {30 + i: text(1, "Tell your friends about this") for i in range(5)} | {40 + i: text(i, f"note {i}") for i in range(1, 6)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_the_wrapper_shows_a_region_that_no_name_does(spark):
    """Pages like the given ones, without a word that the lists know: the plain set of their paths can't tell adverts and closing lines from text."""
    rng = random.Random(67)
    line = lambda n: " ".join(rng.choice(["slate", "river", "copper", "garden", "winter", "lantern"]) + str(rng.randrange(1000)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        parts = [line(6), *(line(rng.randrange(2, 60)) for _ in range(rng.randrange(1, 6)))] if i else [line(6), *(line(50) for _ in range(3))]
        lead, advert, closing = line(60), line(7), f"&copy; plain.org &middot; {line(6)}"
        text = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        rows.append((i, "http://plain.org/x", f"<body><div class=q0>{lead}</div><div class=q1>{advert}</div><div class=q2>{text}</div><div class=q3>{closing}</div></body>"))
        want[i] = "\n".join([lead, *parts])
    rows.append((99, "http://plain.org/x", "<body><div class=q1>A page that has nothing but this lone box of some length.</div></body>"))
    want[99] = "A page that has nothing but this lone box of some length."
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
    trees = [html.Page(r[2]) for r in rows]
    wrapper = html.expression(trees[0].tree)
    for t in trees[1:]:
        wrapper = html.merged(wrapper, html.expression(t.tree))
    stats: dict = {}
    for t in trees:
        for path, text, _ in t.blocks:
            n, chars, *_ = stats.get(path, (0, 0))
            stats[path] = (n + 1, chars + len(text), 0.0, False, 3)
    assert html.text_slots(wrapper, stats)[0]  # lone boxes rank below the region
    nested: list = []  # the same paths, without what the alignment found to repeat
    for p in stats:
        level = nested
        for label in p.split("/")[1:]:
            item = next((x for x in level if x[1] != "#" and x[1][0] == label), None)
            if item is None:
                level.append(item := ["1", [label, []]])
            level = item[1][1]
        level.append(["1", "#"])
    assert not html.text_slots(nested, stats)[0]


def _plain_dropout(coder, text, doc):
    """The ids by a loop that looks for the best candidate again and again."""
    import re

    out = []
    for number, stretch in enumerate(re.findall(" +[^ \n]*|\n|[^ \n]+", " " + text) if text else []):
        key = merge_dropout.drawn(merge_dropout.xxh64_intdigest(f"{coder.seed}:{doc}"), number)
        parts = [(k, "▁" if c == " " else c) for k, c in enumerate(stretch)]
        while True:
            best = None
            for (i, x), (j, y) in zip(parts, parts[1:], strict=False):
                if stretch[i : j + len(y)].count("▁") or (s := coder.score.get(x + y)) is None:
                    continue
                place = sum(a * b for a, b in zip((i, j, len(x + y)), merge_dropout.PLACE, strict=True)) & merge_dropout.WORD
                if merge_dropout.drawn(key, place) >= coder.limit and (best is None or s > best[0]):
                    best = (s, i, j)
            if best is None:
                break
            k = next(k for k, (i, _) in enumerate(parts) if i == best[1])
            parts[k : k + 2] = [(parts[k][0], parts[k][1] + parts[k + 1][1])]
        for i, x in parts:
            out += [coder.ids[x]] if x in coder.ids and stretch[i] != "▁" else [coder.byte[b] for b in (stretch[i] if stretch[i] == "▁" else x).encode()]
    return out


def test_dropout_against_a_plain_loop():
    rng = random.Random(47)
    texts = ["", " ", "\n", "a▁b ▁ c", "internationalization of everything", "two  spaces\n\n and   \n lines", "日本語 𝔘 é ü naïve", "x" * 45 + "information " + "y" * 130 + "ation", "<s> </s> <unk> ▁"]
    texts += ["".join(rng.choice("etaoin shrdlu\n ▁éß") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    for dropout in (0.0, 0.1, 0.5, 1.0):
        coder = merge_dropout.MergeDropout(public_tokenizers.path("piece_bpe_32k.model"), dropout)
        ids = [None, *range(len(texts) - 1)]
        got = coder.encode_many(texts, ids)
        assert got == coder.encode_many(texts, ids, part=64) == [coder.encode(t, d) for t, d in zip(texts, ids, strict=True)]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [_plain_dropout(coder, t, d) for t, d in zip(texts, ids, strict=True)]
        assert [coder.decode(np.frombuffer(x, "<u4")) for x in got] == [t.encode() for t in texts]


def test_each_occurrence_has_draws_of_its_own():
    coder = merge_dropout.MergeDropout(public_tokenizers.path("piece_bpe_32k.model"), 0.1)
    once = len(coder.encode("internationalization", 1))
    assert len({coder.encode("internationalization of everything", d) for d in range(200)}) > 8
    assert len(coder.encode(" ".join(["internationalization"] * 300), 1)) != 300 * once
    long = " ".join(f"word{i}" for i in range(300_000))
    assert coder.decode(np.frombuffer(coder.encode(long, 3), "<u4")) == long.encode()


def test_ids_beyond_16_bits_are_refused():
    for bad in ([65_536], [-1, 5]):
        with pytest.raises(ValueError):
            mixcoder.encode([np.array([1, 2]), np.array(bad)])


def _language(expr):
    """A regular expression over a stream's names, each in brackets."""
    import re

    out = ""
    for times, item in expr:
        if isinstance(item, str):
            one = re.escape("<#>")
        elif item[0][0] == html.OPEN:
            one = _language(item[1])
        else:
            one = re.escape(f"<{item[0]}>") + _language(item[1]) + re.escape("</>")
        out += f"(?:{one}){'' if times == '1' else times}"
    return out


def _stream(node):
    return "".join("<#>" if isinstance(c, str) else f"<{c[0]}>{_stream(c)}</>" for c in node[1])


def test_a_wrapper_matches_every_page_that_it_comes_from():
    import re

    rng = random.Random(53)
    for _ in range(60):
        blocks = ["h2", "p", "ul", "div class=a", "div class=b", "blockquote"]
        unit = rng.sample(blocks, rng.randrange(2, 4))
        pages = []
        for _ in range(5):
            body = [b for b in rng.sample(blocks, 3) if rng.random() < 0.6] + unit * rng.randrange(1, 5) + rng.choices(blocks, k=rng.randrange(3))
            pages.append("<body>" + "".join(f"<{b}>{'<li>x</li>' * rng.randrange(1, 3) if b == 'ul' else 'text'}</{b.split()[0]}>" for b in body) + "</body>")
        trees = [html.Page(p).tree for p in pages]
        wrapper = html.expression(trees[0])
        for t in trees[1:]:
            wrapper = html.merged(wrapper, html.expression(t))
        assert all(re.fullmatch(_language(wrapper), _stream(t)) for t in trees)


def test_sequences_that_repeat():
    a = html.expression(html.Page("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p><h2>f</h2><p>g</p>").tree)
    label = html.OPEN + html.NEXT.join(["h2", "p"])
    assert a == [["+", [label, [["1", ["h2", [["1", "#"]]]], ["+", ["p", [["1", "#"]]]]]]]]
    b = html.expression(html.Page("<ul><li>n</ul><h2>a</h2><p>b</p>").tree)
    for x, y in ((a, b), (b, a)):
        assert [(t, html.name_of(i)) for t, i in html.merged(x, y)] == [("?", "ul"), ("+", label)]


def test_alignment_is_the_longest_or_fits():
    rng = random.Random(59)
    for n in (5, 40, 400):
        a, b = ([f"n{rng.randrange(n // 2 + 2)}" for _ in range(n)] for _ in range(2))
        got = html.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        if n * n <= html.EXACT:
            assert len(got) >= len(html.longest(a, b, 0, 0))


def test_deep_and_wide_pages(spark):
    deep = "<article>" + "<div>" * 5000 + "<p>bottom</p>" + "</div>" * 5000 + "<p>after</p></article>"
    wide = "<article>" + "".join(f"<div class=c{i % 977}>t{i}</div>" for i in range(50_000)) + "</article>"
    other = "<article>" + "".join(f"<div class=c{i * 7 % 991}>u{i}</div>" for i in range(50_000)) + "</article>"
    rows = [(1, "http://a.b/", deep), (1, "http://a.b/", deep), (2, "http://w.b/", wide), (3, "http://w.b/", other), (4, None, deep)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[4] == "bottom\nafter"
    assert got[2] == "\n".join(f"t{i}" for i in range(50_000)) and got[3] == "\n".join(f"u{i}" for i in range(50_000))


def test_extraction_against_known_templates(spark):
    """Hosts of random templates: what a template repeats on every page is not text, what varies is."""
    rng = random.Random(61)
    rows, want = [], {}
    for h in range(6):
        region = rng.choice(["article", "main", "div class=content"])
        fixed = [f"<div class=x{k}><p>Fixed line {h} {k} of this host, told to every reader of it.</p></div>" for k in range(3)]
        for i in range(20):
            parts, text = [fixed[0]], []
            for k in range(rng.randrange(1, 5)):
                t, p = f"Head {h} {i} {k}", f"Prose {h} {i} {k} that nobody else has written."
                parts += [f"<h2>{t}</h2><p>{p}</p>"]
                text += [t, p]
            if rng.random() < 0.5:
                parts.append(f"<blockquote>quote {i}</blockquote>")
                text.append(f"quote {i}")
            page = f"<body><nav>n</nav><{region}>{''.join(parts)}{fixed[1]}</{region.split()[0]}>{fixed[2]}<footer>f</footer></body>"
            rows.append((100 * h + i, f"https://host{h}.org/{i}", page))
            want[100 * h + i] = "\n".join(text)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
    groups = html.wrappers(pages.selectExpr("'one' as host", "html"), fan=3).collect()
    assert len(groups) == 1


def test_ftrl_against_a_plain_version():
    """The same updates with a dictionary for each coordinate, one at a time."""
    rng = random.Random(71)
    rows = [(rng.sample(range(40), rng.randrange(0, 12)), rng.randrange(2)) for _ in range(400)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.4, 0.01
    z, n, bz, bn = Counter(), Counter(), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    model = toxicity.Ftrl(alpha, beta, l1, l2, size=64)
    for features, label in rows:
        w, b = {i: weight(i) for i in features}, -bz / ((beta + math.sqrt(bn)) / alpha + l2)
        g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - label
        for i in features:
            step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - step * w[i]
            n[i] += g * g
        bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * b
        bn += g * g
        model.learn(np.array(features, np.int64), label)
    idx, w = model.model()
    assert idx.tolist() == [i for i in range(64) if weight(i)] and 0 < len(idx) <= 40
    assert np.allclose(w, [weight(i) for i in idx.tolist()]) and abs(model.bias - (-bz / ((beta + math.sqrt(bn)) / alpha + l2))) < 1e-12


def test_repeated_rows_score_alike(spark):
    df, labels = _toxic(spark)
    twice = df.unionByName(df.where("doc_id % 7 = 0"))
    got = {}
    for r in toxicity.score(twice, labels.unionByName(labels)).collect():
        got.setdefault(r.doc_id, set()).add((r.score, r.predicted))
    assert all(len(v) == 1 for v in got.values()) and len(got) == 903
    assert len({s for i in (-1, -2) for s in got[i]}) == 1  # null and empty texts tie


def test_numbers_of_pages_are_no_part_of_a_wrapper(spark):
    """Pages with ids of their own fold into a few expressions, so that merging takes time in proportion."""
    page = lambda i: f"<body><div id=page-{i} class='hentry post{1000 + i} x{5000 + i}y'><article id='post-{i}'><h1>T{i}</h1><p>prose {i}</p></article></div><div class=footer><p id=f{i}>end</p></div></body>"
    pages = spark.createDataFrame([(i, "http://many.org/x", page(i)) for i in range(1000)], "page_id long, url string, html string").repartition(4)
    found = html.wrappers(pages.selectExpr("'many.org' as host", "html")).collect()
    assert len(found) == 1 and len(list(html.slots(__import__("json").loads(found[0].expr)))) == 3
    assert {r.page_id: r.text for r in html.extract(pages, broadcast_slots=0).collect()} == {i: f"T{i}\nprose {i}" for i in range(1000)}
