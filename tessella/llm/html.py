"""Main text of web pages, by wrappers that are inferred for each host.

A page becomes a tree of block elements (inline markup is transparent, unclosed elements are closed where HTML closes them) whose
leaves are text slots; its children, read in order, are the token stream. The wrapper of a host is a union-free regular expression over such streams: it starts
as one page's and is aligned with the next, again and again; what only one of them has becomes optional, neighbours of one shape, or sequences of shapes such as
heading and paragraph, become a repeated group, and differing strings become text slots. Pages whose folded expressions are equal count once, and the different ones of a
host are merged in a tree of groups of about FAN, so that a host with a third of all pages is not one task's work. Long streams are aligned between names that
occur once in both, so aligning takes little more than linear time.

Each slot of a wrapper is judged once for its host: slots under navigation, headers and footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are not text; on pages that have slots in an article or main region, what is left of it is, but for slots that
the wrapper has on every page with one string, where others vary and three different pages at least show it (headings beside what varies stay); elsewhere
it is the slots whose strings are long, differ between pages and aren't mostly links, and the headings, short paragraphs, lists and tables beside them. There the
wrapper shows the region itself: it is the elements whose prose the alignment finds repeated (an article's paragraphs), and lone boxes outside them, such as adverts and
closing lines that differ from page to page, are text only if their strings are as long as the repeated ones, or on pages that have nothing in such an element.
Pages are then read through their host's wrapper, each in the highest region that it has itself.

Defined results: null and empty html give an empty text; each page with a null or strange url is judged by itself; rows with a null or repeated page_id
are treated like others; truncated pages are read as far as they go; an element more than DEPTH deep becomes a sibling of the one before it, as in browsers;
pages of any length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from tessella.llm.common import stored, tune

# Element names and the words in class, id and role that mark regions.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul title noscript template iframe button textarea label svg object video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
NOT_TEXT = frozenset("head nav footer aside form script style noscript template iframe button select option optgroup textarea label svg object video audio menu dialog title fieldset legend".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs topbar masthead footer sidebar rail widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login search comment comments reply replies respond disqus discussion pagination pager contentinfo complementary".split())
REGION = frozenset("article main".split())
REGION_MARKS = frozenset("article main content post entry story articlebody".split())
FEW = 3  # different pages that make an unvarying slot a fixed one
DEPTH, GROUP, FAN = 200, 16, 256  # deepest nesting of blocks; longest sequence that is found to repeat; expressions merged at once
EXACT = 40_000  # pairs of items up to which streams are aligned by the whole table
GROUPS = frozenset("ul ol dl table blockquote pre figure details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.DOTALL)
_attr = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_words = re.compile(r"[a-z0-9]+")
_own = {"id": re.compile(r"[0-9]"), "class": re.compile(r"[0-9]{3}"), "role": re.compile(r"[0-9]{3}")}  # what makes a word one page's own, so that it is no part of a label
_host = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Page:
    """The blocks of text of one page: (path, text, share of it in links), and its tree."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str, float]] = []
        self.tree: list = ["", []]
        self.stack: list[tuple[str, str, list]] = [("", "", self.tree)]  # (element, path, node)
        self.link = 0
        self.parts: list[tuple[str, bool]] = []
        at = 0
        while (m := _token.search(html, at)) is not None:
            if m.start() > at:
                self.parts.append((html[at : m.start()], self.link > 0))
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            name, closing, attrs = name.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
            if closing:
                self.close(name)
                continue
            self.open(name, attrs)
            if name in RAW and not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(html, at)
                at = end.start() if end else len(html)
        if at < len(html):
            self.parts.append((html[at:], self.link > 0))
        self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        raw = "".join(t for t, _ in self.parts)
        text = " ".join(unescape(raw).split())
        if text:
            linked = sum(len(t) for t, a in self.parts if a)
            path, node = self.stack[-1][1:]
            self.blocks.append((path, text, linked / max(1, len(raw))))
            if not node[1] or node[1][-1] != "#":
                node[1].append("#")
        self.parts = []

    def open(self, name: str, attrs: str) -> None:
        if name == "a":
            self.link += 1
        elif name == "br":
            self.parts.append((" ", False))
        if name not in BLOCKS:
            return
        self.flush()
        if name == "hr":
            return
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.until(name, ("ul", "ol", "dl", "table", "select", "menu"))
        self.until("p", ("",))
        marks = sorted({w for g in _attr.findall(attrs) for w in _words.findall("".join(g[1:]).lower()) if not _own[g[0].lower()].search(w)}) if attrs else []
        label = ".".join([name, *marks])
        node = [label, []]
        del self.stack[DEPTH:]
        self.stack[-1][2][1].append(node)
        self.stack.append((name, f"{self.stack[-1][1]}/{label}", node))

    def until(self, name: str, but: tuple[str, ...]) -> None:
        """Closes an open element of this name, unless one of `but` is nearer."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return
            if self.stack[k][0] in but or name == "p" and self.stack[k][0] in BLOCKS:
                return

    def close(self, name: str) -> None:
        if name == "a":
            self.link = max(0, self.link - 1)
        if name not in BLOCKS:
            return
        self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return


# Expressions: [[times, item], ...]; times is one of 1 ? + *; item is "#" or [label, expression], or a sequence, whose label is its members' names behind a bracket.
OR = {("1", "1"): "1", ("+", "1"): "+", ("+", "+"): "+", ("1", "?"): "?", ("?", "?"): "?"}
OPEN, NEXT = "(", "\x1f"


def both(a: str, b: str) -> str:
    return OR.get((min(a, b), max(a, b)), "*")


def name_of(item) -> str:
    return item if isinstance(item, str) else item[0]


def names(items: list[list]) -> list[str]:
    return [name_of(x[1]) for x in items]


def folded(items: list[list]) -> list[list]:
    """Neighbours with one name become one repeated item, sequences that follow one another one repeated sequence."""
    out: list[list] = []
    for times, item in items:
        if out and name_of(out[-1][1]) == name_of(item):
            before = out[-1]
            before[0] = "*" if before[0] in "?*" and times in "?*" else "+"
            before[1] = merged_item(before[1], item)
        else:
            out.append([times, item])
    return grouped(out)


def grouped(items: list[list]) -> list[list]:
    """Shorter sequences are found before longer ones."""
    for k in range(2, GROUP + 1):
        if len(items) < 2 * k:
            break
        name, out, i = names(items), [], 0
        while i < len(items):
            n = 1
            while name[i + n * k : i + n * k + 1] == name[i : i + 1] and name[i + n * k : i + (n + 1) * k] == name[i : i + k]:
                n += 1
            if n == 1:
                out.append(items[i])
                i += 1
                continue
            body = items[i : i + k]
            for m in range(1, n):
                body = [[both(x[0], y[0]), merged_item(x[1], y[1])] for x, y in zip(body, items[i + m * k : i + (m + 1) * k], strict=True)]
            out.append(["+", [OPEN + NEXT.join(name[i : i + k]), body]])
            i += n * k
        items = out
    return items


def absorbed(items: list[list], groups: set[str]) -> list[list]:
    """items with single runs of the members of these sequences as one of the sequence each."""
    for label in sorted(groups):
        want = label[1:].split(NEXT)
        k, name = len(want), names(items)
        if label.count(OPEN) > 1 or label in name:
            continue
        out, i = [], 0
        while i < len(items):
            if name[i] == want[0] and name[i : i + k] == want:
                out.append(["1", [label, items[i : i + k]]])
                i += k
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def expression(node: list) -> list[list]:
    return folded([["1", c if isinstance(c, str) else [c[0], expression(c)]] for c in node[1]])


def merged_item(a, b):
    return a if isinstance(a, str) else [a[0], merged(a[1], b[1])]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal names in both, rising: the longest such list where that is cheap, else what lies between names that occur once in both, else the first that fits."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= EXACT:
            out += longest(a[i:n], b[j:m], i, j)
            continue
        once, other = Counter(a[i:n]), Counter(b[j:m])
        place = {x: q for q, x in enumerate(b[j:m], j) if once[x] == other[x] == 1}
        rising = increasing([(p, place[x]) for p, x in enumerate(a[i:n], i) if x in place])
        if not rising:
            where: dict[str, list[int]] = {}
            for q in range(j, m):
                where.setdefault(b[q], []).append(q)
            for p in range(i, n):
                found = where.get(a[p], [])
                k = bisect_left(found, j)
                if k < len(found):
                    out.append((p, found[k]))
                    j = found[k] + 1
            continue
        out += rising
        for (p, q), (p2, q2) in zip([(i - 1, j - 1), *rising], [*rising, (n, m)], strict=True):
            todo.append((p + 1, p2, q + 1, q2))
    return sorted(out)


def longest(a: list[str], b: list[str], i0: int, j0: int) -> list[tuple[int, int]]:
    """The longest common subsequence by the whole table."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i0 + i, j0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, rising in the first place, that rises in the second too."""
    tails: list[int] = []
    ends: list[int] = []
    back = []
    for k, (_, q) in enumerate(pairs):
        at = bisect_left(tails, q)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [q], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def merged(a: list[list], b: list[list]) -> list[list]:
    """The expression that both a and b match: what is aligned in both, the rest optional."""
    if a == b:
        return a
    groups = [{x for x in names(s) if x[0] == OPEN} for s in (a, b)]
    if groups[0] or groups[1]:
        a, b = absorbed(a, groups[1] - groups[0]), absorbed(b, groups[0] - groups[1])
    out, i, j = [], 0, 0
    maybe = lambda x: [both(x[0], "?"), x[1]]
    for p, q in [*aligned(names(a), names(b)), (len(a), len(b))]:
        out += [maybe(x) for x in a[i:p]] + [maybe(x) for x in b[j:q]]
        if p < len(a):
            out.append([both(a[p][0], b[q][0]), merged_item(a[p][1], b[q][1])])
        i, j = p + 1, q + 1
    return folded(out)


def slots(expr: list[list], path: str = "", repeated: bool = False, always: bool = True) -> Iterator[tuple[str, bool, bool]]:
    """(path, whether in a repeated group, whether on every page that has its region) of every text slot of a wrapper."""
    for times, item in expr:
        again, there = repeated or times in "+*", always and times in "1+"
        if isinstance(item, str):
            yield path, again, there
        else:
            below = path if item[0][0] == OPEN else f"{path}/{item[0]}"
            yield from slots(item[1], below, again, there or region(below) > region(path))


def excluded(path: str) -> bool:
    """Whether a slot lies in a region that is never text."""
    inside = False
    for label in path.split("/")[1:]:
        name, *marks = label.split(".")
        if name in NOT_TEXT or not inside and name == "header":
            return True
        # the region's own marks, such as "post comments-open", don't exclude it
        if name in REGION:
            inside = True
        elif name not in ("html", "body") and MARKS & {*marks}:
            return True
        elif not inside and "header" in marks and not REGION_MARKS & {*marks}:
            return True
    return False


def region(path: str) -> int:
    """2 inside an article or main element, 1 inside one that is marked so, else 0."""
    parts = [label.split(".") for label in path.split("/")[1:]]
    if any(p[0] in REGION for p in parts):
        return 2
    return int(any(p[0] not in ("html", "body") and REGION_MARKS & {*p[1:]} for p in parts))


def text_slots(wrapper: list[list], stats: dict[str, tuple[int, int, float, bool, int]]) -> list[list[str]]:
    """The paths that are main text on pages without a region, with one that the wrapper shows, with a marked one and with an article or main element; stats: path -> (strings, characters, characters in links, all equal, different pages, FEW at most)."""
    known, always = {}, set()
    for path, again, there in slots(wrapper):
        known[path] = known.get(path, False) or again
        if there:
            always.add(path)
    open_ = [p for p in known if p in stats and not excluded(p)]
    ranks = [[p for p in open_ if region(p) == k] for k in range(3)]

    def prose(p: str) -> bool:
        n, chars, linked, *_ = stats[p]
        return chars >= 40 * n and linked < 0.5 * chars

    good = [p for p in ranks[0] if prose(p) and p.rpartition("/")[2].split(".")[0] not in HEADINGS]
    vary = any(not stats[p][3] for p in good)

    def fixed(p: str) -> bool:
        return vary and stats[p][3] and stats[p][0] >= 3 and not known[p]

    good = [p for p in good if not fixed(p)]
    # the elements that hold repeated prose are a region that the alignment shows: a lone slot outside them joins it if its strings are as long as the repeated ones
    groups = [p for p in good if known[p]]
    around = {p.rpartition("/")[0] for p in groups}
    length = sum(stats[p][1] for p in groups) / max(1, sum(stats[p][0] for p in groups))

    def within(p: str) -> bool:
        return known[p] or stats[p][1] >= length * stats[p][0] or any(p.startswith(h + "/") for h in around)

    def with_beside(prose_: list[str]) -> list[str]:
        """These slots and the short ones among them: siblings, or in a list, table or quotation that is one."""
        homes = {p.rpartition("/")[0] for p in prose_}

        def beside(p: str) -> bool:
            labels = p.split("/")
            if labels[-1].split(".")[0] in HEADINGS:
                return p.rpartition("/")[0] in homes
            if stats[p][2] >= 0.5 * stats[p][1] or fixed(p):
                return False
            return any("/".join(labels[:k]) in homes and (k == len(labels) - 1 or labels[k].split(".")[0] in GROUPS) for k in range(1, len(labels)))

        return prose_ + [p for p in ranks[0] if p not in known_good and beside(p)]

    known_good = {*good}
    inner = with_beside([p for p in good if within(p)])
    outer = with_beside([p for p in good if not within(p)])
    for k in (1, 2):
        # what never varies and is never missing or repeated belongs to the template, where enough pages differ elsewhere in the region; a heading beside what varies is the text's own
        vary = {p.rpartition("/")[0] for p in ranks[k] if not stats[p][3]}
        if vary:
            own = lambda p: p.rpartition("/")[2].split(".")[0] in HEADINGS and p.rpartition("/")[0] in vary  # noqa: B023, E731
            ranks[k] = [p for p in ranks[k] if own(p) or not (stats[p][3] and stats[p][4] >= FEW and p in always and not known[p])]
    taken = {*inner}
    return [[p for p in outer if p not in taken], inner, *ranks[1:]]


def short(text: str) -> int:
    h = xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, expression, path, strings, chars, linked, least, most, seen): expressions and slot statistics of a batch, each host's folded together."""
    for b in batches:
        exprs: set[tuple[str, str]] = set()
        stats: dict[tuple[str, str], list] = {}
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            page, digest = Page(html), short(html)
            exprs.add((host, json.dumps(expression(page.tree), separators=(",", ":"))))
            for path, text, linked in page.blocks:
                h = short(text)
                s = stats.setdefault((host, path), [0, 0, 0.0, h, h, []])
                s[0] += 1
                s[1] += len(text)
                s[2] += linked * len(text)
                s[3], s[4] = min(s[3], h), max(s[4], h)
                if len(s[5]) < FEW and digest not in s[5]:
                    s[5].append(digest)
        rows = [(h, e, None, None, None, None, None, None, None) for h, e in exprs] + [(h, None, p, *s) for (h, p), s in stats.items()]
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["host", "expr", "path", "strings", "chars", "linked", "least", "most", "seen"])


STREAMS = "host string, expr string, path string, strings long, chars long, linked double, least long, most long, seen array<long>"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One wrapper for the group, aligned in the order of the expressions' texts."""
    wrapper = None
    for e in sorted(pdf["expr"]):
        wrapper = json.loads(e) if wrapper is None else merged(wrapper, json.loads(e))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "expr": [json.dumps(wrapper, separators=(",", ":"))]})


def _judge(wrappers: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
    if not len(wrappers):
        return pd.DataFrame({"host": [], "expr": [], "keep": []})
    known = {r.path: (r.strings, r.chars, r.linked, r.least == r.most, r.seen) for r in stats.itertuples()}
    keep = [[short(p) for p in ps] for ps in text_slots(json.loads(wrappers["expr"].iloc[0]), known)]
    return pd.DataFrame({"host": [wrappers["host"].iloc[0]], "expr": [wrappers["expr"].iloc[0]], "keep": [keep]})


def wrappers(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, expr, keep): each host's wrapper and the hashes of the paths of its text slots by region rank. pages: (host, html)."""
    found, _ = stored(pages.select("host", "html").mapInArrow(_streams, STREAMS), "streams")
    exprs = found.where("expr is not null").select("host", "expr").distinct()
    most = exprs.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        most = -(-most // fan)
        exprs = exprs.groupBy("host", F.pmod(F.xxhash64("expr"), F.lit(most)).alias("part")).applyInPandas(_merge, "host string, expr string").distinct()
    whole = exprs.groupBy("host").applyInPandas(_merge, "host string, expr string")
    stats = found.where("path is not null").groupBy("host", "path").agg(F.sum("strings").alias("strings"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("least").alias("least"), F.max("most").alias("most"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"))
    return whole.groupBy("host").cogroup(stats.groupBy("host")).applyInPandas(_judge, "host string, expr string, keep array<array<long>>")


def alone(page: Page) -> list[list[int]]:
    """The verdict on a page without a host, from the page itself."""
    stats: dict[str, list] = {}
    for path, text, linked in page.blocks:
        x = stats.setdefault(path, [0, 0, 0.0, set()])
        x[0], x[1], x[2] = x[0] + 1, x[1] + len(text), x[2] + linked * len(text)
        x[3].add(text)
    return [[short(p) for p in ps] for ps in text_slots(expression(page.tree), {p: (n, c, k, len(t) == 1, 1) for p, (n, c, k, t) in stats.items()})]


def main_text(page: Page, keep: dict[int, int], known: dict[str, int] | None = None) -> str:
    """The blocks of a page that lie in kept slots of the highest region rank that the page has, in page order. keep: hash of a path -> rank."""
    known = {} if known is None else known
    for path, _, _ in page.blocks:
        if path not in known:
            known[path] = keep.get(short(path), -1)
    most = max((known[path] for path, _, _ in page.blocks), default=-1)
    return "\n".join(text for path, text, _ in page.blocks if known[path] == most >= 0)


def _ranked(keep) -> dict[int, int]:
    return {h: rank for rank, hs in enumerate(keep) for h in hs}


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[tuple[int, ...], ...], tuple[dict[int, int], dict[str, int]]] = {}
    for b in batches:
        out = []
        for html, keep in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            page = Page(html)
            if keep is None:
                out.append(main_text(page, _ranked(alone(page))))
                continue
            k = tuple(map(tuple, keep))
            if len(known) > 2000:
                known.clear()
            if k not in known:
                known[k] = (_ranked(k), {})
            out.append(main_text(page, *known[k]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, broadcast_hosts: int = 20_000, broadcast_slots: int = 1_000_000, salts: int = 16) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Wrappers' verdicts are broadcast up to broadcast_hosts hosts with broadcast_slots slots (8 bytes each) in all, else joined with salted hosts."""
    tune(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _host, 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    verdicts, _ = stored(wrappers(rows.where("host <> ''")), "wrappers")
    verdicts = verdicts.select("host", "keep")
    hosts, slots_ = verdicts.agg(F.count("*"), F.coalesce(F.sum(F.size(F.flatten("keep")).cast("long")), F.lit(0))).first()
    if hosts <= broadcast_hosts and slots_ <= broadcast_slots:
        joined = rows.join(F.broadcast(verdicts), "host", "left")
    else:
        salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "keep").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
