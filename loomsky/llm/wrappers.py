"""Main text of web pages, by wrappers that are inferred from the pages of a host.

A page is a stream of blocks of text, each known by the path of elements that it lies in. Runs of equal paths, or of equal sequences of paths, are
folded into one repeated group. The folded streams of a host's pages with the same layout are aligned one after the other: what only some
of them have becomes optional, a text that differs becomes a slot, one that most of them share is the template's. The result is a
regular expression without unions: a wrapper.

The wrapper says where the host's pages have their article: in the innermost element that holds most of what its slots were given. What lies outside of it
is left out, whatever its tags are called; inside, only places that tags or class names give to menus, forms, adverts, comments and the
like. A page that none of its host's wrappers fits is read by tags and class names alone.

All pages of a host are aligned and counted, but for copies of others. Equal streams are aligned as one, ``FAN`` at a time, and what they give is aligned again, so
that no task holds a host; which texts are the template's, and where the slots' texts lie, is counted by Spark over all pages.
"""

from __future__ import annotations

import html as entities
import json
import re
from hashlib import blake2b
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, stored
from .urls import host_of

#: streams that a task aligns with each other
FAN = 64
#: hashes of a page by which it meets the pages that it may be a copy of
MEETINGS = 4
#: longest repeated group, in blocks
LONGEST = 12
#: pages that a template needs, and the part of its pages that has a text of it
LEAST, SHARED = 3, 0.6
#: groups of a page or wrapper that are aligned: of more, the texts are counted by their group's paths alone
MOST_GROUPS = 3000
#: between the paths of a group
AND = "\x1f"
#: deepest element that is told from those around it
DEEPEST = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: elements that hold no part of an article
ASIDE = frozenset("nav aside footer form menu dialog button select option fieldset head object canvas video audio".split())
#: words of class names, ids and roles of such places: a name that has one among ``NEUTRAL`` words tells it
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "consent disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pagination pager popup promo promotion replies "
    "sharing sidebar signup sponsor sponsored subscribe toolbar topbar widget".split()
)
#: words that tell it only where all words are of these or neutral
WEAK = frozenset("alert foot form notice notices related reply respond share side skip social".split())
NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons col column container content contents div group head header holder icons inner item items "
    "js left links list main mobile module outer page panel post posts primary reader right row secondary section site slot small stories story text "
    "top unit user wrap wrapper".split()
)
_WORDS = re.compile(r"[a-z]+", re.I)


@lru_cache(maxsize=1 << 14)
def marked(rest: str) -> bool:
    """Whether names, parted by white space, tell a place that holds no part of an article."""
    known, all_known = False, True
    for name in rest.lower().split():
        words = _WORDS.findall(name)
        own = all(w in MARKS or w in WEAK or w in NEUTRAL for w in words)
        known |= own and any(w in MARKS for w in words)
        all_known &= own
    return known or (all_known and any(w in WEAK for w in _WORDS.findall(rest.lower())))


HEAD = re.compile(r"/h[1-3](\.[^/]*)?")
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S
)
NAMED = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page: ``("<", tag, class names)``, ``(">", tag, "")`` or ``("T", "", text)``. What raw elements hold
    is left out."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            yield "T", "", page[at:]
            return
        if m.start() > at:
            yield "T", "", page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield ">", name, ""
            continue
        found = {}
        for x in NAMED.finditer(m[3] or "") if m[3] and m[3].strip() else ():
            found.setdefault(x[1].lower(), x[2] or x[3] or x[4] or "")
        marks = " ".join(filter(None, (found.get("class"), found.get("id"), found.get("role"))))
        if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
            marks = "skip"
        if name in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        yield "<", name, marks
        if m[0].endswith("/>") and name not in VOID and name in ("svg", "path"):
            yield ">", name, ""


class Block:
    __slots__ = ("path", "parts", "main", "aside", "linked", "size", "_text")

    def __init__(self, path: str, main: bool, aside: bool):
        self.path, self.main, self.aside = path, main, aside
        self.parts: list[str] = []
        self.linked = self.size = 0
        self._text: str | None = None

    def text(self) -> str:
        if self._text is None:
            self._text = " ".join(entities.unescape("".join(self.parts)).split())
        return self._text


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order: where they lie, whether in an article, whether in a place that holds none."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, in the article, aside
    links = 0
    open_: Block | None = None
    for kind, name, rest in tokens(page):
        if kind == "T":
            if open_ is None:
                if not rest.strip():
                    continue
                _, path, main, aside = stack[-1]
                open_ = Block(path, main, aside)
                out.append(open_)
            open_.parts.append(rest)
            size = len(rest.strip())
            open_.size += size
            if links:
                open_.linked += size
            continue
        if name == "br":
            if open_ is not None:
                open_.parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                open_ = None
            continue
        if name == "a":
            links = 1 if kind == "<" else 0
        if name in INLINE and not (kind == "<" and rest and marked(rest)):
            if kind == ">":  # the end of an inline element that was taken for a place of its own
                if stack[-1][0] == name:
                    stack.pop()
                    open_ = None
            continue
        open_ = None
        if kind == "<":
            _, path, main, aside = stack[-1]
            told = bool(rest and marked(rest))
            if name in ("article", "main") and not told:
                main, aside = True, False
            elif name in ASIDE or told or (name == "header" and not main):
                aside = True
            if name == "p" and stack[-1][0] == "p":
                stack.pop()
            if len(stack) < DEEPEST:
                path = f"{path}/{name}{'.' + ' '.join(rest.split()).replace('/', '|') if rest else ''}"
            stack.append((name, path, main, aside))
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    links = 0
                    break
    return out


#: a group of blocks: the paths of one occurrence, and all blocks of all of them
Group = tuple[tuple[str, ...], list[Block]]


def folded(found: list[Block]) -> list[Group]:
    """Blocks in groups; runs of equal groups, or of equal sequences of groups, are one group."""
    groups: list[Group] = [((b.path,), [b]) for b in found]
    repeated: set[tuple[str, ...]] = set()
    for period in range(1, LONGEST + 1):
        out: list[Group] = []
        i, keys = 0, [g[0] for g in groups]
        while i < len(groups):
            j = i + period
            if keys[i:j] == keys[j : j + period] and (period == 1 or len(set(keys[i:j])) > 1):
                while keys[i : i + period] == keys[j : j + period]:
                    j += period
                own = tuple(p for k in keys[i : i + period] for p in k)
                repeated.add(own)
                out.append((own, [b for g in groups[i:j] for b in g[1]]))
            else:
                out.append(groups[i])
                j = i + 1
            i = j
        groups = out
    return unrepeated(groups, {r for r in repeated if len(r) > 1})


def unrepeated(groups: list[Group], repeated: set[tuple[str, ...]]) -> list[Group]:
    """``groups`` where a sequence equal to one that is repeated elsewhere is that group too."""
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for r in sorted(repeated, key=len, reverse=True):
        by_first.setdefault(r[0], []).append(r)
    out, i = [], 0
    while i < len(groups):
        for r in by_first.get(groups[i][0][0], ()):
            if len(groups[i][0]) == 1 and [g[0] for g in groups[i : i + len(r)]] == [(p,) for p in r]:
                out.append((r, [b for g in groups[i : i + len(r)] for b in g[1]]))
                i += len(r)
                break
        else:
            out.append(groups[i])
            i += 1
    return out


class Wrapper:
    """A sequence of groups, each with how many pages have it and in how many of them each of its texts lies."""

    def __init__(self) -> None:
        self.groups: list[tuple[tuple[str, ...], int, Counter]] = []
        self.slots: dict[tuple[str, str], Block] = {}
        self.pages = 0

    def take(self, groups: list[tuple[tuple[str, ...], int, Counter]], pages: int) -> None:
        """Take in the groups of ``pages`` pages: groups that both have stay, others become optional."""
        out, mine, theirs = [], [g[0] for g in self.groups], [g[0] for g in groups]
        for op, a, b, c, d in SequenceMatcher(None, mine, theirs, autojunk=False).get_opcodes():
            if op == "equal":
                out += [(key, n + m, seen + new) for (key, n, seen), (_, m, new) in zip(self.groups[a:b], groups[c:d])]
            else:
                out += self.groups[a:b] + groups[c:d]
        self.groups = out
        self.pages += pages

    def align(self, page: list[Group]) -> None:
        """Take in a page and its texts."""
        for _, blocks_ in page:
            for b in blocks_:
                self.slots.setdefault((b.path, b.text()), b)
        self.take([(key, 1, Counter({(b.path, b.text()) for b in blocks_})) for key, blocks_ in page], 1)

    def expression(self) -> str:
        """The regular expression: ``?`` after what only some pages have, ``*`` for a slot, quotes around the template's texts."""
        need, said = self.need(), []
        for key, n, seen in self.groups:
            fixed = sorted({t for (_, t), k in seen.items() if k >= need})
            slot = "*" if any(k < need for k in seen.values()) else ""
            said.append(f"({' '.join(key)} {' '.join(map(repr, fixed))}{slot}){'?' if n < self.pages else ''}")
        return "".join(said)

    def need(self) -> int:
        return max(LEAST, -(-self.pages * 6 // 10))

    def fixed(self) -> list[str]:
        """Texts that most pages have at the same place."""
        return sorted({t for _, _, seen in self.groups for (_, t), k in seen.items() if k >= self.need()})

    def article(self) -> str:
        """The path of the innermost element, but not of a single block, that holds most of what the slots were given; empty if there is none."""
        held: Counter = Counter()
        for _, _, seen in self.groups:
            for (path, text), k in seen.items():
                b = self.slots[path, text]
                if k < self.need() and not b.aside and b.linked * 2 <= b.size:
                    at = path.rfind("/")
                    while at > 0:
                        path = path[:at]
                        held[path] += len(text)
                        at = path.rfind("/")
        most = max(held.values(), default=0)
        return named_around(max((p for p, n in held.items() if n >= 0.7 * most), key=len, default=""))


def named_around(path: str) -> str:
    """``path``, or that of the element around it that is named as the article."""
    for tag in ("/article", "/main"):
        if (m := re.search(f"{tag}(?=[./]|$)[^/]*", path)) is not None:
            return path[: m.end()]
    return path


def alike(own: set[str], paths: set[str]) -> bool:
    """Whether two pages have most of their paths in common."""
    return 2 * len(own & paths) >= min(len(own), len(paths)) + 0.5 * abs(len(own) - len(paths))


def layouts(pages: list[list[Block]]) -> list[list[list[Block]]]:
    """Pages with text in clusters of those that have most of their paths in common, the largest first."""
    found: list[tuple[set[str], list[list[Block]]]] = []
    for page in pages:
        paths = {b.path for b in page}
        if not any(b.text() for b in page):
            continue
        for own, members in found:
            if alike(own, paths):
                members.append(page)
                break
        else:
            found.append((paths, [page]))
    return sorted((m for _, m in found), key=len, reverse=True)


def infer(pages: list[str]) -> list[Wrapper]:
    """The wrappers of ``pages``, one for each layout of which ``LEAST`` pages differ enough to tell the template from a copied article."""
    out = []
    for members in layouts([blocks(p) for p in pages]):
        seen: list[set[str]] = []
        wrapper = Wrapper()
        for page in members:
            texts = {b.text() for b in page if len(b.text()) > 40} or {b.text() for b in page}
            groups = folded([b for b in page if b.text()])
            if len(groups) <= MOST_GROUPS and not any(len(texts & other) * 2 > min(len(texts), len(other)) for other in seen):
                seen.append(texts)
                wrapper.align(groups)
        if wrapper.pages >= LEAST:
            out.append(wrapper)
    return out


def main_text(page: str, wrappers: Sequence[tuple[str, frozenset[int]]] = ()) -> str:
    """The main text of ``page``; ``wrappers`` are where each of its host's wrappers has the article, and the numbers of its template's texts."""
    found = [b for b in blocks(page) if b.text()]
    for article, fixed in wrappers:
        above, _, last = article.rpartition("/")
        titled = not re.match(r"(article|main)(\.|$)", last)  # a head right before an element that nothing names belongs to it
        inside = [
            b for b in found
            if b.path == article or b.path.startswith(article + "/") or (titled and HEAD.fullmatch(b.path[len(above) :]) and b.path.startswith(above) and number(b.text()) not in fixed)
        ]
        if article and any(not b.aside for b in inside):
            # What an article repeats is its own, unless it is of the template.
            return "\n".join(b.text() for b in inside if not b.aside and (b.main or number(b.text()) not in fixed))
    in_article = any(b.main and not b.aside for b in found)
    out = []
    for b in found:
        if b.aside or (in_article and not b.main):
            continue
        if not in_article and b.linked * 2 > b.size:
            continue
        out.append(b.text())
    return "\n".join(out)


def number(text: str) -> int:
    """A 64-bit hash of a text."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


STREAMS = "host string, id long, hash long, keys array<string>, at array<int>, path array<string>, text array<long>, size array<int>, given array<boolean>, long array<long>, meets array<long>"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded stream of each page with text: its groups' keys; group, path, number and length of each text, and whether it may be of an
    article; the numbers of its long texts, and their least ones in ``MEETINGS`` orders."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("row", "keys", "at", "path", "text", "size", "given", "long", "meets")}
        for row, page in enumerate(batch.column("html").to_pylist()):
            groups = folded([b for b in blocks(page) if b.text()])
            if not groups:
                continue
            once = {(i, b.path, b.text()): not b.aside and b.linked * 2 <= b.size for i, (_, found) in enumerate(groups) for b in reversed(found)}
            numbers = {t: number(t) for _, _, t in once}
            long = sorted({n for t, n in numbers.items() if len(t) > 40} or set(numbers.values()))
            out["row"].append(row)
            out["keys"].append([AND.join(key) for key, _ in groups])
            out["at"].append([i for i, _, _ in once])
            out["path"].append([p for _, p, _ in once])
            out["text"].append([numbers[t] for _, _, t in once])
            out["size"].append([len(t) for _, _, t in once])
            out["given"].append(list(once.values()))
            out["long"].append(long)
            out["meets"].append([min(long, key=lambda n, m=m: n * m & (1 << 64) - 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)[:MEETINGS]])
        kept = batch.take(pa.array(out.pop("row"), pa.int32()))
        types = {"keys": pa.string(), "at": pa.int32(), "path": pa.string(), "text": pa.int64(), "size": pa.int32(), "given": pa.bool_(), "long": pa.int64(), "meets": pa.int64()}
        columns = [kept.column(c) for c in ("host", "id", "hash")] + [pa.array(out[c], pa.list_(t)) for c, t in types.items()]
        yield pa.RecordBatch.from_arrays(columns, ["host", "id", "hash", *types])


def copies(streams: DataFrame) -> DataFrame:
    """``id`` of the pages of ``streams`` that have most of their long texts from another page of their host, one that stays or is itself a copy. Each page is
    compared with the first of those that share one of its least texts."""
    each = streams.select("host", "id", "hash", "long", F.posexplode("meets").alias("order", "least"))
    first = each.groupBy("host", "order", "least").agg(F.count("*").alias("n"), F.min(F.struct("hash", "id", "long")).alias("first"))
    first = first.where("n > 1").select("host", "order", "least", F.col("first.id").alias("of"), F.col("first.long").alias("theirs"))
    met = each.join(broadcast_up_to(stored(first)), ["host", "order", "least"]).where("id <> of")
    return met.where("2 * size(array_intersect(long, theirs)) > least(size(long), size(theirs))").select("id").distinct()


def _aligned(items: pd.DataFrame) -> pd.DataFrame:
    """Streams or wrappers without texts (keys, ns, pages, paths) aligned by layout, those of the most pages first."""
    found: list[tuple[set[str], Wrapper]] = []
    rows = [(-pages, list(keys), list(ns), list(paths)) for keys, ns, pages, paths in zip(items["keys"], items["ns"], items["pages"], items["paths"])]
    for less, keys, ns, paths in sorted(rows):
        own = set(paths)
        wrapper = next((w for o, w in found if alike(o, own)), None)
        if wrapper is None:
            found.append((own, wrapper := Wrapper()))
        wrapper.take([((key,), n, Counter()) for key, n in zip(keys, ns)], -less)
        if len(wrapper.groups) > MOST_GROUPS:
            least = sorted((n for _, n, _ in wrapper.groups), reverse=True)[MOST_GROUPS]
            wrapper.groups = [g for g in wrapper.groups if g[1] > least]
    out = [(items["host"].iloc[0], [k[0] for k, _, _ in w.groups], [n for _, n, _ in w.groups], w.pages, sorted(own)) for own, w in found]
    return pd.DataFrame(out, columns=["host", "keys", "ns", "pages", "paths"])


def aligned(streams: DataFrame) -> DataFrame:
    """``host, keys, ns, pages, paths``: a wrapper, without its texts, for each layout of each host. A task aligns about ``FAN`` at a time."""
    items = streams.where(F.size("keys") <= MOST_GROUPS).groupBy("host", "keys").agg(F.count("*").alias("pages"))
    paths = F.array_sort(F.array_distinct(F.split(F.array_join("keys", AND), AND)))
    items = stored(items.select("host", "keys", F.expr("transform(keys, k -> pages)").alias("ns"), "pages", paths.alias("paths")))
    before, turn = None, 0
    while True:
        many = broadcast_up_to(stored(items.groupBy("host").agg(F.count("*").alias("n"))))
        whole, most = many.agg(F.sum("n"), F.max("n")).first()
        # Where nothing was alike any more, layouts that are left stay apart.
        if not whole or whole == before:
            return items
        seat = F.pmod(F.xxhash64(F.lit(turn), "keys", "pages"), F.ceil(F.col("n") / FAN))
        schema = "host string, keys array<string>, ns array<long>, pages long, paths array<string>"
        items = stored(items.join(many, "host").groupBy("host", seat.alias("seat")).applyInPandas(_aligned, schema))
        if most <= FAN:
            return items
        before, turn = whole, turn + 1


@lru_cache(maxsize=1 << 10)
def _layouts(wrappers: str) -> list[tuple[set[str], list[str]]]:
    return [(set(w["paths"]), w["keys"]) for w in json.loads(wrappers)]


@lru_cache(maxsize=1 << 12)
def _places(wrappers: str, keys: tuple[str, ...]) -> tuple[int, list[int]] | None:
    """The layout that a stream has, and the place in its wrapper of each group, a negative number for what isn't in it."""
    paths = {p for key in keys for p in key.split(AND)}
    for i, (own, theirs) in enumerate(_layouts(wrappers)):
        if alike(own, paths):
            places = [-1 - (number(key) & (1 << 62) - 1) for key in keys]
            if len(keys) <= MOST_GROUPS:
                for a, b, n in SequenceMatcher(None, theirs, keys, autojunk=False).get_matching_blocks():
                    places[b : b + n] = range(a, a + n)
            return i, places
    return None


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, layout, place, path, text, size, given`` of each text of each page, and a row without a path for the page."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        columns = [batch.column(c).to_pylist() for c in ("host", "wrappers", "keys", "at", "path", "text", "size", "given")]
        for host, wrappers, keys, at, path, text, size, given in zip(*columns):
            if (found := _places(wrappers, tuple(keys))) is not None:
                layout, places = found
                n = len(at) + 1
                for to, values in zip(out, ([host] * n, [layout] * n, [None, *map(places.__getitem__, at)], [None, *path], [None, *text], [None, *size], [None, *given])):
                    to += values
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["host", "layout", "place", "path", "text", "size", "given"])


def inferred(pages: DataFrame) -> DataFrame:
    """``host, wrappers`` from all ``pages`` (host, page_id, html): of each layout with at least ``LEAST`` pages that aren't copies, those of most pages first, the
    innermost element with most of what the slots were given, and the numbers of the template's texts, as JSON."""
    listed = pages.select("host", F.monotonically_increasing_id().alias("id"), F.xxhash64("page_id", "html").alias("hash"), "html")
    streams = stored(listed.mapInArrow(_streams, STREAMS))
    streams = streams.join(broadcast_up_to(stored(copies(streams))), "id", "left_anti")
    layout = F.struct((-F.col("pages")).alias("less"), "keys", "paths")
    known = aligned(streams).groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(layout))).alias("wrappers"))
    parts = streams.select("host", "keys", "at", "path", "text", "size", "given").join(broadcast_up_to(stored(known)), "host")
    schema = "host string, layout int, place long, path string, text long, size int, given boolean"
    filled = stored(parts.mapInArrow(_filled, schema))
    by = ["host", "layout"]
    # A text is the template's where it lies in as many pages.
    many = filled.where("path is null").groupBy(*by).agg(F.count("*").alias("pages")).where(f"pages >= {LEAST}")
    many = broadcast_up_to(stored(many.withColumn("need", F.greatest(F.lit(LEAST), F.ceil(F.col("pages") * 6 / 10)))))
    texts = filled.where("path is not null").groupBy(*by, "place", "path", "text").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.bool_or("given").alias("given"))
    held, fixed = F.sum(F.when(F.expr("n < need and given"), F.col("size"))), F.collect_set(F.when(F.expr("n >= need"), F.col("text")))
    at = stored(texts.join(many, by).groupBy(*by, "path").agg(held.alias("held"), fixed.alias("fixed")))
    fixed = at.select(*by, F.explode("fixed").alias("text")).groupBy(*by).agg(F.sort_array(F.collect_set("text")).alias("fixed"))
    steps = F.split("path", "/")
    around = F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    above = at.where(F.col("held").isNotNull() & (F.size(steps) > 2)).select(*by, F.explode(around).alias("above"), "held")
    above = stored(above.groupBy(*by, "above").agg(F.sum("held").alias("held")))
    most = above.groupBy(*by).agg(F.max("held").alias("most"))
    inner = above.join(broadcast_up_to(stored(most)), by).where("held >= 0.7 * most").groupBy(*by).agg(F.max_by("above", F.struct(F.length("above"), "above")).alias("article"))
    whole = many.select(*by, "pages").join(inner, by).join(fixed, by, "left")
    each = F.struct((-F.col("pages")).alias("less"), "layout", "article", F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"))
    return whole.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(each))).alias("wrappers"))


@lru_cache(maxsize=1 << 12)
def _read(wrappers: str | None) -> tuple[tuple[str, frozenset[int]], ...]:
    return tuple((named_around(w["article"]), frozenset(w["fixed"])) for w in json.loads(wrappers)) if wrappers else ()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page or "", _read(w)) for page, w in zip(batch.column("html").to_pylist(), batch.column("wrappers").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page: ``page_id, url, text, n_chars``, one row for each row of ``pages``.

    Each host's wrappers, one for each layout, are inferred from all of its pages but copies of others. A layout with fewer than three pages
    that differ has no template, nor has a page without a host; tags and class names alone tell there. A null html is empty; a page
    without text gives an empty text. Rows that share a page_id are extracted each for itself. Other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("host", host_of(F.col("url")))
    wrappers = inferred(pages.where("host <> '' and html is not null"))
    # Where the wrappers are too many to be held by each task, adaptive execution splits a hot host's pages; its wrapper is one row.
    joined = pages.join(broadcast_up_to(stored(wrappers)), "host", "left").select("page_id", "url", "html", "wrappers")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
