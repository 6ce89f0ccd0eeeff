"""Main text of web pages by template deduction: tokens of equal occurrence vectors across the pages of a host."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: A class of tokens is part of a host's template if it has so many tokens and occurs on so many of the host's pages.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 3, 2, 0.5
#: Its texts are, if they also occur on so many pages and leave the slots of its pages a share of the text: copies and
#: near copies of a page, or two pages with a common passage, make classes too, whose texts are articles.
LEAST_TEXT_PAGES, MOST_TEXT = 3, 0.9
#: A discussion: so many like records of so many elements each at the end of the article, less than half of its text. An
#: element around them belongs to it if what it has besides is less than a quarter of them, as a heading is.
LEAST_RECORDS, LEAST_PARTS, MOST_DISCUSSION, MOST_BESIDE = 2, 2, 0.5, 0.25
#: The slot of the article is the innermost template element that holds over half of its host's slot text.
DOMINANT = 0.5
#: Template tokens of all hosts that are broadcast, some 100 MB; beyond, templates are joined by host and salt.
MOST_BROADCAST = 1_000_000
SALTS = 64
#: Elements that are open at once; deeper ones count as part of the last, as in browsers.
DEEPEST = 512
#: Bits of what a block lies in: an element that can hold an article, <article>, <main>, one named so, <h1>.
BOX, ARTICLE, MAIN, NAMED, TITLE = 1, 2, 4, 8, 16
#: Kinds of tokens: elements, those that can hold an article, those that hold one, texts.
ELEMENT, HOLDER, WRAPPER, TEXT = 0, 1, 2, 3

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg canvas object".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
_BUT_P = _BLOCK - {"p"}
#: Raw elements that may hold others of their name, and those that a slash ends.
_NESTING, _SLASHED = frozenset("svg canvas object template".split()), frozenset(("svg", "math"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no record of a discussion, whatever repeats in them, and those that tell who spoke and when.
_NO_RECORDS, _STAMPS = frozenset("p figure table tbody tr td th dl dt dd pre".split()), frozenset("time cite address".split())
_BOXES = frozenset("article body center div main section td".split())
#: What the start of an element ends, if open and not behind one of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
#: Elements, roles and words of class and id names that mark what isn't the article. A name marks if all its words are
#: of these or neutral, or two are of these: "ad-box" and "gdpr-banner-x" do, "ad-free" and "related-work" don't.
_OTHER_TAGS = frozenset("nav aside footer form button select option input label dialog menu".split()) | _RAW
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_COMMENT_WORDS = frozenset("comment comments commentary disqus respond reply replies response responses teaser teasers".split())
_OTHER_WORDS = _COMMENT_WORDS | frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer sidebar sidenav aside rail widget widgets ad ads adv advert adverts "
    "advertisement advertisements adslot adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login signin register search searchbox form share sharing social related recommended recommendations "
    "pagination pager copyright disclaimer skip toolbar".split()
)
_NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box button buttons col column container content desktop form global group header inner item items left link links list main middle mobile "
    "outer page pages panel post posts primary reader readers region right row secondary section sections site slot text thread title top unit user users wrap wrapper zone".split()
) | {""}
_HEADER_WORDS = frozenset(("header", "head"))
_MAIN_WORDS = re.compile(r"(?:^|\s)(?:main|content|main-content|maincontent|article|article-body|articlebody|post|post-content|post-body|entry|entry-content|story|story-body|body-text)(?:\s|$)", re.I)


def _words(name: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))


@lru_cache(1 << 16)
def _kind(name: str, attrs: str) -> tuple[str, str, int]:
    """An element's token, whether names mark it ("other", "header", "") and the bit it gives what it holds.

    Numbers in names don't count: id="post-12" is one token on all pages.
    """
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").strip() for m in _ATTR.finditer(attrs)}
    token = name + "".join(f"{sign}{'.'.join(sorted(re.sub('[0-9]+', '0', w) for w in found[a].split()))}" for a, sign in (("id", "#"), ("class", ".")) if found.get(a))
    role = found.get("role", "").lower()
    names = [_words(w) for a in ("class", "id") for w in found.get(a, "").split()]
    marked = lambda of: any(w & of and (w <= of | _NEUTRAL_WORDS or len(w & of) > 1) for w in names)
    if name in ("html", "body"):
        return token, "", 0
    if name == "article":
        return (token, "other", 0) if marked(_COMMENT_WORDS) else (token, "", ARTICLE)
    if name == "main" or role == "main":
        return token, "", MAIN
    if name in _OTHER_TAGS or role in _OTHER_ROLES or marked(_OTHER_WORDS):
        return token, "other", 0
    if name == "header" or any(w <= _HEADER_WORDS | _NEUTRAL_WORDS and w & _HEADER_WORDS for w in names):
        return token, "header", 0
    named = any(_MAIN_WORDS.search(found.get(a, "")) for a in ("class", "id"))
    return token, "", TITLE if name == "h1" else NAMED if named else 0


@dataclass(slots=True)
class Open:
    name: str
    path: int
    bits: int
    marks: tuple[int, ...]  # paths of the elements around, this one included, that names mark


@dataclass(slots=True)
class Block:
    text: str
    path: int
    bits: int
    marks: tuple[int, ...]

    @property
    def token(self) -> int:
        return _hash(self.path, "=" + self.text)


def _hash(parent: int, token: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}/{token}") >> 1


def _end_of(name: str, html: str, at: int) -> int:
    """Where a raw element ends: behind its end tag, or that of the outermost where they nest; at the page's end without one."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>", re.I).finditer(html, at):
        if m[1]:
            depth -= 1
        elif name in _NESTING and not (name in _SLASHED and m[0].endswith("/>")):
            depth += 1
        if not depth:
            return m.end()
    return len(html)


class Page:
    """A page read once, in time in proportion to its length: elements by path, and blocks of text in page order.

    elements: path -> [parent path, times, place of the first, bit, name, whether it has a class or id].
    """

    def __init__(self, html: str | None) -> None:
        self.elements: dict[int, list] = {}
        self.blocks: list[Block] = []
        self._read(html or "")

    def _read(self, html: str) -> None:
        stack = [Open("", 0, 0, ())]
        text: list[str] = []
        aside: list[tuple[str, Open]] = []  # marked inline elements inside a block
        owner = stack[0]
        opened: dict[str, int] = {}

        def add(raw: str, of: Open) -> None:
            if clean := " ".join(unescape(raw).split()):
                self.blocks.append(Block(clean, of.path, of.bits, of.marks))

        def flush() -> None:
            if text:
                add("".join(text), owner)
                text.clear()
            if aside:
                for raw, of in aside:
                    add(raw, of)
                aside.clear()

        def say(raw: str) -> None:
            nonlocal owner
            top = stack[-1]
            if text and (top.marks != owner.marks or top.bits != owner.bits):
                if len(top.marks) > len(owner.marks):
                    aside.append((raw, top))
                    return
                flush()
            if not text:
                owner = top
            text.append(raw)

        def close(ended, stop) -> bool:
            """Closes the innermost open element of some names, unless one of others comes first."""
            for n in ended:
                if opened.get(n):
                    break
            else:
                return False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ended:
                    for e in stack[k:]:
                        opened[e.name] -= 1
                    del stack[k:]
                    return True
                if stack[k].name in stop:
                    return False
            return False

        at, last = 0, html.rfind(">")  # behind the last ">" there is no tag
        while (lt := html.find("<", at)) >= 0:
            if lt > last:
                comment = html.find("<!--", lt)
                say(html[at : comment if comment >= 0 else len(html)])
                at = len(html)
                break
            m = _TAG.match(html, lt)
            if m is None:
                say(html[at : lt + 1])
                at = lt + 1
                continue
            if lt > at:
                say(html[at:lt])
            at = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["end"]:
                if name in _BLOCK:
                    flush()
                    close((name,), ())
                else:
                    close((name,), _BLOCK)
                continue
            if name == "br":
                say(" ")
                continue
            if name in _BLOCK:
                flush()
                if name not in ("option", "optgroup"):
                    close(("p",), _BUT_P)  # a block ends an open paragraph and what is in it
                if name in _ENDS:
                    close(*_ENDS[name])
            token, mark, bit = _kind(name, m["attrs"])
            top = stack[-1]
            path, bit = _hash(top.path, token), bit | (BOX if name in _BOXES else 0)
            if (known := self.elements.get(path)) is None:
                self.elements[path] = [top.path, 1, len(self.elements), bit, name, token != name]
            else:
                known[1] += 1
            slash = m["attrs"].endswith("/")  # it ends foreign elements; HTML ignores it, but pages write it on inline ones
            if name in _RAW:
                at = at if slash and name in _SLASHED else _end_of(name, html, at)
            elif name not in _VOID and len(stack) < DEEPEST and not (slash and name not in _BLOCK):
                marked = mark == "other" or (mark == "header" and not top.bits & (ARTICLE | MAIN | NAMED))
                stack.append(Open(name, path, top.bits | bit, (*top.marks, path) if marked else top.marks))
                opened[name] = opened.get(name, 0) + 1
        if at < len(html):
            say(html[at:])
        flush()

    def around_article(self) -> set[int]:
        """Paths of elements that hold <article> or <main>, whatever they are named."""
        out: set[int] = set()
        for parent, _, _, bit, *_ in self.elements.values():
            if bit & (ARTICLE | MAIN):
                while parent and parent not in out:
                    out.add(parent)
                    parent = self.elements[parent][0]
        return out

    def unmarked(self, wrappers: frozenset[int]) -> tuple[list[Block], bool]:
        """Blocks outside elements that names mark, and whether their container may be a teaser.

        Wrappers, elements that hold the article on the host's pages, aren't marked whatever their names. Nor are those
        around the page's own containers if all its containers lie in such, or if most of its text then lies in
        containers: so an article keeps its text however the layout around it is named, and a teaser in a sidebar stays one.
        """
        left = lambda ok: [b for b in self.blocks if all(m in ok for m in b.marks)]
        held = lambda blocks: sum(len(b.text) for b in blocks if b.bits & (ARTICLE | MAIN))
        plain = left(wrappers)
        if own := self.around_article() & {m for b in self.blocks for m in b.marks}:
            other = left(wrappers | own)
            if not held(plain) or held(other) - held(plain) > sum(len(b.text) for b in plain):
                return other, not held(plain)
        return plain, False

    def inside(self, path: int) -> set[int]:
        """Paths of an element and all that lie in it; parents come before what they hold."""
        out = {path} if path in self.elements else set()
        for p, (parent, *_) in self.elements.items():
            if parent in out:
                out.add(p)
        return out

    def article_at(self, path: int) -> int:
        """The <article> around an element or itself, if there is one; else the element."""
        at = path
        while at in self.elements:
            if self.elements[at][3] & ARTICLE:
                return at
            at = self.elements[at][0]
        return path

    def main_text(self, template: frozenset[int], wrappers: frozenset[int] = frozenset(), article: int | None = None) -> str:
        """The page's slots in its host's slot of the article: blocks that the template leaves there, and the <h1>.

        A page that has less than half of its slots there has another layout, as has any page of a host without a
        template: its article is the container that holds enough of its slots (<article>, then <main>, then named
        ones), or else all slots. A template that would leave nothing isn't this page's.
        """
        left, doubt = self.unmarked(wrappers)
        slots = [b for b in left if b.token not in template] or left
        whole = sum(len(b.text) for b in slots)
        if article is not None:
            there = self.inside(self.article_at(article))
            chosen = [b for b in slots if b.path in there]
            if chosen and 2 * sum(len(b.text) for b in chosen) >= whole:
                titles = [b for b in slots if b.bits & TITLE]
                return self.told([b for b in slots if b.path in there or (len(titles) == 1 and b is titles[0])])
        for bit in (ARTICLE, MAIN, NAMED):
            chosen = [b for b in slots if b.bits & bit]
            part = sum(len(b.text) for b in chosen)
            if chosen and (2 * part >= whole or (bit == ARTICLE and not (doubt or template) and 3 * part >= whole)):
                return self.told(chosen)
        return self.told(slots)

    def told(self, blocks: list[Block]) -> str:
        """The text of some blocks, without the discussion at their end."""
        return " ".join(b.text for b in blocks[: len(blocks) - self.discussion(blocks)])

    def discussion(self, blocks: list[Block]) -> int:
        """How many of the last blocks are a discussion, by structure and whatever it is named.

        It's made of records: an element with a class or id that is there LEAST_RECORDS times or more, with at least
        LEAST_PARTS elements that each record has once, one of them with a class or id or such that it tells who and when, two
        blocks of text or more, and no heading. The records' parent holds the last blocks and no others, and less than
        MOST_DISCUSSION of all text; so do elements around it that have hardly anything besides (MOST_BESIDE).
        """
        e = self.elements
        if not any(x[1] >= LEAST_RECORDS and (x[5] or x[4] == "article") for x in e.values()):
            return 0
        count, chars, first = Counter(), Counter(), {}
        for k, b in enumerate(blocks):
            count[b.path], chars[b.path] = count[b.path] + 1, chars[b.path] + len(b.text)
            first.setdefault(b.path, k)
        heads, top, parts, stamps = set(), {}, Counter(), Counter()
        for path, x in reversed(e.items()):  # what an element holds comes behind it
            parent = x[0]
            count[parent], chars[parent] = count[parent] + count[path], chars[parent] + chars[path]
            if path in first:
                first[parent] = min(first[path], first.get(parent, first[path]))
            if x[4] in _HEADINGS or path in heads:
                heads.add(parent)
        for path, x in e.items():
            top[path] = top[x[0]] if x[0] in e and e[x[0]][1] == x[1] else path
            if top[path] != path:
                parts[top[path]] += 1
                stamps[top[path]] += x[5] or x[4] in _STAMPS
        last = lambda p: count[p] and first[p] + count[p] == len(blocks) and chars[p] < MOST_DISCUSSION * chars[0]
        found = 0
        for path, x in e.items():
            record = x[1] >= LEAST_RECORDS and (x[5] or x[4] == "article") and x[4] not in _NO_RECORDS and path not in heads
            if record and parts[path] >= LEAST_PARTS and stamps[path] and count[path] >= 2 * x[1] and last(at := x[0]):
                records = chars[path]
                while at in e and last(e[at][0]) and chars[e[at][0]] - records < MOST_BESIDE * records:
                    at = e[at][0]
                if chars[at] - records < MOST_BESIDE * records:
                    found = max(found, count[at])
        return found


def host_of(url: Column) -> Column:
    """Host of a URL, lower case, without port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_FOUND = "array<struct<token:long,parent:long,kind:int,n:long,place:long,share:double>>"
_BLOCKS = "array<struct<token:long,path:long,size:int,marks:array<bigint>>>"


def structures(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page, found, blocks) for each page, without its texts: page is a hash of the html.

    found holds each distinct token once: elements by path (their parent's path as parent), and texts with the path
    they lie in; n is how often the token occurs, place where it first does, share its part of the page's characters.
    Wrappers are elements that hold an <article> or <main>. blocks holds token, path, length and marks of each block.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))
    token = [("token", pa.int64()), ("parent", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("place", pa.int64()), ("share", pa.float64())]
    block = [("token", pa.int64()), ("path", pa.int64()), ("size", pa.int32()), ("marks", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pages = [tokens_of(Page(text.as_py())) for text in batch.column(2)]
            found = _lists([p[0] for p in pages], token)
            blocks = _lists([[(t, b.path, len(b.text), b.marks) for t, b in p[1]] for p in pages], block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, blocks], ["host", "page", "found", "blocks"])

    return rows.mapInArrow(run, f"host string, page long, found {_FOUND}, blocks {_BLOCKS}")


def _lists(rows: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """Lists of structs, made by field."""
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), structs)


def _rows(column: pa.ListArray) -> Iterator[Iterator[tuple]]:
    """The structs of each list, as tuples."""
    flat, at = column.flatten(), np.asarray(column.offsets)
    fields = [flat.field(k).to_pylist() for k in range(flat.type.num_fields)]
    for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True):
        yield zip(*(f[a:b] for f in fields), strict=True)


def tokens_of(page: Page) -> tuple[list[list], list[tuple[int, Block]]]:
    """Distinct tokens of a page as [token, parent, kind, n, place, share], and each block with its token."""
    around, size = page.around_article(), sum(len(b.text) for b in page.blocks)
    found = {p: [p, e[0], WRAPPER if p in around else HOLDER if e[3] & BOX else ELEMENT, e[1], e[2], 0.0] for p, e in page.elements.items()}
    parts = [(b.token, b) for b in page.blocks]
    for t, b in parts:
        if b.bits & ARTICLE:  # no template's, however many articles repeat it
            continue
        one = found.setdefault(t, [t, b.path, TEXT, 0, len(page.elements), 0.0])
        one[3] += 1
        one[5] += len(b.text) / size
    return list(found.values()), parts


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, once, wrappers) from structures(): the template of each host that has one.

    A token's occurrence vector, how often it is on each page of its host, is kept as the number of its pages and two
    sums of hashes of page and count: equal vectors have equal sums, and no page is gathered with another. Pages of one
    host with equal html count once. Tokens of one vector are a class. Classes of LEAST_TOKENS or more on at least
    LEAST_PAGES pages and LEAST_SHARE of the host's are valid if ordered (by mean place no two of their elements fall
    together) and nested: what their elements lie in, where it isn't of the class itself, is one other class. The
    template of a host is all its valid classes, each nested in the one that holds its parents; once are the elements
    that each of their pages has once and that can hold an article. Texts of a class are left out of it without evidence of slots that vary beside
    them (LEAST_TEXT_PAGES); texts in <article> are of no class.
    """
    once = pages.select("host", "page", "found").dropDuplicates(["host", "page"])
    found = once.select("host", "page", F.inline("found")).withColumn("mark", F.xxhash64("page", "n"))
    low = F.col("mark").bitwiseAND(F.lit((1 << 31) - 1))
    vectors = found.groupBy("host", "token").agg(
        F.max("kind").alias("kind"), F.max("parent").alias("parent"), F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum(low).alias("v"), F.sum(F.shiftrightunsigned("mark", 31)).alias("w"),
        F.avg("place").alias("place"), F.avg("share").alias("share"),
    )
    sizes = pages.groupBy("host").agg(F.countDistinct("page").alias("of"))
    often = vectors.where(F.col("pages") >= LEAST_PAGES).join(sizes, "host").where(F.col("pages") >= F.col("of") * LEAST_SHARE)
    is_text = F.col("kind") == TEXT
    member = F.struct("token", "parent", "kind", (F.col("n") == F.col("pages")).alias("single"))
    classes = often.groupBy("host", "pages", "v", "w").agg(
        F.collect_list(member).alias("t"), F.min("token").alias("class"), F.count_if(~is_text).alias("elements"), F.countDistinct(F.when(~is_text, F.col("place"))).alias("places"),
        F.sum(F.when(is_text, F.col("share"))).alias("held"),
    )
    ordered = cut(classes.where((F.size("t") >= LEAST_TOKENS) & (F.col("places") == F.col("elements"))).drop("v", "w"), "classes")
    members = ordered.select("host", "class", F.inline("t"))
    elements = members.where(~is_text).select("host", "class", "token", "parent")
    above = elements.select("host", F.col("token").alias("parent"), F.col("class").alias("up"))
    up = elements.join(above, ["host", "parent"], "left").where(~F.col("class").eqNullSafe(F.col("up")))
    nests = up.groupBy("host", "class").agg(F.countDistinct(F.coalesce("up", F.lit(-1))).alias("ups"))
    valid = ordered.join(nests, ["host", "class"], "left").where(F.coalesce("ups", F.lit(0)) <= 1)
    known = F.filter("t", lambda m: (m["kind"] < TEXT) | ((F.col("pages") >= LEAST_TEXT_PAGES) & (F.col("held") <= MOST_TEXT)))
    tokens = lambda of: F.transform(of, lambda m: m["token"])
    kept = valid.select("host", known.alias("t"))
    return kept.groupBy("host").agg(
        F.flatten(F.collect_list(tokens(F.col("t")))).alias("tokens"),
        F.flatten(F.collect_list(tokens(F.filter("t", lambda m: m["single"] & m["kind"].isin(HOLDER, WRAPPER))))).alias("once"),
        F.flatten(F.collect_list(tokens(F.filter("t", lambda m: m["kind"] == WRAPPER)))).alias("wrappers"),
    )


def _with_templates(rows: DataFrame, found: DataFrame, size: int, salt: Column, parts: tuple[str, ...]) -> tuple[DataFrame, Callable]:
    """Rows, and how a task gets the template's parts of a row's host: (batch, row, host) -> parts, or None without a template.

    Workers get the templates once while they have MOST_BROADCAST tokens together or fewer; else they come with the rows.
    """
    if size <= MOST_BROADCAST:
        shared = rows.sparkSession.sparkContext.broadcast({r["host"]: r[1:] for r in found.select("host", *parts).collect()})
        return rows, lambda batch, k, host: shared.value.get(host)
    # a host can hold a third of all pages: its template is repeated for each salt
    salted = found.select("host", *parts).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    joined = rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").select(*rows.columns, *parts)
    at = len(rows.columns)
    return joined, lambda batch, k, host: None if batch.column(at)[k].as_py() is None else tuple(batch.column(at + i)[k].as_py() for i in range(len(parts)))


def slot_text(elements: dict[int, int], blocks: list[tuple], tokens: frozenset[int], once: frozenset[int], wrappers: frozenset[int]) -> Counter:
    """Characters of slots in each template element that a page has once, by (path, depth); all of them at (0, 0)."""
    out: Counter = Counter()
    for token, path, size, marks in blocks:
        if token in tokens or any(m not in wrappers for m in marks):
            continue
        around, at = [], path
        while at:
            around.append(at)
            at = elements[at]
        out[0, 0] += size
        for depth, p in enumerate(reversed(around), 1):
            if p in once:
                out[p, depth] += size
    return out


def article_slots(pages: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """(host, article): the innermost template element, one a page, with over DOMINANT of its host's slot text.

    Over half of a host's slot text is in at most one of two elements that lie apart, so such elements lie in each
    other, and the innermost is the one with the least text.
    """
    rows = pages.select("host", F.transform(F.filter("found", lambda t: t["kind"] < TEXT), lambda t: F.struct(t["token"], t["parent"])).alias("e"), "blocks", "page")
    rows, template = _with_templates(rows, found, size, F.col("page"), ("tokens", "once", "wrappers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known: dict[str, list[frozenset] | None] = {}
            sums: dict[str, Counter] = {}
            elements, blocks = (list(_rows(batch.column(c))) for c in (1, 2))
            for k, host in enumerate(batch.column(0).to_pylist()):
                if host not in known:
                    parts = template(batch, k, host)
                    known[host] = parts and [frozenset(p) for p in parts]
                if known[host]:
                    sums.setdefault(host, Counter()).update(slot_text(dict(elements[k]), list(blocks[k]), *known[host]))
            out = [(h, p, d, n) for h, c in sums.items() for (p, d), n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int32(), pa.int64())], ["host", "path", "depth", "chars"])

    sums = rows.mapInArrow(run, "host string, path long, depth int, chars long").groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.max("depth").alias("depth"))
    sums = cut(sums, "sums")  # it's read twice
    whole = sums.where("path = 0").select("host", F.col("chars").alias("whole"))
    dominant = sums.where("path <> 0").join(whole, "host").where(F.col("chars") > F.col("whole") * DOMINANT)
    return dominant.groupBy("host").agg(F.max(F.struct(-F.col("chars"), "depth", "path"))["path"].alias("article"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page: the article's blocks in page order, joined by one space.

    The template of a host is deduced from its pages (templates()); what it leaves of a page are slots, and the slot of
    the article is where most of the host's slot text lies (article_slots()), or the <article> around that. Names check
    the slots: parts that elements or names mark as menus, headers, footers, sidebars, notices, adverts, forms or
    comments are left out, unless they hold the article on the host's pages; without a template, as for hosts of one
    page, they and the containers decide alone (Page.main_text()). Discussions at the end of an article are also told by their structure
    (Page.discussion()). Texts in <article> stay, even if all pages of a host repeat them. Character references are decoded, white space in a block is one space, scripts,
    styles and comments are no text. Null and empty pages have empty text; a null or odd url is a host of its own name,
    ''. Repeated rows get equal results, and count once in a template, an empty table gives none, extra columns are not read.
    """
    known = cut(structures(pages, url, html), "structures")
    found = cut(templates(known), "templates")
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    slots = cut(article_slots(known, found, size), "slots")
    found = found.join(slots, "host", "left").select("host", "tokens", "wrappers", "article")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    rows, template = _with_templates(rows, found, size, F.xxhash64("page_id", "url"), ("tokens", "wrappers", "article"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, tuple] = {}
        for batch in slices(batches):
            texts = []
            for k, host in enumerate(batch.column(3).to_pylist()):
                if host not in hosts:
                    if len(hosts) > 1000:
                        hosts.clear()
                    tokens, wrappers, article = template(batch, k, host) or ((), (), None)
                    hosts[host] = frozenset(tokens), frozenset(wrappers), article
                texts.append(Page(batch.column(2)[k].as_py()).main_text(*hosts[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
