"""Main text of web pages by container paths that a host's pages agree on."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textsluice.llm.common import arrow_map, kept, sliced

#: A path is used on a page where its text has so great a share of what the page's own best path gives.
FAIR = 0.4
#: Copies of a path's votes, so that pages of one host spread over tasks.
SALTS = 16

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
CLASSES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold others; a path names these only.
CONTAINERS = frozenset("body main article section div td aside nav header footer form menu dialog ul ol dl table "
                       "figure blockquote details fieldset button select head".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th pre br hr figcaption summary address legend tbody thead tfoot caption option "
                                "center html".split())
#: Elements that are never part of an article.
ASIDE = frozenset("nav footer aside form menu dialog button select head".split())
#: Words that put an element aside wherever they stand in its name ...
OUT_ANYWHERE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus reply replies sidebar "
                         "cookie cookies consent newsletter breadcrumb breadcrumbs popup modal overlay".split())
#: ... or as its last word, which says what the thing is: a post-footer is a footer,
#: a social-network-history is a history.
OUT_LAST = frozenset("banner notice notices alert share sharing social related recommended respond nav navbar navigation footer header masthead widget "
                     "subscribe login signup pagination pager toolbar complementary contentinfo search form alertdialog menubar".split())
#: First words of names that tell of a state and not what the thing is.
STATES = frozenset("has no with is without not".split())
WORDS_IN = frozenset("article content main post entry story text".split())
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What a character counts for in an element of a kind.
WEIGHTS = {"article": 4.0, "main": 3.0, "body": 0.5}
#: How surely an element is aside: by its tag or a plain name, or by the last word alone.
SURE, LIKELY = 2, 1


def aside_by_name(names: list[str], inside: bool) -> int:
    """Whether class, id or role names put an element aside.  ``inside``: it lies
    in an article or main element, where a header is the article's own."""
    worst = 0
    for name in names:
        words = [w.lower() for w in LETTERS.findall(name)]
        if not words or words[0] in STATES:
            continue
        if not OUT_ANYWHERE.isdisjoint(words):
            return SURE
        if words[-1] in OUT_LAST and not (words[-1] == "header" and (inside or not WORDS_IN.isdisjoint(words))):
            worst = LIKELY
    return worst


class Page:
    """Containers in page order and the text pieces in them.

    A container's path is a number made of its parent's path and its own shape,
    so nesting costs nothing, however deep.
    """

    def __init__(self, html: str):
        self.parent, self.path, self.out, self.weight, self.stop = [-1], [0], [0], [0.25], [0]
        self.pieces: list[tuple[int, str, bool, int]] = []
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: Counter[str] = Counter()
        #: elements put aside that are no containers: tag, containers open there, same tags open in it, how surely
        self.muted: list[list] = []
        links, at, last = 0, 0, html.rfind(">") + 1
        find, add = TOKEN.search, self.pieces.append
        while at < len(html):
            found = find(html, at) if at < last else None
            text = html[at:found.start() if found else len(html)]
            if text:
                add((self.stack[-1][1], entities.unescape(text), links > 0, max((m[3] for m in self.muted), default=0)))
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if tag in BLOCKS:
                add((self.stack[-1][1], " ", False, 0))
            if found[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in CONTAINERS:
                    self._close(tag)
                elif self.muted:
                    self._unmute(tag)
            elif tag in RAW and not found[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            else:
                links += tag == "a"
                if tag in CONTAINERS:
                    if tag == "body":               # a head left open ends here
                        while len(self.stack) > 1 and self.stack[-1][0] == "head":
                            self._pop()
                    if self.muted:
                        self._mute(tag, 0)
                    self._open(tag, found[3])
                elif tag not in VOID and (self.muted or "=" in found[3] or "hidden" in found[3]):
                    self._mute(tag, self._aside(tag, found[3])[0])
        while self.stack:
            self._pop()

    def _aside(self, tag: str, attributes: str) -> tuple[int, list[tuple[str, str]]]:
        """How surely the element is aside, and its names with the kind of each."""
        if not attributes:
            return 0, []
        names = [(kind.lower(), name) for kind, value in CLASSES.findall(attributes) for name in value.strip("\"'").split()]
        if HIDDEN.search(attributes):
            return SURE, names
        inside = self.open["article"] + self.open["main"] > 0
        return 0 if tag in ("body", "main", "html") else aside_by_name([n for _, n in names], inside), names

    def _open(self, tag: str, attributes: str) -> None:
        up = self.stack[-1][1]
        aside, names = self._aside(tag, attributes)
        if tag in ASIDE or tag == "header" and not self.open["article"] + self.open["main"]:
            aside = SURE
        words = {w.lower() for _, name in names for w in LETTERS.findall(name)}
        shape = ".".join([tag, *sorted({re.sub(r"\d+", "#", name) for kind, name in names if kind == "class"})])
        self.parent.append(up)
        self.path.append(xxhash.xxh64_intdigest(shape.encode(), self.path[up]))
        self.out.append(max(self.out[up], aside, *(m[3] for m in self.muted)) if self.muted else max(self.out[up], aside))
        self.weight.append(WEIGHTS.get(tag, 1.0 if words.isdisjoint(WORDS_IN) else 2.0))
        self.stop.append(0)
        self.stack.append((tag, len(self.path) - 1))
        self.open[tag] += 1

    def _pop(self) -> None:
        tag, k = self.stack.pop()
        self.stop[k] = len(self.path)
        self.open[tag] -= 1
        while self.muted and self.muted[-1][1] > len(self.stack):
            self.muted.pop()

    def _close(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def _mute(self, tag: str, aside: int) -> None:
        """A paragraph ends at any block, a list item at the next one."""
        here = len(self.stack)
        while self.muted and self.muted[-1][1] == here and (self.muted[-1][0] == "p" and tag in BLOCKS or self.muted[-1][0] == tag == "li"):
            self.muted.pop()
        if aside:
            self.muted.append([tag, here, 0, aside])
        elif self.muted and self.muted[-1][:2] == [tag, here]:
            self.muted[-1][2] += 1

    def _unmute(self, tag: str) -> None:
        for k in range(len(self.muted) - 1, -1, -1):
            if self.muted[k][0] == tag and self.muted[k][1] == len(self.stack):
                if self.muted[k][2]:
                    self.muted[k][2] -= 1
                else:
                    del self.muted[k:]
                return

    def least(self) -> int:
        """What is left out: what is likely or surely aside; only the latter where
        the page has no other text."""
        for level in (LIKELY, SURE):
            if any(not p[2] and max(p[3], self.out[p[0]]) < level and p[1].strip() for p in self.pieces):
                return level
        return LIKELY

    def paths(self, level: int | None = None) -> list[tuple[int, list[int]]]:
        """(path, its containers) by falling score, those marked aside left out; of
        equal ones the one that comes first in the page, so the outer one.  Only
        paths whose text has a ``FAIR`` share of the best one's.

        A path's score is the sum over its containers of characters outside links,
        by weight.  A path names all that a container lies in, so none of them
        lies in another.
        """
        level, size = level or self.least(), [0] * len(self.path)
        for k, text, linked, muted in self.pieces:
            if max(muted, self.out[k]) < level and not linked:
                size[k] += len(text.strip())
        for k in range(len(size) - 1, 0, -1):
            size[self.parent[k]] += size[k]
        found: dict[int, list] = {}
        for k, path in enumerate(self.path):
            if self.out[k] < level and size[k]:
                one = found.setdefault(path, [0.0, 0, []])
                one[0] += size[k] * self.weight[k]
                one[1] += size[k]
                one[2].append(k)
        ranked = sorted(found.items(), key=lambda x: (-x[1][0], x[1][2][0]))
        return [(path, at) for path, (_, chars, at) in ranked if chars >= FAIR * ranked[0][1][1]]

    def text(self, among: list[int], level: int) -> str:
        """Text of containers in page order, white space, block and container ends as one space."""
        parts: list[list[str]] = [[] for _ in among]
        for n, t, _, muted in self.pieces:
            at = bisect_right(among, n) - 1
            if at >= 0 and n < self.stop[among[at]] and max(muted, self.out[n]) < level:
                parts[at].append(t)
        return " ".join(" ".join("".join(part) for part in parts).split())


def host_of(url: str = "url"):
    """The host of a url in lower case, without port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def _paths(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    found = [[_signed(path) for path, _ in Page(html).paths()] for html in batch.column(3).to_pylist()]
    yield from sliced([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int64()))], ["key", "check", "host", "paths"])


def main_text(html: str, path: int | None = None) -> str:
    """Text of all containers on ``path`` where the page has it with a fair share
    of its text, on its own best path otherwise."""
    page = Page(html)
    level = page.least()
    paths = page.paths(level)
    wanted = next((at for p, at in paths if _signed(p) == path), paths[0][1] if paths else [])
    return page.text(wanted, level)


def _texts(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    texts = [main_text(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
    yield from sliced([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_choices(found: DataFrame) -> DataFrame:
    """(key, check, path): for pages (key, check, host, paths) another of a page's
    paths, where more of its host's pages have that as their best one.

    Every page votes for its best path.  All votes of a host count, and a page
    looks up only its own paths, so hosts may have any number of layouts.
    """
    salt = F.pmod("key", F.lit(SALTS)).cast("int")
    votes = found.groupBy("host", F.col("paths")[0].alias("path")).agg(F.count("*").alias("votes")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = found.where(F.size("paths") > 1).select("key", "check", "host", salt.alias("salt"), F.posexplode("paths").alias("place", "path"))
    best = F.max_by(F.struct("place", "path"), F.struct("votes", -F.col("place")))
    return (own.join(votes, ["host", "salt", "path"]).groupBy("key", "check").agg(best.alias("best"))
            .where("best.place > 0").select("key", "check", "best.path"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html).

    Each page scores its containers' paths and votes for the best; a page then
    takes, of its paths with a fair share of its text, the one with most votes of
    its host.  Only pages for which that is not their own best path are joined
    back, so Spark need not shuffle pages where these are few.

    A null or empty html gives an empty text; a null url counts as a host of its
    own.  Rows with null or repeated ids give one row each; an empty table gives
    none.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), host_of().alias("host"),
                        F.xxhash64("page_id", "url", html).alias("key"), F.xxhash64(F.lit(1), html, "url").alias("check"))
    found = kept(arrow_map(rows.select("key", "check", "host", "html"), _paths, "key long, check long, host string, paths array<bigint>").where(F.size("paths") > 0),
                 "page-paths")
    joined = rows.join(host_choices(found), ["key", "check"], "left").select("page_id", "url", "html", "path")
    return arrow_map(joined, _texts, "page_id long, url string, text string")
