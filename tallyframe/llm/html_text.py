"""Main text of HTML pages by consensus host paths.

1. Every page's containers are scored: text outside boilerplate that lies in
   their paragraphs, less what is inside links.
2. The best container, widened to the article that it is part of, has a path -
   tags with classes, digits generalised - that is the page's vote.  Spark adds up
   votes per host and path and picks the winner.
3. Every page is extracted anew: the containers on its host's winning path choose
   the region; where the page has none, or hardly any of its text there, its own
   best does.  The region is the smallest container around all that was chosen,
   widened to its article, and is kept whole, with the text that stands beside it
   in the elements around it (a title, a lead); only boilerplate goes.

Boilerplate is what an element of that kind holds (nav, footer, form, ...) or one
with a class or role that is a boilerplate word as a whole; an id counts only outside
articles and never on what an author writes (headings, paragraphs, lists' items).

Pages are read by a linear tokenizer and a stack of open elements; one page is in
memory at a time.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.words import plain
from tallyframe.session import stage

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body option caption td th tr tbody thead tfoot legend summary".split())
CONTAINER = frozenset("article main section div td body center blockquote".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select input label fieldset head object audio video canvas map".split()) | RAW
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
         "tbody": {"table"}, "tfoot": {"table"}}
HIDES_P = CONTAINER | {"button", "table", "td", "th"}
# Words that mark boilerplate where they make up a whole class, id or role.
BOILERPLATE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside widget widgets ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner notice notices alert cookie cookies consent gdpr popup modal overlay "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe signup "
    "login search pagination pager skip complementary contentinfo sidenav submenu toolbar adbox adslot adunit adsense copyright colophon feedback".split())
# Words that only say where or how such a part is laid out.
PLACE = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer first last sub mini mobile desktop sticky fixed "
    "box bar list wrap wrapper container area block section item items link links unit slot post posts entry form policy panel region "
    "row col column group holder module component text title body content icon icons button buttons icn js u c m l".split())
# Elements whose id never marks boilerplate: what an author writes.
WRITTEN = frozenset("h1 h2 h3 h4 h5 h6 section p blockquote li dt dd pre figure figcaption table td th tr a span b i em strong code".split())
# Ids of the readers' part, which stands inside articles too.
READERS = frozenset("comment comments commentlist disqus respond replies discussion".split())
# Elements that are a part of what encloses them.
PARTS = ("section", "blockquote")

_COMMON = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:="[^"<>]*+")?+)*+)\s*+(/?)>""")
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:="([^"]*+)")?+""")
_GAP = re.compile(r"[\s/]*+")
_KEY = re.compile(r"=?+[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_NAME = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_MAIN_CLASS = re.compile(r"(?:content|article|post|entry|story|main|body)(?:[-_]#)?$")


def tags(source: str):
    """(text before, name, attributes as (key, value), closing, self-closing) of every
    tag, and the text behind the last one; comments, declarations and the contents
    of raw elements go.  Attribute values end where the HTML standard says: an
    unquoted one at white space or ``>``, whatever quotes are in it.  A quote that is
    never closed opens no value.  Linear in the length of the page."""
    n = len(source)
    last = {'"': source.rfind('"'), "'": source.rfind("'")}
    at = begin = 0
    parts: list[str] = []  # text since the last tag
    while True:
        i = source.find("<", at)
        if i < 0 or i + 1 >= n:
            parts.append(source[begin:])
            yield "".join(parts), "", [], False, False
            return
        nxt = source[i + 1]
        if nxt in "!?" or nxt == "/" and not source[i + 2: i + 3].isalpha():
            mark = "-->" if source.startswith("<!--", i) else ">"
            end = source.find(mark, i + 2)
            parts.append(source[begin:i])
            # an open comment hides all that follows
            at = begin = n if end < 0 else end + len(mark)
            continue
        if not (nxt == "/" or nxt.isascii() and nxt.isalpha()):
            at = i + 1  # a sign in the text
            continue
        m = _COMMON.match(source, i)
        if m:
            closing, name, own, end = bool(m[1]), m[2].lower(), bool(m[4]), m.end()
            attrs = [(k.lower(), v) for k, v in _ATTR.findall(m[3])] if m[3] and not closing else []
        else:
            closing = nxt == "/"
            m = _BARE_NAME.match(source, i + 1 + closing)
            name, p, attrs, own = m[0].lower(), m.end(), [], False
            while True:
                gap = _GAP.match(source, p).end()
                own = source.find("/", p, gap) >= 0
                p = gap
                if p >= n or source[p] == ">":
                    break
                m = _KEY.match(source, p)
                key, p, value = m[0].lower(), max(m.end(), p + 1), ""
                if m := _EQUALS.match(source, p):
                    p = m.end()
                    quote = source[p: p + 1]
                    if quote in last and quote and p < last[quote]:
                        close = source.index(quote, p + 1)
                        value, p = source[p + 1: close], close + 1
                    else:
                        m = _BARE.match(source, p)
                        value, p = m[0], m.end()
                attrs.append((key, value))
            end = min(p + 1, n)
        parts.append(source[begin:i])
        at = begin = end
        if name in RAW and not closing and not own:  # goes with all that is in it
            m = _RAW_END[name].search(source, end)
            at = begin = m.end() if m else n
            continue
        yield "".join(parts), name, attrs, closing, own
        parts = []


_BARE_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")


def marks_boilerplate(value: str) -> bool:
    """Whether one of the tokens of a class, id or role is boilerplate as a whole:
    ``ad``, ``site-nav``, ``comment-list``, but not ``comment-free`` or ``with-sidebar``."""
    for token in value.lower().split():
        words = set(_NAME.findall(token))
        if not words.isdisjoint(BOILERPLATE) and words <= BOILERPLATE | PLACE:
            return True
    return False


class Container:
    """An open or closed element that may hold the main text; ``beside`` has the
    places of its unlinked text outside inner containers.  ``node`` is its path in
    the page's tree of paths."""

    __slots__ = ("page", "node", "tag", "article", "first", "last", "parent", "text", "linked", "own", "beside")

    def __init__(self, page: Page, node: int, tag: str, article: bool, first: int, parent: Container | None = None):
        self.page, self.node, self.tag, self.article, self.first, self.last, self.parent = page, node, tag, article, first, -1, parent
        self.text = self.linked = self.own = 0
        self.beside: list[int] = []

    @property
    def path(self) -> str:
        return self.page.path(self.node)

    def around(self) -> list[Container]:
        """The containers around this one, from the inside out."""
        out, box = [], self.parent
        while box is not None:
            out.append(box)
            box = box.parent
        return out


class Page:
    """The blocks of a page's text outside boilerplate, and its containers.

    ``pieces`` are text runs, with None where a block ends; a container covers
    the pieces ``first:last``.  Paths are nodes of a tree of labels (tag and
    classes); the work per tag does not depend on how deep it lies."""

    def __init__(self, source: str):
        self.pieces: list[str | None] = []
        self.containers: list[Container] = []
        self.root = Container(self, 0, "", False, 0)
        self._labels: list[tuple[int, str]] = [(-1, "")]  # parent node, label
        self._nodes: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, Container | None, bool, bool, int]] = []  # name, container, dropped, link, node
        self._open: list[Container] = [self.root]
        self._places: dict[str, list[int]] = {}  # where in the stack a name is open
        self._blocks: list[int] = []  # and where blocks are
        self._dropped = self._links = 0
        self._total = self._linked = 0
        for text, name, attrs, closing, own in tags(source):
            if text:
                self._text(text)
            if name:
                if closing:
                    self._end(name)
                else:
                    self._start(name, attrs, own)
        while self._stack:
            self._pop()
        self.root.last, self.root.text = len(self.pieces), self._total

    def _text(self, raw: str) -> None:
        if self._dropped:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        n = len(text) - text.count(" ") if not text.isspace() else 0
        if n:
            self._total += n
            if self._links:
                self._linked += n
            else:
                box = self._open[-1]
                box.own += n
                box.beside.append(len(self.pieces) - 1)

    def _start(self, name: str, attrs, own: bool = False) -> None:
        if name == "br":
            if not self._dropped:
                self.pieces.append(" ")
            return
        if name in CLOSES_P:
            self._close("p", HIDES_P)
        if name in SIBLINGS:
            for other in SIBLINGS[name]:
                self._close(other, SCOPE[name])
        if name in BLOCK and not self._dropped:
            self.pieces.append(None)
        if name in VOID or own and name not in BLOCK:
            return
        classes: list[str] = []
        dropped = name in DROPPED
        for key, value in attrs:
            if key == "class":
                classes += sorted(re.sub(r"\d+", "#", v).replace(">", "") for v in value.lower().split())
            if dropped or not value or name in ("html", "body", "article", "main"):
                continue
            if key in ("class", "role"):
                dropped = marks_boilerplate(value)
            elif key == "id" and name not in WRITTEN:
                # the parts of an article are named by its author: no id counts there but the readers'
                dropped = marks_boilerplate(value) and (not self._places.get("article") or name == "div" and not READERS.isdisjoint(_NAME.findall(value.lower())))
        label = name + "".join("." + v for v in classes)
        article = name in ("article", "main") or name in CONTAINER and name != "body" and any(_MAIN_CLASS.match(v) for v in classes)
        parent = self._stack[-1][4] if self._stack else 0
        node = self._nodes.setdefault((parent, label), len(self._labels))
        if node == len(self._labels):
            self._labels.append((parent, label))
        box = None
        if name in CONTAINER and not self._dropped and not dropped:
            box = Container(self, node, name, article, len(self.pieces), self._open[-1])
            box.text, box.linked = -self._total, -self._linked
            self.containers.append(box)
            self._open.append(box)
        self._dropped += dropped
        self._links += name == "a"
        self._places.setdefault(name, []).append(len(self._stack))
        if name in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append((name, box, dropped, name == "a", node))

    def _pop(self) -> None:
        name, box, dropped, link, _ = self._stack.pop()
        self._places[name].pop()
        self._dropped -= dropped
        self._links -= link
        if box is not None:
            self._open.pop()
            box.last = len(self.pieces)
            box.text += self._total
            box.linked += self._linked
        if name in BLOCK:
            self._blocks.pop()
            if not self._dropped:
                self.pieces.append(None)

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            node, label = self._labels[node]
            out.append(label)
        return ">".join(reversed(out))

    def node(self, path: str) -> int | None:
        """The node of a path, if the page has it."""
        at: int | None = 0
        for label in path.split(">"):
            at = self._nodes.get((at, label))
            if at is None:
                return None
        return at

    def _close(self, name: str, scope) -> None:
        """Close an open ``name`` that no element of ``scope`` hides."""
        at = self._places.get(name)
        if at and all(not (p := self._places.get(other)) or p[-1] < at[-1] for other in scope):
            place = at[-1]
            while len(self._stack) > place:
                self._pop()

    def _end(self, name: str) -> None:
        if name == "br":
            self._start("br", [])
            return
        at = self._places.get(name)
        # a stray inline end tag closes no block
        if at and (name in BLOCK or not self._blocks or self._blocks[-1] < at[-1]):
            place = at[-1]
            while len(self._stack) > place:
                self._pop()

    def best(self) -> Container | None:
        """The article of the container with the highest score; the outer one of
        equal ones."""
        box = max(self.containers, key=lambda c: (score(c), -c.first), default=None)
        return None if box is None else whole(box)

    def enclosing(self, boxes: list[Container]) -> Container:
        """The article of the smallest container around all of ``boxes``."""
        first, last = min(c.first for c in boxes), max(c.last for c in boxes)
        return whole(next((c for c in [boxes[0], *boxes[0].around()] if c.first <= first and c.last >= last), self.root))

    def text(self, region: Container) -> str:
        """The blocks of a region and those beside it in the containers around
        it, in page order."""
        spans = [(region.first, region.last)]
        upto = 0
        for i in sorted(i for c in region.around() for i in c.beside):
            if i >= upto:
                first, upto = i, i + 1
                while first and self.pieces[first - 1] is not None:
                    first -= 1
                while upto < len(self.pieces) and self.pieces[upto] is not None:
                    upto += 1
                spans.append((first, upto))
        out = []
        for first, last in sorted(spans):
            run: list[str] = []
            for piece in [*self.pieces[first:last], None]:
                if piece is not None:
                    run.append(piece)
                elif run:
                    if block := " ".join("".join(run).split()):
                        out.append(block)
                    run = []
        return " ".join(out)


def whole(box: Container) -> Container:
    """The outermost article around a container (by element or class), else the
    container; a part is widened to what it is a part of."""
    for c in box.around():
        if c.article:
            box = c
    while box.tag in PARTS and box.parent is not None:
        box = box.parent
    return box


def score(box: Container) -> float:
    """Text of the container's own blocks counts whole, that of inner containers
    little; linked text counts against it."""
    own, inner = box.own, box.text - box.linked - box.own
    return (1.5 if box.article else 1.0) * (own + 0.35 * inner) * (1 - box.linked / max(box.text, 1))


def host_of(url):
    """The lower-case host of a URL column, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _votes(batches):
    for batch in batches:
        tally: dict[tuple[str, str], list[int]] = {}
        for host, source in zip(batch.column(0).to_pylist(), plain(batch.column(1)).to_pylist(), strict=True):
            page = Page(source)
            best = page.best()
            if best is not None and best.text:
                cell = tally.setdefault((host, best.path), [0, 0])
                cell[0] += 1
                cell[1] += best.text
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()),
             pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.int64())], ["host", "path", "votes", "chars"])


def extract(source: str, path: str | None) -> str:
    """The main text of one page under its host's winning path."""
    page = Page(source)
    best = page.best()
    if best is None:
        return page.text(page.root)  # no container at all: everything outside boilerplate
    node = page.node(path) if path else None
    chosen = [c for c in page.containers if c.node == node and c.text] if node else []
    if not chosen or page.enclosing(chosen).text < 0.5 * best.text:
        chosen = [best]
    if best.tag in ("article", "main"):
        # the page's own articles are never cut
        chosen += [best, *(c for c in page.containers if c.tag == best.tag and c.text)]
    return page.text(page.enclosing(chosen))


def _extracts(batches):
    for batch in batches:
        texts = [extract(s, p) for s, p in zip(plain(batch.column(2)).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row of ``pages``.

    Null or empty html gives an empty text; pages without a host vote together;
    repeated rows are separate pages; other columns are not looked at.  White
    space inside a block becomes one space, blocks are joined by one space.  An
    empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    votes = (rows.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, votes long, chars long")
             .groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars")))
    # paths of a host, not pages: a few rows for each
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("chars"), "path")
    winners = stage(votes.withColumn("r", F.row_number().over(order)).filter("r = 1").select("host", "path"), "paths")
    found = rows.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left").select("page_id", "url", "html", "path")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return found.mapInArrow(_extracts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
