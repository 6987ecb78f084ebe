"""HTML trees, links, images and per-tag texts of pages, in Arrow batches."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from ..session import bounded_batches

#: Classes and tags whose elements hold no page text (fixed values).
BANNED_CLASSES = frozenset("reference reflist navbox vertical-navbox metadata mw-editsection catlinks toc hatnote thumb magnify noprint".split())
BANNED_TAGS = frozenset("""nav footer aside script style noscript template svg canvas iframe object embed head meta link base source
picture audio video track param form input textarea button select option datalist output label fieldset legend dialog menu portal sup""".split())
#: Tags whose texts are indexed, in the order in which their texts are embedded.
TEXT_TAGS = ("title", "h1", "h2", "strong", "b", "p", "li")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header
hgroup main menu nav ol p section summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr xmp plaintext search""".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("html table td th caption marquee object template applet".split())
#: Elements with rules of their own in the standard, which formatting doesn't reach through (fixed values).
_SPECIAL = frozenset("""address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir
div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link
listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary
table tbody td template textarea tfoot th thead title tr track ul wbr xmp""".split())
_SECTIONS = ("tbody", "tfoot", "thead")
_TABLE_TAGS = frozenset(("caption", "col", "colgroup", "tr", "td", "th", *_SECTIONS))
_TABLE_PARTS = frozenset(("table", "tr", *_SECTIONS))
_TABLE_SCOPE = frozenset(("html", "table", "template"))
#: What stays where it is in a table.
_IN_TABLE = _TABLE_TAGS | {"script", "style", "template", "form"}
_MARKED = ("applet", "marquee", "object")
_NO_REOPEN = frozenset("li dd dt script style template meta link title base noscript param source track".split())
#: Open elements, and formatting elements since the last marker.
MAX_OPEN, MAX_FORMATTING = 512, 64
_HEAD_ONLY = frozenset("base link meta title style script noscript template".split())


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("attrs", "children", "open", "parent", "tag")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.parent, self.children, self.open = tag, attrs or {}, parent, [], False

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


class TreeBuilder(HTMLParser):
    """A tree by the tree construction of the HTML standard, as far as running text goes: implied ends, formatting
    elements that open anew after their block ended, misnested ones by the adoption agency algorithm, tables with
    implied rows and sections, and content that is out of place there moved before the table.

    Two bounds keep the time in proportion to a page's size: MAX_OPEN open elements, beyond which an element has no
    content of its own, and MAX_FORMATTING formatting elements to open anew, of which the oldest go.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head = Node("head", parent=self.root)
        self.body = None
        self.root.children.append(self.head)
        self.stack: list[Node] = []
        self.opened: Counter = Counter()
        self._open(self.root)
        #: Active formatting elements; None is a marker, which cells and the like put before their own.
        self.formatting: list[Node | None] = []

    # the open elements

    def _open(self, node):
        node.open = True
        self.opened[node.tag] += 1
        self.stack.append(node)

    def _pop(self):
        node = self.stack.pop()
        node.open = False
        self.opened[node.tag] -= 1

    def _pop_to(self, node):
        while self.stack[-1] is not node:
            self._pop()
        self._pop()

    def _pop_until(self, tags):
        while self.stack[-1].tag not in tags:
            self._pop()

    def _in_scope(self, tags, stop=_SCOPE):
        """The innermost open element with one of the tags; None if one of stop is nearer."""
        if not any(self.opened[t] for t in tags):
            return None
        for n in reversed(self.stack):
            if n.tag in tags:
                return n
            if n.tag in stop:
                return None
        return None

    def _place(self, child, parent):
        """Puts an element or a string last into parent, or before the table where it has no place in it."""
        at = parent.children
        inside = child.strip() == "" if isinstance(child, str) else child.tag in _IN_TABLE
        if parent.tag in _TABLE_PARTS and not inside:
            table = next(n for n in reversed(self.stack) if n.tag == "table")
            parent = table.parent
            at = parent.children
            i = next(i for i in range(len(at) - 1, -1, -1) if at[i] is table)
            at.insert(i, child)
        else:
            at.append(child)
        if isinstance(child, Node):
            child.parent = parent

    def _push(self, tag, attrs):
        n = Node(tag, attrs)
        self._place(n, self.stack[-1])
        if tag not in _VOID and len(self.stack) < MAX_OPEN:
            self._open(n)
        return n

    def _close_p(self):
        p = self._in_scope(("p",), _SCOPE | {"button"})
        if p is not None:
            self._pop_to(p)

    def _body(self):
        if self.body is None:
            self.body = Node("body", parent=self.root)
            self.root.children.append(self.body)
            self._pop_until(("html",))
            self._open(self.body)

    # formatting elements

    def _reopen(self):
        f = self.formatting
        if not f or f[-1] is None or f[-1].open or len(self.stack) >= MAX_OPEN:
            return
        i = len(f) - 1
        while i and f[i - 1] is not None and not f[i - 1].open:
            i -= 1
        for k in range(i, len(f)):
            f[k] = self._push(f[k].tag, dict(f[k].attrs))

    def _since_marker(self):
        f = self.formatting
        i = len(f)
        while i and f[i - 1] is not None:
            i -= 1
        return i

    def _format(self, tag, attrs):
        self._reopen()
        f, start = self.formatting, self._since_marker()
        alike = [i for i in range(start, len(f)) if f[i].tag == tag and f[i].attrs == attrs]
        if len(alike) >= 3:  # at most three alike are kept
            del f[alike[0]]
        elif len(f) - start >= MAX_FORMATTING:
            del f[start]
        f.append(self._push(tag, attrs))

    def _to_marker(self):
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _listed(self, node):
        return next((i for i in range(len(self.formatting) - 1, -1, -1) if self.formatting[i] is node), None)

    def _adopt(self, tag):
        """The end of a formatting element: what it holds of blocks that go on is dealt out between copies of it."""
        if self.stack[-1].tag == tag and self._listed(self.stack[-1]) is None:
            self._pop()
            return
        for _ in range(8):
            f, stack = self.formatting, self.stack
            at = next((i for i in range(len(f) - 1, self._since_marker() - 1, -1) if f[i].tag == tag), None)
            if at is None:
                self._other_end(tag)
                return
            own = f[at]
            if not own.open:
                del f[at]
                return
            here = next(i for i in range(len(stack) - 1, -1, -1) if stack[i] is own)
            if any(n.tag in _SCOPE for n in stack[here + 1 :]):
                return
            k = next((i for i in range(here + 1, len(stack)) if stack[i].tag in _SPECIAL), None)
            if k is None:
                self._pop_to(own)
                del f[at]
                return
            block = last = stack[k]
            above, mark, steps = stack[here - 1], at, 0
            while True:
                k, steps = k - 1, steps + 1
                node = stack[k]
                if node is own:
                    break
                listed = self._listed(node)
                if steps > 3 and listed is not None:
                    del f[listed]
                    mark -= listed < mark
                    listed = None
                if listed is None:
                    node.open = False
                    self.opened[node.tag] -= 1
                    del stack[k]
                    continue
                copy = Node(node.tag, dict(node.attrs), node.parent)
                copy.open, node.open = True, False
                f[listed] = stack[k] = copy
                if last is block:
                    mark = listed + 1
                self._move(last, copy)
                last = copy
            self._leave(last)
            self._place(last, above)
            copy = Node(own.tag, dict(own.attrs), block)
            copy.children, block.children = block.children, [copy]
            for c in copy.children:
                if isinstance(c, Node):
                    c.parent = copy
            at = self._listed(own)
            del f[at]
            f.insert(mark - (at < mark), copy)
            stack.remove(own)
            own.open, copy.open = False, True
            stack.insert(next(i for i in range(len(stack) - 1, -1, -1) if stack[i] is block) + 1, copy)

    @staticmethod
    def _leave(node):
        at = node.parent.children if node.parent else []
        i = next((i for i in range(len(at) - 1, -1, -1) if at[i] is node), None)
        if i is not None:
            del at[i]

    def _move(self, node, parent):
        self._leave(node)
        parent.children.append(node)
        node.parent = parent

    # tables

    def _close_cell(self):
        cell = self._in_scope(("td", "th", "caption"), _TABLE_SCOPE)
        if cell is not None:
            self._pop_to(cell)
            self._to_marker()

    def _table_tag(self, tag, attrs):
        if self._in_scope(("table",), _TABLE_SCOPE) is None:
            return
        self._close_cell()
        if tag in ("td", "th"):
            self._pop_until(("tr", *_SECTIONS, *_TABLE_SCOPE))
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
            if self.stack[-1].tag in _SECTIONS:
                self._push("tr", {})
        elif tag == "tr":
            self._pop_until((*_SECTIONS, *_TABLE_SCOPE))
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
        else:
            self._pop_until(_TABLE_SCOPE)
        if tag == "col":
            self._push("colgroup", {})
        self._push(tag, attrs)
        if tag in ("td", "th", "caption"):
            self.formatting.append(None)

    # what the tokenizer calls

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in ("html", "head"):
            return
        if tag == "body":
            self._body()
            return
        if self.body is None and tag in _HEAD_ONLY:
            if self.stack[-1] is self.root:
                self._open(self.head)
            self._push(tag, attrs)
            return
        self._body()
        if tag in _TABLE_TAGS:
            self._table_tag(tag, attrs)
            return
        if tag == "table" and self.stack[-1].tag in _TABLE_PARTS:
            self._pop_to(self._in_scope(("table",), _TABLE_SCOPE - {"table"}))
        if tag in _CLOSES_P:
            self._close_p()
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self._pop()
        if tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.stack):
                if n.tag in same:
                    self._pop_to(n)
                    break
                if n.tag in _SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self._close_p()
        if tag in _FORMATTING:
            if tag == "a" and (old := next((n for n in self.formatting[self._since_marker() :] if n.tag == "a"), None)) is not None:
                self._adopt("a")
                if (i := self._listed(old)) is not None:
                    del self.formatting[i]
                if old.open:
                    self._pop_to(old)
            if tag == "nobr" and self._in_scope(("nobr",)) is not None:
                self._reopen()
                self._adopt("nobr")
            self._format(tag, attrs)
            return
        if tag == "button" and (b := self._in_scope(("button",))) is not None:
            self._pop_to(b)
        if tag == "option" and self.stack[-1].tag == "option":
            self._pop()
        if tag not in _CLOSES_P and tag not in _NO_REOPEN:
            self._reopen()
        self._push(tag, attrs)
        if tag in _MARKED:
            self.formatting.append(None)

    def handle_endtag(self, tag):
        if tag in ("html", "body", "head") or tag in _VOID:
            if tag == "head" and self.stack[-1] is self.head:
                self._pop()
            elif tag == "br":
                self.handle_starttag("br", [])
            return
        if tag == "p" and self._in_scope(("p",), _SCOPE | {"button"}) is None:
            self._body()
            self._push("p", {})
        if tag in _FORMATTING:
            self._adopt(tag)
        elif tag in ("table", "tr", *_SECTIONS):
            node = self._in_scope((tag,), _TABLE_SCOPE - {tag})
            if node is not None:
                self._close_cell_in(node)
                self._pop_to(node)
        elif tag in ("td", "th", "caption", *_MARKED):
            node = self._in_scope((tag,), _TABLE_SCOPE if tag not in _MARKED else _SCOPE - {tag})
            if node is not None:
                self._pop_to(node)
                self._to_marker()
        elif tag in _CLOSES_P or tag in ("li", "dd", "dt", "button"):
            stop = _SCOPE | {"ol", "ul"} if tag == "li" else _SCOPE | {"button"} if tag == "p" else _SCOPE
            node = self._in_scope(_HEADINGS if tag in _HEADINGS else (tag,), stop - {tag})
            if node is not None:
                self._pop_to(node)
        else:
            self._other_end(tag)

    def _close_cell_in(self, node):
        """Cells that are open within a table or a part of it end with it, and their markers go."""
        while True:
            cell = next((n for n in reversed(self.stack) if n is node or n.tag in ("td", "th", "caption")), node)
            if cell is node:
                return
            self._pop_to(cell)
            self._to_marker()

    def _other_end(self, tag):
        if not self.opened[tag]:
            return
        for n in reversed(self.stack):
            if n.tag == tag:
                self._pop_to(n)
                return
            if n.tag in _SPECIAL:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.body is None and self.stack[-1] in (self.root, self.head):
            if not data.strip():
                return
            self._body()
        if self.stack[-1].tag not in ("script", "style", "title", "textarea") and data.strip():
            self._reopen()
        self._place(data, self.stack[-1])


def tree(html: str) -> Node:
    b = TreeBuilder()
    b.feed(html or "")
    b.close()
    return b.root


def strip_boilerplate(root: Node) -> Node:
    """root without elements of banned classes and tags."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in BANNED_TAGS or BANNED_CLASSES & set(c.attrs.get("class", "").split()))]
        stack.extend(c for c in n.children if isinstance(c, Node))
    return root


def texts_of(root: Node) -> list[dict]:
    """The text of every element of TEXT_TAGS after boilerplate is gone from root; nested ones each give theirs."""
    found: dict[str, list[str]] = {t: [] for t in TEXT_TAGS}
    for n in strip_boilerplate(root).walk():
        if n.tag in found:
            found[n.tag].append(n.text())
    return [{"tag": t, "text": x} for t in TEXT_TAGS for x in found[t]]


def tag_texts(html: str) -> list[dict]:
    return texts_of(tree(html))


def record_of(root: Node, url: str) -> tuple[str, list[str], dict[str, str]]:
    """Title (of all title elements), link targets and images (target -> alt, the last one wins), as absolute URLs."""
    title, links, images = [], [], {}
    for n in root.walk():
        if n.tag == "title":
            title.append(n.text())
        elif n.tag == "a" and "href" in n.attrs:
            try:
                links.append(urljoin(url or "", n.attrs["href"].strip()))
            except ValueError:
                continue
        elif n.tag == "img" and n.attrs.get("src", "").strip() and n.attrs.get("alt", "").strip():
            try:
                at = urlsplit(urljoin(url or "", n.attrs["src"].strip()))
            except ValueError:
                continue
            path = at.path[:-1] if at.path.endswith("/") else at.path
            images[f"{at.scheme.lower()}://{at.netloc.lower()}{path}"] = n.attrs["alt"].strip()
    return "".join(title), links, images


def page_record(url: str, html: str) -> tuple[str, list[str], dict[str, str]]:
    return record_of(tree(html), url)


def parsed(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, title, links, images, texts): each page's tree is built once, read for its record, then for its texts."""

    def run(frames):
        for f in frames:
            rows = []
            for u, h in zip(f["url"], f["html"]):
                root = tree(h)
                rows.append((*record_of(root, u), texts_of(root)))
            yield pd.DataFrame({key: f[key], "url": f["url"], **{c: [r[i] for r in rows] for i, c in enumerate(("title", "links", "images", "texts"))}})

    return bounded_batches(pages.select(key, "url", "html")).mapInPandas(run, f"{key} long, url string, title string, links array<string>, images map<string,string>, texts array<struct<tag:string,text:string>>")


def with_tag_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, texts: array<struct<tag,text>>)."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "texts": [tag_texts(h) for h in f["html"]]})

    return bounded_batches(pages.select(key, "html")).mapInPandas(run, f"{key} long, texts array<struct<tag:string,text:string>>")


def with_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, title, links, images); links as found, with duplicates, unfiltered."""

    def run(frames):
        for f in frames:
            got = [page_record(u, h) for u, h in zip(f["url"], f["html"])]
            yield pd.DataFrame({key: f[key], "url": f["url"], "title": [g[0] for g in got], "links": [g[1] for g in got], "images": [g[2] for g in got]})

    return bounded_batches(pages.select(key, "url", "html")).mapInPandas(run, f"{key} long, url string, title string, links array<string>, images map<string,string>")
