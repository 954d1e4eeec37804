"""HTML as relations: a small tree on the standard library's parser, and table functions over it.

The tree follows the lenient rules of that parser: void elements have no content, an end tag closes the nearest open element of its
name and all within it, an end tag without such an element is ignored, and nothing is implied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import terms

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset(("script", "style", "template"))


class Node:
    """An element. kids holds elements and strings; place is its number among all elements, in document order."""

    __slots__ = ("tag", "attrs", "kids", "parent", "place")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, place: int):
        self.tag, self.attrs, self.parent, self.place = tag, attrs, parent, place
        self.kids: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def all(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def first(self, tag: str) -> Node | None:
        return next(self.all(tag), None)

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = [*reversed(self.kids)]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in HIDDEN_TEXT or n is self:
                todo += reversed(n.kids)

    def text(self, sep: str = " ") -> str:
        """The stripped strings below, blanks left out."""
        return sep.join(s for s in (x.strip() for x in self.strings()) if s)

    def squeezed(self) -> str:
        return " ".join(self.text().split())

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None, -1)
        self.n = 0

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own[k] = v or ""
        node = Node(tag, own, self.at, self.n)
        self.n += 1
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        kids = self.at.kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def drop(root: Node, tags=(), roles=(), classes=(), ids=(), parts=()) -> None:
    """Takes out elements by tag, role, class or id; parts are looked for inside ids and class attributes, whatever the case."""
    gone = []
    for n in root.walk():
        marks = (n.attrs.get("id", "") + "\n" + n.attrs.get("class", "")).lower()
        if n.tag in tags or n.attrs.get("role") in roles or set(n.classes) & set(classes) or n.attrs.get("id") in ids or any(p in marks for p in parts):
            gone.append(n)
    for n in gone:
        n.parent.kids = [k for k in n.parent.kids if k is not n]


def main_part(root: Node) -> Node:
    return root.first("main") or root.first("article") or root.first("body") or root


def join(page: str | None, href: str) -> str | None:
    """href as seen from page; null where that is no address."""
    try:
        return urljoin(page or "", href)
    except ValueError:
        return None


def anchors(html: str | None, page: str | None = None) -> Iterator[dict]:
    """Every link of a page with its text and absolute address: kind a (href), img (src) or srcset (img and source, one row for each candidate)."""
    root = parse(html)

    def row(kind, href, text=""):
        return {"kind": kind, "href": href, "text": text, "url": join(page, href)}

    for a in root.all("a"):
        if "href" in a.attrs:
            yield row("a", a.attrs["href"].strip(), a.squeezed())
    for i in root.all("img"):
        if "src" in i.attrs:
            yield row("img", i.attrs["src"].strip())
    for i in root.all("img", "source"):
        for c in i.attrs.get("srcset", "").split(","):
            if c.split():
                yield row("srcset", c.split()[0])


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def outline(html: str | None, page: str | None = None) -> Iterator[dict]:
    """Headings and links in document order. previous: the text of the nearest paragraph, heading or list item that begins before a link; label: its title and aria-label."""
    root, previous = parse(html), None
    for n in root.walk():
        if n.tag in HEADINGS or n.tag == "a":
            label = " ".join(v for v in (n.attrs.get(k, "").strip() for k in ("title", "aria-label")) if v)
            href = n.attrs["href"].strip() if n.tag == "a" and "href" in n.attrs else None
            yield {"tag": n.tag, "text": n.squeezed(), "href": href, "url": None if href is None else join(page, href), "label": label if n.tag == "a" else "", "previous": previous.squeezed() if n.tag == "a" and previous is not None else ""}
        if n.tag in HEADINGS or n.tag in ("p", "li"):
            previous = n


def date_context(html: str | None) -> str:
    """What a page says of its own date: update notes, times and meta fields, without repeats."""
    root, found = parse(html), []
    found += [n.squeezed() for n in root.walk() if "page-title-maj" in n.attrs.get("class", "")]
    for n in root.all("time"):
        found.append(" ".join(v for v in (n.squeezed(), n.attrs.get("datetime", "").strip()) if v))
    metas = list(root.all("meta"))
    for name in terms.DATE_META:
        for attr in ("property", "name"):
            found += [m.attrs.get("content", "").strip() for m in metas if m.attrs.get(attr) == name]
    return " ".join(dict.fromkeys(f for f in found if f))


# Structured pages.


def _norm(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def _texts(n: Node) -> tuple[list[str], str]:
    """Texts of the text tags below, the first of those that differ in case only, and the first heading."""
    parts, heading = {}, ""
    for t in n.all(*terms.TEXT_TAGS):
        s = _norm(t.text())
        if s:
            heading = heading or (s if t.tag.startswith("h") else "")
            parts.setdefault(s.lower(), s)
    return list(parts.values()), heading


class _Page:
    def __init__(self, root: Node):
        self.root, self._known = root, {}

    def container(self, n: Node) -> bool:
        """A section, article or div with a heading, two texts, or a link and forty characters."""
        if n.tag not in ("section", "article", "div"):
            return False
        if n.place not in self._known:
            parts, heading = _texts(n)
            links = any("href" in a.attrs for a in n.all("a"))
            self._known[n.place] = bool(parts) and bool(heading or len(parts) >= 2 or links and len("\n".join(parts)) >= 40)
        return self._known[n.place]


def provenance(n: Node) -> dict[str, str]:
    path, at = [], n
    while at is not None and at.tag:
        older = 1
        for k in at.parent.kids if at.parent is not None else ():
            if k is at:
                break
            older += isinstance(k, Node) and k.tag == at.tag
        mark = at.tag + (f"#{at.attrs['id']}" if at.attrs.get("id") else "") + ("." + ".".join(at.classes[:2]) if at.classes else "")
        path.append(f"{mark}[{older}]")
        at = at.parent
        if at is not None and at.tag in ("html", "[document]"):
            break
    return {"source_tag": n.tag, "source_path": ">".join(reversed(path))}


def table_of(n: Node) -> dict:
    cell = lambda c: _norm(c.text())
    headers = [s for s in map(cell, n.all("th")) if s]
    rows = [r for r in ([s for s in map(cell, tr.all("td", "th")) if s] for tr in n.all("tr")) if r]
    caption = n.first("caption")
    joined = " ".join([*headers, *(c for r in rows for c in r)]).lower()
    kind = "cookie_legal" if any(t in joined for t in terms.COOKIE_TABLE) else "spec_table" if any(t in joined for t in terms.SPEC_TABLE) else "unknown"
    return {"title": cell(caption) if caption else "", "headers": headers, "rows": rows, "table_type": kind}


def blocks(html: str | None, url: str) -> list[dict]:
    """Tables, then containers, then loose texts of a page's main part, without repeats."""
    root = parse(html)
    drop(root, terms.PAGE_NOISE_TAGS, terms.PAGE_NOISE_ROLES, parts=terms.PAGE_NOISE_PARTS)
    top = main_part(root)
    page, out = _Page(top), []

    def add(kind, n, text, heading, name=None, **more):
        out.append({"block_id": f"{name or kind}_{len(out)}", "block_type": kind, "text": text, "heading": heading, "url": url, "links": [], "provenance": provenance(n), "metadata": {}, "table": None} | more)

    for t in top.all("table"):
        found = table_of(t)
        if found["rows"]:
            lines = [found["title"], " | ".join(found["headers"]), *(" | ".join(r) for r in found["rows"])]
            add("table", t, "\n".join(x for x in lines if x).strip(), found["title"], table=found)
    for n in top.all("section", "article", "div"):
        if page.container(n):
            parts, heading = _texts(n)
            links = [a.attrs["href"].strip() for a in n.all("a") if "href" in a.attrs]
            kind = "card" if links and (heading or len(parts) >= 2) else "section"
            add(kind, n, "\n".join(parts), heading, links=list(dict.fromkeys(x for x in links if x)), metadata={"text_part_count": str(len(parts))})
    for n in top.all(*terms.TEXT_TAGS):
        if not any(page.container(p) for p in n.up()):
            s = _norm(n.text())
            if s:
                add("heading" if n.tag.startswith("h") else "text", n, s, s if n.tag.startswith("h") else "", name="text")
    seen, kept = set(), []
    for b in out:
        key = (b["block_type"], b["heading"].lower(), b["text"].lower(), b["provenance"]["source_path"])
        if key not in seen:
            seen.add(key)
            kept.append(b)
    return kept


# Texts of a page.


def _clean(html: str | None) -> Node:
    root = parse(html)
    drop(root, terms.TEXT_NOISE_TAGS, terms.PAGE_NOISE_ROLES, terms.TEXT_NOISE_CLASSES, terms.TEXT_NOISE_IDS, terms.TEXT_NOISE_PARTS)
    return main_part(root)


def _count(s: str, words) -> int:
    s = s.lower()
    return sum(s.count(w) for w in words)


def semantic_text(html: str | None) -> str:
    """Headings, paragraphs and list items without cookie notices and short fragments, the first of repeats."""
    found = {}
    for n in _clean(html).all("h1", "h2", "h3", "h4", "p", "li"):
        s = n.text()
        if s and _count(s, terms.COOKIE_MARKERS) < 2 and (len(s) >= 20 or _count(s, terms.CONTENT_HINTS)):
            found.setdefault(s.lower(), s)
    return "\n\n".join(found.values()).strip()


def rich_text(html: str | None) -> str:
    """Texts of the innermost text elements; headings and links are kept whatever their length."""
    found = {}
    for n in _clean(html).all(*terms.RICH_TAGS):
        if any(isinstance(k, Node) and k.tag in terms.RICH_TAGS for k in n.kids):
            continue
        s = n.text()
        if len(s) < 3 or _count(s, terms.COOKIE_MARKERS) >= 2:
            continue
        if n.tag in HEADINGS or n.tag == "a" or any(p.tag == "a" for p in n.up()) or len(s) >= 20 or _count(s, terms.CONTENT_HINTS):
            s = _norm(s)
            found.setdefault(s.lower(), s)
    return "\n\n".join(found.values()).strip()


def merge_texts(candidates) -> str:
    """Paragraphs of all candidates, the first of those that are equal but for case and white space."""
    found = {}
    for c in candidates:
        for block in re.split(r"\n{2,}", c or ""):
            key = _norm(block).lower()
            if key:
                found.setdefault(key, block.strip())
    return "\n\n".join(found.values()).strip()


def _low(md: str) -> bool:
    cookies, hints = _count(md, terms.COOKIE_MARKERS), _count(md, terms.CONTENT_HINTS)
    tables = sum(line.strip().startswith("|") for line in md.splitlines())
    return not md or cookies >= 3 or tables >= 4 and not hints or len(md) < 300 and cookies > hints


def markdown(html: str | None) -> str:
    """A page's text by lines, joined with its semantic and rich texts where it is of low quality."""
    own = re.sub(r"\n{3,}", "\n\n", _clean(html).text("\n")).strip()
    meaning, rich = semantic_text(html), rich_text(html)
    out = merge_texts([meaning, rich]) if _low(own) else merge_texts([own, rich])
    return re.sub(r"\n{3,}", "\n\n", out or own).strip()


# Table functions.

#: Pages are read one at a time; their rows leave the worker after so many characters of HTML or rows.
BATCH_CHARS, BATCH_ROWS = 2_000_000, 5_000


def expand(pages: DataFrame, function, schema: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, pos, columns of schema) of each row that function(html, url) gives for a page; html is read here and not carried on. A worker holds a batch as it comes and the rows of a few pages."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("page_url"), F.col(html).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    whole = f"page_id {kind}, page_url string, pos int, {schema}"
    made = pages.sparkSession.createDataFrame([], whole).schema
    names = made.names[3:]
    maps = {f.name for f in made if isinstance(f.dataType, T.MapType)}
    arrow = to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            out, n = [], 0
            for k in range(batch.num_rows):
                i, u, h = (batch.column(c)[k].as_py() for c in range(3))
                for pos, row in enumerate(function(h, u)):
                    out.append({"page_id": i, "page_url": u, "pos": pos} | {c: [*row[c].items()] if c in maps and row[c] is not None else row[c] for c in names})
                n += len(h or "")
                if n >= BATCH_CHARS or len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, n = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, whole)


def links(pages: DataFrame, **columns) -> DataFrame:
    return expand(pages, anchors, "kind string, href string, text string, url string", **columns)


def outlines(pages: DataFrame, **columns) -> DataFrame:
    return expand(pages, outline, "tag string, text string, href string, url string, label string, previous string", **columns)


TABLE = "struct<title:string,headers:array<string>,rows:array<array<string>>,table_type:string>"
BLOCK = f"block_id string, block_type string, text string, heading string, url string, links array<string>, provenance map<string,string>, metadata map<string,string>, table {TABLE}"


def page_blocks(pages: DataFrame, **columns) -> DataFrame:
    return expand(pages, blocks, BLOCK, **columns)


def page_texts(pages: DataFrame, **columns) -> DataFrame:
    """title, markdown, semantic, rich text, text by lines and date context of each page."""

    def one(h, u):
        root = parse(h)
        t = root.first("title")
        yield {"title": _norm(t.text()) if t else "", "markdown": markdown(h), "semantic": semantic_text(h), "rich": rich_text(h), "date_context": date_context(h)}

    return expand(pages, one, "title string, markdown string, semantic string, rich string, date_context string", **columns).drop("pos")


def register(spark) -> None:
    """SQL table functions html_links, html_headings and html_blocks."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, kind string, href string, text string")
    class HtmlLinks:
        def eval(self, html: str):
            for i, r in enumerate(anchors(html)):
                yield i, r["kind"], r["href"], r["text"]

    @udtf(returnType="pos int, tag string, text string")
    class HtmlHeadings:
        def eval(self, html: str):
            for i, r in enumerate(x for x in outline(html) if x["tag"] != "a"):
                yield i, r["tag"], r["text"]

    @udtf(returnType="pos int, block_id string, block_type string, heading string, text string")
    class HtmlBlocks:
        def eval(self, html: str):
            for i, r in enumerate(blocks(html, "")):
                yield i, r["block_id"], r["block_type"], r["heading"], r["text"]

    for name, f in (("html_links", HtmlLinks), ("html_headings", HtmlHeadings), ("html_blocks", HtmlBlocks)):
        spark.udtf.register(name, f)
