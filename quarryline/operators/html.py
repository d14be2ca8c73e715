"""Heading-delimited fragments of HTML pages.

No Spark function parses HTML as browsers do, so one mapInPandas reads each page
with the standard library's parser; all other columns are expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions import urls as U
from quarryline.operators import tagging

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4")
# What counts as a fragment's container, content and standalone section.
CONTENT_TAGS = ("p", "ul", "ol", "table", "form")
CONTENT_CLASSES = ("content", "info-box")

#: Where a heading without content beside it takes all that stands in its parent.
WRAPPERS = ("div", "section", "article")

SCHEMA = (
    "page string, pos int, standalone boolean, level int, title string, anchor string, key string, content_text string, content_html string, styles array<string>, page_hierarchy array<string>, "
    "hierarchy_lvl0 string, hierarchy_lvl1 string, hierarchy_lvl2 string, hierarchy_lvl3 string, has_form boolean, has_table boolean, has_list boolean, has_checklist boolean, "
    "is_checklist boolean, is_alert boolean, has_warning boolean, has_card boolean, has_video boolean, is_info boolean"
)


#: Characters of HTML whose fragments a worker holds at once (of a longer page: that page's).
SLICE = 2_000_000


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))
        return "".join(parts)

    def html(self) -> str:
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            parts.append(f"<{x.tag}{''.join(f' {k}="{v}"' for k, v in x.attrs.items())}>")
            if x.tag not in VOID:
                stack.append(f"</{x.tag}>")
                stack.extend(reversed(x.children))
        return "".join(parts)

    def is_(self, tags: tuple[str, ...] = (), classes: tuple[str, ...] = ()) -> bool:
        return self.tag in tags or any(c in self.classes for c in classes)

    def has(self, tags: tuple[str, ...] = (), classes: tuple[str, ...] = ()) -> bool:
        return any(n.is_(tags, classes) for n in self.walk())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _container(root: Node) -> Node:
    for fits in (lambda n: n.tag == "main", lambda n: n.attrs.get("id") == "main-content", lambda n: "main-content" in n.classes, lambda n: n.tag == "article", lambda n: n.tag == "body"):
        if found := next((n for n in root.walk() if fits(n)), None):
            return found
    return root


def _breadcrumbs(root: Node) -> list[str]:
    """The items of the first kind of breadcrumbs that has any."""
    for fits in (
        lambda n: "breadcrumb" in n.classes,
        lambda n: n.tag == "nav" and n.attrs.get("aria-label") == "breadcrumb",
        lambda n: "breadcrumbs" in n.classes,
        lambda n: "breadcrumb" in n.attrs.get("class", ""),
    ):
        items = {id(n): n for node in root.walk() if fits(node) for n in node.walk() if n.tag == "li" and n is not node}
        if items:
            return [t for n in items.values() if (t := n.text().strip()) and t not in (">", "/")]
    return []


def _is_content(node: Node) -> bool:
    return node.tag in CONTENT_TAGS or (node.tag == "div" and "content" in node.classes) or "info-box" in node.classes


def _is_alert(node: Node) -> bool:
    return "alert" in node.classes or node.attrs.get("role") == "alert"


#: Fixed: the kinds of standalone sections, in order.
SECTIONS = (
    lambda n: "alert" in n.classes, lambda n: "warning-box" in n.classes, lambda n: "info-panel" in n.classes, lambda n: n.attrs.get("role") == "alert", lambda n: "checklist" in n.classes, lambda n: "step-list" in n.classes,
)


def _flags(nodes: list[Node], alone: bool) -> tuple[bool, ...]:
    """What a fragment holds; of a standalone section some flags are those of the section itself."""
    every = [n for node in nodes for n in node.walk()]
    any_ = lambda tags=(), classes=(): any(n.is_(tags, classes) for n in every)
    steps = any(n.tag == "ol" and "steps" in n.classes for n in every)
    return (
        any_(("form",)), any_(("table",)), any_(("ul", "ol")), any_(("ol",)) or any(n.tag == "ul" and "checklist" in n.classes for n in every),
        steps or ("checklist" in nodes[0].classes if alone else any_((), ("checklist",))), _is_alert(nodes[0]) if alone else any(map(_is_alert, every)), any_((), ("alert", "warning")),
        any_((), ("card", "info-box")), any(n.tag == "video" or (n.tag == "iframe" and "youtube" in n.attrs.get("src", "")) for n in every), any(c in nodes[0].classes for c in ("info-box", "info-panel")),
    )


def _content(heading: Node, following: Node | None) -> list[Node]:
    """The content elements after a heading, up to the heading that follows in the document; without any, what else is in the parent."""
    after, parts = heading.parent.children, []
    for x in after[after.index(heading) + 1 :]:
        if x is following:
            break
        if isinstance(x, Node) and _is_content(x):
            parts.append(x)
    if not parts and heading.parent.tag in WRAPPERS:
        parts = [c for c in after if isinstance(c, Node) and c.tag not in HEADINGS]
    return parts


def page_rows(page: str, html: str) -> list[tuple]:
    """The fragments of a page in order, then its standalone sections."""
    root = parse(html or "")
    box, crumbs = _container(root), _breadcrumbs(root)
    title = next((n.text() for n in root.walk() if n.tag == "title"), "")
    styles = ["".join(c for c in n.children if isinstance(c, str)) for n in root.walk() if n.tag == "style"]
    rows: list[tuple] = []
    headings = [n for n in box.walk() if n.tag in HEADINGS and n is not box]
    for node, following in zip(headings, [*headings, None][1:], strict=True):
        parts, level = _content(node, following), int(node.tag[1])
        if not parts and level > 1:
            continue
        heading = node.text().strip()
        before = [x for x in node.parent.children[: node.parent.children.index(node)] if isinstance(x, Node)]
        last = lambda tag: next((x.text() for x in reversed(before) if x.tag == tag), "")  # noqa: E731, B023
        top = crumbs[-1] if crumbs and level > 1 else ""
        lvl0 = (heading if level == 1 else top) or title or "Content"
        lvl1 = None if level < 2 else (heading if level == 2 else last("h2")) or "Section"
        lvl2 = None if level < 3 else (heading if level == 3 else last("h3")) or "Subsection"
        lvl3 = None if level < 4 else heading or "Item"
        text = "".join(p.text() for p in parts).strip()
        rows.append((page, len(rows), False, level, heading or "Untitled", node.attrs.get("id"), page + heading + text, text, "".join(x.html() for x in [node, *parts]), styles,
                     [c for c in [*crumbs, heading] if c], lvl0, lvl1, lvl2, lvl3, *_flags([node, *parts], False)))
    met: set[int] = set()
    for fits in SECTIONS:
        for node in box.walk():
            if node is box or id(node) in met or not fits(node):
                continue
            met.add(id(node))
            text = node.text()
            heading = next((n.text() for n in node.walk() if n.tag in HEADINGS and n is not node), "") or node.attrs.get("aria-label") or "Important Information"
            inner = "".join(c.html() if isinstance(c, Node) else c for c in node.children)
            rows.append((page, len(rows), True, None, heading, None, page + text, text.strip(), inner, None, crumbs, crumbs[-1] if crumbs else heading, None, None, None, *_flags([node], True)))
    for node in [*root.walk()]:  # without cycles the tree goes at once, not at some later collection
        node.parent = None
    return rows


def _run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for part in parts:
        rows, held = [], 0
        for page, html in zip(part["page"], part["html"], strict=True):
            rows += page_rows(page, html)
            held += len(html or "")
            if held >= SLICE:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)


def split_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each fragment and standalone section of each page."""
    return pages.select(F.col(url_col).alias("page"), F.col(html_col).alias("html")).where("page is not null").mapInPandas(_run, SCHEMA)


def fragments(pages: DataFrame, crawl_version: int, last_seen_at: int, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Fragment rows with ids, hierarchy, flags, reading level, keywords and popularity.

    A standalone section has no page_url, anchor, flags, reading level, classes, keywords and popularity.
    """
    rows = split_pages(pages, url_col, html_col).withColumn("id", F.md5("key"))
    flag, alone = F.col, F.col("standalone")
    whole = lambda c: F.when(~alone, c)
    kind = F.when(alone, tagging.section_type(flag("has_form"), flag("has_table"), flag("is_checklist"), flag("is_alert"), flag("is_info"))).otherwise(
        tagging.component_type(flag("has_form"), flag("has_table"), flag("is_checklist"), flag("is_alert"), flag("has_card"), flag("has_video"))
    )
    score = T.popularity(F.coalesce("level", F.lit(2)), flag("has_form"), flag("has_warning"), flag("has_list"), flag("has_table"), F.concat("title", "content_text"))
    anchor = F.coalesce(F.nullif(F.col("anchor"), F.lit("")), F.col("id"))
    return rows.select(
        "id", F.lit(crawl_version).alias("crawl_version"), F.lit(last_seen_at).cast("long").alias("last_seen_at"),
        F.concat("page", F.lit("#"), anchor).alias("url"), whole(U.base_url(F.col("page"))).alias("page_url"), whole(anchor).alias("anchor"),
        "title", "content_text", "content_html", U.site_hierarchy(F.col("page")).alias("site_hierarchy"), "page_hierarchy", *(f"hierarchy_lvl{k}" for k in range(4)),
        kind.alias("component_type"), whole(flag("has_form")).alias("has_form"), whole(flag("has_checklist")).alias("has_checklist"), whole(T.reading_level(F.col("content_text"))).alias("reading_level"),
        whole(class_set(F.col("content_html"))).alias("classes"), F.col("styles").alias("inline_styles"), whole(T.keywords(F.col("content_text"))).alias("search_keywords"),
        whole(score).alias("popularity_score"), (100 - F.coalesce(whole(score), F.lit(0))).alias("popularity_sort"), "pos",
    )


def class_set(html: Column) -> Column:
    """The distinct classes in HTML, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)class\s*=\s*"([^"]*)"'), 1)
    return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda c: F.split(c, r"\s+"))), lambda c: c != ""))


def text_statistics(text: Column, html: Column) -> Column:
    """struct of word, link, list and emphasis counts, and whether there are images and links."""
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    links = count(r"(?i)<a[\s>]")
    return F.struct(
        T.word_count(text).alias("word_count"), links.alias("link_count"), count(r"(?i)<[uo]l[\s>]").alias("list_count"), count(r"(?i)<(?:strong|em|b|i)[\s>]").alias("emphasis_count"),
        (count(r"(?i)<img[\s>]") > 0).alias("has_images"), (links > 0).alias("has_links"),
    )


def selector_path(node: Node) -> str:
    """A selector from below the html element, or from the nearest element with an id, down to the node."""
    steps: list[str] = []
    while node is not None and node.parent is not None and node.tag != "html":
        if node.attrs.get("id"):
            steps.append(f"{node.tag}#{_escaped(node.attrs['id'])}")
            break
        steps.append(f"{node.tag}.{_escaped(node.classes[0])}" if node.classes else node.tag)
        node = node.parent
    return " > ".join(reversed(steps))


def _escaped(name: str) -> str:
    """name as an identifier of a selector."""
    out = "".join(c if c.isalnum() or c in "-_" or ord(c) >= 0x80 else f"\\{c}" for c in name)
    return f"\\3{out[0]} {out[1:]}" if out[:1].isdigit() else out
