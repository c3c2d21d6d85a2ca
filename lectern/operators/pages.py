"""Posts out of pages of mark-up: one parse for each page, in Arrow batches, by a small selector engine over html.parser."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import HOST, extract_post_links

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
JUNK = frozenset(("script", "style", "iframe", "noscript"))


@dataclass(frozen=True)
class Profile:
    """Where a site keeps what; the defaults are fixed values."""

    title: tuple[str, ...] = ("meta[property='og:title']", "span.se-title-text", "div.se-title-text", ".se-title-text", "h3")
    title_suffix: str = "네이버 블로그"
    content: tuple[str, ...] = ("div.se-main-container", "div#postViewArea", "div.post-view", "div.post_ct", "div#viewTypeSelector")
    least_content: int = 20
    likes: tuple[str, ...] = (
        "li.u_likeit_list.like span.u_likeit_list_count",
        "a[data-type='like'] span.u_likeit_list_count",
        "span.u_likeit_text._count.num",
        "em.u_cnt._count",
        ".btn_sympathy ._count",
    )
    comment_counts: tuple[str, ...] = ("button[class*='comment_btn'] span[class*='num']", "h2[class*='title'] span[class*='num']", "a.btn_reply")
    comment_count_patterns: tuple[str, ...] = (r'"commentCount"\s*:\s*(\d+)', r"commentCount\s*[:=]\s*['\"]?(\d+)")
    property_id: str = "#_post_property"
    writer: tuple[str, ...] = ("meta[property='naverblog:nickname']", "meta[property='og:article:author']", "strong.ell")
    comment: str = "li.u_cbox_comment"
    comment_box: str = "u_cbox_comment_box"
    comment_text: str = "span.u_cbox_contents"
    comment_date: str = "span.u_cbox_date"
    comment_like: str = "a.u_cbox_btn_recomm"
    comment_like_count: str = "em.u_cbox_cnt_recomm"
    source: str = "네이버 블로그"
    hours_east: int = 0


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)  # nodes and texts

    def walk(self) -> Iterator[Node]:
        """This node's descendants in the page's order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    yield x
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def texts(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    yield x
                elif x.tag not in without:
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def text(self, without: frozenset[str] = frozenset()) -> str:
        return tidy(" ".join(t for t in (x.strip() for x in self.texts(without)) if t))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    tree = _Tree()
    tree.feed(markup)
    tree.close()
    return tree.root


def tidy(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub("[​\xa0]", " ", html.unescape(text or ""))).strip()


def number(text: str | None) -> int | None:
    digits = "".join(c for c in tidy(text) if "0" <= c <= "9")
    return int(digits) if digits else None


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:(\*?=)'([^']*)')?\]")


def _fits(node: Node, part: str) -> bool:
    for tag, ident, cls, attr, op, value in _SIMPLE.findall(part):
        if tag and node.tag != tag.lower() or ident and node.attrs.get("id") != ident:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr and (attr not in node.attrs or op == "=" and node.attrs[attr] != value or op == "*=" and value not in node.attrs[attr]):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Nodes below root that a selector of tags, ids, classes, attributes and descent names, in the page's order."""
    *above, last = selector.split()
    for node in root.walk():
        if _fits(node, last):
            x, need = node.parent, list(above)
            while need and x is not None:
                if _fits(x, need[-1]):
                    need.pop()
                x = x.parent if x is not root else None
            if not need:
                yield node


def _first(root: Node, selector: str) -> Node | None:
    return next(select(root, selector), None)


def first_text(root: Node, selectors: tuple[str, ...]) -> str:
    """Text of the first selector whose first node has some; a meta tag's is its content."""
    for s in selectors:
        node = _first(root, s)
        if node is not None and (t := tidy(node.attrs.get("content")) if node.tag == "meta" else node.text()):
            return t
    return ""


def first_number(root: Node, selectors: tuple[str, ...]) -> int | None:
    return next((n for s in selectors for x in select(root, s) if (n := number(x.text())) is not None), None)


def best_content(root: Node, p: Profile) -> str:
    """The longest text among the first selector's nodes that has enough of it, without scripts and the like."""
    for s in p.content:
        best = max((x.text(JUNK) for x in select(root, s)), key=len, default="")
        if len(best) >= p.least_content:
            return best
    return ""


def comment_likes(box: Node, p: Profile) -> int:
    """Likes of a comment: of the first visible button, else of the first button."""
    found = [(b, c) for b in select(box, p.comment_like) if (c := _first(b, p.comment_like_count)) is not None]
    shown = [c for b, c in found if "display:none" not in b.attrs.get("style", "").replace(" ", "").lower()]
    return next((number(c.text()) or 0 for c in shown or [c for _, c in found]), 0)


def comments(root: Node, p: Profile, most: int) -> list[dict]:
    out: list[dict] = []
    for item in select(root, p.comment):
        box = next((x for x in item.children if isinstance(x, Node) and p.comment_box in x.attrs.get("class", "").split()), None)
        if box is None:
            continue
        said, when = _first(box, p.comment_text), _first(box, p.comment_date)
        if said is not None and (t := said.text()):
            out.append({"text": t, "time": (tidy(when.attrs.get("data-value")) or when.text()) if when is not None else "", "like_count": comment_likes(box, p)})
        if len(out) >= most:
            break
    return out


def comment_count(root: Node, markup: str, p: Profile) -> int:
    prop = _first(root, p.property_id)
    if prop is not None and "commentcount" in prop.attrs:
        return number(prop.attrs["commentcount"]) or 0
    for pattern in p.comment_count_patterns:
        if m := re.search(pattern, markup):
            return int(m[1])
    return first_number(root, p.comment_counts) or 0


def post_day(root: Node, p: Profile) -> str:
    prop = _first(root, p.property_id)
    try:
        from datetime import timedelta

        zone = timezone(timedelta(hours=p.hours_east)) if p.hours_east else UTC
        return datetime.fromtimestamp(int(prop.attrs["adddate"]) / 1000, zone).strftime("%Y%m%d")
    except (AttributeError, KeyError, ValueError, OSError, OverflowError):
        return ""


PARSED = (
    "title string, content string, post_like_count long, like_count long, comment_count long, comments_text string, comment_times string, "
    "comment_like_counts string, comments_json string, post_date string, writer string, source string"
)


def parse_post(markup: str | None, p: Profile = Profile(), most_comments: int = 50) -> dict:
    """The fields of one post's page; a page without them gives empty texts and zeros."""
    markup = markup or ""
    root = parse(markup)
    likes, said = first_number(root, p.likes) or 0, comments(root, p, most_comments)
    joined = lambda k: " || ".join(str(c[k]) for c in said)
    return {
        "title": re.sub(rf"\s*:\s*{re.escape(p.title_suffix)}\s*$", "", first_text(root, p.title)).strip(),
        "content": best_content(root, p), "post_like_count": likes, "like_count": likes, "comment_count": comment_count(root, markup, p),
        "comments_text": joined("text"), "comment_times": joined("time"), "comment_like_counts": joined("like_count"),
        "comments_json": json.dumps(said, ensure_ascii=False), "post_date": post_day(root, p), "writer": first_text(root, p.writer), "source": p.source,
    }


def parse_pages(pages: DataFrame, markup: str = "html", key: tuple[str, ...] = ("url",), profile: Profile = Profile(), most_comments: int = 50) -> DataFrame:
    """Key columns and the parsed fields of every page."""
    slim = pages.select(*key, F.col(markup).alias("_markup"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", " + PARSED

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([parse_post(m, profile, most_comments) for m in b["_markup"]], columns=[x.split()[0] for x in PARSED.split(", ")], index=b.index)
            yield pd.concat([b.drop(columns="_markup"), rows], axis=1)

    return slim.mapInPandas(go, schema)


def page_links(pages: DataFrame, markup: str = "html", host: str = HOST) -> DataFrame:
    """Every page with the canonical addresses of the posts that it links to."""
    return pages.withColumn("links", extract_post_links(F.col(markup), host))


def page_titles(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Title tags, natively."""
    from ..functions.text import collapse_ws

    return pages.withColumn("title", collapse_ws(F.regexp_extract(F.coalesce(markup, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))
