"""Addresses of posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, text_or_empty, unescape

# Host, page names that are no posts, the search form, and where addresses stand in a page.
HOST = "blog.naver.com"
SYSTEM_PAGES = ("postview.naver", "postlist.naver", "myblog.naver")
SEARCH = "https://search.naver.com/search.naver"
LINK_ATTRIBUTES = ("href", "data-url", "data-href", "titleHref", "contentHref")
ANYWHERE = r"https?://(?:m\.)?{host}/[A-Za-z0-9_.%-]+/\d+"
IN_SCRIPT = r"\"(?:titleHref|contentHref|keepTriggerUrl)\"\s*:\s*\"(https?://(?:m\.)?{host}/[^\"]+/\d+)\""


def canonical_post_url(c: Column, host: str = HOST) -> Column:
    """https://host/blog/number of a post's address in any of its forms, or null.

    Entities: only &amp; can stand in an address.
    """
    t = strip(F.replace(F.replace(text_or_empty(c), F.lit("&amp;"), F.lit("&")), F.lit("\\/"), F.lit("/")))
    t = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t)
    query = lambda *names: F.coalesce(*(F.nullif(F.regexp_extract(t, rf"[?&]{n}=([^&#]+)", 1), F.lit("")) for n in names), F.lit(""))
    blog, number = query("blogId", "blogid"), query("logNo", "logno")
    by_query = F.when((blog != "") & number.rlike(r"^\d+$"), F.concat(F.lit(f"https://{host}/"), F.url_decode(blog), F.lit("/"), number))
    pattern = r"https?://(?:m\.)?" + host.replace(".", r"\.") + r"/([^/?#]+)/(\d+)"
    name, post = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    by_path = F.when((name != "") & ~F.lower(name).isin(*SYSTEM_PAGES), F.concat(F.lit(f"https://{host}/"), name, F.lit("/"), post))
    netloc = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(netloc.contains(host), F.coalesce(by_query, by_path))


def to_mobile_url(c: Column, host: str = HOST) -> Column:
    """The mobile form of a post's address; another address stays as it is."""
    return F.coalesce(F.replace(canonical_post_url(c, host), F.lit(f"https://{host}/"), F.lit(f"https://m.{host}/")), c)


def build_search_url(keyword: Column, day: Column, sort: Column, base: str = SEARCH) -> Column:
    """Address of the search for a keyword on one day (yyyyMMdd)."""
    span = F.concat(F.lit("so:"), sort, F.lit(",p:from"), day, F.lit("to"), day)
    return F.concat(F.lit(f"{base}?ssc=tab.blog.all&query="), F.url_encode(keyword), F.lit("&sm=tab_opt&nso="), F.url_encode(span))


def extract_post_links(page: Column, host: str = HOST) -> Column:
    """Distinct canonical addresses of posts in a page's mark-up, all entities decoded, in order: attributes first, then addresses anywhere."""
    t = F.replace(unescape(text_or_empty(page)), F.lit("\\/"), F.lit("/"))
    h = host.replace(".", r"\.")
    attribute = rf"(?i)\b(?:{'|'.join(LINK_ATTRIBUTES)})\s*=\s*[\"']?([^\"'\s>]*{h}[^\"'\s>]*)"
    anywhere, in_script = ANYWHERE.replace("{host}", h), IN_SCRIPT.replace("{host}", h)
    found = F.concat(F.regexp_extract_all(t, F.lit(attribute), F.lit(1)), F.regexp_extract_all(t, F.lit(anywhere), F.lit(0)), F.regexp_extract_all(t, F.lit(in_script), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(found, lambda x: canonical_post_url(x, host)), lambda x: x.isNotNull()))
