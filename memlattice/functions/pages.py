"""What raw web pages say of themselves: metadata of their heads, and typed entities of JSON-LD; Arrow-batched."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = "title string, description string, og_image string, og_type string, author string, published_date string, domain string, canonical_url string"
# Kinds of entity by JSON-LD type.
LD_KINDS = {"Person": "PERSON", "Organization": "ORG", "Corporation": "ORG", "Product": "PRODUCT", "Place": "LOCATION", "Event": "EVENT"}


_TITLE = re.compile(r"<title[^>]*>[^<]*", re.IGNORECASE)


class _Head(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.meta: dict[str, str] = {}
        self.title: str | None = None
        self.canonical: str | None = None
        self.data: list[str] = []
        self._into: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "meta" and (name := a.get("property") or a.get("name")) and a.get("content"):
            self.meta.setdefault(name, a["content"])
        elif tag == "link" and a.get("rel") == "canonical" and a.get("href"):
            self.canonical = self.canonical or a["href"]
        elif tag == "title" and self.title is None:
            self._into, self.title = "title", ""
        elif tag == "script" and a.get("type") == "application/ld+json":
            self._into = "data"
            self.data.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("title", "script"):
            self._into = None

    def handle_data(self, text: str) -> None:
        if self._into == "title":
            self.title += text
        elif self._into == "data":
            self.data[-1] += text


def _parsed(html: str | None, read: tuple[str, ...] = ()) -> _Head:
    head = _Head()
    if read:
        other = re.compile(f"&(?!(?:{'|'.join(map(re.escape, read))});)")
        html = _TITLE.sub(lambda m: other.sub("&amp;", m[0]), html or "", count=1)
    head.feed(html or "")
    head.close()
    return head


def head_of(html: str | None, url: str, read: tuple[str, ...] = ()) -> tuple[str | None, ...]:
    """HEAD's fields: Open Graph first, then Twitter's, then plain ones; the address where there is no title or canonical one.

    Character references are read as browsers do; with names in `read`, a plain title's only by those names and with
    their semicolon, and others, such as those of cut titles, stay as they are.
    """
    head = _parsed(html, read)
    m = head.meta
    title = m.get("og:title") or m.get("twitter:title") or (head.title or "").strip() or url
    text = m.get("og:description") or m.get("description")
    return title[:500].strip(" "), text[:1000] if text else None, m.get("og:image"), m.get("og:type"), m.get("author"), m.get("article:published_time"), urlparse(url).netloc, head.canonical or url


def _named(x: object, kind: str) -> list[tuple[str, str]]:
    if isinstance(x, str):
        return [(x, kind)]
    return [(x["name"], LD_KINDS.get(x.get("@type", ""), kind))] if isinstance(x, dict) and x.get("name") else []


def ld_entities(html: str | None) -> list[tuple[str, str]]:
    """(name, kind) of typed objects, their authors (persons, unless typed) and publishers (organisations, if objects)."""
    out: list[tuple[str, str]] = []
    for raw in _parsed(html).data:
        try:
            found = json.loads(raw)
        except ValueError:
            continue
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict):
                if x.get("@type") in LD_KINDS and x.get("name"):
                    out.append((x["name"], LD_KINDS[x["@type"]]))
                publisher = x.get("publisher")
                out += _named(x.get("author"), "PERSON") + (_named(publisher, "ORG") if isinstance(publisher, dict) else [])
    return out


def metadata(html: Column, url: Column, read: tuple[str, ...] = ()) -> Column:
    """A struct of HEAD's fields, see head_of."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in HEAD.split(", ")]
        for pages, urls in parts:
            yield pd.DataFrame([head_of(h, u, read) for h, u in zip(pages, urls, strict=True)], columns=names, dtype=object)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, HEAD)(html, url)


def entities(html: Column) -> Column:
    """array<string> of kind:name from a page's JSON-LD."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: [f"{kind}:{name}" for name, kind in ld_entities(x)], na_action=None)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(html)
