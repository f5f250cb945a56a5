"""Feeds and sitemaps out of binary bodies, parsed with the standard library in Arrow batches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

ITEM = "source string, pos int, url string, published timestamp, updated timestamp, is_index boolean"


def gunzip(body: bytes, most: int) -> bytes | None:
    """Inflated bytes, or None if they are corrupt or more than `most`."""
    try:
        d = zlib.decompressobj(31)
        out = d.decompress(body, most + 1)
        return out if len(out) <= most and d.eof else None
    except zlib.error:
        return None


def w3c_time(text: str | None) -> datetime | None:
    """A W3C or RFC 822 date as UTC; a date alone is its midnight; None if unreadable."""
    text = (text or "").strip()
    try:
        at = datetime.fromisoformat(text.replace("/", "-"))
    except ValueError:
        try:
            at = parsedate_to_datetime(text)
        except (ValueError, TypeError):
            return None
    try:
        return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    except OverflowError:  # before year 1 or after 9999 in UTC
        return None


def joined(base: str | None, link: str) -> str | None:
    """link made absolute; None if it is malformed."""
    try:
        return urljoin(base or "", link)
    except ValueError:
        return None


def _tree(body: bytes) -> ET.Element | None:
    if re.search(rb"<!(DOCTYPE|ENTITY)", body[:100_000], re.I):
        return None  # no document types, so no entity bombs
    try:
        return ET.fromstring(body.strip())
    except (ET.ParseError, ValueError, LookupError):  # broken, or in an unknown encoding
        return None


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _text(e: ET.Element, *names: str) -> str | None:
    return next(((x.text or "").strip() for n in names for x in e.iter() if _local(x) == n and (x.text or "").strip()), None)


def parse_feed(body: bytes | None, base: str) -> list[tuple]:
    """(url, published, updated) of each RSS item or Atom entry."""
    root, out = _tree(body or b""), []
    for e in root.iter() if root is not None else ():
        if _local(e) not in ("item", "entry"):
            continue
        href = next((x.get("href") for x in e if _local(x) == "link" and x.get("href") and x.get("rel", "alternate") == "alternate"), None)
        link = href or _text(e, "link", "guid", "id")
        if link and (link := joined(base, link)):
            out.append((link, w3c_time(_text(e, "pubdate", "published", "date")), w3c_time(_text(e, "updated", "modified"))))
    return out


def parse_sitemap(body: bytes | None, base: str, most: int = 50_000_000) -> tuple[bool, list[tuple]] | None:
    """(is an index, (url, news publication date, lastmod) entries), or None if it is no sitemap."""
    body = body or b""
    if body[:2] == b"\x1f\x8b":
        body = gunzip(body, most) or b""
    root = _tree(body)
    if root is None or _local(root) not in ("urlset", "sitemapindex"):
        return None
    rows = [(at, w3c_time(_text(e, "publication_date")), w3c_time(_text(e, "lastmod"))) for e in root if (loc := _text(e, "loc")) and (at := joined(base, loc))]
    return _local(root) == "sitemapindex", rows


def read_feeds(bodies: DataFrame) -> DataFrame:
    """bodies(source, body) to one row per item: source, pos, url, published, updated, is_index (null for feeds)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for source, body in zip(pdf["source"], pdf["body"], strict=True):
                found = parse_sitemap(body, source)
                index, items = found if found else (None, parse_feed(body, source))
                rows += [(source, k, u, p, m, index) for k, (u, p, m) in enumerate(items)]
            out = pd.DataFrame(rows, columns=["source", "pos", "url", "published", "updated", "is_index"])
            for c in ("published", "updated"):
                out[c] = pd.to_datetime(out[c], utc=True)
            yield out

    return bodies.select("source", "body").mapInPandas(run, ITEM)
