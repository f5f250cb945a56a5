"""URL functions: ASCII forms as columns, full canonicalization as a pandas UDF."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from loomgraph import config

# URL patterns that tell a document's type.
TYPE_PATTERNS = [
    (r"^https?://(www\.|export\.)?arxiv\.org/(abs|pdf|html)/", "paper"),
    (r"^https?://(www\.)?(biorxiv|medrxiv)\.org/content/", "paper"),
    (r"^https?://(www\.)?openreview\.net/(forum|pdf)\?", "paper"),
    (r"^https?://(www\.)?aclanthology\.org/[^/]+\.\d+/?$", "paper"),
    (r"^https?://(www\.)?govinfo\.gov/(content/pkg|app/details)/", "paper"),
    (r"^https?://[^/]+\.gov/(.+/)?(publications?|reports?)/.", "paper"),
    (r"^https?://news\.ycombinator\.com/item\?", "thread"),
    (r"^https?://lobste\.rs/s/", "thread"),
    (r"^https?://[^/]+/r/[^/]+/comments/", "thread"),
    (r"^https?://[^/]+/t/[^/]+/\d+", "thread"),
    (r"^https?://[^/]+/(.+/)?threads?/.", "thread"),
    (r"^https?://[^/]+/wiki/([a-z_]+_)?talk:", "thread"),
    (r"^https?://(www\.|m\.)?youtube\.com/(watch\?|shorts/)", "video"),
    (r"^https?://youtu\.be/.", "video"),
    (r"^https?://(www\.)?vimeo\.com/\d+", "video"),
]
DATED_PATH = r"^https?://[^/]+/(.+/)?(19|20)\d\d/[01]\d/([0-3]\d/)?[^/?]*[a-z][^/?]*/?$"


def host(url: Column) -> Column:
    """The domain key: lower-cased host with its port, unless that is the scheme's own, and without credentials; null
    if the URL has none."""
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    own = F.when(url.rlike("(?i)^https:"), F.regexp_replace(name, ":(443)?$", "")).when(url.rlike("(?i)^http:"), F.regexp_replace(name, ":(80)?$", ""))
    return F.nullif(F.coalesce(own, name), F.lit(""))


def origin(url: Column) -> Column:
    """Scheme and authority."""
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), host(url))


def hostname(host_: Column) -> Column:
    """A host without its port."""
    return F.regexp_replace(host_, r":[0-9]+$", "")


def bare(host_: Column) -> Column:
    """A host without one leading `www.`."""
    return F.regexp_replace(host_, r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return bare(host(a)) == bare(host(b))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def has_segment(url: Column, names: list[str] = config.SKIP_SEGMENTS) -> Column:
    """Does a path segment, unescaped, lower-cased and without final digits, have one of these names?"""
    listed = F.array(*(F.lit(n) for n in names))
    escaped = F.regexp_replace(F.regexp_replace(path(url), r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.exists(F.split(F.lower(F.coalesce(F.try_url_decode(escaped), path(url))), "/"), lambda s: F.array_contains(listed, F.regexp_replace(s, r"[0-9]+$", "")))


def path_words(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), r"[^a-z0-9]+"), lambda w: w != "")


def tracking_pattern(params: list[str] = config.TRACKING_PARAMS) -> str:
    names = "|".join(re.escape(p[:-1]) + ".*" if p.endswith("*") else re.escape(p) for p in params)
    return f"(?i)^({names})(=.*)?$"


def canonical_ascii(url: Column) -> Column:
    """Canonical form of plain ASCII http URLs: lower-cased scheme and host, default port, fragment and tracking
    parameters dropped, parameters sorted by key, an empty path made `/`.  Null for other schemes."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    pieces = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike(tracking_pattern()))
    keyed = F.array_sort(F.transform(pieces, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    kept = F.array_join(F.transform(keyed, lambda s: s["p"]), "&")
    p = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(scheme.isin("http", "https") & host(url).isNotNull(), F.concat(scheme, F.lit("://"), host(url), p, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def type_of_url(url: Column) -> Column:
    """Document type that the URL alone tells, or null."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(TYPE_PATTERNS):
        out = F.when(url.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out


_UNRESERVED = set(string.ascii_letters + string.digits + "-._~")
# What may stand unescaped in a path, and in one part of a query, besides unreserved characters.
IN_PATH = "/:@!$&'()*+,;="
IN_QUERY = "/:@!$'()*+,;=?"
_TRACKING = re.compile(tracking_pattern())


def _escapes(text: str, kept: str) -> str:
    """Escapes in upper case, for what needs one and nothing else."""

    def one(m: re.Match) -> str:
        if m["hex"]:
            char = chr(int(m["hex"], 16))
            return char if char in _UNRESERVED else "%" + m["hex"].upper()
        char = m[0]
        return char if char in kept else "".join(f"%{b:02X}" for b in char.encode("utf-8", "replace"))

    return re.sub(r"%(?P<hex>[0-9A-Fa-f]{2})|[^A-Za-z0-9._~-]", one, text)


def _dots(path_: str) -> str:
    out: list[str] = []
    parts = path_.split("/")[1:]
    for k, part in enumerate(parts):
        if part in (".", ".."):
            if part == ".." and out:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def canonicalize_one(url: str | None) -> str | None:
    """RFC 3986 canonical form, or None: http(s) without credentials and with a valid host and port only."""
    from urllib.parse import unquote, urlsplit

    try:
        parts = urlsplit((url or "").strip())
        port = parts.port
        name = parts.hostname or ""
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or not name or "@" in parts.netloc:
        return None
    name = name.rstrip(".")
    if not name or " " in name:
        return None
    if ":" in name:
        name = f"[{name}]"
    else:
        try:
            name = name.encode("idna").decode()  # refuses empty labels and those of over 63 characters
        except UnicodeError:
            return None
    if port is not None and port != {"http": 80, "https": 443}[scheme]:
        name += f":{port}"
    path_ = _dots(_escapes(parts.path or "/", IN_PATH))
    pieces = [p for p in parts.query.split("&") if p and not _TRACKING.match(unquote(p.split("=", 1)[0].replace("+", " ")))]
    pieces = sorted((_escapes(p, IN_QUERY) for p in pieces), key=lambda p: p.split("=", 1)[0])
    return f"{scheme}://{name}{path_}" + ("?" + "&".join(pieces) if pieces else "")


@F.pandas_udf(StringType())
def canonicalize(url: pd.Series) -> pd.Series:
    return url.map(canonicalize_one)


def glob_to_regex(pattern: Column) -> Column:
    """A case-sensitive shell pattern (`*`, `?`, `[set]`, `[!set]`) as an anchored regular expression; a `[` that
    nothing closes stands for itself."""
    quoted = F.regexp_replace(pattern, r"([\\.^$|(){}+&])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[(?![^\[\]]+\])", r"\\[")
    quoted = F.regexp_replace(quoted, r"(?<!\\)\[!", "[^")
    outside = r"(?![^\[\]]*\])"
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*" + outside, ".*"), r"\?" + outside, "."), F.lit("$"))


def registrable_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, registrable) of each distinct host: the name below the longest public suffix; an address or a bare suffix
    is itself.

    suffixes(rule) are lines of a public suffix list: names, `*.name` for any label below it, `!name` against such a
    rule; without a rule the last label is the suffix.  Each host meets the rules by equality with its own endings, so
    the list may be of any length.
    """
    name = hostname(F.col("host"))
    labels = hosts.select("host").distinct().filter("host IS NOT NULL").withColumn("labels", F.split(name, r"\."))
    n = F.size("labels")
    tail = lambda k: F.array_join(F.slice("labels", n - k + 1, k), ".")
    ends = labels.filter(~name.rlike(r"^[0-9.]+$|^\[")).withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    tried = ends.select("host", "labels", F.explode(F.array(
        F.struct(tail(F.col("k")).alias("rule"), F.col("k").alias("size"), F.lit(0).alias("rank")),
        F.struct(F.concat(F.lit("*."), tail(F.col("k") - 1)).alias("rule"), F.col("k").alias("size"), F.lit(0).alias("rank")),
        F.struct(F.concat(F.lit("!"), tail(F.col("k"))).alias("rule"), (F.col("k") - 1).alias("size"), F.lit(1).alias("rank")),
    )).alias("t")).select("host", "t.*")
    best = tried.join(suffixes.select(F.lower("rule").alias("rule")).distinct(), "rule").groupBy("host").agg(F.max(F.struct("rank", "size"))["size"].alias("suffix"))
    found = labels.join(best, "host", "left").withColumn("suffix", F.coalesce("suffix", F.lit(1)))
    whole = name.rlike(r"^[0-9.]+$|^\[") | (n <= F.col("suffix"))
    return found.select("host", F.when(whole, name).otherwise(F.array_join(F.slice("labels", n - F.col("suffix"), F.col("suffix") + 1), ".")).alias("registrable"))


@F.pandas_udf(BooleanType())
def is_public_address(address: pd.Series) -> pd.Series:
    """Is it a public IP address?  IPv4 inside IPv6 counts as IPv4."""
    import ipaddress

    def one(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return False
        a = getattr(a, "ipv4_mapped", None) or a
        return a.is_global and not a.is_multicast

    return address.map(one)
