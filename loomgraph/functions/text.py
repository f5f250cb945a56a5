"""Text functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: White space as Unicode defines it, with the separators U+001C-U+001F: what Python's str.split cuts at.
SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, WORD = f"[{SPACES}]", f"[^{SPACES}]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used: interpreted expressions share nothing."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Characters at the end of a text's head where a cut is looked for first.
TAIL = 80


def stripped(text: Column) -> Column:
    """Without white space at its ends, which are all that is looked at."""
    return F.regexp_extract(text, rf"(?s)\A{SPACE}*+(.*{WORD})", 1)


def flat(text: Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize(text: Column, most: int = 200_000) -> Column:
    """CR LF becomes LF, runs of other white space one space, lines trimmed, at most one blank line, cut at `most`.

    Without Unicode composition: `normalize_nfc` adds that.
    """
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, f"[{SPACES}&&[^\n]]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(t, r"^[ \n]+|[ \n]+$", ""), 1, most)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    from unicodedata import normalize as composed

    return text.map(lambda t: None if t is None else composed("NFC", t))


def normalize_nfc(text: Column, most: int = 200_000) -> Column:
    return normalize(nfc(text), most)


def word_count(text: Column) -> Column:
    t = flat(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def excerpt(text: Column, most: int = 300) -> Column:
    """Flattened text; a longer one is cut before its last space, if it has one, and gets an ellipsis.

    The text's head is flattened first; the rest only if that is not longer than the excerpt."""
    flattened = once(flat(F.substring(text, 1, 2 * most)), lambda head: F.when(F.length(head) > most, head).otherwise(flat(text)))

    def shortened(t: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", ""), r"[ ,;:.]+$", "")
        return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("…")))

    return once(flattened, shortened)


def truncate_words(text: Column, most: int) -> Column:
    """At most `most` characters; a cut inside a word goes back to the white space before the word, if something stands
    before that.  A text that was cut has no white space at its end."""

    def cut(head: Column) -> Column:
        inside = F.substring(text, most + 1, 1).rlike(WORD) & head.rlike(rf"{WORD}{SPACE}+{WORD}*\n?\z")
        whole = F.when(inside, F.regexp_replace(head, rf"{SPACE}+{WORD}*\n?\z", "")).otherwise(head)
        return F.regexp_replace(whole, rf"{SPACE}+\z", "")

    # What goes lies in the head's tail, unless the tail is no more than a part of it.
    before = max(most - TAIL, 0)
    tail = F.substring(text, before + 1, most - before)
    ends = once(tail, lambda t: F.when(~t.rlike(rf"\A{SPACE}*{WORD}*\n?\z"), F.concat(F.substring(text, 1, before), cut(t))))
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(ends, cut(F.substring(text, 1, most))))


def embedding_input(title: Column, summary: Column, text: Column, most: int = 2000) -> Column:
    """Title, excerpt and text, stripped, blank ones left out, joined by blank lines; no excerpt that repeats the start
    of the text."""

    def joined(s: Column) -> Column:
        start = flat(F.regexp_replace(s, "…$", ""))
        repeated = (F.length(text) > 0) & F.startswith(flat(F.substring(text, F.lit(1), 2 * F.length(s))), start)
        parts = F.array(title, F.when(~F.coalesce(repeated, F.lit(False)), s), truncate_words(text, most))
        return F.array_join(F.filter(F.transform(parts, stripped), lambda p: p.isNotNull() & (p != "")), "\n\n")

    return once(summary, joined)


def body_hash(body: Column) -> Column:
    """SHA-256 of the bytes of a response, which tells an unchanged page."""
    return F.sha2(body, 256)


def content_hash_ascii(text: Column) -> Column:
    """SHA-256 of the lower-cased, flattened text; see content_hash for full case folding."""
    return F.sha2(F.lower(flat(text)), 256)


@F.pandas_udf(StringType())
def content_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of the text after compatibility composition, case folding and flattening."""
    import hashlib
    import unicodedata

    def one(t):
        return None if t is None else hashlib.sha256(" ".join(unicodedata.normalize("NFKC", t).casefold().split()).encode()).hexdigest()

    return text.map(one)


def clip(text: Column, most: int) -> Column:
    """Flattened and cut; null if empty."""
    return F.nullif(F.substring(flat(text), 1, most), F.lit(""))
