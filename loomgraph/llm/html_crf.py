"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A lenient parser cuts a page into leaf blocks: runs of text between block-level tags, with their open ancestors.
Each block has binary features of its ancestors' tags, of the words in their class, id and role, and of its text.
A CRF with the labels 0 (boilerplate) and 1 (main text) is trained by gradient ascent on the likelihood of labelled
pages; Viterbi decodes a page's blocks.  The labelled pages come from `labelled_pages`, a fixed number of pages of
varied layouts, so training is bounded and the same everywhere; other pages with labels may be given instead.

Edge cases: null, empty and blockless pages give an empty text; unclosed and misnested tags close as browsers
close them; scripts, styles, templates and comments are never text; whole pages are read whatever their length;
repeated rows each get a row; an empty table gives an empty result; further columns are ignored.  Formulas and
fallback text of math, svg, object, canvas, audio and video are text like any other.  Parsing takes time in proportion
to the page, whatever its nesting.  Bylines and dates inside the article are main text: nothing but the kinds of
boilerplate named above is dropped.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul label input".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is raw text up to their end tag, or the end of the page, and never main text.
RAW_TAGS = frozenset("script style textarea title".split())
#: Skipped up to their end tag; one that is never closed is an element like others.
SKIPPED_TAGS = frozenset("xmp noscript noembed noframes iframe template".split())
#: An opening tag closes these open ones, up to the nearest of the boundary tags.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_ENDS = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW_TAGS | SKIPPED_TAGS}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: What words in class, id and role hint at.
HINTS = {
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pagination pager skip topbar tabs sitemap",
    "head": "header masthead banner logo branding hero top",
    "foot": "footer foot copyright legal colophon contentinfo credits bottom",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more complementary teaser teasers promo latest",
    "ad": "ad ads adv advert advertisement adverts advertising sponsor sponsored sponsors dfp adsense adslot promoted promotion commercial",
    "notice": "cookie cookies consent notice notices gdpr alert banner popup modal overlay newsletter subscribe subscription signup paywall dialog toast disclaimer message warning announcement privacy",
    "comment": "comment comments reply replies disqus respond discussion thread responses reader readers feedback commentlist reviews",
    "social": "share sharing social follow tweet facebook buttons toolbar tools actions meta byline tags",
    "form": "form search login register input contact",
    "good": "content article post entry story text main body prose page maintext articlebody",
}
_HINT_OF = {}
for _hint, _words in HINTS.items():
    for _word in _words.split():
        _HINT_OF.setdefault(_word, []).append(_hint)
_PHRASES = {
    "rights": r"©|\(c\)|copyright|all rights reserved", "cookie": r"\bcookies?\b|\bconsent\b|\bgdpr\b", "subscribe": r"\bsubscribe|\bnewsletter|\bsign up\b|\blog ?in\b|\bregister\b",
    "advert": r"\badvertis|\bsponsored\b|\bpromoted\b", "share": r"\bshare\b|\bfollow us\b|\btweet\b", "more": r"\bread more\b|\brelated\b|\bclick here\b|\bsee also\b", "comments": r"\bcomments?\b|\breply\b|\breplied\b|\bposted by\b|\bsays:|\bdiscussion\b|\b(?:hour|day|week)s? ago\b",
}
_PHRASES = {k: re.compile(v, re.I) for k, v in _PHRASES.items()}
#: Every text with a phrase holds, in lower case, one of these strings; most texts hold none.
_SIGNS = {
    "rights": ("©", "(c)", "copyright", "rights"), "cookie": ("cookie", "consent", "gdpr"), "subscribe": ("subscribe", "newsletter", "sign up", "log", "register"),
    "advert": ("advertis", "sponsored", "promoted"), "share": ("share", "follow us", "tweet"), "more": ("read more", "related", "click here", "see also"),
    "comments": ("comment", "reply", "replied", "posted by", "says:", "discussion", " ago"),
}
_ENDINGS = frozenset('.!?…»"”')
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TAGS = "nav header footer aside form button article main section figure figcaption table ul ol blockquote pre dialog select label fieldset address menu details".split()


@dataclass
class Block:
    """A leaf block: its text, how much of it is link text, and the features of where it stands."""

    text: str
    linked: int
    where: frozenset[str]
    tag: str
    article: int  # which outermost article element it stands in; 0: none


def attributes_of(raw: str) -> frozenset[str]:
    """Features of an element's attributes."""
    found = set()
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for word in _WORD.findall(_CAMEL.sub(" ", value).lower()):
                found.update(f"hint:{h}" for h in _HINT_OF.get(word, ()))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add("hidden")
    return frozenset(found)


def tag_end(html: str, at: int) -> int:
    """Position of the > that ends the tag at `at`, quotes respected unless they never close; -1: none."""
    end = html.find(">", at)
    seek = at
    while end >= 0:
        quotes = [q for q in (html.find('"', seek, end), html.find("'", seek, end)) if q >= 0]
        if not quotes:
            return end
        q = min(quotes)
        if html[q - 1] not in "= \t\n\r":  # not the start of a value
            seek = q + 1
            continue
        close = html.find(html[q], q + 1)
        if close < 0:
            return end
        seek = close + 1
        if close > end:
            end = html.find(">", close)
    return -1


class Open:
    """The stack of open elements: their tags, the features of each with its ancestors, the innermost block of each,
    and where each tag is open, so that no step has to walk over the stack."""

    def __init__(self):
        self.tags: list[str] = []
        self.where: list[frozenset[str]] = []
        self.block: list[int] = []
        self.article: list[int] = []
        self.articles = 0
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, own: frozenset[str]) -> None:
        k = len(self.tags)
        self.where.append(self.where[-1] | own if k else own)
        self.block.append(k if tag in BLOCK_TAGS else self.block[-1] if k else -1)
        outer = self.article[-1] if k else 0
        if tag == "article" and not outer:
            self.articles += 1
            outer = self.articles
        self.article.append(outer)
        self.tags.append(tag)
        self.at[tag].append(k)

    def pop_to(self, k: int) -> None:
        for tag in self.tags[k:]:
            self.at[tag].pop()
        del self.tags[k:], self.where[k:], self.block[k:], self.article[k:]

    def innermost(self) -> int:
        """Position of the innermost open block; -1: none."""
        return self.block[-1] if self.block else -1

    def place(self) -> tuple[frozenset[str], str, int]:
        return (self.where[-1], self.tags[self.innermost()] if self.innermost() >= 0 else "", self.article[-1]) if self.tags else (frozenset(), "", 0)

    def close(self, tag: str) -> None:
        """An end tag; that of an inline element does not close blocks."""
        if self.at[tag] and (tag in BLOCK_TAGS or self.at[tag][-1] > self.innermost()):
            self.pop_to(self.at[tag][-1])

    def before(self, tag: str) -> None:
        """Close what an opening tag ends: a paragraph, and the items or cells of the same list or table."""
        if tag in BLOCK_TAGS and tag not in ("label", "button", "input") and self.innermost() >= 0 and self.tags[self.innermost()] == "p":
            self.pop_to(self.innermost())
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            bound = max((self.at[b][-1] for b in bounds if self.at[b]), default=-1)
            inside = [self.at[e][n] for e in ends if (n := bisect_right(self.at[e], bound)) < len(self.at[e])]
            if inside:
                self.pop_to(min(inside))


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in page order."""
    out: list[Block] = []
    open_, text = Open(), []
    html, at, linked, started = html or "", 0, 0, False
    place: tuple[frozenset[str], str, int] = (frozenset(), "", 0)

    def flush() -> None:
        nonlocal linked, started
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, linked, *place))
        text.clear()
        linked, started = 0, False

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            lt = len(html)
        if lt > at:
            piece = html[at:lt]
            size = len(piece.strip())
            if not started:
                place, started = open_.place(), size > 0
            text.append(piece)
            if open_.at["a"]:
                linked += size
        if lt == len(html):
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = len(html) if end < 0 else end + 3
            continue
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?"):
            end = html.find(">", lt)
            at = len(html) if end < 0 else end + 1
            continue
        closing = after == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if not name:
            if closing:
                end = html.find(">", lt)
                at = len(html) if end < 0 else end + 1
            else:
                text.append("&lt;")
                at = lt + 1
            continue
        end = tag_end(html, name.end())
        if end < 0:
            break  # a tag that never ends
        tag, at = name[0].lower(), end + 1
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            text.append(" ")
        if closing:
            open_.close(tag)
            continue
        if tag in _ENDS and (close := _ENDS[tag].search(html, at)):
            at = html.find(">", close.end()) + 1 or len(html)
            continue
        if tag in RAW_TAGS:
            break  # raw text up to the end of the page
        open_.before(tag)
        if tag in VOID_TAGS:
            continue
        own = attributes_of(html[name.end() : end])
        open_.push(tag, own | {f"in:{tag}"} if tag in _TAGS else own)
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Binary features of each block of a page."""
    sizes: dict[int, int] = defaultdict(int)
    for b in page:
        sizes[b.article] += len(b.text)
    headed = {b.article for b in page if b.tag == "h1"}
    has_main = any("in:main" in b.where or "hint:good" in b.where for b in page)
    likely = {b.article for b in page if b.article in headed or "hint:comment" not in b.where and (not has_main or "in:main" in b.where or "hint:good" in b.where)} - {0}
    largest = max(likely, key=lambda k: (k in headed, sizes[k]), default=0)  # comments may be articles too
    heading = next((k for k, b in enumerate(page) if b.tag == "h1"), None)

    def place_of(b: Block) -> str:
        if largest:
            return "main-article" if b.article == largest else "other-article" if b.article else "outside-article"
        return "main" if "in:main" in b.where or "hint:good" in b.where else "outside-main" if has_main else "plain"

    places = [place_of(b) for b in page]
    last_inside = max((k for k, x in enumerate(places) if x in ("main-article", "main")), default=None)
    under: list[str] = []
    out = []
    for k, b in enumerate(page):
        words, n = b.text.count(" ") + 1, len(b.text)
        dense = b.linked / max(n, 1)
        found = {"bias", f"tag:{b.tag}", *b.where}
        found.add("words:" + ("1" if words == 1 else "2-4" if words < 5 else "5-14" if words < 15 else "15-39" if words < 40 else "40+"))
        found.add("links:" + ("none" if not b.linked else "few" if dense < 0.3 else "some" if dense < 0.8 else "all"))
        if b.text[-1] in _ENDINGS:
            found.add("ends")
        if heading is not None:
            found.add("before-h1" if k < heading else "after-h1")
        low = b.text.lower()
        says = [f"says:{name}" for name, signs in _SIGNS.items() if any(x in low for x in signs) and _PHRASES[name].search(b.text)]
        found.update(f"{x}@{places[k]}" for x in says)
        if b.tag in _HEADINGS:
            under = [f"under:{x[5:]}" for x in says]  # what the last heading says
        found.update(under)
        if last_inside is not None and k > last_inside:
            found.add("after-the-end")
        found.add(f"place:{places[k]}")
        out.append(sorted(found))
    return out


class Crf:
    """Two-label linear-chain CRF over binary features."""

    def __init__(self, names: list[str], emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.index = {x: k for k, x in enumerate(names)}
        self.emission, self.transition, self.start = emission, transition, start

    def scores(self, page: list[list[str]]) -> np.ndarray:
        return np.array([self.emission[[self.index[x] for x in f if x in self.index]].sum(0) for f in page]).reshape(-1, 2)

    def decode(self, page: list[list[str]]) -> list[int]:
        """The best labels, by Viterbi; ties go to 1."""
        if not page:
            return []
        e = self.scores(page)
        best, back = self.start + e[0], []
        for row in e[1:]:
            total = best[:, None] + self.transition
            from_ = 1 - total[::-1].argmax(0)
            back.append(from_)
            best = total[from_, [0, 1]] + row
        labels = [int(best[1] >= best[0])]
        for from_ in reversed(back):
            labels.append(int(from_[labels[-1]]))
        return labels[::-1]

    @staticmethod
    def expectations(e: np.ndarray, transition: np.ndarray, start: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition function, and expected labels and pairs of labels, of each page by forward-backward; e holds
        the emission scores (pages, blocks, labels), mask which blocks there are."""
        n, longest = mask.shape
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp.reduce(forward[:, t - 1, :, None] + transition, axis=1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], moved, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = np.logaddexp.reduce(transition + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], moved, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        double = np.exp(forward[:, :-1, :, None] + transition + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        return total, single, double

    @staticmethod
    def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.15, ridge: float = 2e-4) -> Crf:
        """Maximum likelihood with a ridge, by Adam over all pages at once."""
        names = sorted({x for f, _ in pages for b in f for x in b})
        index = {x: k for k, x in enumerate(names)}
        n, longest = len(pages), max(len(y) for _, y in pages)
        x = np.zeros((n, longest, len(names)), np.float32)
        y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for k, (f, labels) in enumerate(pages):
            for t, b in enumerate(f):
                x[k, t, [index[v] for v in b]] = 1
            y[k, : len(labels)], mask[k, : len(labels)] = labels, True
        flat = x.reshape(-1, len(names))
        truth = np.eye(2)[y] * mask[..., None]
        pairs = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
        theta = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]

        def gradients() -> list[np.ndarray]:
            _, single, double = Crf.expectations((flat @ theta[0].astype(np.float32)).reshape(n, longest, 2).astype(float), theta[1], theta[2], mask)
            return [
                (flat.T @ (truth - single).reshape(-1, 2).astype(np.float32)).astype(float) / n - ridge * theta[0],
                (pairs - double.sum((0, 1))) / n - ridge * theta[1], (truth[:, 0] - single[:, 0]).sum(0) / n - ridge * theta[2],
            ]

        first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        for step in range(1, rounds + 1):
            for k, g in enumerate(gradients()):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                theta[k] = theta[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return Crf(names, *theta)


#: How a made page names its parts: with telling words, with words that tell nothing, or not at all; and what holds
#: its article.
NAMINGS = ("telling", "opaque", "none")
CONTAINERS = ("article", "main", "named", "bare")


def labelled_pages(n: int = 480, seed: int = 3, namings: tuple[str, ...] = NAMINGS, containers: tuple[str, ...] = CONTAINERS) -> list[tuple[str, list[int]]]:
    """n made pages of the given families of layouts, each with the label of every leaf block."""
    r = random.Random(seed)
    syllables = "an ber de en fer gu ha il ka lo mi no or pa qui re sa tu ver zo".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(a, b)))

    def sentence(a: int = 1, b: int = 30) -> str:
        return words(a, b).capitalize() + r.choice(["." * 9, ".", ".", "!", "?", ""])[:1]

    def page() -> tuple[str, list[int]]:
        parts, labels = [], []
        container = r.choice(containers)
        naming = r.choice(["telling", "telling", *namings] if "telling" in namings else list(namings))

        def add(markup: str, *label: int) -> None:
            parts.append(markup)
            labels.extend(label)

        def links(tag: str, attrs: str, count: int) -> None:
            items = "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(count))
            add(f"<{tag}{attrs}><ul>{items}</ul></{tag}>", *[0] * count)

        def named(*choices: str) -> str:
            if naming == "none":
                return ""
            name = r.choice(choices) if naming == "telling" else "-".join("".join(r.choices(syllables, k=2)) for _ in range(r.randint(1, 2)))
            return f' {r.choice(["class", "class", "id"])}="{name}"'

        def boiler(*kinds: str) -> None:
            kind = r.choice(kinds)
            if kind == "nav":
                tag, attrs = r.choice([("nav", ""), ("nav", named("main-nav", "menu")), ("div", named("navbar", "site-menu", "breadcrumbs")), ("div", ' role="navigation"' if naming == "telling" else named(""))])
                links(tag, attrs, r.randint(2, 7))
            elif kind == "header":
                tag, attrs = r.choice([("header", ""), ("header", named("site-header")), ("div", named("masthead", "page-header")), ("div", ' role="banner"' if naming == "telling" else named(""))])
                add(f"<{tag}{attrs}><p>{words(1, 9)}</p></{tag}>", 0)
            elif kind == "footer":
                tag, attrs = r.choice([("footer", ""), ("footer", ""), ("div", named("footer", "site-footer", "copyright")), ("div", ' role="contentinfo"' if naming == "telling" else named(""))])
                add(f"<{tag}{attrs}>{r.choice(['&copy; ', 'Copyright ', '', ''])}{sentence(1, 12)}</{tag}>", 0)
            elif kind == "ad":
                attrs = r.choice([named("ad", "ads", "advert", "ad-slot", "sponsored"), named("banner-ad", "promo"), named("advertisement")])
                add(f"<{r.choice(['div', 'div', 'section'])}{attrs}>{sentence(2, 30)}</div>".replace("</div>", "</div></section>"), 0)
            elif kind == "side":
                tag, attrs = r.choice([("aside", ""), ("aside", named("sidebar")), ("div", named("sidebar", "related-posts", "widget", "recommended"))])
                title = words(1, 4) if naming == "telling" or tag == "aside" else r.choice(["Related", "Read more", "See also", "Related stories"])
                body = f"<h3>{title}</h3><p>{sentence(3, 40)}</p>"
                add(f"<{tag}{attrs}>{body}</{tag}>", 0, 0)
            elif kind == "notice":
                attrs = r.choice([named("cookie-notice", "cookie-banner", "consent"), named("notice", "alert"), named("newsletter", "popup"), ' role="dialog"' if naming == "telling" else named(""), ' role="alert"' if naming == "telling" else named("")])
                add(f"<div{attrs}><p>{r.choice(['We use cookies. ', 'Subscribe to our newsletter. ', ''])}{sentence(3, 25)}</p></div>", 0)
            elif kind == "form":
                add(f"<form{r.choice(['', named('search-form', 'login', 'contact')])}><label>{words(1, 3)}</label><input name='q'><p>{sentence(2, 15)}</p><button>{words(1, 2)}</button></form>", 0, 0, 0)
            elif kind == "share":
                add(f"<div{named('share', 'social-links', 'share-buttons')}>{words(1, 5)}</div>", 0)
            else:
                count = r.randint(1, 4)
                style = r.choice(["div", "article", "li"])
                if naming != "telling":
                    style = "div"
                by = r.choice(["", "", "<b>{} says:</b> ", "{}, 3 days ago: "])
                inner = "".join(f"<{style}{named('comment', 'reply', 'comment-body')}><p>{by.format(words(1, 2))}{sentence(3, 40)}</p></{style}>" for _ in range(count))
                tag, attrs = r.choice([("section", named("comments")), ("div", named("comments", "reader-comments", "disqus_thread", "responses"))])
                title = words(1, 3) if naming == "telling" and r.random() < 0.7 else r.choice(["Comments", "3 comments", "Leave a reply", "Reader comments", "Join the discussion"])
                titled = r.random() < 0.6 or naming != "telling" and container in ("named", "bare")  # else nothing tells it from the article
                add(f"<{tag}{attrs}>{f'<h3>{title}</h3>' if titled else ''}{inner}</{tag}>", *[0] * (count + titled))

        def body() -> None:
            if r.random() < 0.85:
                title = f"<h1>{sentence(1, 12)}</h1>"
                add(f"<header>{title}</header>" if r.random() < 0.2 else title, 1)
            for _ in range(r.randint(1, 9)):
                kind = r.random()
                if kind < 0.72:
                    text = sentence(1, 60)
                    if r.random() < 0.06:
                        text = r.choice(["All rights reserved.", "They share the cookies.", "Read more about it there.", "He said: no comment.", "The sponsored match was lost.", "You may subscribe to it."])
                    if r.random() < 0.25:
                        text = f"{r.choice(['<b>', '<em>', '<a href=x>'])}{text}" + r.choice(["<br>", "</b>", "</a>"])
                    add(f"<p>{text}{r.choice(['</p>', '</p>', ''])}", 1)
                elif kind < 0.82:
                    add(f"<h{r.choice('234')}>{words(1, 8)}</h2>", 1)
                elif kind < 0.9:
                    count = r.randint(1, 4)
                    add("<ul>" + "".join(f"<li>{sentence(2, 20)}</li>" for _ in range(count)) + "</ul>", *[1] * count)
                elif kind < 0.95:
                    add(f"<blockquote>{sentence(5, 30)}</blockquote>", 1)
                elif kind < 0.97:
                    add(f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>", 1, 1)
                elif kind < 0.985:
                    add(f"<pre>{words(2, 9)}</pre>", 1)
                else:
                    boiler("ad", "share", "side", "notice", "form")

        begins = r.random() < 0.25  # with the article
        for kind in () if begins else ("notice", "header", "nav", "ad"):
            if r.random() < (0.85 if kind == "nav" else 0.35):
                boiler(kind)
        start, end = {
            "article": [("<article>", "</article>"), ("<main><article>", "</article></main>"), (f"<article{named('post')}>", "</article>")], "bare": [("<div>", "</div>")],
            "main": [("<main>", "</main>"), ('<div role="main">', "</div>")], "named": [(f"<div{named('content', 'main-content', 'post-body')}>", "</div>"), (f"<section{named('entry-content')}>", "</section>")],
        }[container][r.randrange({"article": 3, "bare": 1}.get(container, 2))]
        parts.append(start)
        body()
        if r.random() < 0.15:
            boiler("share", "comment", "form")
        parts.append(end)
        for kind in ("comment", "side", "form", "ad", "footer"):
            if r.random() < (0.85 if kind == "footer" else 0.4 if kind == "comment" else 0.25):
                boiler(kind)
        return "<html><head><title>x</title></head><body>" + "".join(parts) + r.choice(["</body></html>", ""]), labels

    return [page() for _ in range(n)]


_TRAINED: dict[int, Crf] = {}


def trained(pages: list[tuple[str, list[int]]] | None = None) -> Crf:
    """The CRF of the given labelled pages, or of the made ones (kept)."""
    if pages is None:
        if 0 not in _TRAINED:
            _TRAINED[0] = trained(labelled_pages())
        return _TRAINED[0]
    return Crf.train([(features(blocks(h)), y) for h, y in pages])


def main_text(html: str | None, crf: Crf) -> str:
    page = blocks(html)
    return "\n\n".join(b.text for b, y in zip(page, crf.decode(features(page)), strict=True) if y)


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages`."""
    shared = pages.sparkSession.sparkContext.broadcast(crf or trained())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            texts = [main_text(h.as_py(), crf) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op1_crf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
