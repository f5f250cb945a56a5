"""Pure crawl logic over a table of responses: outcomes, headers, robots rules, pacing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT, Config

REDIRECTS, RETRIES = (301, 302, 303, 307, 308), (408, 425, 429)


def outcome(status: Column, location: Column, content_type: Column, size: Column, allowed: list[str], max_bytes: int) -> Column:
    """ok, not_modified, redirect, gone, retry or rejected."""
    bad = ~media_type(content_type).isin(*allowed) | (size > max_bytes)
    return (
        F.when(status == 304, "not_modified")
        .when(status.isin(*REDIRECTS), F.when(F.coalesce(location, F.lit("")) == "", "gone").otherwise("redirect"))
        .when(status.isin(*RETRIES) | (status >= 500), "retry")
        .when(~status.isin(200, 203), "gone")
        .when(F.coalesce(bad, F.lit(True)), "rejected")
        .otherwise("ok")
    )


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(header, ";", 1)))


def charset(header: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(header, r"(?i);\s*charset\s*=\s*\"?([^\s;\"]+)", 1)), F.lit(""))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait, from delta seconds or an HTTP date; never negative, null if unreadable."""
    text = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d) GMT$", "$1"), F.lit("d MMM yyyy HH:mm:ss"))
    seconds = F.when(text.rlike(r"^\d+$"), F.expr("NULL").cast("double")).otherwise((F.unix_micros(date) - F.unix_micros(now.cast("timestamp"))) / 1e6)
    return F.greatest(F.when(text.rlike(r"^\d{1,9}$"), text.try_cast("double")).otherwise(seconds), F.lit(0.0))


#: Bytes of a robots.txt that count, and redirects followed to it, fixed values.
ROBOTS_BYTES, ROBOTS_REDIRECTS = 500 * 1024, 5


def robots_status(status: Column, redirects: Column | None = None) -> Column:
    """found, missing (everything allowed; also beyond the most redirects) or unreachable (nothing allowed)."""
    lost = F.lit(False) if redirects is None else F.coalesce(redirects > ROBOTS_REDIRECTS, F.lit(False))
    return F.when(lost, "missing").when(status.between(200, 299), "found").when(status.between(300, 499), "missing").otherwise("unreachable")


def robots_update(rows: DataFrame) -> DataFrame:
    """rows(host, old_text, old_status, new_text, new_status) with text, status and refreshed: a failed refresh keeps
    the cached copy."""
    failed = F.col("new_status") == "unreachable"
    cached = F.col("old_status").isNotNull()
    return rows.withColumns({
        "text": F.when(failed & cached, F.col("old_text")).otherwise(F.col("new_text")),
        "status": F.when(failed & cached, F.col("old_status")).otherwise(F.col("new_status")),
        "refreshed": ~failed,
    })


def robots_rules(text: str | None, agent: str) -> tuple[list[tuple[bool, str]], float | None, list[str]]:
    """((allow, pattern) rules, crawl delay, sitemaps) for an agent's product token; its own groups come before `*`."""
    groups: dict[str, list[tuple[str, str]]] = {}
    names: list[str] = []
    open_, sitemaps = False, []
    for line in (text or "").encode()[:ROBOTS_BYTES].decode(errors="ignore").splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
            for n in names:
                groups.setdefault(n, [])
        elif field == "sitemap":
            sitemaps.append(value)
        elif field in ("allow", "disallow", "crawl-delay"):
            open_ = False
            for n in names:
                groups[n].append((field, value))
    token = agent.lower().split("/")[0]
    own = groups.get(token, groups.get("*", []))
    delay = next((float(v) for f, v in own if f == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", v)), None)
    return [(f == "allow", v) for f, v in own if f != "crawl-delay" and v], delay, sitemaps


def _plain(path: str) -> str:
    """A path or pattern with escapes in upper case, unreserved characters unescaped and all beyond ASCII escaped."""
    text = "".join(c if c.isascii() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in path)

    def one(m: re.Match) -> str:
        char = chr(int(m[1], 16))
        return char if char.isascii() and (char.isalnum() or char in "-._~") else "%" + m[1].upper()

    return re.sub(r"%([0-9A-Fa-f]{2})", one, text)


def _fits(pattern: str, path: str) -> bool:
    """Does a pattern with `*` and a final `$` match a path from its start?  Each part is sought once, from left to right."""
    anchored = pattern.endswith("$")
    first, *rest = pattern.removesuffix("$").split("*")
    if not path.startswith(first):
        return False
    at = len(first)
    for part in rest[:-1] if anchored else rest:
        found = path.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    if not anchored:
        return True
    return path.endswith(rest[-1]) and len(path) - len(rest[-1]) >= at if rest else at == len(path)


def robots_allows(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest matching rule decides, allow beats disallow, no match allows."""
    best, path = (-1, True), _plain(path)
    for allow, pattern in rules:
        pattern = _plain(pattern)
        if _fits(pattern, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls(host, path) with `allowed`: joined with robots(host, text, status) and judged in Arrow batches."""
    joined = urls.join(robots.select("host", F.col("text").alias("_text"), F.col("status").alias("_status")), "host", "left")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("_text", "_status").schema.fields)

    def judged(batches):
        known: dict[str, list] = {}
        for pdf in batches:
            allowed = []
            for path, text, status in zip(pdf["path"], pdf["_text"], pdf["_status"], strict=True):
                if status == "found":
                    if text not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[text] = robots_rules(text, agent)[0]
                    allowed.append(robots_allows(known[text], path or "/"))
                else:
                    allowed.append(status != "unreachable")
            yield pdf.drop(columns=["_text", "_status"]).assign(allowed=allowed)

    return joined.mapInPandas(judged, f"{columns}, allowed boolean")


def signal(outcome_: Column, status: Column) -> Column:
    """What a request's outcome tells the domain's gate."""
    return F.when(outcome_ == "retry", "failed").when(status.isin(401, 403), "refused").otherwise("succeeded")


def exhausted(requests: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(domain): domains whose last requests in a row failed or were refused too often; requests(domain, at, signal)."""
    good = requests.filter("signal = 'succeeded'").groupBy("domain").agg(F.max("at").alias("good"))
    tail = requests.filter("signal <> 'succeeded'").join(good, "domain", "left").filter("good IS NULL OR at > good")
    counts = tail.groupBy("domain").agg(F.count(F.when(F.col("signal") == "failed", 1)).alias("errors"), F.count(F.when(F.col("signal") == "refused", 1)).alias("refusals"))
    return counts.filter((F.col("errors") >= cfg.max_errors) | (F.col("refusals") >= cfg.max_refusals)).select("domain")


def learned_delays(observations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(domain, delay_s): the adaptive delay after a domain's observations(domain, at, signal, latency_s, floor_s).

    Each success moves the delay halfway to factor x latency, within bounds; a refusal or failure takes it back to
    the start at least.  Every step has the form x -> min(max(a x + b, lo), hi), and so has a run of steps: the
    observations of one domain and day, of which the pacing itself bounds the number, become one such step, and a
    domain's delay is the fold of its days.
    """
    floors = observations.groupBy("domain").agg(F.max(F.coalesce("floor_s", F.lit(0.0))).alias("floor"))
    day = F.to_date("at") if dict(observations.dtypes)["at"].startswith("timestamp") else F.floor(F.col("at") / 86400)
    seen = F.array_sort(F.collect_list(F.struct("at", "signal", "latency_s"))).alias("seen")
    days = observations.groupBy("domain", day.alias("day")).agg(seen).join(floors, "domain")
    most = F.greatest(F.lit(cfg.max_delay_s), F.col("floor"))

    def bounded(x: Column) -> Column:
        return F.least(F.greatest(x, F.col("floor"), F.lit(cfg.min_delay_s)), most)

    def step(f: Column, o: Column) -> Column:
        ok, aim, least = o["signal"] == "succeeded", bounded(o["latency_s"] * cfg.latency_factor), bounded(F.lit(cfg.start_delay_s))

        def moved(x: Column, limited: bool = True) -> Column:
            return F.when(ok, (x + aim) / 2).otherwise(F.least(F.greatest(x, least), most) if limited else x)

        slope = F.when(ok, f["a"] / 2).otherwise(f["a"])
        return F.struct(slope.alias("a"), moved(f["b"], limited=False).alias("b"), moved(f["lo"]).alias("lo"), moved(f["hi"]).alias("hi"))

    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-1e300).alias("lo"), F.lit(1e300).alias("hi"))
    steps = days.select("domain", "floor", F.struct("day", F.aggregate("seen", same, step).alias("f")).alias("s"))
    folded = steps.groupBy("domain", "floor").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    one = lambda x, s: F.least(F.greatest(s["f"]["a"] * x + s["f"]["b"], s["f"]["lo"]), s["f"]["hi"])
    return folded.select("domain", F.aggregate("steps", bounded(F.lit(cfg.start_delay_s)), one).alias("delay_s"))


def gate_floors(hosts: DataFrame) -> DataFrame:
    """(registrable, floor_s): hosts of one registrable domain share a gate, no faster than the slowest Crawl-delay;
    hosts(host, registrable, crawl_delay_s)."""
    return hosts.groupBy("registrable").agg(F.max(F.coalesce("crawl_delay_s", F.lit(0.0))).alias("floor_s"))


def robots_fresh(fetched_at: Column, now: Column, ttl_h: float = 24.0) -> Column:
    """Whether the cached robots text still serves."""
    return F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(fetched_at.cast("timestamp"))) < ttl_h * 3.6e9, F.lit(False))


def feed_health(feeds: DataFrame, entries: DataFrame, now: Column, max_age_days: float = 180.0) -> DataFrame:
    """(source, entries, newest, finding): empty, undated, stale, future or null; entries(source, published, updated)."""
    dated = entries.groupBy("source").agg(F.count("*").alias("entries"), F.max(F.coalesce("published", "updated")).alias("newest"))
    rows = feeds.select("source").join(dated, "source", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 86400e6
    finding = F.when(F.col("entries") == 0, "empty").when(F.col("newest").isNull(), "undated").when(age > max_age_days, "stale").when(age < 0, "future")
    return rows.select("source", "entries", "newest", finding.alias("finding"))


def backoff(delay: Column, errors: Column, asked: Column, cfg: Config = DEFAULT) -> Column:
    """Pause after failures in a row: the longer of what the server asked for and doubling, within the limit."""
    return F.least(F.greatest(asked, delay * F.pow(F.lit(2.0), errors)), F.lit(cfg.backoff_max_s))


def poll_targets(frontier: DataFrame, feeds: DataFrame, max_hops: int = 0) -> DataFrame:
    """(domain, url, hops): domains with feeds or near enough a seed, with their first URL; frontier(domain, url, hops),
    feeds(domain)."""
    least = frontier.groupBy("domain").agg(F.min("url").alias("url"), F.min("hops").alias("hops"))
    return least.join(feeds.select("domain").distinct().withColumn("f", F.lit(True)), "domain", "left").filter(F.col("f").isNotNull() | (F.col("hops") <= max_hops)).drop("f")


def newest(items: DataFrame, limit: int, now: Column, max_age_days: float | None = None) -> DataFrame:
    """The newest items of each source: published ones first, then updated, undated last; items(source, pos, published,
    updated)."""
    date = F.coalesce("published", "updated")
    rows = items if max_age_days is None else items.filter(date.isNull() | (date >= now - F.make_dt_interval(F.lit(int(max_age_days)))))
    w = Window.partitionBy("source").orderBy(F.col("published").isNotNull().desc(), date.desc_nulls_last(), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def sitemap_files(files: DataFrame, skip: list[str], path_words: Column, limit: int) -> DataFrame:
    """Sitemap files worth reading, those with the path word `news` first; files(source, pos, url)."""
    kept = files.filter(~F.arrays_overlap(path_words, F.array(*(F.lit(s) for s in skip))))
    w = Window.partitionBy("source").orderBy(F.array_contains(path_words, "news").desc(), "pos")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def item_position(hops: Column, same_site: Column, kind: Column) -> Column:
    """Hops of a feed or sitemap item: same site as its source, one more off site, null (dropped) for off-site sitemaps."""
    return F.when(same_site, hops).when(kind == "feed", hops + 1)
