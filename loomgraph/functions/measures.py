"""Numbers: recency, scales, schedules."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT, Config


def recency(age_days: Column, half_life: Column | float = DEFAULT.half_life_days) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def half_life(kind: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(kind.isin("paper", "pdf"), cfg.slow_half_life_days).otherwise(cfg.half_life_days)


def age_days(now: Column, at: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400e6)


def ppr_scale(ppr: Column, n_documents: Column) -> Column:
    return F.log1p(ppr * F.greatest(n_documents, F.lit(1)))


def hide_penalty(similarity: Column, threshold: float = DEFAULT.hide_threshold) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - threshold) / (1 - threshold)))


def feedback(liked: Column, hidden: Column) -> Column:
    return F.greatest(liked - hidden, F.lit(0.0))


def min_max(value: Column, *group: str) -> Column:
    """0 to 1 within the group; a constant group is 1 where positive, else 0."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value > 0, 1.0).otherwise(0.0))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def token_estimate(chars: Column, per_token: int = DEFAULT.chars_per_token) -> Column:
    return F.ceil(chars / per_token).cast("long")


def retry_hours(failures: Column, cfg: Config = DEFAULT) -> Column:
    return F.lit(cfg.retry_base_h) * F.pow(F.lit(2.0), failures - 1)


def shifted(at: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + (hours * 3.6e9).cast("long"))


def room(window_s: float, crawl_delay: Column, learned: Column, planned: Column, limit: int, cfg: Config = DEFAULT) -> Column:
    """Requests that a domain has room for in the window, those planned taken off; without a delay, the limit."""
    delay = F.greatest(F.lit(cfg.min_delay_s), F.coalesce(crawl_delay, F.lit(0.0)), F.coalesce(learned, F.lit(cfg.start_delay_s)))
    return F.coalesce(F.floor(window_s / F.nullif(delay, F.lit(0.0))) * cfg.concurrency, F.lit(limit)) - F.coalesce(planned, F.lit(0))


def interest_level(weight: Column) -> Column:
    return F.when(weight >= 2.0, "very_interested").otherwise("interested")


def spread(page_size: Column, count: Column) -> Column:
    """count positions evenly spaced through a page, each in the middle of its stretch."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor((2 * i + 1) * page_size / (2 * count)).cast("long"))).otherwise(F.array().cast("array<long>"))
