"""Tunables that the operators share, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
SKIP_SEGMENTS = "account accounts cart checkout forgot-password login logout password-reset register sign-in sign-up signin signup subscribe subscription subscriptions".split()
TRACKING_PARAMS = "utm_* mc_* fbclid gclid gclsrc dclid msclkid igshid ref ref_src _hsenc _hsmi".split()
SITEMAP_SKIP_WORDS = (
    "author authors categories category cities city collections contributor contributors landing location locations player players region regions roster rosters "
    "schedule schedules standings stats subscription tag tagpages tags team teams topic topics weather"
).split()
PRESETS = {  # weights of interest, ppr, feedback, recency, hide
    "balanced": (1.0, 1.0, 0.5, 0.5, 1.0),
    "trust_my_sources": (0.5, 2.0, 0.5, 0.5, 1.0),
    "match_my_interests": (2.0, 0.5, 0.5, 0.5, 1.0),
    "fresh": (0.5, 0.5, 0.5, 2.0, 1.0),
}


@dataclass(frozen=True)
class Config:
    max_depth: int = 5
    max_hops: int = 1
    cycle_budget: int = 20_000
    recrawl_share: float = 0.2
    recrawl_after_h: float = 20.0
    retry_base_h: float = 20.0
    max_failures: int = 4
    prior_weight: float = 1.0
    window_s: float = 14_400.0
    start_delay_s: float = 1.0
    min_delay_s: float = 0.5
    max_delay_s: float = 10.0
    latency_factor: float = 2.0
    concurrency: int = 1
    backoff_max_s: float = 600.0
    max_errors: int = 5
    max_refusals: int = 3
    damping: float = 0.85
    tolerance: float = 1e-6
    max_iterations: int = 100
    top_k: int = 50_000
    like_half_life_days: float = 90.0
    query_weight: float = 5.0
    topic_blend: float = 0.5
    half_life_days: float = 7.0
    slow_half_life_days: float = 90.0
    hide_threshold: float = 0.75
    shown_limit: int = 3
    per_source: int = 500
    page_size: int = 20
    per_domain: int = 2
    exploration: float = 0.2
    semantic_share: float = 0.5
    band_skip: int = 500
    band_take: int = 1000
    max_reasons: int = 3
    min_contribution: float = 0.1
    examples: int = 2
    tags_per_document: int = 3
    tag_floor: float = 0.2
    tag_gap: float = 0.05
    hash_min_words: int = 50
    dedup_confidence: float = 0.9
    max_links: int = 500
    anchor_chars: int = 200
    chars_per_token: int = 3

    def __post_init__(self) -> None:
        if not 0 < self.min_delay_s <= self.start_delay_s <= self.max_delay_s:
            raise ValueError("delays must be ordered: minimum, start, maximum")
        if not (0 < self.damping < 1 and 0 <= self.exploration <= 1 and 0 <= self.semantic_share <= 1 and 0 <= self.recrawl_share <= 1):
            raise ValueError("shares lie between 0 and 1, damping strictly")


DEFAULT = Config()
