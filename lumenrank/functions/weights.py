"""Weights, thresholds and dimensions of the scores. Results depend on each."""

from __future__ import annotations

PAGE_TYPES = ["service_page", "company_homepage", "platform_or_tool", "comparison_listicle", "ecommerce_product", "blog_article", "directory_marketplace", "news_or_media", "other", "forum_or_social"]
FIT_COMMERCIAL = [1.0, 0.85, 0.8, 0.7, 0.7, 0.5, 0.45, 0.35, 0.3, 0.25]
FIT_INFORMATIONAL = [0.45, 0.35, 0.4, 0.7, 0.3, 1.0, 0.35, 0.8, 0.3, 0.6]
PAGE_IMPORTANCE = dict(zip(PAGE_TYPES, [0.95, 1.0, 0.7, 0.7, 0.85, 0.6, 0.4, 0.4, 0.35, 0.3], strict=True))

#: Thousandths, so that sums of shares are exact.
POSITION_WEIGHTS, POSITION_REST = [1000, 900, 800, 700, 600, 500, 400, 300, 250, 200], 100
CTR_CURVE, CTR_REST = [300, 150, 100, 70, 50, 40, 30, 25, 20, 15], 5

STRENGTH = {"type_fit": 0.3, "dedicated": 0.25, "title_match": 0.2, "dominance": 0.1, "depth": 0.15}
EASY_AT, MEDIUM_AT = 0.5, 0.38
OPPORTUNITY = {"weakness": 0.5, "commercial": 0.2, "specificity": 0.15, "demand": 0.15}
NEUTRAL_WEAKNESS, NEUTRAL_DEMAND = 0.35, 0.4
QUICK_WIN_AT, GOOD_AT, HARD_AT, UNVERIFIED_CAP, MIN_RELEVANCE = 52.0, 42.0, 28.0, 52.0, 0.5
CITABILITY = {"answer": 0.22, "facts": 0.17, "sources": 0.14, "author": 0.12, "faq": 0.1, "fresh": 0.1, "compare": 0.08, "links": 0.07}
FIX_TARGET, FRESH_MONTHS, STALE_MONTHS, FRESH_FLOOR = 0.8, 6.0, 24.0, 0.1
COMPETITOR = {"answer": 0.28, "depth": 0.28, "proof": 0.2, "schema": 0.12, "fresh": 0.12}
STEAL_AT, STEAL_MIN_RELEVANCE = 0.58, 0.45
WEAK_BELOW, ANSWERED_AT = 0.3, 0.62
ELEMENT_WEIGHT = {"title": 1.0, "meta": 0.7, "h1": 0.8, "intro": 0.6, "h2": 0.5, "faq": 0.5, "schema": 0.6, "canonical": 0.8, "url": 0.4, "links": 0.4, "images": 0.3}
CONTENT = {"depth": 0.35, "need": 0.25, "specific": 0.15, "length": 0.25}
TRUST = {"portfolio": 0.3, "reviews": 0.3, "identity": 0.25, "contact": 0.15}
CONVERSION = {"cta": 0.4, "prices": 0.25, "form": 0.2, "contact": 0.15}
OVERALL = {"content": 0.4, "optimization": 0.25, "trust": 0.2, "conversion": 0.15}
STAGES = ["discover", "compare", "price", "trust", "howto", "local"]
QUESTION_SOURCES = ["llm", "paa", "suggest", "related", "template"]
LABELS = ["quick_win", "good", "hard", "skip"]
VERDICTS = ["no_page", "weak", "answered"]
