"""Numeric and conditional column functions."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves toward plus infinity."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


def per(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, b)


def percent_change(new: Column, old: Column) -> Column:
    return per((new - old) * 100.0, old)


def clip(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null stays null, which greatest and least alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ladder(x: Column, steps: list[tuple[float, str]], last: str, *, strict: bool = False) -> Column:
    """The label of the first step whose bound x reaches (exceeds, if strict), bounds descending; null stays null."""
    out = F.when(x.isNull(), F.lit(None))
    for bound, label in steps:
        out = out.when(x > bound if strict else x >= bound, label)
    return out.otherwise(last)


def binned(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (a, b]; null outside."""
    out = None
    for (a, b), label in zip(pairwise(edges), labels, strict=True):
        hit = (x > a) & (x <= b)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def surprise_percent(actual: Column, expected: Column) -> Column:
    """Surprise against the expectation's size, at most 1000 either way; an expectation of zero counts as one per cent."""
    return clip(F.when(expected == 0, actual * 100.0).otherwise(per((actual - expected) * 100.0, F.abs(expected))), -1000.0, 1000.0)


def surprise_class(percent: Column, band: float = 2.0) -> Column:
    return F.when(percent > band, "beat").when(percent < -band, "miss").when(percent.isNotNull(), "inline")


def surprise_size(percent: Column) -> Column:
    return ladder(F.abs(percent), [(20, "massive"), (10, "large"), (5, "moderate"), (2, "small")], "inline")


def winsorised(x: Column, bound: float = 50.0) -> Column:
    return F.coalesce(clip(x, -bound, bound), F.lit(0.0))


def cap_tier(market_cap: Column) -> Column:
    """Tiers of the scorer: 200, 10 and 2 billions."""
    return F.when(market_cap >= 200e9, "mega").when(market_cap >= 10e9, "large").when(market_cap >= 2e9, "mid").otherwise("small")


def cap_tier_export(market_cap: Column) -> Column:
    """Tiers of the data-set export: 500, 200 and 50 billions."""
    return F.when(market_cap >= 500e9, "mega").when(market_cap >= 200e9, "large").when(market_cap >= 50e9, "mid").otherwise("small")


def cap_category(market_cap: Column) -> Column:
    """Categories of the data-set report: 500, 200 and 10 billions."""
    return F.when(market_cap < 10e9, "microCap").when(market_cap < 200e9, "smallCap").when(market_cap < 500e9, "largeCap").when(market_cap.isNotNull(), "megaCap")


def consensus_score(strong_buy: Column, buy: Column, hold: Column, sell: Column, strong_sell: Column) -> Column:
    n = strong_buy + buy + hold + sell + strong_sell
    return half_up(per(100.0 * strong_buy + 75.0 * buy + 50.0 * hold + 25.0 * sell, n))


def consensus_from_mean(mean: Column) -> Column:
    """A mean rating of 1 (best) to 5 as 100 to 0; null for none or 0."""
    return F.when(mean != 0, (5 - mean) / 4 * 100)


def concern_label(level: Column) -> Column:
    return F.when(level <= 2, "LOW").when(level <= 4, "MODERATE").when(level <= 6, "ELEVATED").when(level <= 8, "HIGH").when(level.isNotNull(), "CRITICAL")


def confidence_number(name: Column) -> Column:
    return F.when(name == "high", 0.85).when(name == "medium", 0.65).otherwise(0.5)


def pe_multiplier(pe: Column) -> Column:
    return F.when(pe < 15, 0.8).when(pe < 25, 1.0).when(pe < 40, 1.2).otherwise(1.5)


def position_value(confidence: Column, predicted: Column, largest: Column) -> Column:
    """Share of the capital for a trade."""
    return F.least(confidence * F.abs(predicted) / 100.0, largest)


def trade_pnl(direction: Column, entry: Column, exit_: Column, fees: Column) -> Column:
    return F.when(direction == "LONG", exit_ - entry).otherwise(entry - exit_) - fees


def yield_curve(ten: Column, two: Column) -> Column:
    return half_up(ten - two, 3)


def change_bps(now: Column, then: Column) -> Column:
    return half_up((now - then) * 1000.0) / 10.0


def abnormal_return(r: Column, market: Column, beta: Column) -> Column:
    return r - F.coalesce(beta, F.lit(1.0)) * market


def dispersion(consensus: Column, strong_buy: Column, buy: Column, hold: Column) -> Column:
    """Spread of estimates from the spread of ratings; null without a consensus."""
    n = strong_buy + buy + hold
    parts = [F.pow(per(x * 1.0, n) - 0.33, 2) for x in (strong_buy, buy, hold)]
    spread = F.when(n > 0, F.sqrt(sum(parts[1:], parts[0]) / 3)).otherwise(0.1)
    return F.abs(F.nullif(consensus, F.lit(0.0))) * (0.05 + 0.10 * spread)
