"""The non-linear challenger of 13 effects, the two models for very large companies, and their ensemble.

What an effect is worth stands in tables of bounds or of points; the columns only look them up.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlark.functions.math import clip, per

#: What a missing input counts as.
DEFAULTS = {"risk_score": 5.0, "sentiment_score": 0.0, "pe_ratio": 20.0, "forward_pe": 18.0, "price_to_target": 1.0, "price_to_high": 0.85, "analyst_bullish_ratio": 0.5, "volume_ratio": 1.0, "dividend_yield": 0.02, "beta": 1.0, "eps_actual": 0.0, "eps_estimate_next_y": 0.0}
#: Points between which the effect of the market value (in billions) runs straight.
CAP_POINTS = [(0.0, -2.0), (10.0, -1.0), (50.0, -0.5), (200.0, 0.0), (500.0, 2.0), (1000.0, 1.5), (4000.0, 1.0)]
#: The effect above each bound, and of the rest.
HIGH_STEPS, HIGH_REST = [(0.95, -1.0), (0.85, 2.0), (0.70, 1.0)], -0.5
TARGET_STEPS, TARGET_REST = [(0.75, 3.0), (0.9, 1.5), (1.05, 0.0), (1.15, -1.0)], -2.5  # below each bound
ANALYST_STEPS, ANALYST_REST = [(0.75, 2.0), (0.60, 1.0), (0.40, 0.0), (0.25, -1.0)], -2.0
DIVIDEND_STEPS, DIVIDEND_REST = [(0.05, -0.5), (0.02, 0.5)], 0.0
FAIR_PE, BASE = 18.0, 0.83
#: Weights of the effects in the sum.
WEIGHTS = {"market_cap": 0.25, "pe": 0.15, "pe_expansion": 0.10, "price_high": 0.20, "valuation_gap": 0.30, "analyst": 0.25, "sentiment": 0.35, "risk": 0.20, "eps_growth": 0.25, "dividend": 0.10, "beta": 0.15, "volume": 0.15, "filing_type": 0.10}
#: Slopes, and the value at which a term is 0, of the line for very large companies.
LARGE_LINE = {
    "current_price": (-0.0078, 0.0), "eps_estimate_current_y": (0.0909, 0.0), "eps_estimate_next_y": (0.0635, 0.0), "eps_actual": (0.0534, 0.0), "forward_pe": (0.0450, 0.0), "price_to_high": (2.7294, 0.0), "price_to_low": (0.5406, 0.0), "risk_score": (0.0716, 0.0),
    "dividend_yield": (-0.1071, 0.0), "price_to_ma30": (5.0, 1.0), "rsi14": (0.05, 50.0), "macd_histogram": (0.3, 0.0), "volatility30": (-0.2, 0.0), "return_30d": (0.15, 0.0), "spx_return_7d": (0.25, 0.0), "vix_close": (-0.05, 20.0),
}
#: Input, bound, whether above it, and what it adds to the rules for very large companies.
LARGE_RULES = [
    ("analyst_bullish_ratio", 0.6, True, 1.5), ("analyst_bullish_ratio", 0.4, False, -1.5), ("price_to_ma30", 1.02, True, 0.5), ("rsi14", 30.0, False, 0.5), ("rsi14", 70.0, True, -0.5), ("spx_return_7d", 2.0, True, 0.3), ("vix_close", 30.0, True, -0.3),
]
#: As above, for inputs that count only over 0.
LARGE_RATIOS = [("pe_ratio", 15.0, False, 1.0), ("pe_ratio", 30.0, True, -1.0), ("price_to_target", 0.9, False, 1.0), ("price_to_target", 1.1, True, -1.0)]


def through(x: Column, points: list[tuple[float, float]]) -> Column:
    """Straight between the points, level beyond them; null stays null."""
    out = F.when(x < points[0][0], points[0][1])
    for (a, u), (b, v) in pairwise(points):
        out = out.when(x < b, u + (x - a) / (b - a) * (v - u))
    return out.when(x.isNotNull(), points[-1][1])


def above(x: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    out = F.when(F.lit(False), rest)
    for bound, worth in steps:
        out = out.when(x > bound, worth)
    return out.otherwise(rest)


def effects(c: dict[str, Column]) -> dict[str, Column]:
    """The effects by name, from columns by the names of DEFAULTS, market_cap and filing_type."""
    x = {k: F.coalesce(c[k], F.lit(v)) for k, v in DEFAULTS.items()}
    cap = F.nullif(c["market_cap"], F.lit(0.0)) / 1e9
    off = x["pe_ratio"] - FAIR_PE
    gap = x["price_to_target"]
    growth = F.when((x["eps_estimate_next_y"] != 0) & (x["eps_actual"] != 0), per(x["eps_estimate_next_y"] - x["eps_actual"], F.abs(x["eps_actual"])))
    mood = x["sentiment_score"]
    return {
        "market_cap": F.coalesce(through(cap, CAP_POINTS), F.lit(0.0)),
        "pe": -0.05 * F.abs(off) - 0.002 * off * off,
        "pe_expansion": F.when((x["forward_pe"] != 0) & (x["pe_ratio"] != 0), (x["forward_pe"] - x["pe_ratio"]) / F.greatest(x["pe_ratio"], F.lit(1.0)) * 5.0).otherwise(0.0),
        "price_high": above(x["price_to_high"], HIGH_STEPS, HIGH_REST),
        "valuation_gap": F.when(gap < TARGET_STEPS[0][0], TARGET_STEPS[0][1]).when(gap < TARGET_STEPS[1][0], TARGET_STEPS[1][1]).when(gap <= TARGET_STEPS[2][0], TARGET_STEPS[2][1]).when(gap < TARGET_STEPS[3][0], TARGET_STEPS[3][1]).otherwise(TARGET_REST),
        "analyst": above(x["analyst_bullish_ratio"], ANALYST_STEPS, ANALYST_REST),
        "sentiment": 3.0 * mood * (1 - x["risk_score"] / 15),
        "risk": -0.8 * x["risk_score"] - 0.05 * x["risk_score"] * x["risk_score"],
        "eps_growth": F.coalesce(clip(growth * 2.0, -2.0, 3.0), F.lit(0.0)),
        "dividend": above(x["dividend_yield"], DIVIDEND_STEPS, DIVIDEND_REST),
        "beta": (x["beta"] - 1.0) * 0.5,
        "volume": F.when(x["volume_ratio"] > 2.0, F.when(mood > 0, 1.0).otherwise(-1.0)).when(x["volume_ratio"] > 1.3, mood * 0.5).otherwise(0.0),
        "filing_type": F.when(c["filing_type"] == "10-K", 0.3).when(c["filing_type"] == "10-Q", 0.2).when(c["filing_type"] == "8-K", F.when(mood > 0, 0.5).otherwise(-0.5)).otherwise(0.0),
    }


def enhanced(rows: DataFrame) -> DataFrame:
    """The rows with e_<effect> and predicted, the weighted sum of the effects over the base."""
    made = effects({c: F.col(c) for c in (*DEFAULTS, "market_cap", "filing_type")})
    total = sum((made[k] * w for k, w in WEIGHTS.items()), F.lit(BASE))
    return rows.withColumns({**{f"e_{k}": v for k, v in made.items()}, "predicted": total})


def large_rules(c: dict[str, Column]) -> Column:
    """The rule model for very large companies; what is missing adds nothing."""
    total = F.coalesce(c["risk_score"] * -0.5, F.lit(0.0)) + F.coalesce(c["sentiment_score"] * 0.8, F.lit(0.0))
    for rules, least in ((LARGE_RULES, None), (LARGE_RATIOS, 0.0)):
        for name, bound, over, worth in rules:
            hit = c[name] > bound if over else c[name] < bound
            total = total + F.when(hit if least is None else hit & (c[name] > least), worth).otherwise(0.0)
    return total


def large_line(c: dict[str, Column]) -> Column:
    return sum((F.coalesce((c[k] - zero) * slope, F.lit(0.0)) for k, (slope, zero) in LARGE_LINE.items()), F.lit(0.0))


def ensemble(rows: DataFrame) -> DataFrame:
    """The rows with predicted: annual filings by the rules, others by the line."""
    c = {name: F.col(name) for name in rows.columns}
    return rows.withColumn("predicted", F.when(F.col("filing_type") == "10-K", large_rules(c)).otherwise(large_line(c)))
