"""The rule-based 7-day forecast: effects added in order, two of which look at the sum so far.

What an effect is worth stands in tables; the columns only look them up. The
market regime scales what has been summed before it, and very large
companies have a floor, so the order of the steps is part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per cent for each outcome.
EPS = {"beat": (1.0, 0.8), "miss": (-1.0, -0.7), "inline": (0.6, 0.0)}  # and beyond 5 per cent
REVENUE = {"beat": 0.8, "miss": -1.5}
GUIDANCE = {"raised": 3.5, "lowered": -4.0, "new": 1.0}
FORM = {"10-K": 0.5, "10-Q": 0.3}
EVENT = {"8-K-earnings-announcement": 0.1, "8-K-earnings-release": 0.0}
OTHER_EVENT = -0.5
DOLLAR = {"weak": 1.0, "strong": -0.6}
GROWTH = {"strong": 0.7, "weak": -0.5}
#: Fixed values by regime: weight of momentum, share added to a sum under 0, share added to one over 0, floor of the largest.
REGIME = {"bull": (0.20, 0.70, 0.15, -1.5), "bear": (0.18, 0.20, -0.50, -7.0)}
FLAT = (0.10, 0.0, 0.0, -5.0)
RISK, CONCERN, SENTIMENT, DAMPING, BOUND = -1.2, -0.9, 2.0, 0.5, 10.0


def pick(column: Column, values: dict[str, float], other: float = 0.0) -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for name, value in values.items():
        out = out.when(column == name, value)
    return out.otherwise(other)


def steps(value: Column, bounds: list[tuple[float, float]], last: float) -> Column:
    """The value of the first bound that is above; null gives ``last`` as well."""
    out = F.when(F.lit(False), F.lit(last))
    for bound, worth in bounds:
        out = out.when(value < bound, worth)
    return out.otherwise(last)


def pe_weight(pe: Column) -> Column:
    return F.when(pe.isNull() | (pe <= 0), 1.0).otherwise(steps(pe, PE_STEPS, PE_LAST))


def cap_weight(cap: Column) -> Column:
    return F.when(cap.isNull() | (cap <= 0), 1.0).otherwise(steps(cap, CAP_STEPS, CAP_LAST))


#: How strongly surprises move a company, by P/E and by capitalisation in billions.
PE_STEPS, PE_LAST = [(15.0, 0.8), (25.0, 1.0), (40.0, 1.2)], 1.5
CAP_STEPS, CAP_LAST = [(2.0, 0.9), (10.0, 1.0), (50.0, 1.1), (200.0, 1.2)], 1.3


def fundamentals() -> Column:
    """Risk, tone, concern, surprises, guidance and form."""
    tone, concern = F.coalesce("sentiment_score", F.lit(0.0)), F.coalesce("concern_level", F.lit(5.0))
    cheerful = tone > 0
    weight = F.when(cheerful & (concern >= 7), -1.0).when(cheerful & (concern >= 5), 1.0).otherwise(SENTIMENT)
    size = F.coalesce("eps_surprise_magnitude", F.lit(0.0))
    far = F.when(F.col("eps_surprise") == "miss", size < -5).otherwise(size > 5)
    surprise = pick(F.col("eps_surprise"), {k: a for k, (a, _) in EPS.items()}) + F.when(far, pick(F.col("eps_surprise"), {k: b for k, (_, b) in EPS.items()})).otherwise(0.0)
    form = F.when(F.col("filing_type") == "8-K", pick(F.col("event_type"), EVENT, OTHER_EVENT)).otherwise(pick(F.col("filing_type"), FORM))
    return (
        F.coalesce("risk_score_delta", F.lit(0.0)) * RISK + tone * weight + (concern - 5.0) * CONCERN + surprise * pe_weight(F.col("pe_ratio")) * cap_weight(F.col("market_cap_b"))
        + pick(F.col("revenue_surprise"), REVENUE) + pick(F.col("guidance_change"), GUIDANCE) + form
    )


def regime_value(i: int) -> Column:
    return pick(F.col("market_regime"), {k: v[i] for k, v in REGIME.items()}, FLAT[i])


def market(total: Column) -> Column:
    """What the market adds: momentum, a share of the total by regime and sign, the flight to quality. Nothing if it isn't known."""
    share = F.when(total < 0, regime_value(1)).when(total > 0, regime_value(2)).otherwise(0.0)
    cap = F.nullif("market_cap_b", F.lit(0.0))
    flight = F.when(F.col("flight_to_quality") & (cap > 200), 1.5).when(F.col("flight_to_quality") & (cap < 10), -2.0).when(F.col("flight_to_quality") & (cap < 50), -1.0).otherwise(0.0)
    known = F.col("market_momentum").isNotNull() & F.col("market_regime").isNotNull()
    return F.when(known, F.col("market_momentum") * regime_value(0) + total * share + flight).otherwise(0.0)


def size_effect() -> Column:
    cap = F.nullif("market_cap_b", F.lit(0.0))
    worth = F.when(cap < 200, -0.5).when(cap < 500, F.when(F.col("market_regime") == "bull", 1.5).otherwise(1.0)).when(cap < 1000, 0.3).when(cap.isNotNull(), 0.5)
    return F.coalesce(worth, F.lit(0.0))


def analysts() -> Column:
    """Rating changes (at most 2 either way, and only where they don't cancel out), consensus, and upside over 10 per cent (at most 1 either way)."""
    net = F.coalesce("analyst_net_upgrades", F.lit(0))
    major = F.coalesce("analyst_major_upgrades", F.lit(0)) - F.coalesce("analyst_major_downgrades", F.lit(0))
    moves = F.when(net != 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), net * 0.3 + major * 0.5))).otherwise(0.0)
    consensus = F.when(F.col("analyst_consensus") > 80, 0.8).when(F.col("analyst_consensus") < 40, -0.5).otherwise(0.0)
    upside = F.col("analyst_upside")
    return moves + consensus + F.when(F.abs(upside) > 10, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), upside * 0.05))).otherwise(0.0)


def certainty() -> Column:
    """0.4 and more for each kind of evidence that is there, 0.95 at most."""
    there = [
        (F.col("eps_surprise") != "unknown", 0.20), (F.col("guidance_change") != "maintained", 0.20), (F.col("risk_score_delta").isNotNull(), 0.10), (F.col("sentiment_score").isNotNull(), 0.10),
        (F.col("concern_level") != 5.0, 0.10), (F.col("ticker").isNotNull() & F.col("historical_return").isNotNull(), 0.15), (F.col("analyst_net_upgrades").isNotNull() | F.col("analyst_consensus").isNotNull(), 0.10),
    ]
    return F.least(F.lit(0.95), sum((F.when(c, w).otherwise(0.0) for c, w in there), F.lit(0.4)))


def forecast(rows: DataFrame) -> DataFrame:
    """Rows with predicted_7d and certainty. Missing evidence adds nothing; a missing concern counts as 5."""
    out = rows.withColumn("_t", fundamentals())
    out = out.withColumn("_t", F.col("_t") + market(F.col("_t")))
    out = out.withColumn("_t", F.col("_t") + size_effect())
    largest = F.col("market_cap_b") > 1000
    out = out.withColumn("_t", F.when(largest & (F.col("_t") < 0), F.greatest(F.col("_t"), regime_value(3))).otherwise(F.col("_t")))
    history = F.coalesce("historical_return", F.lit(0.0)) * F.when(F.col("ticker").isNotNull(), 0.4).otherwise(0.2)
    total = F.col("_t") + pick(F.col("dollar_strength"), DOLLAR) + pick(F.col("growth_trend"), GROWTH) + analysts() + history
    return out.withColumns({"predicted_7d": F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), total * DAMPING)), "certainty": certainty()}).drop("_t")
