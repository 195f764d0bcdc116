"""Market state: macro rows, regimes, rating scales, sections of filings, trade-signal helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlark.functions.math import per, percent_change
from finlark.functions.text import once
from finlark.operators.windows import last_rows, series

#: Ratings from 1 (sell) to 5 (strong buy).
RATINGS = {
    "Strong Buy": 5, "Buy": 4, "Outperform": 4, "Overweight": 4, "Accumulate": 4, "Hold": 3, "Neutral": 3, "Market Perform": 3, "Peer Perform": 3, "Equal Weight": 3,
    "Underperform": 2, "Underweight": 2, "Sell": 1, "Strong Sell": 1, "Reduce": 1,
}
#: Large firms, by exact name and by a part of the name.
FIRMS_EXACT = ["Goldman Sachs", "Morgan Stanley", "JPMorgan", "Bank of America", "Citigroup", "Wells Fargo", "Barclays", "Credit Suisse", "UBS", "Deutsche Bank", "BofA Securities", "Jefferies", "Piper Sandler", "Raymond James", "RBC Capital", "Stifel", "Evercore ISI"]
FIRMS_PART = ["Goldman Sachs", "Morgan Stanley", "JP Morgan", "Bank of America", "Citi", "Wells Fargo", "Barclays", "UBS"]


def rating(name: Column) -> Column:
    """The rating's place; 3 for names that aren't known."""
    found = F.lit(3)
    for label, place in RATINGS.items():
        found = F.when(name == label, place).otherwise(found)
    return found


def rating_change(before: Column, after: Column) -> Column:
    old, new = rating(before), rating(after)
    return F.when(F.trim(F.coalesce(before, F.lit(""))) == "", "initiated").when(new > old, "upgrade").when(new < old, "downgrade").otherwise("reiterated")


def is_major(firm: Column, exact: bool = True) -> Column:
    if exact:
        return F.exists(F.array(firm, F.replace(firm, F.lit(" Securities"), F.lit("")), F.replace(firm, F.lit(" Capital Markets"), F.lit(""))), lambda x: x.isin(FIRMS_EXACT))
    return F.exists(F.array(*[F.lit(x) for x in FIRMS_PART]), lambda x: F.contains(firm, x))


def value_back(prices: DataFrame, n: int, look_back: int, *, key: str = "ticker", day: str = "day", value: str = "close", name: str = "back") -> DataFrame:
    """prices and the value n days back, or the last one of up to ``look_back`` days before that; one window over each series, which has a row a day."""
    frame = Window.partitionBy(key).orderBy(day).rangeBetween(-(n + look_back), -n)
    return prices.withColumn(name, F.when(F.col(key).isNotNull() & F.col(day).isNotNull(), F.last(value).over(frame)))


def horizon_returns(prices: DataFrame, days: list[int], *, key: str = "ticker", day: str = "day") -> DataFrame:
    """return_<n> against the close nearest to n calendar days before; of equals the later.

    One sort of each series, which has a row a day, serves all horizons: the last row up to n days before is
    carried along, and the first one from there on is at most the row itself.
    """
    series = Window.partitionBy(key).orderBy(day)
    row = F.when(F.col(day).isNotNull(), F.struct(F.col(day).alias("at"), F.col("close").alias("close")))
    out = prices.withColumn("_row", row)
    for n in days:
        before = F.last("_row", ignorenulls=True).over(series.rangeBetween(Window.unboundedPreceding, -n))
        after = F.first("_row", ignorenulls=True).over(series.rangeBetween(-n, 0))
        out = out.withColumns({f"_before_{n}": before, f"_after_{n}": after})
    for n in days:
        b, a, then = F.col(f"_before_{n}"), F.col(f"_after_{n}"), F.col(day) - n
        past = F.when(then - b["at"] < a["at"] - then, b["close"]).otherwise(a["close"])
        known = F.col(key).isNotNull() & F.col(day).isNotNull()
        out = out.withColumn(f"return_{n}", F.when(known, percent_change(F.col("close"), past)))
    return out.drop("_row", *[f"_{side}_{n}" for n in days for side in ("before", "after")])


def level_mean(prices: DataFrame, n: int = 30, least: int = 20) -> Column:
    """Mean of the last n closes, a missing one as 0; null under ``least`` rows."""
    w = last_rows(series(), n)
    return F.when(F.count("*").over(w) >= least, F.avg(F.coalesce("close", F.lit(0.0))).over(w))


def regime(prices: DataFrame, n: int = 30) -> DataFrame:
    """momentum over n - 1 rows, a year's volatility of n daily changes, regime and flight to quality."""
    w = series()
    moved = prices.withColumns({"momentum": percent_change(F.col("close"), F.lag("close", n - 1).over(w)), "_r": per(F.col("close") - F.lag("close").over(w), F.lag("close").over(w))})
    spread = F.when(F.count("_r").over(last_rows(w, n)) == n, F.stddev_samp("_r").over(last_rows(w, n)) * 252**0.5 * 100)
    out = moved.withColumn("volatility", spread)
    name = F.when(F.col("momentum") > 5, "bull").when(F.col("momentum") < -2, "bear").when(F.col("momentum").isNotNull(), "flat")
    return out.withColumns({"regime": name, "flight_to_quality": F.col("volatility") > 20}).drop("_r")


def regime_score(trend: Column, level: Column, rates: Column) -> Column:
    """Points for the market's trend, its level of fear and the trend of rates."""
    points = F.when(trend > 5, 2).when(trend > 0, 1).when(trend < -5, -2).when(trend < 0, -1).otherwise(0) + F.when(level < 15, 1).when(level > 25, -1).otherwise(0) + F.when(rates == "falling", 1).when(rates == "rising", -1).otherwise(0)
    return F.when(points >= 3, "strong_bull").when(points >= 1, "bull").when(points <= -3, "strong_bear").when(points <= -1, "bear").otherwise("neutral")


def second_nearest(events: DataFrame, prices: DataFrame, *, key: str, by: str, day: str, target: int, reach: int = 15) -> DataFrame:
    """For each event the close whose day is second nearest to ``target`` days later, of days from the event on."""
    from finlark.operators.asof import interval_join

    pairs = interval_join(events.select(key, by, day), prices.select(by, day, "close"), by=[by], on=day, low=0, high=reach)
    gap = F.abs(F.col(f"{day}_right") - F.col(day) - target)
    w = Window.partitionBy(key).orderBy(gap, f"{day}_right")
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 2").select(key, F.col(f"{day}_right").alias("end_day"), F.col("close_right").alias("end_close"))


def wrapped_chunk(rows: DataFrame, order: str, start: int, size: int) -> DataFrame:
    """``size`` rows from place ``start`` on in the order, going on at the beginning after the last."""
    n = rows.count()
    start = start % max(1, n)
    head = rows.orderBy(order).offset(start).limit(size)
    over = start + size - n
    return head.unionByName(rows.orderBy(order).limit(min(over, start))) if over > 0 else head


#: Headings that begin a section, by name, tried in this order.
SECTIONS = {
    "risk_factors": [r"item\s+1a\.?\s*[-:.]?\s*risk\s+factors", r"risk\s+factors"],
    "discussion": [r"item\s+[27]\.?\s*[-:.]?\s*management.{0,3}s\s+discussion", r"management.{0,3}s\s+discussion\s+and\s+analysis"],
}
NEXT_ITEM = r"(?i)\n\s*item\s+\d+[a-z]?\."
#: What follows a heading that isn't one of a table of contents: over 200 characters without a row of dots, with sentences among the first 500.
PROSE = r"(?=.{201})(?!.{0,494}?\.{6})(?=.{0,498}?(?:\. [A-Z]|ollowing))"


def section(text: Column, name: str, most: int = 30_000) -> Column:
    """The section's text: from the first heading that prose follows to the next item, at least 100 characters on.

    Headings in a table of contents are passed over. A null text, or none found: null.
    """
    rest = F.lit(None).cast("string")
    for p in reversed(SECTIONS[name]):
        rest = F.coalesce(_after(text, f"(?s)(?i:{p}){PROSE}"), rest)

    def kept(rest: Column) -> Column:
        stop = F.regexp_instr(F.substring(rest, F.lit(101), F.length(rest)), F.lit(NEXT_ITEM))
        found = once(stop, lambda at: F.when(at > 0, F.substring(rest, F.lit(1), at + 99)).otherwise(rest))
        return F.trim(F.substring(found, 1, most), F.lit(" \n\r\t"))

    return once(rest, kept)


def _after(text: Column, pattern: str) -> Column:
    """What is behind the first match of a pattern that doesn't match at the end, from one search; null if there is none.

    The pattern is compiled once and the search ends there; ``split`` compiles it for each row and looks for all matches.
    """
    return once(F.regexp_extract(text, f"{pattern}(.*)", 1), lambda behind: F.when(behind != "", behind))


def row_macro(levels: DataFrame, *, key: str = "ticker", time: str = "date") -> DataFrame:
    """Changes over 7, 14, 21 and 30 rows, first and last included, with the estimates of the row form.

    Fixed values: the two-year rate counts as 0.85 of the level, the policy rate as the level; momentum has bands at 2 and 0.5 per cent.
    """
    w = series(key, time)
    moved = levels.withColumns({f"return_{n}d": percent_change(F.col("close"), F.lag("close", n - 1).over(w)) for n in (7, 14, 21, 30)})
    r = F.col("return_7d")
    name = F.when(r > 2, "strong_up").when(r > 0.5, "up").when(r < -2, "strong_down").when(r < -0.5, "down").when(r.isNotNull(), "flat")
    return moved.withColumns({"two_year": F.col("close") * 0.85, "fed_funds": F.col("close"), "momentum": name})
