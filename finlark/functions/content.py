"""What a filing's analysis document holds: predicates and scores over the parsed document."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from finlark.functions.text import holds_any
from finlark.schemas import ANALYSIS

# Fields of the document are parted by a comma and a space, those inside a struct by a comma alone.
DOCUMENT = "struct<" + ",".join(part.replace(" ", ":", 1) for part in ANALYSIS.split(", ")) + ">"
#: Figures that count as financial data of an event filing.
FIGURES = ["revenue", "netIncome", "eps", "grossMargin", "operatingMargin", "revenueYoY", "netIncomeYoY", "epsYoY", "consensusEPS", "consensusRevenue"]


def parsed(text: Column) -> Column:
    """The document; null if it is no JSON."""
    return F.from_json(text, DOCUMENT)


def any_of(*conditions: Column) -> Column:
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions])


def has_financial_data(filing_type: Column, doc: Column) -> Column:
    """Some surprise, figure, guidance or metric; an event filing must be about earnings too."""
    fm = doc["financialMetrics"]
    data = fm["structuredData"]
    earnings = holds_any(doc["filingContentSummary"], ["earnings", "financial results", "results of operations", "item 2.02"])
    found = any_of(data["epsSurprise"].isNotNull(), data["revenueSurprise"].isNotNull(), data["revenue"].isNotNull(), data["eps"].isNotNull(), fm["guidanceDirection"] != "not_provided", F.size(fm["keyMetrics"]) > 0)
    return found & F.when(filing_type == "8-K", F.coalesce(earnings, F.lit(False))).otherwise(True)


def has_financials(filing_type: Column, doc: Column) -> Column:
    """True for annual and quarterly filings; for event filings if some figure, surprise, growth, metric or guidance is given."""
    fm = doc["financialMetrics"]
    figures = [fm["structuredData"][f].isNotNull() for f in FIGURES]
    given = any_of(*figures, F.size(fm["surprises"]) > 0, ~fm["revenueGrowth"].isin("Not disclosed", "not_disclosed"), F.size(fm["keyMetrics"]) > 0, ~fm["guidanceDirection"].isin("", "not_provided", "Not provided"))
    return filing_type.isin("10-K", "10-Q") | ((filing_type == "8-K") & given)


def share_given(columns: list[Column]) -> Column:
    return sum((F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in columns), F.lit(0.0)) / len(columns)


def calibrated_confidence(core: list[Column], analyst: list[Column], momentum: Column, macro: Column, market_cap: Column, sentiment: Column, buy_share: Column, volatility: Column) -> Column:
    """0 to 100 from completeness, the tier's record, certainty, calm and size."""
    cap = F.coalesce(market_cap, F.lit(0.0))
    complete = share_given(core) * 0.5 + share_given(analyst) * 0.25 + F.when(momentum, 0.15).otherwise(0.0) + F.when(macro, 0.10).otherwise(0.0)
    record = F.when(cap >= 500e9, 0.58).when(cap >= 50e9, 0.56).otherwise(0.45)
    certainty = F.greatest(F.lit(0.5), F.abs(F.coalesce(sentiment, F.lit(0.0))), F.when((buy_share > 0.7) | ((buy_share < 0.3) & (buy_share > 0)), 0.8).otherwise(0.5))
    calm = F.when(volatility > 0, F.greatest(F.lit(0.0), 1 - volatility / 40)).otherwise(0.5)
    bonus = F.when(cap >= 500e9, 0.15).when((cap >= 50e9) & (cap < 200e9), 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (complete * 0.40 + record * 0.30 + certainty * 0.20 + calm * 0.10 + bonus) * 100))
