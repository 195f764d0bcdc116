"""Exports and bundles: the modelling data set, model features, drift features, chat lookups, the daily close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from finlark.functions.math import abnormal_return, cap_tier_export, per
from finlark.operators.asof import asof_join, interval_join

TECHNICAL = ["ma30", "ma50", "ma200", "price_to_ma30", "price_to_ma50", "rsi14", "macd", "volatility30", "return_30d"]
MACRO = ["spx_return_7d", "spx_return_30d", "vix_close"]
#: Fields of the analysis document's analyst part, and of its activity.
ANALYST = {"analyst_upside_potential": ("upsidePotential", "double"), "analyst_consensus_score": ("consensusScore", "double"), "analyst_coverage": ("numberOfAnalysts", "int")}
ACTIVITY = {"upgrades_last_30d": "upgradesLast30d", "downgrades_last_30d": "downgradesLast30d", "net_upgrades": "netUpgrades", "major_upgrades": "majorUpgrades", "major_downgrades": "majorDowngrades"}
DOCUMENT = "struct<analyst:struct<" + ",".join(f"{n}:{t}" for n, t in ANALYST.values()) + ",activity:struct<" + ",".join(f"{n}:int" for n in ACTIVITY.values()) + ">>>"


def latest(rows: DataFrame, side: DataFrame, by: list[str], take: list[str], tolerance: int | None = None) -> DataFrame:
    """rows with ``take`` of the side's last row up to their day; ``side`` has a row a key and day."""
    met = asof_join(rows, side, by=by, on="day", take=take, tolerance=tolerance).drop("day_right")
    return met.withColumnsRenamed({f"{c}_right": c for c in take})


def of_the_day(rows: DataFrame, side: DataFrame, take: list[str], tolerance: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``latest`` for a side of one series: worked out for each different day, of which there are some thousands, however many rows share it.

    asked: rows that have the same days and cost less.
    """
    days = (rows if asked is None else asked).select("day").distinct().withColumn("_all", F.lit(1))
    known = latest(days, side.select(F.lit(1).alias("_all"), "day", *take), ["_all"], take, tolerance).drop("_all")
    return rows.join(F.broadcast(known), "day", "left")  # a row a day


def dataset(filings: DataFrame, companies: DataFrame, technical: DataFrame, macro: DataFrame, *, concern: bool = True) -> DataFrame:
    """The modelling data set, a row an annual or quarterly filing that has a 7-day return and scores, and whose company has a value and a price.

    filings: identifiers, day, returns, scores and analysis_data (JSON); technical by ticker and day; macro by day. Indicators are
    those last known on the day of filing. 42 columns, the market value's tier last; without ``concern`` the older form of 41.
    """
    scores = ["risk_score", "sentiment_score", *(["concern_level"] if concern else [])]
    kept = filings.where(F.col("filing_type").isin("10-K", "10-Q")).where(" and ".join(f"{c} is not null" for c in ("actual_7d_return", *scores)))
    facts = ["market_cap", "current_price", "pe_ratio", "forward_pe", "fifty_two_week_high", "fifty_two_week_low", "analyst_target_price"]
    met = kept.join(companies.where("market_cap <> 0 and current_price <> 0").select("company_id", "ticker", "name", *facts), "company_id")
    met = latest(met, technical.select("ticker", "day", *TECHNICAL), ["ticker"], TECHNICAL)
    met = of_the_day(met, macro, MACRO)
    doc = F.from_json("analysis_data", DOCUMENT)
    ratio = lambda c: per(F.col("current_price"), F.col(c)).alias(f"price_to_{c.rpartition('_')[2]}")
    return met.select(
        "filing_id", "ticker", F.col("name").alias("company_name"), "filing_type", "filing_date", "actual_7d_return", "actual_30d_return", "actual_7d_alpha", "actual_30d_alpha", *scores, *facts,
        ratio("fifty_two_week_high"), ratio("fifty_two_week_low"), per(F.col("current_price"), F.col("analyst_target_price")).alias("price_to_target"), *TECHNICAL, *MACRO,
        *[doc["analyst"][n].alias(c) for c, (n, _) in ANALYST.items()], *[doc["analyst"]["activity"][n].alias(c) for c, n in ACTIVITY.items()], cap_tier_export(F.col("market_cap")).alias("market_cap_category"),
    )


FINANCIALS = "struct<guidanceDirection:string,xbrlFinancials:struct<revenue:double,netIncome:double,earningsPerShareDiluted:double,earningsPerShareBasic:double,totalAssets:double,totalLiabilities:double>>"


def share(part: Column, whole: Column) -> Column:
    """part in per cent of whole; null where either is missing or 0."""
    return F.when((part != 0) & (whole != 0), part / whole * 100)


def free_cash_flow(operating: Column) -> Column:
    """Fixed value: four fifths of the operating cash flow."""
    return operating * 0.8


def model_features(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """Surprise flags, scores, reported figures with their ratios, and guidance of filings with a return and a surprise."""
    kept = filings.where("actual_7d_return is not null and eps_surprise is not null").join(companies.select("company_id", "ticker", "market_cap"), "company_id", "left")
    doc, s = F.from_json("analysis_data", FINANCIALS), F.col("eps_surprise")
    x = {n: F.nullif(doc["xbrlFinancials"][n], F.lit(0.0)) for n in ("revenue", "netIncome", "earningsPerShareDiluted", "earningsPerShareBasic", "totalAssets", "totalLiabilities")}
    guidance = F.coalesce(F.nullif(doc["guidanceDirection"], F.lit("")), F.lit("not_provided"))
    return kept.select(
        "filing_id", F.coalesce("ticker", F.lit("UNKNOWN")).alias("ticker"), F.to_date("filing_date").alias("filing_date"), "actual_7d_return", "actual_30d_return", "eps_surprise", "actual_eps", "consensus_eps", "revenue_surprise", "actual_revenue", "consensus_revenue",
        (s > 2).alias("eps_beat"), (s < -2).alias("eps_miss"), s.between(-2, 2).alias("eps_inline"), (s > 10).alias("large_beat"), (s < -10).alias("large_miss"), F.abs(s).alias("surprise_magnitude"), "risk_score", "sentiment_score", "concern_level",
        x["revenue"].alias("revenue"), x["netIncome"].alias("net_income"), F.coalesce(x["earningsPerShareDiluted"], x["earningsPerShareBasic"]).alias("eps"), x["totalAssets"].alias("assets"), x["totalLiabilities"].alias("liabilities"),
        share(x["netIncome"], x["revenue"]).alias("profit_margin"), share(x["totalLiabilities"], x["totalAssets"]).alias("debt_to_assets"), guidance.alias("guidance_direction"), (guidance == "raised").alias("guidance_raised"), (guidance == "lowered").alias("guidance_lowered"), "market_cap",
    )


#: The macro column with the 30-day return of a sector.
SECTOR_RETURNS = {"Technology": "tech_return_30d", "Financial Services": "financial_return_30d", "Energy": "energy_return_30d", "Healthcare": "healthcare_return_30d"}
SNAPSHOT = ["eps_estimate", "rating_count", "buy_count", "hold_count", "sell_count", "current_price"]


def sector_return(sector: Column, names: dict[str, str] | None = None) -> Column:
    out = F.lit(None).cast("double")
    for name, column in (names or SECTOR_RETURNS).items():
        out = F.when(sector == name, F.col(column)).otherwise(out)
    return out


def relative_strength(stock_90d: Column, sector_30d: Column) -> Column:
    """The stock's 90 days against the sector's 30, as it is defined; a stock return of 0 counts as missing."""
    return F.nullif(stock_90d, F.lit(0.0)) - sector_30d


def with_days_around(events: DataFrame, sides: dict[str, tuple[DataFrame, list[str]]], back: int, ahead: int, found: Callable[[WindowSpec], dict[str, Column]], bin_width: int = 730) -> DataFrame:
    """events with the columns ``found`` over windows of days of their ticker, from one exchange and one sort of all rows.

    sides: by name a table with a row a ticker and day, and its columns; a window sees them as a struct of that name, day first.
    Sides that are one table go as one row. Rows meet within bins of days; a side's row is copied to the bins of events up to ``back`` days after it or ``ahead`` before it.
    """
    at = lambda c: F.floor(c / bin_width)
    whole = events.select("ticker", "day", at(F.col("day")).alias("_bin"), F.struct(*[c for c in events.columns if c not in ("ticker", "day")]).alias("_event"))
    for table in {id(t): t for t, _ in sides.values()}.values():
        own = [F.struct("day", *take).alias(name) for name, (t, take) in sides.items() if t is table]
        rows = table.where("ticker is not null and day is not null").select("ticker", "day", F.explode(F.sequence(at(F.col("day") - ahead), at(F.col("day") + back))).alias("_bin"), *own)
        whole = whole.unionByName(rows, allowMissingColumns=True)
    made = found(Window.partitionBy("ticker", "_bin").orderBy("day"))
    return whole.withColumns(made).where("_event is not null").select("ticker", "day", "_event.*", *made)


def rate_changes(days: DataFrame, macro: DataFrame, back: int = 90, least: int = 30) -> DataFrame:
    """day and rates: the changes of the ten-year rate over the last ``back`` days, in order; only days with at least ``least`` of them."""
    pairs = interval_join(days.select("day").distinct().withColumn("_all", F.lit(1)), macro.select(F.lit(1).alias("_all"), "day", "treasury10y"), by=["_all"], on="day", low=-back, high=0, bin_width=back)
    before = F.lag("treasury10y_right").over(Window.partitionBy("day").orderBy("day_right"))
    moved = pairs.withColumn("v", F.when((F.col("treasury10y_right") != 0) & (before != 0), F.col("treasury10y_right") - before)).where("v is not null")
    kept = moved.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("day_right", "v"))).alias("r")).where(F.size("r") >= least)
    return kept.select("day", F.col("r.v").alias("rates"))


def price_changes(rows: Column) -> Column:
    """The daily returns between structs with a close, in order; those from or to nothing are left out."""
    moved = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda x, i: per(x["close"] - F.get(rows, i)["close"], F.get(rows, i)["close"]))
    return F.filter(moved, lambda v: v.isNotNull())


def paired_correlation(x: Column, y: Column) -> Column:
    """Pearson's of two arrays paired by place, as far as both go; 0 where one doesn't vary."""
    pairs = F.slice(F.arrays_zip(x.alias("x"), y.alias("y")), 1, F.least(F.size(x), F.size(y)))
    names = ("n", "mx", "my", "xy", "xx", "yy")

    def step(s: Column, p: Column) -> Column:
        n, dx, dy = s["n"] + 1, p["x"] - s["mx"], p["y"] - s["my"]
        mx, my = s["mx"] + dx / n, s["my"] + dy / n
        values = (n, mx, my, s["xy"] + dx * (p["y"] - my), s["xx"] + dx * (p["x"] - mx), s["yy"] + dy * (p["y"] - my))
        return F.struct(*[v.alias(c) for v, c in zip(values, names, strict=True)])

    return F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(c) for c in names]), step, lambda s: F.coalesce(F.try_divide(s["xy"] / s["n"], F.sqrt(s["xx"] / s["n"]) * F.sqrt(s["yy"] / s["n"])), F.lit(0.0)))


def drift_features(events: DataFrame, companies: DataFrame, snapshots: DataFrame, technical: DataFrame, macro: DataFrame, prices: DataFrame, sectors: dict[str, str] | None = None) -> DataFrame:
    """The post-earnings bundle, a row an event: 23 features and targets.

    events: filing_id, ticker, day, eps_actual, guidance_low and guidance_high. Snapshots, indicators and macro rows count
    if they are at most two days old. A consensus, price or ratio of 0 counts as missing. Net upgrades are 0, as they are defined.
    """
    one = events.join(companies.select("ticker", "sector", "market_cap", "beta", "pe_ratio"), "ticker", "left")
    tech = ["return_90d", "price_to_ma50", "price_to_ma200", "rsi14"]
    # The greatest struct is that of the last day.
    around = with_days_around(one, {"_shot": (snapshots, SNAPSHOT), "_tech": (technical, tech), "_price": (prices, ["close"])}, 90, 10, lambda w: {
        "_near": F.max("_shot").over(w.rangeBetween(-2, 0)), "_state": F.max("_tech").over(w.rangeBetween(-2, 0)), "_old": F.max("_shot").over(w.rangeBetween(-33, -27)),
        "_later": F.min("_price").over(w.rangeBetween(4, 10)), "_closes": F.collect_list("_price").over(w.rangeBetween(-90, 0)),
    })
    # The stock's returns and the rate's changes of the last 90 days are paired by place, not by date, as it is defined; 30 of either at least.
    moves = price_changes(F.col("_closes"))
    sensitive = around.join(F.broadcast(rate_changes(events, macro)), "day", "left")  # a row a day
    met = sensitive.select(
        *one.columns, *[F.col(f"_near.{c}").alias(c) for c in SNAPSHOT], *[F.col(f"_state.{c}").alias(c) for c in tech], F.col("_old.eps_estimate").alias("old"), F.col("_near.eps_estimate").alias("new"), F.col("_near.current_price").alias("paid"), F.col("_later.close").alias("later"),
        F.when(F.col("rates").isNotNull() & (F.size(moves) >= 30), paired_correlation(moves, F.col("rates"))).alias("interest_rate_sensitivity"),
    )
    wide = ["spx_return_7d", "vix_close", "yield_curve", *(sectors or SECTOR_RETURNS).values()]
    met = of_the_day(met, macro, wide, 2, events)
    none = lambda c: F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    consensus, n = none("eps_estimate"), none("rating_count")
    parts = [F.pow(F.coalesce(F.col(c), F.lit(0)) / n - 0.33, 2) for c in ("buy_count", "hold_count", "sell_count")]
    spread = F.abs(consensus) * (0.05 + 0.10 * F.coalesce(F.sqrt((parts[0] + parts[1] + parts[2]) / 3), F.lit(0.1)))
    delta = ((none("guidance_low") + none("guidance_high")) / 2 - consensus) / consensus * 100
    raw = (none("later") - none("current_price")) / none("current_price") * 100
    market, beta, sector = none("spx_return_7d"), F.coalesce(none("beta"), F.lit(1.0)), sector_return(F.col("sector"), sectors)
    strength = relative_strength(F.col("return_90d"), sector)
    return met.select(
        "filing_id", per(F.col("eps_actual") - consensus, spread).alias("sue"), "eps_actual", consensus.alias("eps_consensus"), (F.col("eps_actual") - consensus).alias("eps_beat"), delta.alias("guidance_delta"),
        F.when(delta > 1, 1).when(delta < -1, -1).otherwise(0).alias("guidance_shift"), ((none("new") - none("old")) / none("paid") * 100).alias("analyst_revision_30d"), spread.alias("consensus_dispersion"), F.lit(0).alias("analyst_upgrade_30d"),
        strength.alias("relative_strength_90d"), F.when(strength.isNotNull(), sector).alias("sector_return_90d"), none("price_to_ma50").alias("price_to_ma50"), none("price_to_ma200").alias("price_to_ma200"), none("rsi14").alias("rsi14"),
        "interest_rate_sensitivity", none("yield_curve").alias("yield_curve"), none("vix_close").alias("vix"), market.alias("spx_return_7d"), none("market_cap").alias("market_cap"), beta.alias("beta"), none("pe_ratio").alias("pe_ratio"),
        abnormal_return(raw, market, beta).alias("abnormal_return_7d"), raw.alias("raw_return_7d"), market.alias("market_return_7d"),
    )


#: Sectors as they are named in messages, and under which names the data has them.
SECTOR_ALIASES = {
    "Technology": ["Technology", "Information Technology"], "Basic Materials": ["Basic Materials"], "Communication Services": ["Communication Services"], "Consumer Cyclical": ["Consumer Cyclical", "Consumer Discretionary"],
    "Consumer Defensive": ["Consumer Defensive", "Consumer Staples"], "Energy": ["Energy"], "Financial Services": ["Financial Services", "Financials"], "Healthcare": ["Healthcare"], "Industrials": ["Industrials"], "Real Estate": ["Real Estate"], "Utilities": ["Utilities"],
}


def mentioned_sector(message: Column) -> Column:
    """The first sector of the table that a message names, in any case; null if none."""
    return F.get(F.filter(F.array(*[F.lit(s) for s in SECTOR_ALIASES]), lambda s: F.contains(F.lower(message), F.lower(s))), 0)


def sector_names(sector: Column) -> Column:
    """The names under which the data may have a sector; one that isn't known stands for itself."""
    table = F.create_map(*[x for s, names in SECTOR_ALIASES.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in names]))])
    return F.when(sector.isNotNull(), F.coalesce(F.try_element_at(table, sector), F.array(sector)))


def mentioned_ticker(message: Column) -> Column:
    """The first run of one to five capitals, before 's or a space; whether it is a ticker, a join has to tell."""
    return F.nullif(F.regexp_extract(message, r"\b([A-Z]{1,5})\b(?:'s|’s|\s)", 1), F.lit(""))


def with_mentions(messages: DataFrame, companies: DataFrame, text: str = "text") -> DataFrame:
    """messages with sector, sector_names and ticker (null where there is no such company)."""
    known = companies.select(F.col("ticker").alias("_known")).distinct()
    named = messages.withColumns({"sector": mentioned_sector(F.col(text)), "_ticker": mentioned_ticker(F.col(text))})
    return named.join(known, F.col("_ticker") == F.col("_known"), "left").withColumns({"sector_names": sector_names(F.col("sector")), "ticker": F.col("_known")}).drop("_ticker", "_known")


def daily_close(trades: DataFrame, portfolios: DataFrame, prices: DataFrame, today: int, *, held_days: int = 7, fee: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Closes what active portfolios have held for ``held_days`` days or more, and values them.

    trades: portfolio_id, trade_id, ticker, direction, status, day, shares, entry_value; portfolios: portfolio_id, is_active, cash;
    prices: ticker, day, close, of which the last one up to ``today`` counts. First the trades after the close, with exit_value and
    pnl of those closed now; then cash, market_value, total_value, closed and open of each active portfolio. What has no price stays open.
    """
    last = prices.where(F.col("day") <= today).groupBy("ticker").agg(F.max_by("close", "day").alias("_price"))
    active = portfolios.where("is_active").select("portfolio_id", F.lit(True).alias("_active"))
    met = trades.join(last, "ticker", "left").join(active, "portfolio_id", "left")
    due = (F.col("status") == "OPEN") & F.col("_active") & (F.col("day") <= today - held_days) & F.col("_price").isNotNull()
    got = F.col("_price") * F.col("shares")
    gain = F.when(F.col("direction") == "LONG", got - F.col("entry_value")).otherwise(F.col("entry_value") - got)
    closed = met.withColumn("_due", F.coalesce(due, F.lit(False))).withColumns({"exit_value": F.when(F.col("_due"), got), "pnl": F.when(F.col("_due"), gain - 2 * fee), "status": F.when(F.col("_due"), "CLOSED").otherwise(F.col("status"))})
    still = F.col("status") == "OPEN"
    worth = F.col("entry_value") + F.coalesce(gain, F.lit(0.0))
    sums = closed.where("_active").groupBy("portfolio_id").agg(
        F.sum(F.when(F.col("_due"), F.col("entry_value") + F.col("pnl") + fee).otherwise(0.0)).alias("_got"), F.sum(F.when(still, worth).otherwise(0.0)).alias("market_value"), F.count_if("_due").alias("closed"), F.count_if(still).alias("open"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    valued = portfolios.where("is_active").join(sums, "portfolio_id", "left").select("portfolio_id", (F.col("cash") + zero("_got")).alias("cash"), zero("market_value").cast("double").alias("market_value"), zero("closed").alias("closed"), zero("open").alias("open"))
    return closed.drop("_price", "_active", "_due"), valued.withColumn("total_value", F.col("cash") + F.col("market_value"))


#: What a missing training feature counts as.
TRAINING_MEANS = {"price_to_low": 1.3978, "price_to_high": 0.8588, "analyst_upside": 13.518, "concern_level": 5.345, "market_cap": 682_892_847_207.0}
FORMS = {"10-K": 0.0, "10-Q": 1.0, "8-K": 2.0}


def training_set(filings: DataFrame, companies: DataFrame, snapshots: DataFrame, activity: DataFrame, macro: DataFrame) -> DataFrame:
    """filing_id, sector, tier, target and the 13 features f_*, a row a filing with a 30-day return against the market and a sentiment.

    Prices are those of the filing's last snapshot if it has one, else the company's, field by field where a snapshot lacks one; without a price there
    is no row. The tone's change is against the filing before of that company and form (of one date, both look to the one before them), what analysts did
    counts over the 30 days before, the market's state is the nearest under 7 days away.
    """
    from pyspark.sql import Window

    from finlark.functions.math import cap_tier, winsorised
    from finlark.operators.asof import interval_aggregate

    kept = filings.where("actual_30d_alpha is not null and sentiment is not null").where(F.col("filing_type").isin(*FORMS))
    days = kept.groupBy("company_id", "filing_type", "day").agg(F.max_by("sentiment", "filing_id").alias("last"))
    w = Window.partitionBy("company_id", "filing_type").orderBy("day")
    prior = days.select("company_id", "filing_type", "day", F.lag("last").over(w).alias("prior"))
    met = kept.join(prior, ["company_id", "filing_type", "day"], "left")
    shot = snapshots.groupBy("filing_id").agg(F.max_by(F.struct(*[F.col(c).alias(f"s_{c}") for c in PRICES]), "snapshot_day").alias("s")).select("filing_id", "s.*")
    met = met.join(shot, "filing_id", "left").join(companies.select("company_id", "sector", "market_cap", *PRICES), "company_id")
    c, m = F.col("change_right"), F.col("major_right")
    moved = interval_aggregate(kept.select("filing_id", "company_id", "day"), activity.select("company_id", "day", "change", "major"), key="filing_id", by=["company_id"], on="day", low=-30, high=0, closed_high=False, aggregates=lambda: [F.count_if(c == "upgrade").alias("ups"), F.count_if((c == "downgrade") & m).alias("downs")])
    met = met.join(moved.select("filing_id", "ups", "downs"), "filing_id", "left").withColumn("_all", F.lit(1))
    known = macro.where("spx_return_30d is not null or vix_close is not null").select(F.lit(1).alias("_all"), "day", "spx_return_30d", "vix_close")
    met = asof_join(met, known, by=["_all"], on="day", take=["spx_return_30d", "vix_close"], direction="nearest", tolerance=7, strict_tolerance=True)
    has = F.coalesce(F.col("s_current_price") != 0, F.lit(False))
    p = {name: F.when(has, F.coalesce(F.col(f"s_{name}"), F.col(name))).otherwise(F.col(name)) for name in PRICES}
    price = F.coalesce(p["current_price"], F.lit(0.0))
    over = lambda x: F.when(p[x] > 0, price / p[x])
    cap = F.coalesce("market_cap", F.lit(TRAINING_MEANS["market_cap"]))
    f = {
        "price_to_low": F.coalesce(over("fifty_two_week_low"), F.lit(TRAINING_MEANS["price_to_low"])), "major_downgrades": F.coalesce("downs", F.lit(0)).cast("double"),
        "analyst_upside": F.coalesce((F.nullif(p["analyst_target_price"], F.lit(0.0)) / price - 1) * 100, F.lit(TRAINING_MEANS["analyst_upside"])), "price_to_high": F.coalesce(over("fifty_two_week_high"), F.lit(TRAINING_MEANS["price_to_high"])),
        "concern_level": F.coalesce("concern", F.lit(TRAINING_MEANS["concern_level"])), "market_cap": cap, "sentiment_score": F.col("sentiment"), "upgrades_30d": F.coalesce("ups", F.lit(0)).cast("double"),
        "filing_type_factor": F.element_at(F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv]), F.col("filing_type")), "tone_change": F.coalesce(F.col("sentiment") - F.col("prior"), F.lit(0.0)), "eps_surprise": winsorised(F.col("eps_surprise")),
        "spx_trend_30d": F.coalesce("spx_return_30d_right", F.lit(0.0)), "vix_level": F.coalesce("vix_close_right", F.lit(20.0)),
    }
    return met.where(price > 0).select("filing_id", "sector", cap_tier(cap).alias("tier"), F.col("actual_30d_alpha").alias("target"), *[v.alias(f"f_{k}") for k, v in f.items()])


PRICES = ["current_price", "fifty_two_week_high", "fifty_two_week_low", "analyst_target_price"]
#: Share of right directions by ticker in the record, in per cent, and that of the model.
ACCURACY = {
    "HD": 80.0, "JPM": 75.0, "AMD": 73.3, "PYPL": 66.7, "MA": 66.7, "META": 66.7, "AAPL": 60.0, "MSFT": 60.0, "GOOGL": 57.1, "AMZN": 53.3,
    "TSLA": 53.3, "NFLX": 50.0, "NVDA": 46.7, "INTC": 46.7, "WMT": 60.0, "COST": 60.0, "PG": 60.0, "V": 60.0, "DIS": 53.3, "AVGO": 53.3,
}
MODEL_ACCURACY = 56.8


def record(ticker: Column) -> Column:
    """The ticker's share of right directions; the model's where it has no record."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ACCURACY.items() for x in kv]), F.upper(ticker)), F.lit(MODEL_ACCURACY))


def adjusted_confidence(confidence: Column, ticker: Column) -> Column:
    """A confidence moved by the ticker's record, within 0.1 and 0.95."""
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), confidence + (record(ticker) - MODEL_ACCURACY) / 100))


def record_tier(ticker: Column) -> Column:
    return F.when(record(ticker) >= 70, "high").when(record(ticker) >= 55, "medium").otherwise("low")
