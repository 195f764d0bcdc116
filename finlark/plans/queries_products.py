"""Registered exports, bundles, lookups and the challenger's models, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.operators import aggregates
from finlark.operators.asof import asof_join
from finlark.plans import bindings as B
from finlark.plans import challenger, products, scoring
from finlark.plans.market_state import value_back
from finlark.plans.queries_aggregate import rounded
from finlark.plans.queries_series import SIDE, sides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = run, B.WITH + sql
        return run

    return register


def made(rows: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return rows.select("*", *[F.expr(e).alias(c) for c, e in expressions.items()])


def listed(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} as {c}" for c, e in expressions.items())


#: The challenger's inputs. Both engines read these expressions.
INPUTS = {
    "market_cap": "case when filing_id % 9 <> 0 then ((filing_id * 13) % 5000) * 1e9 end", "risk_score": "case when filing_id % 4 <> 0 then (filing_id % 81) / 8e0 end", "sentiment_score": "case when filing_id % 5 <> 0 then sentiment end",
    "pe_ratio": "case when filing_id % 6 <> 0 then cast(filing_id % 50 as double) end", "forward_pe": "case when filing_id % 7 <> 0 then cast(filing_id % 43 as double) end", "price_to_target": "case when filing_id % 8 <> 0 then (filing_id % 33) / 2e1 end",
    "price_to_high": "case when filing_id % 3 <> 0 then (filing_id % 101) / 1e2 end", "price_to_low": "case when filing_id % 5 <> 1 then 1 + (filing_id % 64) / 6.4e1 end", "analyst_bullish_ratio": "case when filing_id % 10 <> 0 then (filing_id % 21) / 2e1 end",
    "volume_ratio": "case when filing_id % 11 <> 0 then (filing_id % 25) / 1e1 end", "dividend_yield": "case when filing_id % 12 <> 0 then (filing_id % 9) / 1e2 end", "beta": "case when filing_id % 13 <> 0 then (filing_id % 23) / 8e0 end",
    "eps_actual": "case when filing_id % 4 <> 1 then (filing_id % 17 - 8) / 4e0 end", "eps_estimate_next_y": "case when filing_id % 5 <> 2 then (filing_id % 29 - 9) / 4e0 end", "eps_estimate_current_y": "case when filing_id % 5 <> 3 then (filing_id % 31 - 9) / 4e0 end",
    "current_price": "value / 1e3", "price_to_ma30": "case when filing_id % 4 <> 2 then (filing_id % 41 + 80) / 1e2 end", "rsi14": "case when filing_id % 6 <> 1 then cast(filing_id % 101 as double) end", "macd_histogram": "case when filing_id % 7 <> 1 then predicted end",
    "volatility30": "case when filing_id % 7 <> 2 then cast(filing_id % 60 as double) end", "return_30d": "case when filing_id % 7 <> 3 then predicted * 2 end", "spx_return_7d": "case when filing_id % 7 <> 4 then (filing_id % 13 - 6) / 2e0 end", "vix_close": "case when filing_id % 7 <> 5 then cast(12 + filing_id % 30 as double) end",
}
RAW = ", raw as (select filing_id, filing_type, " + listed(INPUTS) + " from filing)"


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).select("filing_id", "filing_type", *[F.expr(e).alias(c) for c, e in INPUTS.items()])


M4 = RAW + """, x as (
  select filing_id, filing_type, market_cap / 1e9 as cap, coalesce(risk_score, 5) as risk, coalesce(sentiment_score, 0) as mood, coalesce(pe_ratio, 20) as pe, coalesce(forward_pe, 18) as fpe, coalesce(price_to_target, 1) as gap, coalesce(price_to_high, 0.85) as high,
    coalesce(analyst_bullish_ratio, 0.5) as bulls, coalesce(volume_ratio, 1) as volume, coalesce(dividend_yield, 0.02) as yield, coalesce(beta, 1) as beta, coalesce(eps_actual, 0) as eps, coalesce(eps_estimate_next_y, 0) as next_eps from raw),
e as (
  select filing_id,
    case when coalesce(cap, 0) = 0 then 0 when cap < 10 then -2 + cap / 10 when cap < 50 then -1 + (cap - 10) / 80 when cap < 200 then -0.5 + (cap - 50) / 300 when cap < 500 then (cap - 200) / 150 when cap < 1000 then 2 - (cap - 500) / 1000 else greatest(1.0, 1.5 - (cap - 1000) / 6000) end as e_market_cap,
    -0.05 * abs(pe - 18) - 0.002 * (pe - 18) * (pe - 18) as e_pe, case when fpe <> 0 and pe <> 0 then (fpe - pe) / greatest(pe, 1) * 5 else 0 end as e_pe_expansion,
    case when high > 0.95 then -1.0 when high > 0.85 then 2.0 when high > 0.7 then 1.0 else -0.5 end as e_price_high, case when gap < 0.75 then 3.0 when gap < 0.9 then 1.5 when gap <= 1.05 then 0.0 when gap < 1.15 then -1.0 else -2.5 end as e_valuation_gap,
    case when bulls > 0.75 then 2.0 when bulls > 0.6 then 1.0 when bulls > 0.4 then 0.0 when bulls > 0.25 then -1.0 else -2.0 end as e_analyst, 3 * mood * (1 - risk / 15) as e_sentiment, -0.8 * risk - 0.05 * risk * risk as e_risk,
    case when next_eps <> 0 and eps <> 0 then greatest(-2, least(3, (next_eps - eps) / abs(eps) * 2)) else 0 end as e_eps_growth, case when yield > 0.05 then -0.5 when yield > 0.02 then 0.5 else 0 end as e_dividend, (beta - 1) * 0.5 as e_beta,
    case when volume > 2 then case when mood > 0 then 1 else -1 end when volume > 1.3 then mood * 0.5 else 0 end as e_volume, case filing_type when '10-K' then 0.3 when '10-Q' then 0.2 else case when mood > 0 then 0.5 else -0.5 end end as e_filing_type from x)
select filing_id, round(e_market_cap, 11) as e_market_cap, round(e_pe, 11) as e_pe, round(e_pe_expansion, 11) as e_pe_expansion, round(e_price_high, 11) as e_price_high, round(e_valuation_gap, 11) as e_valuation_gap, round(e_analyst, 11) as e_analyst, round(e_sentiment, 11) as e_sentiment, round(e_risk, 11) as e_risk,
  round(e_eps_growth, 11) as e_eps_growth, round(e_dividend, 11) as e_dividend, round(e_beta, 11) as e_beta, round(e_volume, 11) as e_volume, round(e_filing_type, 11) as e_filing_type,
  round(0.83 + e_market_cap * 0.25 + e_pe * 0.15 + e_pe_expansion * 0.1 + e_price_high * 0.2 + e_valuation_gap * 0.3 + e_analyst * 0.25 + e_sentiment * 0.35 + e_risk * 0.2 + e_eps_growth * 0.25 + e_dividend * 0.1 + e_beta * 0.15 + e_volume * 0.15 + e_filing_type * 0.1, 11) as predicted from e"""


@query("M4_enhanced_challenger", M4)
def enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(challenger.enhanced(inputs(spark, sf_dir)).select("filing_id", *[f"e_{k}" for k in challenger.WEIGHTS], "predicted"), 11)


@query("M20_large_ensemble", RAW + """ select filing_id, round(case when filing_type = '10-K' then
    coalesce(risk_score * -0.5, 0) + coalesce(sentiment_score * 0.8, 0) + case when pe_ratio > 0 and pe_ratio < 15 then 1 when pe_ratio > 30 then -1 else 0 end + case when analyst_bullish_ratio > 0.6 then 1.5 when analyst_bullish_ratio < 0.4 then -1.5 else 0 end
    + case when price_to_target > 0 and price_to_target < 0.9 then 1 when price_to_target > 1.1 then -1 else 0 end + case when price_to_ma30 > 1.02 then 0.5 else 0 end + case when rsi14 < 30 then 0.5 when rsi14 > 70 then -0.5 else 0 end + case when spx_return_7d > 2 then 0.3 else 0 end - case when vix_close > 30 then 0.3 else 0 end
  else coalesce(current_price * -0.0078, 0) + coalesce(eps_estimate_current_y * 0.0909, 0) + coalesce(eps_estimate_next_y * 0.0635, 0) + coalesce(eps_actual * 0.0534, 0) + coalesce(forward_pe * 0.045, 0) + coalesce(price_to_high * 2.7294, 0) + coalesce(price_to_low * 0.5406, 0) + coalesce(risk_score * 0.0716, 0)
    + coalesce(dividend_yield * -0.1071, 0) + coalesce((price_to_ma30 - 1) * 5, 0) + coalesce((rsi14 - 50) * 0.05, 0) + coalesce(macd_histogram * 0.3, 0) + coalesce(volatility30 * -0.2, 0) + coalesce(return_30d * 0.15, 0) + coalesce(spx_return_7d * 0.25, 0) + coalesce((vix_close - 20) * -0.05, 0) end, 11) as predicted from raw""")
def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(challenger.ensemble(inputs(spark, sf_dir)).select("filing_id", "predicted"), 11)


#: Price rows in the roles of indicators, snapshots and macro rows.
TECHNICAL = {
    "ma30": "close / 2", "ma50": "close / 3", "ma200": "close / 4", "price_to_ma30": "close / high", "price_to_ma50": "close / high", "price_to_ma200": "low / close", "rsi14": "volume", "macd": "high - low", "volatility30": "volume * 2", "return_30d": "close - low", "return_90d": "cast(day % 41 - 20 as double)",
}
SNAPSHOTS = {
    "eps_estimate": "cast(day % 13 - 3 as double)", "rating_count": "cast(day % 9 as int)", "buy_count": "cast(day % 4 as int)", "hold_count": "cast(day % 3 as int)", "sell_count": "cast(day % 2 as int)", "current_price": "close",
}
MACRO = {
    "spx_return_7d": "cast(day % 15 - 7 as double)", "spx_return_30d": "cast(day % 31 - 15 as double)", "vix_close": "cast(10 + day % 30 as double)", "yield_curve": "(day % 9 - 3) / 4e0", "treasury10y": "(day % 17) / 4e0", "tech_return_30d": "cast(day % 19 - 9 as double)", "energy_return_30d": "cast(day % 23 - 11 as double)",
}
SECTOR_COLUMNS = {"MACHINERY": "tech_return_30d", "FURNITURE": "energy_return_30d"}
EVENTS = {"eps_actual": "cast(filing_id % 19 - 6 as double)", "guidance_low": "case when filing_id % 3 <> 0 then cast(filing_id % 11 as double) end", "guidance_high": "case when filing_id % 4 <> 0 then cast(filing_id % 11 + filing_id % 5 as double) end"}
KEYED = SIDE + f", technical as (select ticker, day, {listed(TECHNICAL)} from price), snapshot as (select ticker, day, {listed(SNAPSHOTS)} from price), macro as (select day, {listed(MACRO)} from price where ticker = 1)"


def prices(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return B.prices(spark, sf_dir).select("ticker", "day", *[F.expr(e).alias(c) for c, e in columns.items()])


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir, MACRO).where("ticker = 1").drop("ticker")


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company a price series: the customer of that number."""
    n = B.table(spark, sf_dir, "supplier").count()
    return B.companies(spark, sf_dir).where(F.col("company_id") < n).withColumn("ticker", F.col("company_id"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.table(spark, sf_dir, "supplier").count()
    return made(B.filings(spark, sf_dir).drop("value").withColumn("company_id", F.col("company_id") % n), SCORED)


SCORED = {
    "actual_7d_return": "case when filing_id % 7 <> 0 then actual end", "actual_30d_return": "actual * 2", "actual_7d_alpha": "actual / 2", "actual_30d_alpha": "case when filing_id % 5 <> 0 then actual / 4 end", "risk_score": "case when filing_id % 8 <> 0 then cast(filing_id % 10 as double) end",
    "sentiment_score": "sentiment", "concern_level": "case when filing_id % 9 <> 0 then concern end", "eps_surprise": "case when filing_id % 3 <> 0 then cast(filing_id % 31 - 15 as double) end", "actual_eps": "cast(filing_id % 19 as double)", "consensus_eps": "cast(filing_id % 17 as double)", "revenue_surprise": "cast(filing_id % 7 as double)",
    "actual_revenue": "cast(filing_id % 1000 as double)", "consensus_revenue": "cast(filing_id % 900 as double)",
    "analysis_data": "case when filing_id % 6 = 0 then 'broken' when filing_id % 6 = 1 then null else concat('{\"guidanceDirection\": \"', case filing_id % 3 when 0 then 'raised' when 1 then 'lowered' else '' end, '\", \"xbrlFinancials\": {\"revenue\": ', cast(filing_id % 5 as varchar(20)), ', \"netIncome\": ', cast(filing_id % 4 as varchar(20)), ', \"totalAssets\": 10, \"totalLiabilities\": ', cast(filing_id % 8 as varchar(20)), ', \"earningsPerShareBasic\": 2}, \"analyst\": {\"upsidePotential\": ', cast(filing_id % 30 as varchar(20)), ', \"consensusScore\": 70, \"activity\": {\"upgradesLast30d\": ', cast(filing_id % 5 as varchar(20)), ', \"netUpgrades\": 1}}}') end",
}
SCORED_SQL = ", n as (select count(*) as firms from supplier), scored as (select filing_id, company_id % firms as company_id, filing_type, filing_date, day, " + listed(SCORED) + " from filing cross join n), firm as (select * replace (company_id as ticker) from company cross join n where company_id < firms)"
GOOD = "filing_id % 6 > 1"


def as_of(side: str, columns: list[str], by: str, alias: str, within: int | None = None) -> str:
    near = f" and p.day >= f.day - {within}" if within is not None else ""
    return f" left join lateral (select {', '.join(columns)} from {side} p where {by} p.day <= f.day{near} order by p.day desc limit 1) {alias} on true"


def export_sql(concern: bool) -> str:
    return KEYED + SCORED_SQL + " select f.filing_id, c.ticker, c.name as company_name, f.filing_type, f.filing_date, actual_7d_return, actual_30d_return, actual_7d_alpha, actual_30d_alpha, risk_score, sentiment_score, " + ("concern_level, " if concern else "") + (
        "market_cap, current_price, pe_ratio, cast(null as double) as forward_pe, fifty_two_week_high, fifty_two_week_low, analyst_target_price, round(current_price / nullif(fifty_two_week_high, 0), 8) as price_to_high, round(current_price / nullif(fifty_two_week_low, 0), 8) as price_to_low, round(current_price / nullif(analyst_target_price, 0), 8) as price_to_target, "
        + ", ".join(f"round(t.{x}, 8) as {x}" for x in ("ma30", "ma50", "ma200", "price_to_ma30", "price_to_ma50", "rsi14", "macd", "volatility30", "return_30d")) + ", spx_return_7d, spx_return_30d, vix_close, "
        + f"case when {GOOD} then (filing_id % 30)::double end as analyst_upside_potential, case when {GOOD} then 70.0::double end as analyst_consensus_score, cast(null as int) as analyst_coverage, case when {GOOD} then (filing_id % 5)::int end as upgrades_last_30d, cast(null as int) as downgrades_last_30d, case when {GOOD} then 1 end as net_upgrades, cast(null as int) as major_upgrades, cast(null as int) as major_downgrades, "
        + "case when market_cap >= 500e9 then 'mega' when market_cap >= 200e9 then 'large' when market_cap >= 50e9 then 'mid' else 'small' end as market_cap_category from scored f join firm c using (company_id)"
    ) + as_of("technical", list(TECHNICAL), "p.ticker = f.company_id and", "t") + as_of("macro", ["spx_return_7d", "spx_return_30d", "vix_close"], "", "m") + " where filing_type <> '8-K' and actual_7d_return is not null and risk_score is not null and sentiment_score is not null" + (" and concern_level is not null" if concern else "") + " and market_cap <> 0 and current_price <> 0"


def export(spark: SparkSession, sf_dir: str, concern: bool) -> DataFrame:
    companies = firms(spark, sf_dir).withColumn("forward_pe", F.lit(None).cast("double"))
    out = products.dataset(scored(spark, sf_dir), companies, prices(spark, sf_dir, TECHNICAL), macro(spark, sf_dir), concern=concern)
    exact = {"price_to_high", "price_to_low", "price_to_target", *products.TECHNICAL}
    return out.select(*[F.round(c, 8).alias(c) if c in exact else c for c in out.columns])


@query("X1_dataset_full", export_sql(True))
def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(spark, sf_dir, True)


@query("V21_dataset_without_concern", export_sql(False))
def older(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(spark, sf_dir, False)


@query("X2_F52_model_features", SCORED_SQL + f""", y as (select *, case when {GOOD} then nullif(filing_id % 5, 0)::double end as rev, case when {GOOD} then nullif(filing_id % 4, 0)::double end as inc, case when {GOOD} then 10.0::double end as ass, case when {GOOD} then nullif(filing_id % 8, 0)::double end as lia, case when {GOOD} and filing_id % 3 = 0 then 'raised' when {GOOD} and filing_id % 3 = 1 then 'lowered' else 'not_provided' end as g from scored)
select filing_id, coalesce(c.ticker::varchar, 'UNKNOWN') as ticker, cast(filing_date as date) as filing_date, actual_7d_return, actual_30d_return, eps_surprise, actual_eps, consensus_eps, revenue_surprise, actual_revenue, consensus_revenue, eps_surprise > 2 as eps_beat, eps_surprise < -2 as eps_miss, eps_surprise between -2 and 2 as eps_inline, eps_surprise > 10 as large_beat, eps_surprise < -10 as large_miss, abs(eps_surprise) as surprise_magnitude,
  risk_score, sentiment_score, concern_level, rev as revenue, inc as net_income, case when {GOOD} then 2.0::double end as eps, ass as assets, lia as liabilities, round(inc / rev * 100, 8) as profit_margin, round(lia / ass * 100, 8) as debt_to_assets, g as guidance_direction, g = 'raised' as guidance_raised, g = 'lowered' as guidance_lowered, market_cap
from y left join firm c using (company_id) where actual_7d_return is not null and eps_surprise is not null""")
def feature_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = products.model_features(scored(spark, sf_dir), firms(spark, sf_dir).withColumn("ticker", F.col("ticker").cast("string")))
    return out.withColumns({c: F.round(c, 8) for c in ("profit_margin", "debt_to_assets")})


@query("M19_F44_drift_features", KEYED + f""", n as (select count(*) as firms from supplier), firm as (select company_id as ticker, sector, market_cap, beta, pe_ratio from company cross join n where company_id < firms), ev as (select filing_id, company_id % firms as ticker, day, {listed(EVENTS)} from filing cross join n),
near as (select f.*, c.sector, nullif(c.market_cap, 0) as market_cap, coalesce(nullif(c.beta, 0), 1) as beta, nullif(c.pe_ratio, 0) as pe_ratio, nullif(eps_estimate, 0) as cons, nullif(rating_count, 0) as cnt, buy_count, hold_count, sell_count, nullif(current_price, 0) as price, nullif(return_90d, 0) as r90, nullif(price_to_ma50, 0) as m50, nullif(price_to_ma200, 0) as m200, nullif(rsi14, 0) as rsi,
  nullif(spx_return_7d, 0) as spx, nullif(vix_close, 0) as vix, nullif(yield_curve, 0) as curve, case c.sector when 'MACHINERY' then tech_return_30d when 'FURNITURE' then energy_return_30d end as sect
  from ev f left join firm c using (ticker)""" + as_of("snapshot", list(SNAPSHOTS), "p.ticker = f.ticker and", "s", 2) + as_of("technical", ["return_90d", "price_to_ma50", "price_to_ma200", "rsi14"], "p.ticker = f.ticker and", "t", 2) + as_of("macro", list(MACRO), "", "m", 2) + """),
bands as (select f.filing_id, nullif(max_by(eps_estimate, p.day) filter (p.day between f.day - 33 and f.day - 27), 0) as old, nullif(max_by(eps_estimate, p.day) filter (p.day between f.day - 2 and f.day), 0) as new, nullif(max_by(current_price, p.day) filter (p.day between f.day - 2 and f.day), 0) as paid, nullif(min_by(current_price, p.day) filter (p.day between f.day + 4 and f.day + 10), 0) as later from ev f join snapshot p on p.ticker = f.ticker and p.day between f.day - 33 and f.day + 10 group by 1),
a1 as (select filing_id, p.day, (close - lag(close) over w) / lag(close) over w as v from ev f join price p on p.ticker = f.ticker and p.day between f.day - 90 and f.day window w as (partition by filing_id order by p.day)),
a2 as (select filing_id, row_number() over (partition by filing_id order by day) as i, count(*) over (partition by filing_id) as n, v from a1 where v is not null),
b1 as (select filing_id, p.day, case when treasury10y <> 0 and lag(treasury10y) over w <> 0 then treasury10y - lag(treasury10y) over w end as v from ev f join macro p on p.day between f.day - 90 and f.day window w as (partition by filing_id order by p.day)),
b2 as (select filing_id, row_number() over (partition by filing_id order by day) as i, count(*) over (partition by filing_id) as n, v from b1 where v is not null),
sens as (select filing_id, coalesce(case when stddev_pop(a.v) * stddev_pop(b.v) > 0 then covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) end, 0) as r from a2 a join b2 b using (filing_id, i) where a.n >= 30 and b.n >= 30 group by 1),
z as (select *, abs(cons) * (0.05 + 0.1 * coalesce(sqrt((pow(buy_count / cnt - 0.33, 2) + pow(hold_count / cnt - 0.33, 2) + pow(sell_count / cnt - 0.33, 2)) / 3), 0.1)) as spread, ((nullif(guidance_low, 0) + nullif(guidance_high, 0)) / 2 - cons) / cons * 100 as delta, (later - price) / price * 100 as raw from near left join bands using (filing_id) left join sens using (filing_id))
select filing_id, round((eps_actual - cons) / nullif(spread, 0), 6) as sue, eps_actual, cons as eps_consensus, eps_actual - cons as eps_beat, round(delta, 6) as guidance_delta, case when delta > 1 then 1 when delta < -1 then -1 else 0 end as guidance_shift, round((new - old) / paid * 100, 6) as analyst_revision_30d, round(spread, 6) as consensus_dispersion, 0 as analyst_upgrade_30d, r90 - sect as relative_strength_90d, case when r90 - sect is not null then sect end as sector_return_90d,
  round(m50, 6) as price_to_ma50, round(m200, 6) as price_to_ma200, rsi as rsi14, round(r, 6) as interest_rate_sensitivity, curve as yield_curve, vix, spx as spx_return_7d, market_cap, beta, pe_ratio, round(raw - beta * spx, 6) as abnormal_return_7d, round(raw, 6) as raw_return_7d, spx as market_return_7d from z""")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.table(spark, sf_dir, "supplier").count()
    events = B.filings(spark, sf_dir).select("filing_id", (F.col("company_id") % n).alias("ticker"), "day", *[F.expr(e).alias(c) for c, e in EVENTS.items()])
    series = prices(spark, sf_dir, {**SNAPSHOTS, **TECHNICAL, "close": "close"})
    out = products.drift_features(events, firms(spark, sf_dir), series, series, macro(spark, sf_dir).withColumns({"financial_return_30d": F.lit(None), "healthcare_return_30d": F.lit(None)}), series, SECTOR_COLUMNS)
    exact = ["sue", "guidance_delta", "analyst_revision_30d", "consensus_dispersion", "price_to_ma50", "price_to_ma200", "interest_rate_sensitivity", "abnormal_return_7d", "raw_return_7d"]
    return out.withColumns({c: F.round(c, 6) for c in exact})


@query("F15_F16_message_lookups", """, said as (select filing_id, concat(case filing_id % 5 when 0 then 'How are energy and technology firms doing? ' when 1 then 'Consumer Cyclical names please. ' when 2 then 'A word on utilities. ' else 'What about ' end, case filing_id % 4 when 0 then 'AB''s risks' when 1 then 'XY now' when 2 then 'ABCDEFG is long' else 'nobody' end) as text from filing)
select filing_id, case filing_id % 5 when 0 then 'Technology' when 1 then 'Consumer Cyclical' when 2 then 'Utilities' end as sector, case filing_id % 5 when 0 then 'Technology,Information Technology' when 1 then 'Consumer Cyclical,Consumer Discretionary' when 2 then 'Utilities' end as names, case when filing_id % 5 <> 2 and filing_id % 4 = 0 then 'AB' end as ticker from said""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("filing_id")
    start = F.when(k % 5 == 0, "How are energy and technology firms doing? ").when(k % 5 == 1, "Consumer Cyclical names please. ").when(k % 5 == 2, "A word on utilities. ").otherwise("What about ")
    end = F.when(k % 4 == 0, "AB's risks").when(k % 4 == 1, "XY now").when(k % 4 == 2, "ABCDEFG is long").otherwise("nobody")
    known = spark.createDataFrame([("AB",), ("CD",)], "ticker string")
    out = products.with_mentions(B.filings(spark, sf_dir).select("filing_id", F.concat(start, end).alias("text")), known)
    return out.select("filing_id", "sector", F.array_join("sector_names", ",").alias("names"), "ticker")


CLOSE_SQL = SIDE + """, today as (select max(day) - 30 as d from price), t as (select g.filing_id as trade_id, g.company_id % 20 as portfolio_id, f.ticker, g.day, case when g.predicted > 0 then 'LONG' else 'SHORT' end as direction, g.status, g.filing_id % 9 + 1 as shares, g.value / 100 as paid from f join filing g using (filing_id) cross join today where g.day <= d and g.day > d - 40),
last as (select ticker, max_by(close, day) as price from price cross join today where day <= d group by 1),
m as (select t.*, d, price, portfolio_id % 4 <> 0 as active, case when direction = 'LONG' then price * shares - paid else paid - price * shares end as gain from t cross join today left join last using (ticker)),
u as (select *, status = 'O' and active and day <= d - 7 and price is not null as due from m)
select p as portfolio_id, round(100000 + p + coalesce(sum(case when due then paid + gain - 1 end), 0), 6) as cash, round(coalesce(sum(case when status = 'O' and not due then paid + coalesce(gain, 0) end), 0), 6) as market_value, count(*) filter (due) as closed, count(*) filter (status = 'O' and not due) as open,
  round(100000 + p + coalesce(sum(case when due then paid + gain - 1 when status = 'O' then paid + coalesce(gain, 0) end), 0), 6) as total_value from (select unnest(range(20)) as p) left join u on portfolio_id = p where p % 4 <> 0 group by p"""


@query("V27_daily_close", CLOSE_SQL)
def daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open trades of the last 40 days of each portfolio, 30 days before the last price."""
    left, right = sides(spark, sf_dir)
    today = right.agg(F.max("day")).first()[0] - 30
    facts = B.filings(spark, sf_dir).where(F.col("day").between(today - 39, today)).select("filing_id", "company_id", "predicted", "status", "value")
    trades = left.join(facts, "filing_id").select(
        F.col("filing_id").alias("trade_id"), (F.col("company_id") % 20).alias("portfolio_id"), "ticker", "day", F.when(F.col("predicted") > 0, "LONG").otherwise("SHORT").alias("direction"),
        F.when(F.col("status") == "O", "OPEN").otherwise("DONE").alias("status"), (F.col("filing_id") % 9 + 1).alias("shares"), (F.col("value") / 100).alias("entry_value"),
    )
    owners = spark.range(20).select(F.col("id").alias("portfolio_id"), (F.col("id") % 4 != 0).alias("is_active"), (100000.0 + F.col("id")).alias("cash"))
    return rounded(products.daily_close(trades, owners, right, today)[1], 6)


@query("F26_day_of_year", "select filing_id, dayofyear(filing_date)::int as day, (dayofyear(filing_date) % 6)::int as slot from filing")
def day_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.dayofyear("filing_date")
    return B.filings(spark, sf_dir).select("filing_id", d.alias("day"), (d % 6).alias("slot"))


@query("J12_last_known_price", SIDE + "select f.filing_id, round(p.close, 6) as base from f left join lateral (select close from price p where p.ticker = f.ticker and p.day <= f.day order by p.day desc limit 1) p on true")
def last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return asof_join(left, right, by=["ticker"], on="day", take=["close"]).select("filing_id", F.round("close_right", 6).alias("base"))


@query("W22_value_days_back", "select p.ticker, p.day, round(q.close, 6) as back from price p left join lateral (select close from price q where q.ticker = p.ticker and q.day <= p.day - 30 and q.day >= p.day - 35 order by q.day desc limit 1) q on true")
def days_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close 30 days back, or the last one of up to 5 days before that."""
    rows = B.prices(spark, sf_dir).select("ticker", "day", "close")
    return value_back(rows, 30, 5).select("ticker", "day", F.round("back", 6).alias("back"))


V3 = """, s as (select *, row_number() over w as k from price window w as (partition by ticker order by date)) select ticker, date, round((close - lag(close, 6) over w) * 100 / lag(close, 6) over w, 6) as return_7d, round((close - lag(close, 13) over w) * 100 / lag(close, 13) over w, 6) as return_14d, round((close - lag(close, 20) over w) * 100 / lag(close, 20) over w, 6) as return_21d, round((close - lag(close, 29) over w) * 100 / lag(close, 29) over w, 6) as return_30d,
  round(close * 0.85 / close, 6) as two_year_share, close as fed_funds, case when (close - lag(close, 6) over w) * 100 / lag(close, 6) over w > 2 then 'strong_up' when (close - lag(close, 6) over w) * 100 / lag(close, 6) over w > 0.5 then 'up' when (close - lag(close, 6) over w) * 100 / lag(close, 6) over w < -2 then 'strong_down' when (close - lag(close, 6) over w) * 100 / lag(close, 6) over w < -0.5 then 'down' when lag(close, 6) over w is not null then 'flat' end as momentum from s window w as (partition by ticker order by date)"""


@query("V3_row_macro", V3)
def row_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.plans.market_state import row_macro as rows

    made = rows(B.prices(spark, sf_dir))
    return made.select("ticker", "date", *[F.round(c, 6).alias(c) for c in ("return_7d", "return_14d", "return_21d", "return_30d")], F.round(F.col("two_year") / F.col("close"), 6).alias("two_year_share"), "fed_funds", "momentum")


@query("F50_record_by_ticker", """, t as (select filing_id, confidence, ['hd', 'JPM', 'AMD', 'PYPL', 'MA', 'META', 'aapl', 'MSFT', 'GOOGL', 'AMZN', 'TSLA', 'NFLX', 'NVDA', 'INTC', 'WMT', 'COST', 'PG', 'V', 'DIS', 'AVGO', 'ZZZ'][filing_id % 21 + 1] as ticker, [80.0, 75.0, 73.3, 66.7, 66.7, 66.7, 60.0, 60.0, 57.1, 53.3, 53.3, 50.0, 46.7, 46.7, 60.0, 60.0, 60.0, 60.0, 53.3, 53.3, 56.8][filing_id % 21 + 1]::double as acc from filing)
select filing_id, ticker, round(greatest(0.1, least(0.95, confidence + (acc - 56.8) / 100)), 8) as confidence, case when acc >= 70 then 'high' when acc >= 55 then 'medium' else 'low' end as tier from t""")
def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["hd", "JPM", "AMD", "PYPL", "MA", "META", "aapl", "MSFT", "GOOGL", "AMZN", "TSLA", "NFLX", "NVDA", "INTC", "WMT", "COST", "PG", "V", "DIS", "AVGO", "ZZZ"]
    rows = B.filings(spark, sf_dir).withColumn("ticker", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("filing_id") % 21 + 1).cast("int")))
    return rows.select("filing_id", "ticker", F.round(products.adjusted_confidence(F.col("confidence"), F.col("ticker")), 8).alias("confidence"), products.record_tier(F.col("ticker")).alias("tier"))


M10 = KEYED + """, fi as (select filing_id, company_id, filing_type, day, sentiment, case when filing_id % 5 <> 0 then concern end as concern, case when filing_id % 4 <> 0 then predicted * 10 end as eps, actual / 2 as alpha from filing where filing_id % 7 <> 0),
snaps as (select filing_id, case when filing_id % 4 <> 0 then value / 1e3 end as cp, case when filing_id % 8 <> 1 then value / 5e2 end as hi, value / 2e3 as lo, null::double as tp from filing where filing_id % 2 = 0),
pr as (select company_id, filing_type, day, lag(last) over (partition by company_id, filing_type order by day) as prior from (select company_id, filing_type, day, max_by(sentiment, filing_id) as last from fi group by all)),
act as (select company_id, day + o as day, change, major from (select company_id, day, filing_id % 61 - 30 as o, ['upgrade', 'downgrade', 'reiterated'][filing_id % 3 + 1] as change, filing_id % 2 = 0 as major from filing)),
mv as (select f.filing_id, count(*) filter (change = 'upgrade') as ups, count(*) filter (change = 'downgrade' and major) as downs from fi f join act a on a.company_id = f.company_id and a.day >= f.day - 30 and a.day < f.day group by 1),
x as (select fi.*, c.sector, c.market_cap, prior, coalesce(ups, 0) as ups, coalesce(downs, 0) as downs, m.spx_return_30d as spx, m.vix_close as vix, case when cp <> 0 then cp else c.current_price end as price, case when cp <> 0 then coalesce(hi, fifty_two_week_high) else fifty_two_week_high end as high, case when cp <> 0 then coalesce(lo, fifty_two_week_low) else fifty_two_week_low end as low, case when cp <> 0 then coalesce(tp, analyst_target_price) else analyst_target_price end as target
  from fi join company c using (company_id) left join snaps using (filing_id) left join pr using (company_id, filing_type, day) left join mv using (filing_id) left join lateral (select spx_return_30d, vix_close from macro p where abs(p.day - fi.day) < 7 order by abs(p.day - fi.day), p.day limit 1) m on true)
select filing_id, sector, case when market_cap >= 200e9 then 'mega' when market_cap >= 10e9 then 'large' when market_cap >= 2e9 then 'mid' else 'small' end as tier, alpha as target, round(coalesce(case when low > 0 then price / low end, 1.3978), 8) as f_price_to_low, downs::double as f_major_downgrades, round(coalesce((nullif(target, 0) / price - 1) * 100, 13.518), 8) as f_analyst_upside,
  round(coalesce(case when high > 0 then price / high end, 0.8588), 8) as f_price_to_high, coalesce(concern, 5.345) as f_concern_level, market_cap as f_market_cap, sentiment as f_sentiment_score, ups::double as f_upgrades_30d, case filing_type when '10-K' then 0 when '10-Q' then 1 else 2 end::double as f_filing_type_factor, coalesce(sentiment - prior, 0) as f_tone_change,
  case when eps is null then 0 else greatest(-50, least(50, eps)) end as f_eps_surprise, coalesce(spx, 0) as f_spx_trend_30d, coalesce(vix, 20) as f_vix_level from x where coalesce(price, 0) > 0"""


@query("M10_training_set", M10)
def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = B.filings(spark, sf_dir), F.col("filing_id")
    filings = rows.where("filing_id % 7 <> 0").select("filing_id", "company_id", "filing_type", "day", "sentiment", F.when(k % 5 != 0, F.col("concern")).alias("concern"), F.when(k % 4 != 0, F.col("predicted") * 10).alias("eps_surprise"), (F.col("actual") / 2).alias("actual_30d_alpha"))
    shots = rows.where("filing_id % 2 = 0").select("filing_id", F.col("day").alias("snapshot_day"), F.when(k % 4 != 0, F.col("value") / 1e3).alias("current_price"), F.when(k % 8 != 1, F.col("value") / 5e2).alias("fifty_two_week_high"), (F.col("value") / 2e3).alias("fifty_two_week_low"), F.lit(None).cast("double").alias("analyst_target_price"))
    moves = rows.select("company_id", (F.col("day") + k % 61 - 30).cast("int").alias("day"), F.element_at(F.array(F.lit("upgrade"), F.lit("downgrade"), F.lit("reiterated")), (k % 3 + 1).cast("int")).alias("change"), (k % 2 == 0).alias("major"))
    out = products.training_set(filings, B.companies(spark, sf_dir), shots, moves, macro(spark, sf_dir))
    exact = {"f_price_to_low", "f_analyst_upside", "f_price_to_high"}
    return out.select(*[F.round(c, 8).alias(c) if c in exact else c for c in out.columns])


WEIGHED = " + ".join(f"(f_{name} - {mean!r}::double) / {sd!r}::double * {w!r}::double" for name, (mean, sd, w) in scoring.GLOBAL.items())
X5 = M10.replace("\nselect filing_id, sector, case", ", training as (select filing_id, sector, case") + f"""),
scored as (select filing_id, target, floor(({WEIGHED}) * 10000 + 0.5) / 10000 as raw from training),
r as (
  select s.*, case when raw > 0.0288::double or raw < -0.029::double then 1 else 0 end as sure, filing_type, date_diff('day', cast(filing_date as date), date '2001-08-02') as age, filing_id % 2 = 0 and filing_id % 4 <> 0 as snap
  from scored s join filing using (filing_id)
),
slices as (select *, unnest(['all', filing_type, case when age <= 365 then 'last 12 months' when age <= 730 then '12 to 24 months' else 'older' end, case when snap then 'snapshot' else 'current' end]) as slice from r)
select slice, count(*) as n, round(coalesce(avg((sign(raw) = sign(target))::int) filter (raw <> 0), 0) * 100, 6) as direction, round(coalesce(avg((sign(raw) = sign(target))::int) filter (raw <> 0 and sure >= 0.8), 0) * 100, 6) as sure_direction,
  round(coalesce(avg(target) filter (raw > 0), 0), 6) as long, round(coalesce(avg(target) filter (raw < 0), 0), 6) as short, round(coalesce(avg(target) filter (raw > 0), 0) - coalesce(avg(target) filter (raw < 0), 0), 6) as spread
from slices group by 1"""


@query("X5_alpha_backtest", X5)
def alpha_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set scored and held against what came of it: overall, by form, by age in steps of 12 months, and with or without a snapshot's prices."""
    made = scoring.score(training(spark, sf_dir), scoring.global_expert(spark)).select("filing_id", "target", "raw_score", F.when(F.col("confidence_label") == "high", 1.0).otherwise(0.0).alias("sure"))
    k, age = F.col("filing_id"), F.date_diff(F.lit("2001-08-02").cast("date"), F.col("filing_date").cast("date"))
    aged = F.when(age <= 365, "last 12 months").when(age <= 730, "12 to 24 months").otherwise("older")
    slices = F.array(F.lit("all"), "filing_type", aged, F.when((k % 2 == 0) & (k % 4 != 0), "snapshot").otherwise("current"))
    met = made.join(B.filings(spark, sf_dir).select("filing_id", "filing_type", "filing_date"), "filing_id").withColumn("slice", F.explode(slices))
    return rounded(met.groupBy("slice").agg(F.count("*").alias("n"), *aggregates.alpha_statistics(F.col("raw_score"), F.col("target"), F.col("sure"))))
