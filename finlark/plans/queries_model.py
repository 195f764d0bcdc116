"""Registered scoring (M), portfolio and incremental operators (T), and products (X), with SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.operators.asof import asof_join, interval_aggregate
from finlark.operators.windows import every_nth
from finlark.plans import bindings as B
from finlark.plans import learning, portfolio, rules, scoring
from finlark.plans.queries_aggregate import rounded
from finlark.plans.queries_series import SIDE, sides
from finlark.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = B.WITH + sql
        return run

    return register


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with what the scorer needs: company, prior tone, market trend and level, analyst counts."""
    rows = scoring.tone_change(B.filings(spark, sf_dir)).join(B.companies(spark, sf_dir).drop("name", "nation"), "company_id")
    return rows.withColumns({"spx_return_30d": F.col("value") / 1e5, "vix_close": F.when(F.col("filing_id") % 3 != 0, 12 + F.col("filing_id") % 16).cast("double"), "upgrades": (F.col("filing_id") % 3).cast("int"), "downgrades": (F.col("filing_id") % 2).cast("int"), "eps_surprise_raw": F.col("predicted") * 10, "market_cap": F.col("market_cap") * 10})


FEATURE_SQL = ", x as (select filing_id, sector, case when nullif(current_price, 0) is null or fifty_two_week_low = 0 then 1.3638 else current_price / fifty_two_week_low end as price_to_low, case when nullif(current_price, 0) is null or fifty_two_week_high = 0 then 0.8381 else current_price / fifty_two_week_high end as price_to_high, case when nullif(current_price, 0) is null or coalesce(analyst_target_price, 0) = 0 then 29.5690 else (analyst_target_price / current_price - 1) * 100 end as upside, concern, case when market_cap = 0 then 9.8179e10 else market_cap * 10 end as cap, sentiment, coalesce(sentiment - lag(sentiment) over (partition by company_id, filing_type order by filing_date, filing_id), -0.0113) as tone, value / 1e5 as spx, case when filing_id % 3 <> 0 then 12.0 + filing_id % 16 else 20.0 end as vix, filing_id % 3 as up, filing_id % 2 as down, greatest(-50, least(50, predicted * 10)) as eps, case filing_type when '10-K' then 0 when '10-Q' then 1 else 2 end::double as form from filing join company using (company_id)) "


M1 = "select filing_id, round(price_to_low, 9) as f_price_to_low, down::double as f_major_downgrades, round(upside, 9) as f_analyst_upside, round(price_to_high, 9) as f_price_to_high, concern as f_concern_level, cap as f_market_cap, sentiment as f_sentiment_score, up::double as f_upgrades_30d, form as f_filing_type_factor, round(tone, 9) as f_tone_change, eps as f_eps_surprise, round(spx, 9) as f_spx_trend_30d, vix as f_vix_level from x"


@query("M1_features", FEATURE_SQL + M1)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.features(inputs(spark, sf_dir))
    return rounded(made.select("filing_id", *[f"f_{c}" for c in scoring.FEATURES]), 9)


M2 = """, y as (select filing_id, floor((
    (price_to_low - 1.3638::double) / 0.3776::double * -0.0032::double + (down - 0.0409::double) / 0.2162::double * -0.0007::double + (upside - 29.5690::double) / 55.1452::double * 0.0239::double + (price_to_high - 0.8381::double) / 0.1401::double * -0.0002::double
    + (concern - 5.3333::double) / 0.8027::double * 0.0050::double + (cap - 9.8179e10::double) / 3.4064e11::double * 0.0001::double + (sentiment - 0.1095::double) / 0.1893::double * 0.0007::double + (up - 0.1130::double) / 0.3751::double * -0.0021::double
    + (form - 0.7378::double) / 0.4399::double * -0.0058::double + (tone - -0.0113::double) / 0.2243::double * -0.0011::double + (eps - 3.8894::double) / 14.2667::double * 0.0104::double + (spx - 1.8286::double) / 3.4503::double * 0.0100::double + (vix - 18.1503::double) / 4.4550::double * 0.0058::double
  ) * 10000 + 0.5) / 10000 as raw_score from x)
select filing_id, raw_score, case when raw_score > 0.0114::double then 'LONG' when raw_score < -0.0158::double then 'SHORT' else 'NEUTRAL' end as signal, case when raw_score > 0.0288::double or raw_score < -0.029::double then 'high' when raw_score > 0.0114::double or raw_score < -0.0158::double then 'medium' else 'low' end as confidence_label, floor((raw_score + 0.8) * 100 + 0.5) / 100 as predicted_30d from y"""


@query("M2_alpha_signal", FEATURE_SQL + M2)
def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(scoring.features(inputs(spark, sf_dir)), scoring.global_expert(spark)).select("filing_id", "raw_score", "signal", "confidence_label", "predicted_30d")


@query("M9_experts")
def experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.train_experts(scoring.features(inputs(spark, sf_dir)), "actual")


@query("M9_M2_routed_signals")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.features(inputs(spark, sf_dir))
    return scoring.score(made, scoring.train_experts(made, "actual")).select("filing_id", "expert", "raw_score", "signal", "confidence_label", "predicted_30d")


@query("M6_ridge_by_type", "select filing_type, count(*) as n, round((syy_c - sxy_c) / det, 6) as b1, round((sx2c) / det, 6) as b2 from (select filing_type, (sum(predicted * actual)) * (sum(sentiment * sentiment) + 100) as syy_c, sum(sentiment * actual) * sum(predicted * sentiment) as sxy_c, sum(sentiment * actual) * (sum(predicted * predicted) + 100) - sum(predicted * actual) * sum(predicted * sentiment) as sx2c, (sum(predicted * predicted) + 100) * (sum(sentiment * sentiment) + 100) - sum(predicted * sentiment) * sum(predicted * sentiment) as det from filing group by 1) join filing using (filing_type) group by all")
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.ridge_by(B.filings(spark, sf_dir), ["predicted", "sentiment"], "actual", ["filing_type"])
    return made.select("filing_type", "n", F.round(F.col("beta")[0], 6).alias("b1"), F.round(F.col("beta")[1], 6).alias("b2"))


@query("M7_standardised", "select filing_id, round((sentiment - avg(sentiment) over (partition by filing_type)) / stddev_samp(sentiment) over (partition by filing_type), 6) as z from filing")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.standardised(B.filings(spark, sf_dir), ["sentiment"], ["filing_type"]).select("filing_id", F.round("z_sentiment", 6).alias("z"))


@query("M8_walk_forward", ", e as (select quantile_cont(day, [1/6.0, 2/6.0, 3/6.0, 4/6.0, 5/6.0]) as q from filing), d as (select *, (select len(list_filter(q, lambda x: x < day)) from e) as fold from filing), k as (select unnest(range(1, 6)) as fold), b as (select k.fold, count(*) as n_train, sum(predicted * actual) / (sum(predicted * predicted) + 100) as beta from k join d on d.fold < k.fold group by 1) select b.fold, any_value(n_train) as n_train, count(*) as n_test, round(avg(cast(sign(predicted * beta) = sign(actual) as double)), 6) as direction, round(avg(abs(predicted * beta - actual)), 6) as mae from b join d on d.fold = b.fold group by 1")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.walk_forward(B.filings(spark, sf_dir), ["predicted"], "actual", order="day"))


@query("F54_recommendation", "select filing_id, case when confidence >= 0.65 then 'BUY FULL' when confidence >= 0.55 then 'BUY HALF' when confidence <= 0.35 then 'SHORT HALF' else 'HOLD SMALL' end as call from filing")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).select("filing_id", learning.baseline_recommendation(F.col("confidence")).alias("call"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of portfolios 0 to 19: entry at the first price from the filing's day on, exit at the first from 30 days later."""
    left, right = sides(spark, sf_dir, "abs(predicted) >= 0.5 and confidence >= 0.4", ("company_id", "predicted", "confidence"))
    return dealt(portfolio.positions(left, right, 30))


def dealt(met: DataFrame) -> DataFrame:
    """Positions of filings as signals of portfolios 0 to 19."""
    return met.select((F.col("company_id") % 20).alias("portfolio_id"), F.col("filing_id").alias("trade_id"), "ticker", F.when(F.col("predicted") > 0, "LONG").otherwise("SHORT").alias("direction"), F.col("entry_day").cast("int").alias("day"), F.col("exit_day").cast("int"), "entry", "exit", "confidence", "predicted")


@query("T8s_portfolio_trades")
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.run(signals(spark, sf_dir))


@query("T11s_backtest")
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = portfolio.run(signals(spark, sf_dir))
    worst = portfolio.equity(made).groupBy("portfolio_id").agg(F.max("drawdown").alias("max_drawdown"))
    return rounded(portfolio.statistics(made).join(worst, "portfolio_id").join(portfolio.sharpe(made, "portfolio_id", "pnl_pct"), "portfolio_id"))


@query("T9s_gate", "select filing_id from filing f where confidence >= 0.7 and abs(predicted) >= 0.5 and f.company_id not in (select company_id from filing where status = 'O')")
def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir)
    signal = rows.select("filing_id", F.lit(1).alias("portfolio_id"), F.col("company_id").alias("ticker"), "confidence", "predicted", F.when(F.col("predicted") > 0, "LONG").otherwise("SHORT").alias("signal"))
    held = rows.where("status = 'O'").select(F.lit(1).alias("portfolio_id"), F.col("company_id").alias("ticker"), F.lit("OPEN").alias("status"))
    owner = spark.createDataFrame([(1, True, 0.7)], "portfolio_id int, is_active boolean, min_confidence double")
    return portfolio.gate(signal, owner, held).select("filing_id")


@query("T1s_catch_up", "select cast(max(filing_date) as date) + 1 as first, date '2001-08-09' as last from filing")
def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.catch_up(B.filings(spark, sf_dir), "2001-08-10")


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("T2s_streamed_upsert", "select company_id as user_id, max(event_id) as event_id, max_by(value, event_id) as value from activity group by 1")
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = f"{ingest.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    source = ingest.landed(spark, sf_dir, EVENTS, "events.parquet").select("user_id", "event_id", "value")
    ingest.merge_into(source, f"{top}/table", ["user_id"], ["event_id"], f"{top}/state").awaitTermination()
    return ingest.current(spark, f"{top}/table").select("user_id", "event_id", "value")


@query("T3s_invalidated", "select filing_id, case when company_id not in (select company_id from filing where filing_date >= timestamp '2001-07-01') then predicted end as predicted from filing")
def invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir)
    return ingest.invalidated(rows, rows.where(F.col("filing_date") >= F.lit("2001-07-01")), ["predicted"]).select("filing_id", "predicted")


@query("T6s_alert_window", "select event_id from activity where ts >= timestamp '2024-01-20 13:00:00' - interval 14 hour and ts < timestamp '2024-01-20 13:00:00'")
def alert_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 13:00:00").cast("timestamp")
    return B.activity(spark, sf_dir).where((F.col("ts") >= now - F.expr("interval 14 hours")) & (F.col("ts") < now)).select("event_id")


@query("T7s_daily_quota", "select company_id as user_id, date_trunc('day', ts) as day, count(*) as n from activity group by 1, 2")
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = ingest.landed(spark, sf_dir, EVENTS, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.drained(ingest.daily_counts(source, "user_id", "ts"), f"quota_{uuid.uuid4().hex}")


@query("X1_dataset", SIDE + "select f.filing_id, g.company_id, filing_type, round(p.close, 6) as close, coalesce(n, 0) as prior_filings from f join filing g using (filing_id) left join lateral (select close from price p where p.ticker = f.ticker and p.day <= f.day order by day desc limit 1) p on true left join (select a.filing_id, count(*) as n from filing a join filing b on b.company_id = a.company_id and b.day >= a.day - 90 and b.day < a.day group by 1) c on c.filing_id = f.filing_id")
def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    priced = asof_join(left, right, by=["ticker"], on="day", take=["close"]).select("filing_id", F.round("close_right", 6).alias("close"))
    rows = B.filings(spark, sf_dir).select("filing_id", "company_id", "filing_type", "day")
    counted = interval_aggregate(rows, rows.select("company_id", "day"), key="filing_id", by=["company_id"], on="day", low=-90, high=0, closed_high=False, bin_width=90, aggregates=lambda: [F.count("*").alias("n")])
    return counted.join(priced, "filing_id").select("filing_id", "company_id", "filing_type", "close", F.coalesce("n", F.lit(0)).alias("prior_filings"))


@query("X3_returns", SIDE + "select f.filing_id, round((b.close - a.close) * 100 / a.close, 6) as ret_30d from f join lateral (select close from price p where p.ticker = f.ticker and abs(p.day - f.day) <= 5 order by abs(p.day - f.day), day limit 1) a on true join lateral (select close from price p where p.ticker = f.ticker and abs(p.day - f.day - 30) <= 5 order by abs(p.day - f.day - 30), day limit 1) b on true")
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    at = lambda days, name: asof_join(left.withColumn("day", F.col("day") + days), right, by=["ticker"], on="day", take=["close"], direction="nearest", tolerance=5).where("close_right is not null").select("filing_id", F.col("close_right").alias(name))
    return at(0, "a").join(at(30, "b"), "filing_id").select("filing_id", F.round((F.col("b") - F.col("a")) * 100 / F.col("a"), 6).alias("ret_30d"))


@query("X7_latest_feed", "select filing_id, filing_date, ticker, count(*) over () as total_count from filing join company using (company_id) where filing_date >= date '2001-08-02' - 180 and filing_type in ('10-K', '10-Q') order by filing_date desc, filing_id limit 50")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.plans.screener import paged

    rows = B.filings(spark, sf_dir).where((F.col("filing_date") >= F.date_sub(F.lit("2001-08-02").cast("date"), 180)) & F.col("filing_type").isin("10-K", "10-Q"))
    met = rows.join(B.companies(spark, sf_dir).select("company_id", "ticker"), "company_id")
    return paged(met, [F.col("filing_date").desc(), F.col("filing_id")], 1).select("filing_id", "filing_date", "ticker", "total_count")


@query("X10_universe", "select sector, count(*) as n, min(market_cap) as least from (select *, row_number() over (partition by sector order by market_cap desc, company_id) - 1 as i, count(*) over (partition by sector) as n from company) where i % greatest(1, n // 25) = 0 and i // greatest(1, n // 25) < 25 group by 1")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = every_nth(B.companies(spark, sf_dir), bucket="sector", order=[F.col("market_cap").desc(), F.col("company_id")], target=25)
    return picked.groupBy("sector").agg(F.count("*").alias("n"), F.min("market_cap").alias("least"))


EVIDENCE = {
    "risk_score_delta": "case when filing_id % 4 <> 0 then (filing_id % 17 - 8) / 4e0 end",
    "sentiment_score": "sentiment",
    "concern_level": "case when filing_id % 6 <> 0 then concern end",
    "eps_surprise": "case filing_id % 5 when 0 then 'beat' when 1 then 'miss' when 2 then 'inline' when 3 then 'unknown' end",
    "eps_surprise_magnitude": "cast(filing_id % 23 - 11 as double)",
    "revenue_surprise": "case filing_id % 3 when 0 then 'beat' when 1 then 'miss' end",
    "guidance_change": "case filing_id % 7 when 0 then 'raised' when 1 then 'lowered' when 2 then 'new' when 3 then 'maintained' end",
    "event_type": "case filing_id % 2 when 0 then '8-K-earnings-announcement' else '8-K-other' end",
    "pe_ratio": "case when filing_id % 8 <> 0 then cast(filing_id % 60 as double) end",
    "market_cap_b": "case when filing_id % 9 <> 0 then cast((filing_id * 13) % 1500 as double) end",
    "market_momentum": "case when filing_id % 10 <> 0 then (filing_id % 21 - 10) / 2e0 end",
    "market_regime": "case filing_id % 3 when 0 then 'bull' when 1 then 'bear' else 'flat' end",
    "flight_to_quality": "filing_id % 4 = 1",
    "dollar_strength": "case filing_id % 3 when 0 then 'weak' when 1 then 'strong' end",
    "growth_trend": "case filing_id % 4 when 0 then 'weak' when 1 then 'strong' end",
    "analyst_net_upgrades": "case when filing_id % 5 <> 0 then cast(filing_id % 9 - 4 as int) end",
    "analyst_major_upgrades": "cast(filing_id % 3 as int)",
    "analyst_major_downgrades": "cast(filing_id % 4 as int)",
    "analyst_consensus": "case when filing_id % 6 <> 0 then cast(filing_id % 101 as double) end",
    "analyst_upside": "case when filing_id % 7 <> 0 then cast(filing_id % 81 - 40 as double) end",
    "historical_return": "case when filing_id % 3 <> 0 then (filing_id % 13 - 6) / 4e0 end",
    "ticker": "case when filing_id % 11 <> 0 then 'T' end",
}
RULES_SQL = ", e as (select filing_id, filing_type, " + ", ".join(f"{x} as {k}" for k, x in EVIDENCE.items()) + """ from filing),
a as (select *, coalesce(risk_score_delta, 0) * -1.2 + coalesce(sentiment_score, 0) * case when sentiment_score > 0 and coalesce(concern_level, 5) >= 7 then -1.0 when sentiment_score > 0 and coalesce(concern_level, 5) >= 5 then 1.0 else 2.0 end
  + (coalesce(concern_level, 5) - 5) * -0.9
  + (case eps_surprise when 'beat' then 1.0 + case when eps_surprise_magnitude > 5 then 0.8 else 0 end when 'miss' then -1.0 - case when eps_surprise_magnitude < -5 then 0.7 else 0 end when 'inline' then 0.6 else 0 end)
    * 1.0 * case when pe_ratio is null or pe_ratio <= 0 then 1.0 when pe_ratio < 15 then 0.8 when pe_ratio < 25 then 1.0 when pe_ratio < 40 then 1.2 else 1.5 end
    * case when market_cap_b is null or market_cap_b <= 0 then 1.0 when market_cap_b < 2 then 0.9 when market_cap_b < 10 then 1.0 when market_cap_b < 50 then 1.1 when market_cap_b < 200 then 1.2 else 1.3 end
  + case revenue_surprise when 'beat' then 0.8 when 'miss' then -1.5 else 0 end + case guidance_change when 'raised' then 3.5 when 'lowered' then -4.0 when 'new' then 1.0 else 0 end
  + case filing_type when '10-K' then 0.5 when '10-Q' then 0.3 else case event_type when '8-K-earnings-announcement' then 0.1 else -0.5 end end as t from e),
b as (select *, t + case when market_momentum is null then 0 else market_momentum * case market_regime when 'bull' then 0.2 when 'bear' then 0.18 else 0.1 end
  + t * case when market_regime = 'bull' and t < 0 then 0.7 when market_regime = 'bull' then 0.15 when market_regime = 'bear' and t < 0 then 0.2 when market_regime = 'bear' then -0.5 else 0 end
  + case when flight_to_quality and market_cap_b > 200 then 1.5 when flight_to_quality and market_cap_b > 0 and market_cap_b < 10 then -2 when flight_to_quality and market_cap_b > 0 and market_cap_b < 50 then -1 else 0 end end
  + case when coalesce(market_cap_b, 0) = 0 then 0 when market_cap_b < 200 then -0.5 when market_cap_b < 500 then case when market_regime = 'bull' then 1.5 else 1.0 end when market_cap_b < 1000 then 0.3 else 0.5 end as u from a),
d as (select *, case when market_cap_b > 1000 and u < 0 then greatest(u, case market_regime when 'bull' then -1.5 when 'bear' then -7.0 else -5.0 end) else u end
  + case dollar_strength when 'weak' then 1.0 when 'strong' then -0.6 else 0 end + case growth_trend when 'strong' then 0.7 when 'weak' then -0.5 else 0 end
  + case when coalesce(analyst_net_upgrades, 0) <> 0 then greatest(-2.0, least(2.0, analyst_net_upgrades * 0.3 + (analyst_major_upgrades - analyst_major_downgrades) * 0.5)) else 0 end
  + case when analyst_consensus > 80 then 0.8 when analyst_consensus < 40 then -0.5 else 0 end + case when abs(analyst_upside) > 10 then greatest(-1.0, least(1.0, analyst_upside * 0.05)) else 0 end
  + coalesce(historical_return, 0) * case when ticker is not null then 0.4 else 0.2 end as v from b)
select filing_id, round(greatest(-10, least(10, v * 0.5)), 10) as predicted_7d, round(least(0.95, 0.4 + case when eps_surprise <> 'unknown' then 0.2 else 0 end + case when guidance_change <> 'maintained' then 0.2 else 0 end + case when risk_score_delta is not null then 0.1 else 0 end + 0.1
  + case when concern_level <> 5 then 0.1 else 0 end + case when ticker is not null and historical_return is not null then 0.15 else 0 end + case when analyst_net_upgrades is not null or analyst_consensus is not null then 0.1 else 0 end), 10) as certainty from d"""


@query("M3_rule_forecast", RULES_SQL)
def rule_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).select("filing_id", "filing_type", *[F.expr(x).alias(k) for k, x in EVIDENCE.items()])
    return rounded(rules.forecast(rows).select("filing_id", "predicted_7d", "certainty"), 10)
