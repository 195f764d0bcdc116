"""Registered upkeep: look-ups with other limits, universes, backfills, explicit signals, watch lists and alerts, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.functions.text import is_weekday
from finlark.operators import merge
from finlark.operators.asof import asof_join, interval_aggregate
from finlark.operators.windows import every_nth
from finlark.operators.words import matches
from finlark.plans import bindings as B
from finlark.plans import portfolio
from finlark.plans.queries_aggregate import rounded
from finlark.plans.queries_model import dealt
from finlark.plans.queries_series import SIDE, sides
from finlark.sources import commits
from finlark.streaming.ingest import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = B.WITH + sql
        return run

    return register


def nearest(name: str, days: int, strict: bool) -> None:
    sign = "<" if strict else "<="

    @query(name, SIDE + f"select f.filing_id, p.day as day_right, round(p.close, 6) as close_right from f left join lateral (select day, close from price p where p.ticker = f.ticker and abs(p.day - f.day) {sign} {days} order by abs(p.day - f.day), day limit 1) p on true")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = sides(spark, sf_dir)
        return asof_join(left, right, by=["ticker"], on="day", take=["close"], direction="nearest", tolerance=days, strict_tolerance=strict).select("filing_id", "day_right", F.round("close_right", 6).alias("close_right"))


nearest("V10_nearest_under_90", 90, True)
nearest("V10_nearest_within_45", 45, False)


@query("V9_activity_30_days", ", a as (select company_id, coalesce(case when event_id % 5 <> 0 then hour end, hour - 1) as hour, ['upgrade', 'downgrade', 'reiterated'][event_id % 3 + 1] as change, event_id % 2 = 0 as major from activity), e as (select event_id, company_id, hour from activity where action = 'click') select e.event_id, count(*) filter (change = 'upgrade') as upgrades, count(*) filter (change = 'downgrade') as downgrades, count(*) filter (change = 'upgrade' and major) as major_upgrades, count(*) filter (change = 'downgrade' and major) as major_downgrades from e left join a on a.company_id = e.company_id and a.hour >= e.hour - 72 and a.hour < e.hour group by 1")
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating changes in a window before an event; where a record lacks its own date, the one it was fetched at counts."""
    rows, k = B.activity(spark, sf_dir), F.col("event_id")
    change = F.element_at(F.array(F.lit("upgrade"), F.lit("downgrade"), F.lit("reiterated")), (k % 3 + 1).cast("int"))
    side = rows.select("company_id", F.coalesce(F.when(k % 5 != 0, F.col("hour")), F.col("hour") - 1).alias("hour"), change.alias("change"), (k % 2 == 0).alias("major"))
    c, m = F.col("change_right"), F.col("major_right")
    count = lambda x, name: F.count_if(x).alias(name)
    made = interval_aggregate(
        rows.where("action = 'click'").select("event_id", "company_id", "hour"), side, key="event_id", by=["company_id"], on="hour", low=-72, high=0, closed_high=False, bin_width=72,
        aggregates=lambda: [count(c == "upgrade", "upgrades"), count(c == "downgrade", "downgrades"), count((c == "upgrade") & m, "major_upgrades"), count((c == "downgrade") & m, "major_downgrades")],
    )
    return made.select("event_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("upgrades", "downgrades", "major_upgrades", "major_downgrades")])


TIERS = "case when market_cap >= 80e9 then 'mega' when market_cap >= 60e9 then 'large' when market_cap >= 40e9 then 'upper mid' when market_cap >= 20e9 then 'mid' else 'small' end"


@query("V22_universe_with_mid_caps", f", t as (select *, {TIERS} as tier from company where market_cap > 0), r as (select *, row_number() over (partition by tier order by market_cap desc, company_id) - 1 as i, count(*) over (partition by tier) as n from t) select company_id, tier from r where i % greatest(1, n // 20) = 0 and i // greatest(1, n // 20) < 20")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.companies(spark, sf_dir).where("market_cap > 0").withColumn("tier", F.expr(TIERS))
    return every_nth(rows, bucket="tier", order=[F.col("market_cap").desc(), F.col("company_id")], target=20).select("company_id", "tier")


@query("V24_backfilled_range", "select filing_id, case when filing_date >= date '1996-03-01' and filing_date < date '1996-09-01' and isodow(filing_date) < 6 then 'backfill' else 'stored' end as source from filing where filing_id % 3 <> 0 or (filing_date >= date '1996-03-01' and filing_date < date '1996-09-01' and isodow(filing_date) < 6)")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of the weekdays of a range, put over a table that lacks a third of all."""
    from finlark.sources.filings import index_days

    rows = B.filings(spark, sf_dir)
    days = index_days(spark, "1996-03-01", "1996-08-31").select(F.unix_date("day").alias("day"))
    fetched = rows.join(days, "day", "left_semi").select("filing_id", F.lit("backfill").alias("source"))
    return merge.upsert(rows.where("filing_id % 3 <> 0").select("filing_id", F.lit("stored").alias("source")), fetched, ["filing_id"])


@query("V26_explicit_signals", """, s as (select filing_id, company_id, predicted, confidence, case when predicted >= 2 then 'LONG' when predicted <= -2 then 'SHORT' else 'NEUTRAL' end as signal from filing), open as (select distinct company_id from filing where status = 'O' and filing_id % 5 = 0)
select filing_id, signal, round(least(confidence * abs(predicted) / 100, 0.1) * 100000, 6) as worth from s where confidence >= 0.6 and abs(predicted) >= 0.5 and signal <> 'NEUTRAL' and company_id not in (select company_id from open)""")
def explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal that is given, gated as any other, with what it may spend."""
    from finlark.functions.math import position_value

    rows, p = B.filings(spark, sf_dir), F.col("predicted")
    given = rows.select("filing_id", F.lit(1).alias("portfolio_id"), F.col("company_id").alias("ticker"), "confidence", "predicted", F.when(p >= 2, "LONG").when(p <= -2, "SHORT").otherwise("NEUTRAL").alias("signal"))
    held = rows.where("status = 'O' and filing_id % 5 = 0").select(F.lit(1).alias("portfolio_id"), F.col("company_id").alias("ticker"), F.lit("OPEN").alias("status")).distinct()
    owner = spark.createDataFrame([(1, True, 0.6)], "portfolio_id int, is_active boolean, min_confidence double")
    return portfolio.gate(given, owner, held).select("filing_id", "signal", F.round(position_value(F.col("confidence"), p, F.lit(0.1)) * 100_000, 6).alias("worth"))


@query("V29_watch_lists", """, base as (select company_id % 7 as user_id, ticker, 'old' as note from company where company_id % 2 = 0), added as (select company_id % 7 as user_id, ticker, 'new' as note from company where company_id % 5 = 0 and sector in ('MACHINERY', 'BUILDING', 'FURNITURE')), gone as (select company_id % 7 as user_id, ticker from company where company_id % 11 = 0)
select user_id, ticker, note from (select * from added union all select * from base where (user_id, ticker) not in (select (user_id, ticker) from added)) where (user_id, ticker) not in (select (user_id, ticker) from gone)""")
def watch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of users put in or replaced if their sector is a known one, then some taken out."""
    rows = B.companies(spark, sf_dir).withColumn("user_id", F.col("company_id") % 7)
    entries = lambda where, note: rows.where(where).select("user_id", "ticker", F.lit(note).alias("note"))
    put = merge.upsert(entries("company_id % 2 = 0", "old"), entries("company_id % 5 = 0 and sector in ('MACHINERY', 'BUILDING', 'FURNITURE')", "new"), ["user_id", "ticker"])
    return merge.delete_matching(put, rows.where("company_id % 11 = 0").select("user_id", "ticker"), ["user_id", "ticker"])


@query("V30_all_or_nothing", "select company_id, case when company_id % 2 = 0 and (select count(*) from company where company_id % 2 = 0 and current_price is null and company_id % 6 = 1) = 0 then market_cap + 1 else market_cap end as market_cap from company")
def all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of updates that counts only if none of them is invalid."""
    rows = B.companies(spark, sf_dir)
    delta = rows.where("company_id % 2 = 0").select("company_id", (F.col("market_cap") + 1).alias("market_cap"), (F.col("current_price").isNotNull() | (F.col("company_id") % 6 != 1)).alias("valid"))
    return merge.upsert_whole(rows.select("company_id", "market_cap"), delta, ["company_id"], F.col("valid"))


@query("V30_S28_committed_together", "select 'company' as held, company_id as id, market_cap + case when company_id % 2 = 0 then 1 else 0 end as worth from company union all select 'filing', filing_id, value * case when filing_id % 3 = 0 then 2 else 1 end from filing where company_id % 11 <> 0 or filing_id % 3 = 0")
def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables updated, deleted from and inserted into by one commit; a later commit that fails half-way, and one from an old version, change nothing."""
    held = commits.Tables(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}")
    companies, rows = B.companies(spark, sf_dir).select("company_id", "market_cap"), B.filings(spark, sf_dir).select("filing_id", "company_id", "value")
    first = held.commit({"company": companies, "filing": rows.where("filing_id % 3 <> 0")})
    richer = merge.update_where(held.read("company"), F.col("company_id") % 2 == 0, {"market_cap": F.col("market_cap") + 1})
    kept = held.read("filing").where("company_id % 11 <> 0")
    second = held.commit({"company": richer, "filing": kept.unionByName(rows.where("filing_id % 3 = 0").withColumn("value", F.col("value") * 2))})
    worse = held.read("company").withColumn("market_cap", F.lit(0.0))
    for changes, base in (({"company": worse, "filing": held.read("filing").withColumn("value", F.raise_error(F.lit("half-way")).cast("double"))}, second), ({"company": worse}, first)):
        try:
            held.commit(changes, base=base)
        except (commits.Conflict, SparkRuntimeException):
            pass
    return held.read("company").select(F.lit("company").alias("held"), F.col("company_id").alias("id"), F.col("market_cap").alias("worth")).unionByName(held.read("filing").select(F.lit("filing").alias("held"), F.col("filing_id").alias("id"), F.col("value").alias("worth")))


@query("P7_P17_words_in_names", ", w as (select distinct substr(p_name, 2, 4) as word from part union select split_part(p_name, ' ', 2) from part union select 'no such word'), n as (select distinct p_name as name from part) select word, name from w join n on contains(name, word)")
def words_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the parts' names, and the names that hold them, by the index of grams."""
    names = B.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    words = names.select(F.explode(F.array(F.substring("name", 2, 4), F.split_part("name", F.lit(" "), F.lit(2)), F.lit("no such word"))).alias("word"))
    return matches(words, "word", names, "name")


@query("F24_weekdays", "select filing_id, isodow(filing_date) < 6 as weekday from filing")
def weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).select("filing_id", is_weekday(F.col("filing_date")).alias("weekday"))


@query("F7_discussion_text", "select filing_id, 'Sales & costs rose. ' || repeat('More of it came. ', 20) || 'End' as text from filing where filing_id % 3 <> 0 union all select filing_id, null from filing where filing_id % 3 = 0")
def discussion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.functions.text import discussion_text

    k = F.col("filing_id")
    head = F.when(k % 3 == 1, "<b>Item 7. Management's Discussion and Analysis of Financial Condition</b>").when(k % 3 == 2, "MANAGEMENT&#8217;S DISCUSSION AND ANALYSIS").otherwise("Nothing of the kind")
    page = F.concat(F.lit("<html><p>Item 1. Business</p>"), head, F.lit("<div>Sales &amp; costs rose. "), F.repeat(F.lit("More of it came. "), 20), F.lit("End</div><p>Item 8. Financial Statements</p></html>"))
    return B.filings(spark, sf_dir).select("filing_id", discussion_text(page).alias("text"))


@query("T11s_paper")
def paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper back-test: sure and large forecasts of annual and quarterly filings, in at the next close, out at the first from 7 days later; by portfolio."""
    left, right = sides(spark, sf_dir, "filing_type in ('10-K', '10-Q') and confidence >= 0.6 and abs(predicted) >= 2", ("company_id", "predicted", "confidence"))
    trades = portfolio.run(dealt(portfolio.positions(left, right, 7, inclusive=False)))
    worst = portfolio.equity(trades).groupBy("portfolio_id").agg(F.max("drawdown").alias("max_drawdown"))
    return rounded(portfolio.statistics(trades).join(worst, "portfolio_id").join(portfolio.sharpe(trades, "portfolio_id", "pnl_pct"), "portfolio_id"))


@query("T11s_by_age", "select case when months <= 12 then 'last 12' when months <= 24 then '13 to 24' else 'older' end as age, filing_type, count(*) as n, round(avg(cast(sign(predicted) = sign(actual) as double)) * 100, 6) as direction, round(avg(case when predicted > 0 then actual end) - avg(case when predicted < 0 then actual end), 6) as spread, round(avg(case when predicted > 0 then actual else -actual end) / nullif(stddev_samp(case when predicted > 0 then actual else -actual end), 0) * sqrt(12), 6) as sharpe from (select *, (2001 - year(filing_date)) * 12 + 8 - month(filing_date) as months from filing where predicted <> 0) group by 1, 2")
def by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second back-test's breakdown: by age in steps of 12 months and by form; a year's Sharpe from monthly-like trades (sample deviation)."""
    months = (2001 - F.year("filing_date")) * 12 + 8 - F.month("filing_date")
    p, a = F.col("predicted"), F.col("actual")
    gain = F.when(p > 0, a).otherwise(-a)
    rows = B.filings(spark, sf_dir).where("predicted <> 0").withColumn("age", F.when(months <= 12, "last 12").when(months <= 24, "13 to 24").otherwise("older"))
    return rounded(rows.groupBy("age", "filing_type").agg(F.count("*").alias("n"), (F.avg((F.signum(p) == F.signum(a)).cast("double")) * 100).alias("direction"), (F.avg(F.when(p > 0, a)) - F.avg(F.when(p < 0, a))).alias("spread"), (F.avg(gain) / F.nullif(F.stddev_samp(gain), F.lit(0.0)) * 12**0.5).alias("sharpe")))
