"""Registered variants (V), remaining joins, macro products and helpers, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finlark.functions import math as M
from finlark.operators.asof import asof_join, interval_join
from finlark.operators.windows import last_rows, series
from finlark.plans import bindings as B
from finlark.plans import challenger
from finlark.plans import market_state as S
from finlark.plans.queries_aggregate import rounded
from finlark.plans.queries_series import FRAME, SIDE, sides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = run, B.WITH + sql
        return run

    return register


@query("S2_S3_lookups", "select (select name from company where ticker = 'T5') as name, (select filing_id from filing where company_id = 5 order by filing_date desc, filing_id limit 1) as filing_id")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = B.companies(spark, sf_dir).where("ticker = 'T5'").limit(1).agg(F.first("name").alias("name"))
    last = B.filings(spark, sf_dir).where("company_id = 5").agg(F.max_by("filing_id", F.struct("day", -F.col("filing_id"))).alias("filing_id"))
    return name.join(last, F.lit(True))


@query("S4_projection", "select company_id, ticker, name, market_cap, current_price, pe_ratio, dividend_yield, beta, fifty_two_week_high, fifty_two_week_low, analyst_target_price from company")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.companies(spark, sf_dir).select("company_id", "ticker", "name", "market_cap", "current_price", "pe_ratio", "dividend_yield", "beta", "fifty_two_week_high", "fifty_two_week_low", "analyst_target_price")


@query("S23_metadata", "select count(*) as rows, min(filing_date) as first, max(filing_date) as last, count(*) filter (concern <= 2) as low, count(*) filter (concern > 8) as critical from filing")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.sources.market import describe

    return describe(B.filings(spark, sf_dir), "filing_date", {"low": "concern <= 2", "critical": "concern > 8"}).select("rows", "first", "last", "buckets.*")


@query("S28_append", "select filing_id from filing where filing_id % 2 = 0 union all select filing_id + 1000000 from filing where filing_id % 7 = 0")
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = B.filings(spark, sf_dir).select("filing_id")
    return ids.where("filing_id % 2 = 0").unionByName(ids.where("filing_id % 7 = 0").select((F.col("filing_id") + 1_000_000).alias("filing_id")))


@query("J11_nearest_period", SIDE + "select f.filing_id, p.day as day_right from f left join lateral (select day from price p where p.ticker = f.ticker and abs(p.day - f.day) < 90 order by abs(p.day - f.day), day limit 1) p on true")
def nearest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return asof_join(left, right, by=["ticker"], on="day", take=["close"], direction="nearest", tolerance=90, strict_tolerance=True).select("filing_id", "day_right")


@query("J15_interval_counts_closed", "select c.filing_id, count(a.filing_id) filter (a.predicted > 2) as up, count(a.filing_id) filter (a.predicted < -2) as down, count(a.filing_id) filter (a.predicted > 2) - count(a.filing_id) filter (a.predicted < -2) as net from filing c left join filing a on a.company_id = c.company_id and a.day between c.day - 180 and c.day group by 1")
def interval_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.operators.asof import interval_aggregate

    rows = B.filings(spark, sf_dir).select("filing_id", "company_id", "day", "predicted")
    up, down = F.count_if(F.col("predicted_right") > 2), F.count_if(F.col("predicted_right") < -2)
    return interval_aggregate(rows.drop("predicted"), rows.drop("filing_id"), key="filing_id", by=["company_id"], on="day", low=-180, high=0, bin_width=180, aggregates=lambda: [up.alias("up"), down.alias("down"), (up - down).alias("net")]).select("filing_id", "up", "down", "net")


@query("J20_J21_lookup_joins", "select filing_id, coalesce(c.ticker, 'none') as ticker, coalesce(x.n, 0) as same_day from filing f left join company c on c.company_id = f.company_id and c.sector <> 'BUILDING' left join (select company_id, day, count(*) as n from filing where filing_type = '8-K' group by 1, 2) x on x.company_id = f.company_id and x.day = f.day")
def lookup_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir)
    owners = B.companies(spark, sf_dir).where("sector <> 'BUILDING'").select("company_id", "ticker")
    events = rows.where("filing_type = '8-K'").groupBy("company_id", "day").agg(F.count("*").alias("n"))
    return rows.join(owners, "company_id", "left").join(events, ["company_id", "day"], "left").select("filing_id", F.coalesce("ticker", F.lit("none")).alias("ticker"), F.coalesce("n", F.lit(0)).alias("same_day"))


@query("J22_watchlist", ", w as (select o_custkey % 40 as user_id, o_custkey + 700 as company_id from orders group by all) select user_id, w.company_id, c.ticker, c.market_cap from w left join company c on c.company_id = w.company_id")
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = B.filings(spark, sf_dir).select((F.col("company_id") % 40).alias("user_id"), (F.col("company_id") + 700).alias("company_id")).distinct()
    return listed.join(B.companies(spark, sf_dir).select("company_id", "ticker", "market_cap"), "company_id", "left").select("user_id", "company_id", "ticker", "market_cap")


@query("A11_rounded_summary", "select status, round(avg(cast(sign(p) = sign(a) as double)) * 100, 1) as direction, round(avg(p), 6) as mean_predicted from (select status, floor(predicted * 100 + 0.5) / 100 as p, floor(actual * 100 + 0.5) / 100 as a from filing) group by 1")
def rounded_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).select("status", M.half_up(F.col("predicted"), 2).alias("p"), M.half_up(F.col("actual"), 2).alias("a"))
    return rows.groupBy("status").agg(F.round(F.avg((F.signum("p") == F.signum("a")).cast("double")) * 100, 1).alias("direction"), F.round(F.avg("p"), 6).alias("mean_predicted"))


@query("A29_extremes", "select filing_type, max_by(filing_id, (actual, -filing_id)) as best, min_by(filing_id, (actual, filing_id)) as worst from filing group by 1")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, worst = F.max_by("filing_id", F.struct("actual", -F.col("filing_id"))), F.min_by("filing_id", F.struct("actual", "filing_id"))
    return B.filings(spark, sf_dir).groupBy("filing_type").agg(best.alias("best"), worst.alias("worst"))


@query("W10_horizon_returns", ", s as (select * from price) select s.ticker, s.day, round((s.close - p.close) * 100 / p.close, 6) as return_14, round((s.close - q.close) * 100 / q.close, 6) as return_30 from s left join lateral (select close from s x where x.ticker = s.ticker order by abs(x.day - s.day + 14), x.day desc limit 1) p on true left join lateral (select close from s x where x.ticker = s.ticker order by abs(x.day - s.day + 30), x.day desc limit 1) q on true")
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.prices(spark, sf_dir).select("ticker", "day", "close")
    return rounded(S.horizon_returns(rows, [14, 30]).select("ticker", "day", "return_14", "return_30"))


@query("W11_level_mean", FRAME + "select ticker, date, round(case when count(*) over r >= 20 then avg(coalesce(case when day % 7 <> 0 then close end, 0)) over r end, 4) as level from s window r as (partition by ticker order by date rows 29 preceding)")
def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.prices(spark, sf_dir).withColumn("close", F.when(F.col("day") % 7 != 0, F.col("close")))
    return rows.select("ticker", "date", F.round(S.level_mean(rows), 4).alias("level"))


@query("W12_regime", FRAME + ", t as (select *, (close - lag(close, 29) over w) * 100 / lag(close, 29) over w as m, (close - before) / before as r from s window w as (partition by ticker order by date)) select ticker, date, case when m > 5 then 'bull' when m < -2 then 'bear' when m is not null then 'flat' end as regime, case when count(r) over r30 = 30 then stddev_samp(r) over r30 * sqrt(252) * 100 end > 20 as flight_to_quality from t window r30 as (partition by ticker order by date rows 29 preceding)")
def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regime(B.prices(spark, sf_dir)).select("ticker", "date", "regime", "flight_to_quality")


@query("V4_regime_score", "select filing_id, case when p >= 3 then 'strong_bull' when p >= 1 then 'bull' when p <= -3 then 'strong_bear' when p <= -1 then 'bear' else 'neutral' end as regime from (select filing_id, case when predicted > 5 then 2 when predicted > 0 then 1 when predicted < -5 then -2 when predicted < 0 then -1 else 0 end + case when concern * 4 < 15 then 1 when concern * 4 > 25 then -1 else 0 end + case status when 'F' then 1 when 'O' then -1 else 0 end as p from filing)")
def regime_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.when(F.col("status") == "F", "falling").when(F.col("status") == "O", "rising")
    return B.filings(spark, sf_dir).select("filing_id", S.regime_score(F.col("predicted"), F.col("concern") * 4, rates).alias("regime"))


@query("V2_row_offset_returns", "select ticker, date, round((close - lag(close, 7) over w) * 100 / lag(close, 7) over w, 6) as r7, round(avg(case when day % 7 <> 0 then volume end) over (partition by ticker order by date rows 29 preceding), 6) as level from price window w as (partition by ticker order by date)")
def row_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series()
    return B.prices(spark, sf_dir).select("ticker", "date", F.round(M.percent_change(F.col("close"), F.lag("close", 7).over(w)), 6).alias("r7"), F.round(F.avg(F.when(F.col("day") % 7 != 0, F.col("volume"))).over(last_rows(w, 30)), 6).alias("level"))


@query("V6_second_nearest", SIDE + "select f.filing_id, p.day as end_day from f join lateral (select day from price p where p.ticker = f.ticker and p.day between f.day and f.day + 15 order by abs(p.day - f.day - 9), day limit 1 offset 1) p on true")
def second_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return S.second_nearest(left, right, key="filing_id", by="ticker", day="day", target=9).select("filing_id", "end_day")


@query("V7_V8_consensus_scales", "select filing_id, case when concern <> 0 then (5 - concern) / 4 * 100 end as percent, (3 - concern) / 2 as unit from filing")
def consensus_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).select("filing_id", M.consensus_from_mean(F.col("concern")).alias("percent"), ((3 - F.col("concern")) / 2).alias("unit"))


@query("V15_error_bands", "select case when e < 3 then 'a' when e < 6 then 'b' when e < 10 then 'c' else 'd' end as band, count(*) as n from (select abs(predicted - actual) as e from filing) group by 1")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.abs(F.col("predicted") - F.col("actual"))
    return B.filings(spark, sf_dir).groupBy(F.when(e < 3, "a").when(e < 6, "b").when(e < 10, "c").otherwise("d").alias("band")).agg(F.count("*").alias("n"))


@query("V23_wrapped_chunk", "(select company_id from company order by company_id limit 100 offset (select count(*) - 40 from company)) union all (select company_id from company order by company_id limit 60)")
def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.companies(spark, sf_dir).select("company_id")
    return S.wrapped_chunk(rows, "company_id", rows.count() - 40, 100)


@query("V28_delivery_slot", "select event_id, case when hour(ts) = 13 then 'morning' else 'evening' end as slot from activity")
def slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.activity(spark, sf_dir).select("event_id", F.when(F.hour("ts") == 13, "morning").otherwise("evening").alias("slot"))


@query("V25_reset", "select filing_id, case when concern > 9 then null else predicted end as predicted from filing")
def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.operators.merge import update_where

    return update_where(B.filings(spark, sf_dir), F.col("concern") > 9, {"predicted": F.lit(None).cast("double")}).select("filing_id", "predicted")


NAMES = ["Buy", "Hold", "Sell", "Outperform", "Underweight", "no such rating"]


@query("F35_rating_change", "select filing_id, case when b = '' then 'initiated' when n > o then 'upgrade' when n < o then 'downgrade' else 'reiterated' end as change from (select filing_id, case when filing_id % 10 = 0 then '' else 'x' end as b, [4, 3, 1, 4, 2, 3][filing_id % 6 + 1] as o, [4, 3, 1, 4, 2, 3][(filing_id // 6) % 6 + 1] as n from filing)")
def rating_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda i: F.element_at(F.array(*[F.lit(x) for x in NAMES]), i.cast("int") + 1)
    key = F.col("filing_id")
    before = F.when(key % 10 == 0, "").otherwise(name(key % 6))
    return B.filings(spark, sf_dir).select("filing_id", S.rating_change(before, name(F.floor(key / 6) % 6)).alias("change"))


@query("F9_major_firms", "select filing_id, filing_id % 4 < 2 as exact, filing_id % 4 <> 3 and filing_id % 4 <> 0 as part from filing")
def major(spark: SparkSession, sf_dir: str) -> DataFrame:
    firm = F.element_at(F.array(F.lit("Jefferies"), F.lit("Goldman Sachs"), F.lit("UBS Group"), F.lit("Small Firm")), (F.col("filing_id") % 4 + 1).cast("int"))
    return B.filings(spark, sf_dir).select("filing_id", S.is_major(firm).alias("exact"), S.is_major(firm, exact=False).alias("part"))


@query("F40_dispersion", "select filing_id, round(abs(nullif(predicted, 0)) * (0.05 + 0.1 * case when a + b + c > 0 then sqrt((pow(a / (a + b + c) - 0.33, 2) + pow(b / (a + b + c) - 0.33, 2) + pow(c / (a + b + c) - 0.33, 2)) / 3) else 0.1 end), 6) as spread from (select filing_id, predicted, (filing_id % 4)::double as a, (filing_id % 5)::double as b, (filing_id % 3)::double as c from filing)")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("filing_id")
    return B.filings(spark, sf_dir).select("filing_id", F.round(M.dispersion(F.col("predicted"), k % 4, k % 5, k % 3), 6).alias("spread"))


@query("F43_position_aligned_correlation", ", x as (select *, row_number() over (partition by company_id order by filing_date, filing_id) as i from filing where filing_type = '10-K'), y as (select *, row_number() over (partition by company_id order by filing_date, filing_id) as i from filing where filing_type = '10-Q') select company_id, count(*) as n, round(coalesce(case when stddev_pop(x.actual) * stddev_pop(y.actual) > 0 then covar_pop(x.actual, y.actual) / (stddev_pop(x.actual) * stddev_pop(y.actual)) end, 0), 6) as r from x join y using (company_id, i) group by 1 having count(*) >= 3")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.operators.aggregates import correlation

    w = Window.partitionBy("company_id").orderBy("filing_date", "filing_id")
    side = lambda form, name: B.filings(spark, sf_dir).where(F.col("filing_type") == form).select("company_id", F.col("actual").alias(name), F.row_number().over(w).alias("i"))
    met = side("10-K", "x").join(side("10-Q", "y"), ["company_id", "i"])
    return rounded(met.groupBy("company_id").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("r")).where("n >= 3"))


@query("F53_scaling", "select filing_id, predicted * 7 / 30 as week, actual * 30 / 7 + 0.8 as month from filing")
def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).select("filing_id", (F.col("predicted") * 7 / 30).alias("week"), (F.col("actual") * 30 / 7 + 0.8).alias("month"))


@query("F50_adjusted_confidence", "select filing_id, round(greatest(0.1, least(0.95, confidence + (coalesce(acc, 56.8) - 56.8) / 100)), 6) as confidence from filing left join (select company_id, avg(cast(sign(predicted) = sign(actual) as double)) * 100 as acc from filing group by 1 having count(*) >= 10) using (company_id)")
def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir)
    past = rows.groupBy("company_id").agg((F.avg((F.signum("predicted") == F.signum("actual")).cast("double")) * 100).alias("acc"), F.count("*").alias("n")).where("n >= 10").select("company_id", "acc")
    return rows.join(past, "company_id", "left").select("filing_id", F.round(M.clip(F.col("confidence") + (F.coalesce("acc", F.lit(56.8)) - 56.8) / 100, 0.1, 0.95), 6).alias("confidence"))


@query("M4_M20_piecewise_ensemble", "select filing_id, case when filing_type = '10-K' then round(case when sentiment > 0.3 then 1.2 when sentiment > 0 then 0.5 else -0.4 end + case when concern > 6 then -0.8 else 0.2 end + 0.83, 6) else round(0.1 * predicted + 0.5 * sentiment, 10) end as predicted from filing")
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("sentiment"), F.col("concern")
    curved = challenger.above(s, [(0.3, 1.2), (0.0, 0.5)], -0.4) + challenger.above(c, [(6.0, -0.8)], 0.2) + challenger.BASE
    return B.filings(spark, sf_dir).select("filing_id", F.when(F.col("filing_type") == "10-K", F.round(curved, 6)).otherwise(F.round(0.1 * F.col("predicted") + 0.5 * s, 10)).alias("predicted"))


@query("M18_baseline_flags", "select filing_id, predicted > 2 as beat, predicted > 10 as large_beat, predicted < -2 as miss, predicted < -10 as large_miss, abs(predicted) as size from filing")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("predicted")
    return B.filings(spark, sf_dir).select("filing_id", (p > 2).alias("beat"), (p > 10).alias("large_beat"), (p < -2).alias("miss"), (p < -10).alias("large_miss"), F.abs(p).alias("size"))


@query("X5_backtest_by_slice", "select coalesce(filing_type, 'all') as filing_type, coalesce(y, -1) as y, count(*) as n, round(avg(cast(sign(predicted) = sign(actual) as double)) * 100, 6) as direction from (select *, year(filing_date) as y from filing where predicted <> 0) group by grouping sets ((filing_type), (y), ())")
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).where("predicted <> 0").withColumn("y", F.year("filing_date"))
    made = rows.groupingSets([[F.col("filing_type")], [F.col("y")], []], F.col("filing_type"), F.col("y")).agg(F.count("*").alias("n"), (F.avg((F.signum("predicted") == F.signum("actual")).cast("double")) * 100).alias("direction"))
    return rounded(made.fillna({"filing_type": "all", "y": -1}))


@query("X6_company_page", "select c.company_id, ticker, n, latest, round(target, 6) as target from company c left join (select company_id, count(*) as n, max(filing_date) as latest from filing group by 1) f using (company_id) left join (select company_id, max_by(value, (ts, event_id)) as target from activity where action <> 'error' group by 1) a using (company_id)")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = B.filings(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n"), F.max("filing_date").alias("latest"))
    target = B.activity(spark, sf_dir).where("action <> 'error'").groupBy("company_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("target"))
    return rounded(B.companies(spark, sf_dir).select("company_id", "ticker").join(counts, "company_id", "left").join(target, "company_id", "left").select("company_id", "ticker", "n", "latest", "target"))


@query("X8_alert_digest", ", w as (select distinct company_id % 25 as user_id, company_id from filing), hits as (select user_id, filing_id from w join filing using (company_id) where filing_date >= date '2001-07-20' and concern >= 6) select user_id, count(*) as n, min(filing_id) as first, max(filing_id) as last from hits group by 1")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir)
    listed = rows.select((F.col("company_id") % 25).alias("user_id"), "company_id").distinct()
    hits = rows.where((F.col("filing_date") >= F.lit("2001-07-20")) & (F.col("concern") >= 6)).join(listed, "company_id")
    return hits.groupBy("user_id").agg(F.count("*").alias("n"), F.min("filing_id").alias("first"), F.max("filing_id").alias("last"))


CONTEXT = """, c as (select company_id, ticker, name, sector, market_cap, pe_ratio from company),
f as (select *, case when filing_id % 5 <> 0 then concern end as level, case when filing_id % 4 <> 0 then actual end as came from filing),
r as (select *, row_number() over (order by filing_date desc, filing_id desc) as newest, row_number() over (partition by company_id order by filing_date desc, filing_id desc) as of_company from f),
sect as (select company_id, sector, row_number() over (partition by sector order by market_cap desc, company_id) as k from c),
rows as (
  select 'company' as kind, ticker as subject, of_company as place, filing_id from r join c using (company_id) where of_company <= 10
  union all select 'high concern', 'all', row_number() over (order by filing_date desc, filing_id desc), filing_id from f where level >= 5 and came is not null qualify row_number() over (order by filing_date desc, filing_id desc) <= 20
  union all select 'analysed', 'all', row_number() over (order by filing_date desc, filing_id desc), filing_id from f where level is not null qualify row_number() over (order by filing_date desc, filing_id desc) <= 20
)
select kind, subject, place, '{"filing_id":' || filing_id || ',"filing_type":"' || filing_type || '","filing_date":"' || strftime(filing_date, '%Y-%m-%d') || '"' || case when level is null then '' else ',"concern":' || level end || ',"company":{"ticker":"' || ticker || '","name":"' || name || '","sector":"' || sector || '"}}' as row
from rows join f using (filing_id) join c using (company_id)
union all select 'sector', sector, k, '{"ticker":"' || ticker || '","name":"' || name || '","sector":"' || sector || '"}' from sect join c using (company_id, sector) where k <= 50"""


@query("X12_context_rows", CONTEXT)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question's answer is given to read, as JSON: a company's ten newest filings, the newest of high concern and of those analysed, a sector's fifty largest companies."""
    k = F.col("filing_id")
    rows = B.filings(spark, sf_dir).withColumns({"concern": F.when(k % 5 != 0, F.col("concern")), "actual": F.when(k % 4 != 0, F.col("actual"))})
    company = F.struct("ticker", "name", "sector")
    firms = B.companies(spark, sf_dir).select("company_id", "ticker", "sector", "market_cap", company.alias("company"))
    newest = [F.col("filing_date").desc(), F.col("filing_id").desc()]
    top = lambda kept, n: kept.orderBy(*newest).limit(n)
    place = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    said = F.to_json(F.struct("filing_id", "filing_type", F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"), "concern", "company"))
    one = rows.withColumn("place", place(["company_id"], newest)).where("place <= 10").withColumn("kind", F.lit("company"))
    lists = [top(rows.where(bound), 20).withColumn("kind", F.lit(kind)).withColumn("place", place(["kind"], newest)) for kind, bound in (("high concern", "concern >= 5 and actual is not null"), ("analysed", "concern is not null"))]
    met = one.unionByName(lists[0], allowMissingColumns=True).unionByName(lists[1], allowMissingColumns=True).join(firms, "company_id")
    of_filings = met.select("kind", F.when(F.col("kind") == "company", F.col("ticker")).otherwise("all").alias("subject"), "place", said.alias("row"))
    ranked = firms.withColumn("place", place(["sector"], [F.col("market_cap").desc(), F.col("company_id")])).where("place <= 50")
    return of_filings.unionByName(ranked.select(F.lit("sector").alias("kind"), F.col("sector").alias("subject"), "place", F.to_json("company").alias("row")))


@query("J5_revision_pair", SIDE + "select f.filing_id, max_by(p.close, p.day) filter (p.day between f.day - 93 and f.day - 87) as before, max_by(p.close, p.day) filter (p.day between f.day - 1 and f.day + 1) as now from f join price p on p.ticker = f.ticker and p.day between f.day - 93 and f.day + 1 group by 1")
def revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    gap = F.col("day_right") - F.col("day")
    pick = lambda low, high: F.max_by(F.when(gap.between(low, high), F.col("close_right")), F.when(gap.between(low, high), F.col("day_right")))
    pairs = interval_join(left, right, by=["ticker"], on="day", low=-93, high=1, bin_width=95)
    return pairs.groupBy("filing_id").agg(pick(-93, -87).alias("before"), pick(-1, 1).alias("now"))
