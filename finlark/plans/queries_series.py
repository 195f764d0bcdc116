"""Registered as-of and interval joins (J), indicators and other windows (W), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finlark.functions.math import per, percent_change
from finlark.functions.text import next_trading_day
from finlark.operators import windows as W
from finlark.operators.asof import asof_join, interval_aggregate, interval_join
from finlark.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = run, B.WITH + sql
        return run

    return register


def sides(spark: SparkSession, sf_dir: str, where: str = "true", more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Filings, keyed by the supplier that stands for the company's price series, and that series. where: of which filings; more: their other columns."""
    n = B.table(spark, sf_dir, "supplier").count()
    left = B.filings(spark, sf_dir).where(where).select("filing_id", (F.col("company_id") % n).alias("ticker"), "day", *more)
    return left, B.prices(spark, sf_dir).select("ticker", "day", "close")


SIDE = ", f as (select filing_id, company_id % (select count(*) from supplier) as ticker, day from filing) "
PICK = "select f.filing_id, p.day as day_right, round(p.close, 6) as close_right from f left join lateral (select day, close from price p where p.ticker = f.ticker and {where} order by {order} limit 1) p on true"


def asof(name: str, where: str, order: str, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = sides(spark, sf_dir)
        return asof_join(left, right, by=["ticker"], on="day", take=["close"], **how).select("filing_id", "day_right", F.round("close_right", 6).alias("close_right"))

    QUERIES[name], SQL[name] = run, B.WITH + SIDE + PICK.format(where=where, order=order)


asof("J2_asof_backward", "p.day <= f.day", "day desc")
asof("J3_asof_strict_before", "p.day < f.day", "day desc", inclusive=False)
asof("J3_asof_from_on", "p.day >= f.day", "day", direction="forward")
asof("J4_asof_two_days", "p.day <= f.day and p.day >= f.day - 2", "day desc", tolerance=2)
asof("J7_nearest_under_7", "abs(p.day - f.day) < 7", "abs(p.day - f.day), day", direction="nearest", tolerance=7, strict_tolerance=True)
asof("J8_nearest_within_7", "abs(p.day - f.day) <= 7", "abs(p.day - f.day), day", direction="nearest", tolerance=7)
asof("J9_nearest", "true", "abs(p.day - f.day), day", direction="nearest")
asof("J10_nearest_within_2", "abs(p.day - f.day) <= 2", "abs(p.day - f.day), day", direction="nearest", tolerance=2)
asof("W10_nearest_tie_later", "true", "abs(p.day - f.day), day desc", direction="nearest", tie="later")


@query("J5_latest_in_band", SIDE + "select filing_id, max(p.day) as day_right, round(max_by(p.close, p.day), 6) as close_right from f join price p on p.ticker = f.ticker and p.day between f.day - 3 and f.day + 3 group by 1")
def latest_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    pairs = interval_join(left, right, by=["ticker"], on="day", low=-3, high=3)
    return pairs.groupBy("filing_id").agg(F.max("day_right").alias("day_right"), F.round(F.max_by("close_right", "day_right"), 6).alias("close_right"))


@query("J6_earliest_in_band", SIDE + "select filing_id, min(p.day) as day_right, round(min_by(p.close, p.day), 6) as close_right from f join price p on p.ticker = f.ticker and p.day between f.day - 3 and f.day + 3 group by 1")
def earliest_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    pairs = interval_join(left, right, by=["ticker"], on="day", low=-3, high=3)
    return pairs.groupBy("filing_id").agg(F.min("day_right").alias("day_right"), F.round(F.min_by("close_right", "day_right"), 6).alias("close_right"))


@query("J14_interval_counts_half_open", ", later as (select event_id, company_id, hour from activity where action = 'click') select l.event_id, count(a.event_id) filter (a.action = 'purchase') as upgrades, count(a.event_id) filter (a.action = 'error' and a.value > 20) as downgrades from later l left join activity a on a.company_id = l.company_id and a.hour >= l.hour - 72 and a.hour < l.hour group by 1")
def interval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.activity(spark, sf_dir)
    left = events.where("action = 'click'").select("event_id", "company_id", "hour")
    right = events.select("company_id", "hour", "action", "value")
    counted = interval_aggregate(left, right, key="event_id", by=["company_id"], on="hour", low=-72, high=0, closed_high=False, bin_width=72, aggregates=lambda: [F.count_if(F.col("action_right") == "purchase").alias("u"), F.count_if((F.col("action_right") == "error") & (F.col("value_right") > 20)).alias("d")])
    return counted.select("event_id", F.coalesce("u", F.lit(0)).alias("upgrades"), F.coalesce("d", F.lit(0)).alias("downgrades"))


@query("J16_related_filing_5_days", "select q.filing_id, max_by(k.filing_id, (k.filing_date, k.filing_id)) as related from filing q join filing k on k.company_id = q.company_id and k.filing_type = '8-K' and k.day between q.day - 60 and q.day where q.filing_type = '10-Q' group by 1")
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).select("filing_id", "company_id", "filing_type", "day")
    pairs = interval_join(rows.where("filing_type = '10-Q'").drop("filing_type"), rows.where("filing_type = '8-K'").drop("filing_type"), by=["company_id"], on="day", low=-60, high=0, bin_width=60)
    return pairs.groupBy("filing_id").agg(F.max_by("filing_id_right", F.struct("day_right", "filing_id_right")).alias("related"))


def same_type() -> Window:
    return Window.partitionBy("company_id", "filing_type").orderBy("filing_date", "filing_id")


@query("J17_prior_same_type", "select filing_id, lag(filing_id) over (partition by company_id, filing_type order by filing_date, filing_id) as prior from filing")
def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).select("filing_id", F.lag("filing_id").over(same_type()).alias("prior"))


@query("J18_no_newer", "select filing_id from filing f where filing_type <> '8-K' and not exists (select 1 from filing g where g.company_id = f.company_id and g.filing_type <> '8-K' and g.filing_date > f.filing_date)")
def no_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).where("filing_type <> '8-K'")
    newest = rows.groupBy("company_id").agg(F.max("filing_date").alias("newest"))
    return rows.join(newest, "company_id").where("filing_date = newest").select("filing_id")


@query("J24_key_difference", "select filing_id from filing where filing_id not in (select filing_id from filing where value > 200000)")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir)
    return rows.join(rows.where("value > 200000").select("filing_id"), "filing_id", "left_anti").select("filing_id")


@query("J25_children_top_2", "select company_id, filing_id, k from (select company_id, filing_id, row_number() over (partition by company_id order by filing_date desc, filing_id desc) as k from filing) where k <= 2")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(F.col("filing_date").desc(), F.col("filing_id").desc())
    return B.filings(spark, sf_dir).select("company_id", "filing_id", F.row_number().over(w).alias("k")).where("k <= 2")


@query("J26_fallback_row", SIDE + "select f.filing_id, round(coalesce(case when p.close > 2500 then p.close end, c.current_price, 0), 6) as price from f join filing g using (filing_id) left join company c on c.company_id = g.company_id left join lateral (select close from price p where p.ticker = f.ticker and p.day <= f.day order by day desc limit 1) p on true")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    met = asof_join(left, right, by=["ticker"], on="day", take=["close"])
    owner = B.filings(spark, sf_dir).select("filing_id", "company_id").join(B.companies(spark, sf_dir).select("company_id", "current_price"), "company_id", "left")
    chosen = F.coalesce(F.when(F.col("close_right") > 2500, F.col("close_right")), F.col("current_price"), F.lit(0.0))
    return met.join(owner, "filing_id").select("filing_id", F.round(chosen, 6).alias("price"))


@query("J13_date_join_with_default", ", spy as (select day, max(close) as spy from price where ticker % 5 = 0 group by 1) select p.ticker, p.day, p.close - coalesce(s.spy, 0) as gap from price p left join spy s using (day)")
def date_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.prices(spark, sf_dir)
    spy = rows.where("ticker % 5 = 0").groupBy("day").agg(F.max("close").alias("spy"))
    return rows.join(spy, "day", "left").select("ticker", "day", (F.col("close") - F.coalesce("spy", F.lit(0.0))).alias("gap"))


@query("J19_left_join_defaults", "select c.company_id, coalesce(n, 0) as filings, coalesce(flag, false) as has_annual from company c left join (select company_id, count(*) as n, bool_or(filing_type = '10-K') as flag from filing where value > 300000 group by 1) using (company_id)")
def left_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = B.filings(spark, sf_dir).where("value > 300000").groupBy("company_id").agg(F.count("*").alias("n"), F.bool_or(F.col("filing_type") == "10-K").alias("flag"))
    return B.companies(spark, sf_dir).join(made, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).alias("filings"), F.coalesce("flag", F.lit(False)).alias("has_annual"))


@query("J23_alert_rules", ", rules as (select * from (values (1, 1, 'sector', 'BUILD', 6.0), (1, 2, 'concern', null, 9.0), (2, 1, 'sector', 'MACH', 3.0)) r(user_id, rule, kind, word, least)), hits as (select r.user_id, f.filing_id, r.rule, row_number() over (partition by r.user_id, f.filing_id order by r.rule) as k from filing f join company c using (company_id) join rules r on f.concern >= r.least and (r.word is null or contains(c.sector, r.word)) where f.filing_date >= date '2001-01-01') select user_id, filing_id, rule from hits where k = 1")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.streaming.alerts import matched

    rules = spark.createDataFrame([(1, 1, "sector", "BUILD", 6.0), (1, 2, "concern", None, 9.0), (2, 1, "sector", "MACH", 3.0)], "user_id int, rule int, kind string, word string, least double")
    events = B.filings(spark, sf_dir).where(F.col("filing_date") >= F.lit("2001-01-01")).join(B.companies(spark, sf_dir).select("company_id", "sector"), "company_id")
    return matched(events, rules).select("user_id", "filing_id", "rule")


# --- windows

FRAME = ", s as (select *, row_number() over w as i, lag(close) over w as before from price window w as (partition by ticker order by date)) "
IND = FRAME + """, t as (select *, close - before as chg, ln(close / before) as lr, greatest(high - low, abs(high - before), abs(low - before)) as tr from s),
u as (select ticker, date,
  case when count(close) over r30 = 30 then avg(close) over r30 end as ma30, case when count(close) over r200 = 200 then avg(close) over r200 end as ma200,
  case when count(chg) over r14 = 14 then case when sum(greatest(-chg, 0)) over r14 = 0 then 100.0 else 100 - 100 / (1 + sum(greatest(chg, 0)) over r14 / sum(greatest(-chg, 0)) over r14) end end as rsi14,
  case when before is not null and count(before) over r14 = 14 then avg(case when before is not null then tr end) over r14 end as atr14,
  case when count(lr) over r30 = 30 then stddev_pop(lr) over r30 * sqrt(252.0) * 100 end as volatility30,
  (close - lag(close, 7) over w) * 100 / lag(close, 7) over w as return_7d, (close - lag(close, 90) over w) * 100 / lag(close, 90) over w as return_90d,
  close, volume, case when count(volume) over r30 = 30 then avg(volume) over r30 end as volume_ma30
  from t window w as (partition by ticker order by date), r14 as (partition by ticker order by date rows 13 preceding), r30 as (partition by ticker order by date rows 29 preceding), r200 as (partition by ticker order by date rows 199 preceding)) """


def indicator(name: str, column: str, expr: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return W.indicators(B.prices(spark, sf_dir)).select("ticker", "date", F.round(column, 4).alias(column))

    QUERIES[name], SQL[name] = run, B.WITH + IND + f"select ticker, date, round({expr or column}, 4) as {column} from u"


indicator("W1_ma30", "ma30")
indicator("W1_ma200", "ma200")
indicator("W2_price_to_ma30", "price_to_ma30", "close / ma30")
indicator("W3_rsi14", "rsi14")
indicator("W6_atr14", "atr14")
indicator("W7_volatility30", "volatility30")
indicator("W8_return_7d", "return_7d")
indicator("W8_return_90d", "return_90d")
indicator("W9_volume_ratio", "volume_ratio", "volume / volume_ma30")


@query("X4_indicators", IND + "select ticker, count(ma30) as n30, count(ma200) as n200, count(rsi14) as nrsi, round(avg(rsi14), 4) as rsi, round(avg(atr14), 4) as atr, round(avg(volatility30), 4) as vol from u group by 1")
def indicator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = W.indicators(B.prices(spark, sf_dir))
    return made.groupBy("ticker").agg(F.count("ma30").alias("n30"), F.count("ma200").alias("n200"), F.count("rsi14").alias("nrsi"), F.round(F.avg("rsi14"), 4).alias("rsi"), F.round(F.avg("atr14"), 4).alias("atr"), F.round(F.avg("volatility30"), 4).alias("vol"))


EMA = "list_reduce(list_concat([list_avg(xs[1:{n}])], xs[{n} + 1:]), lambda e, x: (x - e) * 2.0 / ({n} + 1) + e)"


@query("W4_W5_ema_macd_last", f", l as (select ticker, list(close order by date) as xs, max(date) as date from price group by 1) select ticker, date, round({EMA.format(n=12)}, 4) as ema_fast, round({EMA.format(n=26)}, 4) as ema_slow, round(case when len(xs) >= 35 then {EMA.format(n=12)} - {EMA.format(n=26)} end, 4) as macd from l where len(xs) >= 26")
def ema_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = W.macd(B.prices(spark, sf_dir))
    last = made.groupBy("ticker").agg(F.max_by(F.struct("date", "ema_fast", "ema_slow", "macd"), "date").alias("r")).select("ticker", "r.*")
    return last.where("ema_slow is not null").select("ticker", "date", *[F.round(c, 4).alias(c) for c in ("ema_fast", "ema_slow", "macd")])


@query("W14_year_range", "select ticker, date, case when count(*) over y >= 20 then max(high) over y end as high_52w, case when count(*) over y >= 20 then min(low) over y end as low_52w from price window y as (partition by ticker order by day range between 365 preceding and current row)")
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.year_range(B.prices(spark, sf_dir)).select("ticker", "date", "high_52w", "low_52w")


@query("W15_nth_row_later", "select ticker, date, lead(close, 7) over (partition by ticker order by date) as later from price")
def later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.prices(spark, sf_dir).select("ticker", "date", F.lead("close", 7).over(W.series()).alias("later"))


@query("W16_return_and_alpha", ", spy as (select date, avg(close) as spy from price group by 1), m as (select ticker, date, (lead(close, 7) over w - close) * 100 / close as r, (lead(spy, 7) over w - spy) * 100 / spy as m from price join spy using (date) window w as (partition by ticker order by date)) select ticker, date, round(r - m, 4) as alpha, sign(round(r - m, 4)) = sign(round(r, 4)) as same_sign from m where r is not null")
def alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.prices(spark, sf_dir)
    met = rows.join(rows.groupBy("date").agg(F.avg("close").alias("spy")), "date")
    w = W.series()
    made = met.select("ticker", "date", W.forward_return(7, w).alias("r"), W.forward_return(7, w, "spy").alias("m")).where("r is not null")
    return made.select("ticker", "date", F.round(F.col("r") - F.col("m"), 4).alias("alpha"), F.col("r")).select("ticker", "date", "alpha", (F.signum("alpha") == F.signum(F.round("r", 4))).alias("same_sign"))


@query("W17_two_latest", "select company_id, latest, previous, round(latest - previous, 6) as change from (select company_id, max(case when k = 1 then value end) as latest, max(case when k = 2 then value end) as previous from (select company_id, value, row_number() over (partition by company_id order by ts desc, event_id desc) as k from activity where value > 3) group by 1) where previous is not null")
def two_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.activity(spark, sf_dir).withColumn("v", F.when(F.col("value") > 3, F.col("value")))
    return W.change_of_rank(rows, key="company_id", time=["ts", "event_id"], value="v").select("company_id", "latest", "previous", F.round("change", 6).alias("change"))


@query("W18_tone_change", "select filing_id, coalesce(sentiment - lag(sentiment) over (partition by company_id, filing_type order by filing_date, filing_id), 0) as change from filing")
def tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).select("filing_id", F.coalesce(F.col("sentiment") - F.lag("sentiment").over(same_type()), F.lit(0.0)).alias("change"))


@query("W19_prior_non_null", "select filing_id, last_value(case when concern > 5 then sentiment end ignore nulls) over (partition by company_id order by filing_date, filing_id rows between unbounded preceding and 1 preceding) as prior from filing")
def prior_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy("filing_date", "filing_id").rowsBetween(Window.unboundedPreceding, -1)
    return B.filings(spark, sf_dir).select("filing_id", F.last(F.when(F.col("concern") > 5, F.col("sentiment")), ignorenulls=True).over(w).alias("prior"))


@query("W20_volume_trend", FRAME + "select ticker, date, case when count(*) over r > 1 then round(regr_slope(volume, i) over r * 30 / avg(volume) over r * 100, 6) + 0.0 end as trend, max(volume) over r as spike, count(*) over r as n from s window r as (partition by ticker order by date rows 29 preceding)")
def volume_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.series()
    r = W.last_rows(w, 30)
    rows = B.prices(spark, sf_dir).withColumn("i", F.row_number().over(w).cast("double"))
    slope = F.regr_slope("volume", "i").over(r)
    return rows.select("ticker", "date", (F.round(per(slope * 30.0, F.avg("volume").over(r)) * 100.0, 6) + 0.0).alias("trend"), F.max("volume").over(r).alias("spike"), F.count("*").over(r).alias("n"))


@query("W21_forward_fill", ", bounds as (select unnest(range(min(day), max(day) + 1)) as day from price), k as (select distinct ticker from price) select k.ticker, b.day, last_value(p.close ignore nulls) over (partition by k.ticker order by b.day range between 5 preceding and current row) as close from k cross join bounds b left join price p on p.ticker = k.ticker and p.day = b.day")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.prices(spark, sf_dir)
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    return W.forward_filled(rows, first, last, key="ticker", day="day", value="close").select("ticker", "day", "close")


@query("W23_drawdown", ", e as (select company_id, filing_date, filing_id, 1000 + sum(actual) over (partition by company_id order by filing_date, filing_id) as equity from filing), p as (select *, max(equity) over (partition by company_id order by filing_date, filing_id) as peak from e) select company_id, max(round((peak - equity) * 100 / peak, 6)) as worst from p group by 1")
def worst_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).withColumn("at", F.struct("filing_date", "filing_id"))
    w = W.series("company_id", "at").rowsBetween(Window.unboundedPreceding, 0)
    equity = rows.select("company_id", "at", (1000 + F.sum("actual").over(w)).alias("equity"))
    return W.drawdown(equity, key="company_id", time="at", value="equity").groupBy("company_id").agg(F.max(F.round("drawdown", 6)).alias("worst"))


@query("W24_month_boundary", FRAME + "select ticker, date from (select ticker, date, lead(date) over (partition by ticker order by date) as after from price) where date_trunc('month', after) > date_trunc('month', date)")
def month_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.prices(spark, sf_dir).select("ticker", "date", F.lead("date").over(W.series()).alias("after"))
    return rows.where(F.trunc("after", "month") > F.trunc("date", "month")).select("ticker", "date")


@query("W25_W26_sample_by_bucket", "select sector, company_id from (select sector, company_id, row_number() over (partition by sector order by market_cap desc, company_id) - 1 as i, count(*) over (partition by sector) as n from company) where i % greatest(1, n // 10) = 0 and i // greatest(1, n // 10) < 10")
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.every_nth(B.companies(spark, sf_dir), bucket="sector", order=[F.col("market_cap").desc(), F.col("company_id")], target=10).select("sector", "company_id")


@query("W27_daily_change", FRAME + "select ticker, date, round((close - before) * 100 / before, 6) as pct, round(close - first_value(close) over (partition by ticker order by date), 6) as total from s")
def daily_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.series()
    return B.prices(spark, sf_dir).select("ticker", "date", F.round(percent_change(F.col("close"), F.lag("close").over(w)), 6).alias("pct"), F.round(F.col("close") - F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("total"))


@query("W28_rebased", ", b as (select ticker, min_by(close, date) as base from price group by 1) select ticker, date, round((close - base) * 100 / base, 6) as rebased from price join b using (ticker)")
def rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.prices(spark, sf_dir)
    base = rows.groupBy("ticker").agg(F.min_by("close", "date").alias("base"))
    return rows.join(base, "ticker").select("ticker", "date", F.round(percent_change(F.col("close"), F.col("base")), 6).alias("rebased"))


@query("W29_seventh_weekday", " select filing_id, (select d from (select cast(filing_date as date) + cast(n as int) as d from range(1, 15) t(n)) x where isodow(d) < 6 order by d limit 1 offset 6) as seventh from filing")
def seventh_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("filing_date").cast("date")
    ahead = F.filter(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda n: F.date_add(day, n)), lambda d: F.weekday(d) < 5)
    return B.filings(spark, sf_dir).select("filing_id", F.element_at(ahead, 7).alias("seventh"))


@query("W30_next_trading_day", "select filing_id, cast(filing_date as date) + case isodow(filing_date) when 5 then 3 when 6 then 2 else 1 end as next_day from filing")
def trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).select("filing_id", next_trading_day(F.col("filing_date").cast("date")).alias("next_day"))


@query("V11_four_back", "select filing_id, case when v > 1.05 * p then 'beat' when v < 0.95 * p then 'miss' when p is not null then 'inline' end as surprise from (select filing_id, value as v, lag(value, 4) over (partition by company_id order by filing_date, filing_id) as p from filing)")
def four_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy("filing_date", "filing_id")
    rows = B.filings(spark, sf_dir).select("filing_id", F.col("value").alias("v"), F.lag("value", 4).over(w).alias("p"))
    return rows.select("filing_id", F.when(F.col("v") > 1.05 * F.col("p"), "beat").when(F.col("v") < 0.95 * F.col("p"), "miss").when(F.col("p").isNotNull(), "inline").alias("surprise"))
