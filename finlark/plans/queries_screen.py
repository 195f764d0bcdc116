"""Registered screens (N), predicates (P), ordering and paging (K), with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.operators.order import Pages, ranked, ranked_within
from finlark.plans import bindings as B
from finlark.plans import screener
from finlark.streaming.ingest import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2001-08-02"


def tables(spark: SparkSession, sf_dir: str) -> screener.Tables:
    """Snapshots are the activity of the company that is also a customer."""
    snapshots = B.activity(spark, sf_dir).select("event_id", "company_id", F.col("ts").alias("snapshot_date"), F.when(F.col("action") != "error", F.col("value")).alias("analyst_target_price"))
    return screener.Tables(B.companies(spark, sf_dir), B.filings(spark, sf_dir), snapshots, AS_OF)


def asked(name: str, question: str, columns: list[str], sql: str, page: int = 1) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return screener.ask(tables(spark, sf_dir), question, page)[1].select(*[F.expr(c) for c in columns])

    QUERIES[name], SQL[name] = run, B.WITH + (sql if sql[0] == "," else " " + sql)


def plain(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = run, B.WITH + (sql if sql[0] == "," else " " + sql)
        return run

    return register


asked("N1_compound_and", "find companies with market cap > 20b and beta < 1.5", ["company_id", "market_cap", "beta", "total_count"], "select company_id, market_cap, beta, count(*) over () as total_count from company where market_cap > 20e9 and beta < 1.5 order by company_id limit 50")
asked("N1_compound_or_sector", "p/e under 5 or dividend yield above 6%", ["company_id", "pe_ratio", "dividend_yield", "total_count"], "select company_id, pe_ratio, dividend_yield, count(*) over () as total_count from company where pe_ratio < 5 or dividend_yield > 0.06 order by company_id limit 50")
asked("N2_target_history", "show me T7 target price history", ["company_id", "snapshot_date", "analyst_target_price"], "select company_id, snapshot_date, analyst_target_price from (select event_id, company_id, ts as snapshot_date, case when action <> 'error' then value end as analyst_target_price from activity) where company_id = 7 order by snapshot_date desc limit 30")
asked("N4_target_increase", "companies where target increased", ["company_id", "latest", "previous", "round(change_pct, 6) as change_pct"], "select company_id, latest, previous, round((latest - previous) * 100.0 / previous, 6) as change_pct from (select company_id, max(case when k = 1 then v end) as latest, max(case when k = 2 then v end) as previous from (select company_id, value as v, row_number() over (partition by company_id order by ts desc) as k from activity where action <> 'error') where k <= 2 group by company_id) where latest > previous order by abs((latest - previous) * 100.0 / previous) desc, company_id limit 50")
asked("N4_target_decrease", "show where analyst target price went down", ["company_id", "round(change_pct, 6) as change_pct"], "select company_id, round((latest - previous) * 100.0 / previous, 6) as change_pct from (select company_id, max(case when k = 1 then v end) as latest, max(case when k = 2 then v end) as previous from (select company_id, value as v, row_number() over (partition by company_id order by ts desc) as k from activity where action <> 'error') where k <= 2 group by company_id) where latest < previous order by abs((latest - previous) * 100.0 / previous) desc, company_id limit 50")
asked("N5_metrics", "what is T12 stock price", ["company_id", "ticker", "current_price", "pe_ratio"], "select company_id, ticker, current_price, pe_ratio from company where ticker = 'T12'")
asked("N6_pe_below", "list companies with pe ratio < 15", ["company_id", "pe_ratio"], "select company_id, pe_ratio from company where pe_ratio > 0 and pe_ratio <= 15 order by pe_ratio, company_id limit 50")
asked("N7_cap_above", "show companies with market cap > $40b", ["company_id", "market_cap"], "select company_id, market_cap from company where market_cap >= 40e9 order by market_cap desc, company_id limit 50")
asked("N8_recent_filings", "show me T9 filings in the last 900 days", ["filing_id", "filing_date", "ticker"], "select filing_id, filing_date, ticker from filing join company using (company_id) where ticker = 'T9' and filing_date >= date '2001-08-02' - interval 900 day order by filing_date desc, filing_id limit 100")
asked("N9_filed_this_month", "list all 10-k filed this month", ["filing_id", "filing_date", "company_id"], "select filing_id, filing_date, company_id from filing where filing_type = '10-K' and filing_date >= date '2001-07-02' order by filing_date desc, filing_id limit 100")
asked("N9_filed_this_week", "show 8-k filed this week", ["filing_id", "filing_date", "company_id"], "select filing_id, filing_date, company_id from filing where filing_type = '8-K' and filing_date >= date '2001-07-26' order by filing_date desc, filing_id limit 100")
asked("N10_filed_in_quarter", "which companies filed 10-qs in q2 1997", ["filing_id", "filing_date", "ticker"], "select filing_id, filing_date, ticker from filing join company using (company_id) where filing_type = '10-Q' and filing_date >= date '1997-04-01' and filing_date < date '1997-07-01' order by filing_date desc, filing_id limit 100")
asked("N10_filed_in_month", "which companies filed 8-k in march 1996", ["filing_id", "filing_date", "ticker"], "select filing_id, filing_date, ticker from filing join company using (company_id) where filing_type = '8-K' and filing_date >= date '1996-03-01' and filing_date < date '1996-04-01' order by filing_date desc, filing_id limit 100")
asked("N11_all_filings", "list all T3 filings", ["filing_id", "filing_date"], "select filing_id, filing_date from filing where company_id = 3 order by filing_date desc, filing_id limit 50")
asked("N12_form_in_quarter", "find 10-k filed in q1 1998", ["filing_id", "filing_date"], "select filing_id, filing_date from filing where filing_type = '10-K' and filing_date >= date '1998-01-01' and filing_date < date '1998-04-01' order by filing_date desc, filing_id limit 100")
asked("N13_dividend_yield", "show companies with dividend yield > 3", ["company_id", "dividend_yield", "market_cap", "total_count"], "select company_id, dividend_yield, market_cap, count(*) over () as total_count from company where dividend_yield >= 0.03 order by dividend_yield desc, market_cap desc, company_id limit 50")
asked("N14_low_beta_page_2", "find low beta", ["company_id", "beta", "total_count"], "select company_id, beta, count(*) over () as total_count from company where beta between 0 and 0.9 order by beta, market_cap desc, company_id limit 50 offset 50", page=2)
asked("N15_revenue_growth", "list companies with revenue growth above 20", ["company_id", "latest_revenue_yoy", "total_count"], "select company_id, latest_revenue_yoy, count(*) over () as total_count from company where latest_revenue_yoy >= 20 order by latest_revenue_yoy desc, market_cap desc, company_id limit 50")
asked("N16_net_income", "show companies with net income over $1b", ["company_id", "latest_net_income"], "select company_id, latest_net_income from company where latest_net_income >= 1e9 order by latest_net_income desc, company_id limit 50")
asked("N17_operating_margin", "show companies with operating margin > 25", ["company_id", "latest_operating_margin"], "select company_id, latest_operating_margin from company where latest_operating_margin >= 0.25 order by latest_operating_margin desc, company_id limit 50")
asked("N18_undervalued", "show undervalued companies", ["company_id", "round(upside, 6) as upside", "total_count"], "select company_id, round((analyst_target_price - current_price) * 100.0 / current_price, 6) as upside, count(*) over () as total_count from company where current_price < analyst_target_price order by (analyst_target_price - current_price) * 100.0 / current_price desc, market_cap desc, company_id limit 50")
asked("N19_volatile", "list volatile stocks", ["company_id", "beta"], "select company_id, beta from company where beta >= 1.3 order by beta desc, company_id limit 50")
asked("N20_near_high", "find companies near 52-week high", ["company_id", "current_price", "fifty_two_week_high"], "select company_id, current_price, fifty_two_week_high from company where current_price > 0 and fifty_two_week_high > 0 and (fifty_two_week_high - current_price) / fifty_two_week_high * 100 <= 5 order by market_cap desc, company_id limit 50")


#: Questions put into some of the users' turns, the screens that answer them, and which of them name a bound.
TURNS = [("show volatile stocks", "volatile"), ("find companies near 52-week high", "near_high"), ("List stocks with  pe under {k}", "pe"), ("show companies with market cap > {k}b and beta < 1", "compound"), ("get companies with market cap over {k}", "fallback"), ("what a lovely day {k}", "fallback")]
ASKED = "case conv_id % 9 " + " ".join(f"when {i} then replace('{q}', '{{k}}', cast(turn + 5 as varchar(20)))" for i, (q, _) in enumerate(TURNS)) + " else text end"
ANSWERED = "case conv_id % 9 " + " ".join(f"when {i} then '{name}'" for i, (_, name) in enumerate(TURNS)) + " else 'fallback' end"


@plain("N23_fallback", f"select conv_id, turn, {ASKED} as question, {ANSWERED} as screen, {ANSWERED} = 'fallback' as fallback from conversations where role = 'user'")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns of all conversations put to the dispatcher: which screen answers, or that none does."""
    turns = B.table(spark, sf_dir, "conversations").where("role = 'user'")
    said = turns.select("conv_id", "turn", F.expr(ASKED.replace("varchar(20)", "string")).alias("question")).withColumn("screen", screener.routed(F.col("question")))
    return said.withColumn("fallback", F.col("screen") == "fallback")


@plain("N3_around_filing", ", last as (select company_id, max(filing_date) as filed from filing group by 1) select l.company_id, filed, max(ts) filter (ts < filed) as before_at, min(ts) filter (ts >= filed) as after_at, max_by(value, ts) filter (ts < filed) as before_value, min_by(value, ts) filter (ts >= filed) as after_value from last l join activity a on a.company_id = l.company_id group by 1, 2")
def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = B.filings(spark, sf_dir).groupBy("company_id").agg(F.max("filing_date").alias("filed"))
    before, after = F.col("ts") < F.col("filed"), F.col("ts") >= F.col("filed")
    value = lambda pick, c: pick(F.when(c, F.col("value")), F.when(c, F.col("ts")))
    return B.activity(spark, sf_dir).join(last, "company_id").groupBy("company_id", "filed").agg(
        F.max(F.when(before, F.col("ts"))).alias("before_at"), F.min(F.when(after, F.col("ts"))).alias("after_at"), value(F.max_by, before).alias("before_value"), value(F.min_by, after).alias("after_value")
    )


@plain("N22_sector", "select company_id, sector, count(*) over () as total_count from company where lower(sector) like '%machinery%' order by company_id limit 50")
def sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.companies(spark, sf_dir).where(F.contains(F.lower("sector"), F.lit("machinery")))
    return screener.paged(rows, screener.asc("company_id"), 1).select("company_id", "sector", "total_count")


@plain("N21_sector_undervalued", "select company_id, round((analyst_target_price - current_price) * 100.0 / current_price, 6) as upside from company where lower(sector) like '%building%' and current_price < analyst_target_price and market_cap >= 5e9 order by (analyst_target_price - current_price) * 100.0 / current_price desc, market_cap desc, company_id limit 50")
def sector_undervalued(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screener.undervalued(B.companies(spark, sf_dir).where(F.contains(F.lower("sector"), F.lit("building")) & (F.col("market_cap") >= 5e9)))
    return screener.top(rows, screener.desc("upside", "market_cap")).select("company_id", F.round("upside", 6).alias("upside"))


def shape(name: str, of: Callable[[SparkSession, str], DataFrame], where: Callable[[], Column], columns: list[str], sql_where: str, source: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return of(spark, sf_dir).where(where()).select(*columns)

    QUERIES[name], SQL[name] = run, B.WITH + f" select {', '.join(columns)} from {source} where {sql_where}"


c, f = ["company_id", "beta", "pe_ratio"], ["filing_id", "filing_date"]
shape("P1_range", B.companies, lambda: (F.col("beta") >= 0.5) & (F.col("beta") < 2) & (F.col("pe_ratio") > 3) & (F.col("pe_ratio") <= 30), c, "beta >= 0.5 and beta < 2 and pe_ratio > 3 and pe_ratio <= 30", "company")
shape("P2_equality", B.companies, lambda: F.col("sector") == "BUILDING", c, "sector = 'BUILDING'", "company")
shape("P3_not_equal_drops_null", B.companies, lambda: F.col("pe_ratio") != 10, c, "pe_ratio <> 10", "company")
shape("P5_null", B.companies, lambda: F.col("pe_ratio").isNull() & F.col("beta").isNotNull(), c, "pe_ratio is null and beta is not null", "company")
shape("P6_in_list", B.companies, lambda: F.col("sector").isin("BUILDING", "MACHINERY"), c, "sector in ('BUILDING', 'MACHINERY')", "company")
shape("P7_contains", B.companies, lambda: F.contains(F.lower("sector"), F.lit("mach")), c, "sector ilike '%mach%'", "company")
shape("P8_starts_with", B.companies, lambda: F.startswith(F.col("ticker"), F.lit("T1")), ["company_id", "ticker"], "starts_with(ticker, 'T1')", "company")
shape("P9_and_or", B.companies, lambda: ((F.col("beta") > 2) | (F.col("pe_ratio") < 5)) & (F.col("dividend_yield") > 0.02), c, "(beta > 2 or pe_ratio < 5) and dividend_yield > 0.02", "company")
shape("P10_half_open_dates", B.filings, lambda: (F.col("filing_date") >= F.lit("1998-01-01")) & (F.col("filing_date") < F.lit("1998-02-01")), f, "filing_date >= date '1998-01-01' and filing_date < date '1998-02-01'", "filing")
shape("P14_column_to_column", B.companies, lambda: F.col("current_price") < F.col("analyst_target_price"), ["company_id", "current_price", "analyst_target_price"], "current_price < analyst_target_price", "company")
shape("P18_confidence_band", B.filings, lambda: (F.col("confidence") >= 0.6) & (F.col("confidence") < 0.8), ["filing_id", "confidence"], "confidence >= 0.6 and confidence < 0.8", "filing")
shape("P19_outliers", B.filings, lambda: F.col("actual").between(-5, 5), ["filing_id", "actual"], "actual between -5 and 5", "filing")


@plain("P11_some_child", "select company_id, ticker from company c where exists (select 1 from filing f where f.company_id = c.company_id and filing_type = '10-K' and value > 400000)")
def some_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = B.filings(spark, sf_dir).where("filing_type = '10-K' and value > 400000").select("company_id")
    return B.companies(spark, sf_dir).join(child, "company_id", "left_semi").select("company_id", "ticker")


@plain("P12_through_parent", "select filing_id, ticker from filing join company using (company_id) where sector = 'AUTOMOBILE' and beta > 2")
def through_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = B.companies(spark, sf_dir).where("sector = 'AUTOMOBILE' and beta > 2").select("company_id", "ticker")
    return B.filings(spark, sf_dir).join(parent, "company_id").select("filing_id", "ticker")


@plain("P20_scenarios", "select scenario, count(*) as n, round(avg(actual), 6) as mean from (select actual, unnest([case when predicted > 2 and confidence > 0.5 then 'beat_sure' end, case when predicted < -2 then 'miss' end, case when concern > 7 then 'concern' end]) as scenario from filing) where scenario is not null group by 1")
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array_compact(F.array(F.when(F.expr("predicted > 2 and confidence > 0.5"), "beat_sure"), F.when(F.col("predicted") < -2, "miss"), F.when(F.col("concern") > 7, "concern")))
    return B.filings(spark, sf_dir).select("actual", F.explode(named).alias("scenario")).groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.avg("actual"), 6).alias("mean"))


@plain("K2_two_keys_nulls_first", "select company_id, dividend_yield, beta from company order by dividend_yield desc nulls first, beta desc nulls first, company_id limit 40")
def two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.companies(spark, sf_dir).orderBy(*screener.desc("dividend_yield", "beta")).limit(40).select("company_id", "dividend_yield", "beta")


@plain("K4_absolute_order", "select filing_id, actual from filing order by abs(actual) desc, filing_id limit 50")
def absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).orderBy(F.abs("actual").desc(), "filing_id").limit(50).select("filing_id", "actual")


@plain("K6_relevance", "select company_id, ticker, market_cap from company where starts_with(ticker, 'T4') or contains(lower(name), 'customer#00000004') order by starts_with(ticker, 'T4') desc, coalesce(market_cap, 0) desc, ticker limit 10")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.startswith(F.col("ticker"), F.lit("T4"))
    rows = B.companies(spark, sf_dir).where(starts | F.contains(F.lower("name"), F.lit("customer#00000004")))
    return rows.orderBy(starts.desc(), F.coalesce("market_cap", F.lit(0)).desc(), "ticker").limit(10).select("company_id", "ticker", "market_cap")


@plain("K7_both_ends", "(select 'best' as side, filing_id, actual from filing order by actual desc, filing_id limit 10) union all (select 'worst', filing_id, actual from filing order by actual, filing_id limit 10)")
def both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).select("filing_id", "actual")
    best, worst = rows.orderBy(F.col("actual").desc(), "filing_id").limit(10), rows.orderBy("actual", "filing_id").limit(10)
    return best.select(F.lit("best").alias("side"), "*").unionByName(worst.select(F.lit("worst").alias("side"), "*"))


@plain("K9_rotating_slice", "select company_id from (select company_id, ntile(6) over (order by company_id) as slice, row_number() over (order by company_id) - 1 as i, count(*) over () as n from company) where i // cast(ceil(n / 6.0) as bigint) = 214 % 6")
def rotating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixth of the companies, in order of id, that a day of the year stands for; found by rank."""
    rows = ranked(B.companies(spark, sf_dir).select("company_id"), [F.col("company_id")])
    size = F.ceil(F.col("n") / 6)
    met = rows.join(F.broadcast(rows.agg(F.count("*").alias("n"))), F.lit(True))
    return met.where(F.floor((F.col("rank") - 1) / size) == 214 % 6).select("company_id")


@plain("K3_deep_pages", "select filing_id, value, total_count from (select filing_id, value, row_number() over (order by value desc, filing_id) - 1 as i, count(*) over () as total_count from filing) where i // 50 = total_count // 100 or i // 50 = (total_count - 1) // 50")
def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle page and the last one of all filings by value; each reads one range or two of those written."""
    rows = B.filings(spark, sf_dir).select("filing_id", "value")
    held = Pages(rows, [F.col("value").desc(), F.col("filing_id")], f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}")
    middle, last = held.total // 100 + 1, held.pages
    return held.page(middle) if middle == last else held.page(middle).unionByName(held.page(last))


@plain("W25_rank_by_size", "select company_id, row_number() over (order by market_cap desc, company_id) as rank, row_number() over (partition by sector order by market_cap desc, company_id) as sector_rank from company")
def by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("market_cap").desc(), F.col("company_id")]
    rows = ranked(B.companies(spark, sf_dir).select("company_id", "sector", "market_cap"), order)
    return ranked_within(rows, ["sector"], order, "sector_rank").select("company_id", "rank", "sector_rank")
