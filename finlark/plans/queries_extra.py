"""Registered content predicates, legacy and fixed models, macro rows, and refits, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finlark.functions import content
from finlark.functions.math import per, percent_change
from finlark.operators.asof import asof_join
from finlark.operators.windows import last_rows, placed, series, sma, volatility, with_long_mean
from finlark.plans import bindings as B
from finlark.plans import scoring
from finlark.plans.queries_aggregate import rounded
from finlark.plans.queries_series import FRAME

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = B.WITH + sql
        return run

    return register


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with an analysis document; every 13th is broken."""
    k = F.col("filing_id")
    data = F.struct(F.when(k % 5 == 0, F.lit(1.5)).alias("eps"), F.when(k % 7 == 0, F.lit("beat")).alias("epsSurprise"), F.when(k % 11 == 0, F.lit("+3%")).alias("epsYoY"))
    metrics = F.struct(data.alias("structuredData"), F.when(k % 3 == 0, "not_provided").when(k % 3 == 1, "raised").alias("guidanceDirection"), F.when(k % 17 == 0, F.array(F.lit("x"))).otherwise(F.array()).alias("keyMetrics"), F.when(k % 2 == 0, F.lit("Not disclosed")).alias("revenueGrowth"))
    doc = F.to_json(F.struct(metrics.alias("financialMetrics"), F.when(k % 4 == 0, "Item 2.02 Results").otherwise("Other news").alias("filingContentSummary")))
    return B.filings(spark, sf_dir).select("filing_id", "filing_type", content.parsed(F.when(k % 13 == 0, "{broken").otherwise(doc)).alias("doc"))


@query("P15_has_financial_data", "select filing_id, filing_id % 13 <> 0 and (filing_id % 5 = 0 or filing_id % 7 = 0 or filing_id % 3 = 1 or filing_id % 17 = 0) and (filing_type <> '8-K' or filing_id % 4 = 0) as has from filing")
def financial_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir).select("filing_id", content.has_financial_data(F.col("filing_type"), F.col("doc")).alias("has"))


@query("P16_has_financials", "select filing_id, filing_type <> '8-K' or (filing_id % 13 <> 0 and (filing_id % 5 = 0 or filing_id % 11 = 0 or filing_id % 3 = 1 or filing_id % 17 = 0)) as has from filing")
def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir).select("filing_id", content.has_financials(F.col("filing_type"), F.col("doc")).alias("has"))


@query("F51_calibrated_confidence", "select filing_id, round(greatest(0, least(100, ((0.2 * (1 + (case when filing_id % 3 = 0 then 0 else 1 end) + 1 + (case when filing_id % 4 = 0 then 0 else 1 end) + 1) * 0.5 + (case when filing_id % 5 = 0 then 1 else 2 end) / 2.0 * 0.25 + case when filing_id % 2 = 0 then 0.15 else 0 end + 0.1) * 0.4 + case when value * 2e6 >= 500e9 then 0.58 when value * 2e6 >= 50e9 then 0.56 else 0.45 end * 0.3 + greatest(0.5, abs(sentiment), case when confidence > 0.7 or (confidence < 0.3 and confidence > 0) then 0.8 else 0.5 end) * 0.2 + case when concern > 0 then greatest(0, 1 - concern * 5 / 40) else 0.5 end * 0.1 + case when value * 2e6 >= 500e9 then 0.15 when value * 2e6 >= 50e9 and value * 2e6 < 200e9 then 0.1 else 0 end) * 100)), 6) as score from filing")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("filing_id")
    core = [F.lit(1), F.when(k % 3 != 0, 1), F.lit(1), F.when(k % 4 != 0, 1), F.lit(1)]
    analyst = [F.lit(1), F.when(k % 5 != 0, 1)]
    score = content.calibrated_confidence(core, analyst, k % 2 == 0, F.lit(True), F.col("value") * 2e6, F.col("sentiment"), F.col("confidence"), F.col("concern") * 5)
    return B.filings(spark, sf_dir).select("filing_id", F.round(score, 6).alias("score"))


@query("W13_dollar_and_growth", FRAME + "select ticker, date, case when v > 3 then 'strong' when v < -3 then 'weak' when v is not null then 'neutral' end as dollar, case when g > 8 then 'strong' when g < -5 then 'weak' when g is not null then 'neutral' end as growth from (select ticker, date, (close - avg(close) over y) * 100 / avg(close) over y as v, (close - lag(close, 59) over w) * 100 / lag(close, 59) over w as g from s window w as (partition by ticker order by date), y as (partition by ticker order by date rows 274 preceding))")
def dollar(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = percent_change(F.col("close"), F.col("mean"))
    g = percent_change(F.col("close"), F.lag("close", 59).over(placed()))
    named = lambda c, high, low: F.when(c > high, "strong").when(c < low, "weak").when(c.isNotNull(), "neutral")
    return with_long_mean(B.prices(spark, sf_dir).select("ticker", "date", "close"), "close", 275, "mean").select("ticker", "date", named(v, 3, -3).alias("dollar"), named(g, 8, -5).alias("growth"))


@query("W31_legacy_features", FRAME + "select ticker, date, round((close / case when count(*) over r30 = 30 then avg(close) over r30 else close end - 1) * 100, 4) as to_ma30, round(case when count(*) over r30 = 30 then stddev_pop(ret) over r29 * sqrt(252) * 100 else 0 end, 4) as volatility, round(coalesce((close - lag(close, 29) over w) * 100 / lag(close, 29) over w, 0), 4) as return_30 from (select *, (close - before) / before as ret from s) window w as (partition by ticker order by date), r30 as (partition by ticker order by date rows 29 preceding), r29 as (partition by ticker order by date rows 28 preceding)")
def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older model's features: fallbacks instead of nulls, ratios in per cent, 29 intervals."""
    w = series()
    rows = B.prices(spark, sf_dir).withColumn("ret", per(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)))
    mean = F.coalesce(sma(F.col("close"), 30, w), F.col("close"))
    spread = F.when(F.count("*").over(last_rows(w, 30)) == 30, F.stddev_pop("ret").over(last_rows(w, 29)) * 252**0.5 * 100).otherwise(0.0)
    return rows.select("ticker", "date", F.round((F.col("close") / mean - 1) * 100, 4).alias("to_ma30"), F.round(spread, 4).alias("volatility"), F.round(F.coalesce(percent_change(F.col("close"), F.lag("close", 29).over(w)), F.lit(0.0)), 4).alias("return_30"))


@query("V5_simple_return_volatility", FRAME + "select ticker, date, round(case when count(ret) over r = 30 then stddev_pop(ret) over r * sqrt(252) * 100 end, 4) as volatility from (select *, (close - before) / before as ret from s) window r as (partition by ticker order by date rows 29 preceding)")
def simple_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series()
    rows = B.prices(spark, sf_dir).withColumn("ret", per(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)))
    return rows.select("ticker", "date", F.round(volatility(F.col("ret"), 30, w), 4).alias("volatility"))


@query("V1_X11_macro_rows", ", s as (select day, close from price where ticker = 1), v as (select day, close from price where ticker = 2) select s.day, round((s.close - p.close) * 100 / p.close, 6) as return_30, round((select avg(close) from (select close from v where v.day <= s.day order by day desc limit 30)), 4) as level from s left join lateral (select close from s x where x.day <= s.day - 30 order by x.day desc limit 1) p on true where (select count(*) from v where v.day <= s.day) >= 30")
def macro_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a trading day of the index: its change against the last close 30 days back, and the fear index's mean as known that day."""
    rows = B.prices(spark, sf_dir)
    index = rows.where("ticker = 1").select(F.lit(1).alias("k"), "day", "close")
    past = asof_join(index.select("k", F.col("day").alias("at"), (F.col("day") - 30).alias("day"), F.col("close").alias("now")), index, by=["k"], on="day", take=["close"])
    w = Window.partitionBy("k").orderBy("day")
    fear = rows.where("ticker = 2").select(F.lit(1).alias("k"), "day", "close")
    mean = fear.select("k", "day", F.when(F.count("*").over(last_rows(w, 30)) == 30, F.avg("close").over(last_rows(w, 30))).alias("level"))
    met = asof_join(past.select("k", F.col("at").alias("day"), "now", F.col("close_right").alias("then")), mean, by=["k"], on="day", take=["level"])
    return met.where("level_right is not null").select("day", F.round(percent_change(F.col("now"), F.col("then")), 6).alias("return_30"), F.round("level_right", 4).alias("level"))


#: Weights of the linear model with momentum, its centres and slopes.
FIXED_LINE = {"current_price": -0.0038, "eps_estimate": 0.0399, "eps_actual": 0.0450, "pe_ratio": 0.0210, "eps_next": 0.0287, "volume_ratio": 1.5333, "sentiment": 3.1723, "dividend_yield": -0.2342, "forward_pe": 0.0098}
FIXED_MOMENTUM = {"price_to_ma30": (1.0, 5.0), "rsi14": (50.0, 0.05), "macd": (0.0, 0.3), "volatility30": (0.0, -0.2), "return_30d": (0.0, 0.15), "spx_return_7d": (0.0, 0.25), "vix_close": (20.0, -0.05)}


def fixed_line(values: dict, momentum: dict):
    """Terms that are there; a missing one, or a momentum value of 0, adds nothing."""
    total = sum((F.coalesce(values[c] * w, F.lit(0.0)) for c, w in FIXED_LINE.items() if c in values), F.lit(0.0))
    return sum((F.coalesce((F.nullif(momentum[c], F.lit(0.0)) - m) * w, F.lit(0.0)) for c, (m, w) in FIXED_MOMENTUM.items() if c in momentum), total)


@query("V20_fixed_line_with_momentum", "select filing_id, round(value / 1e3 * -0.0038 + concern * 0.0450 + sentiment * 3.1723 + case when predicted <> 0 then predicted * 0.3 else 0 end + case when concern <> 0 then (concern - 20) * -0.05 else 0 end, 12) as score from filing")
def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fixed_line({"current_price": F.col("value") / 1e3, "eps_actual": F.col("concern"), "sentiment": F.col("sentiment")}, {"macd": F.col("predicted"), "vix_close": F.col("concern")})
    return B.filings(spark, sf_dir).select("filing_id", F.round(line, 12).alias("score"))


@query("M5_least_squares", "select round(b, 8) as slope, round(a, 8) as intercept from (select ((count(*) + 0.01) * sum(predicted * actual) - sum(predicted) * sum(actual)) / ((count(*) + 0.01) * (sum(predicted * predicted) + 0.01) - sum(predicted) * sum(predicted)) as b, ((sum(predicted * predicted) + 0.01) * sum(actual) - sum(predicted) * sum(predicted * actual)) / ((count(*) + 0.01) * (sum(predicted * predicted) + 0.01) - sum(predicted) * sum(predicted)) as a from filing)")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with an intercept and a penalty of 0.01 on both."""
    rows = B.filings(spark, sf_dir).withColumns({"one": F.lit(1.0), "all": F.lit("all")})
    made = scoring.ridge_by(rows, ["predicted", "one"], "actual", ["all"], penalty=0.01)
    return made.select(F.round(F.col("beta")[0], 8).alias("slope"), F.round(F.col("beta")[1], 8).alias("intercept"))


@query("M17_segment_refits", "select status, count(*) as n, round(sum(predicted * actual) / (sum(predicted * predicted) + 100), 8) as beta from filing group by 1 having count(*) >= 10")
def refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ridge_by(B.filings(spark, sf_dir), ["predicted"], "actual", ["status"], least=10).select("status", "n", F.round(F.col("beta")[0], 8).alias("beta"))


@query("M11_r_squared", "select round(1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual), 8) as r2, round(avg(cast(sign(predicted) = sign(actual) as double)), 8) as direction from filing")
def r_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.operators.aggregates import r_squared as r2

    return rounded(B.filings(spark, sf_dir).agg(r2(F.col("predicted"), F.col("actual")).alias("r2"), F.avg((F.signum("predicted") == F.signum("actual")).cast("double")).alias("direction")), 8)


@query("T10s_mark_to_market", ", last as (select ticker, max_by(close, day) as price from price group by 1) select filing_id, round(case when predicted > 0 then price * 10 - value / 100 else value / 100 - price * 10 end, 6) as unrealised from filing join last on last.ticker = company_id % (select count(*) from supplier) where status = 'O'")
def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.plans.portfolio import marked as mark

    n = B.table(spark, sf_dir, "supplier").count()
    trades = B.filings(spark, sf_dir).select("filing_id", (F.col("company_id") % n).alias("ticker"), F.when(F.col("predicted") > 0, "LONG").otherwise("SHORT").alias("direction"), F.lit(10).alias("shares"), (F.col("value") / 100).alias("entry_value"), F.when(F.col("status") == "O", "OPEN").otherwise("CLOSED").alias("status"))
    return mark(trades, B.prices(spark, sf_dir)).select("filing_id", F.round("unrealised", 6).alias("unrealised"))


SENTENCES = "'Some of the following may happen. ' || repeat('Prices move. ', 30) || filing_id"


@query("F6_V13_sections", f"select filing_id, case when filing_id % 4 <> 0 then {SENTENCES} end as risks, case when filing_id % 5 <> 0 then repeat('Sales rose. ', 25) || 'It went on' end as discussion from filing")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sections of a filing; the headings in its table of contents are passed over, and some filings lack one."""
    from finlark.plans.market_state import once, section

    k = F.col("filing_id")
    contents = F.lit("Contents\nItem 1A. Risk Factors ......... 7\nItem 7. Management's Discussion and Analysis ......... 20\n")
    risks = F.when(k % 4 != 0, F.concat(F.lit("Item 1A. Risk Factors\n"), F.lit("Some of the following may happen. "), F.repeat(F.lit("Prices move. "), 30), k)).otherwise("Item 1A. None")
    talk = F.when(k % 5 != 0, F.concat(F.lit("\nItem 7. Management's Discussion and Analysis\n"), F.repeat(F.lit("Sales rose. "), 25), F.lit("It went on"))).otherwise("\nItem 7. None")
    text = F.concat(contents, risks, F.lit("\nItem 2. Properties. None."), talk, F.lit("\nItem 8. Statements."))
    both = once(text, lambda t: F.struct(section(t, "risk_factors").alias("risks"), section(t, "discussion").alias("discussion")))  # the text is put together once
    found = B.filings(spark, sf_dir).select("filing_id", both.alias("s")).select("filing_id", "s.risks", "s.discussion")
    heading = r"(?is)^\s*(?:of financial condition|and analysis)\s*"
    return found.withColumn("discussion", F.regexp_replace("discussion", heading, ""))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job runs: views have started and not ended, errors have failed, the rest took their value in minutes."""
    rows = B.activity(spark, sf_dir)
    status = F.when(F.col("action") == "view", "running").when(F.col("action") == "error", "failed").otherwise("success")
    done = F.when(F.col("action") != "view", F.timestamp_micros(F.unix_micros("ts") + F.floor("value") * 60_000_000))
    return rows.select("event_id", (F.col("company_id") % 12).cast("string").alias("job_name"), status.alias("status"), F.col("ts").alias("started_at"), done.alias("completed_at"), F.lit(None).cast("string").alias("error_message"))


@query("T4s_stuck_runs", "select event_id, case when action = 'view' and ts < timestamp '2024-01-30 23:50:00' then 'failed' when action = 'view' then 'running' when action = 'error' then 'failed' else 'success' end as status from activity")
def stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.streaming.jobs import with_stuck_failed

    return with_stuck_failed(runs(spark, sf_dir), "2024-01-31 00:00:00").select("event_id", "status")


@query("T5s_freshness", ", r as (select cast(company_id % 12 as varchar) as job_name, max(case when action not in ('view', 'error') then ts + to_minutes(cast(floor(value) as int)) end) as last_success from activity group by 1) select job_name, last_success, coalesce(epoch_us(timestamp '2024-01-31 06:00:00') - epoch_us(last_success) > case job_name when '3' then 48 else 7 end * 3600000000, true) as stale from r")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.streaming.jobs import stale

    return stale(runs(spark, sf_dir), "2024-01-31 06:00:00", {"3": 48}, default=7).select("job_name", "last_success", "stale")


@query("K3_K10_filtered_page", "select filing_id, value, count(*) over () as total_count from filing where filing_type <> '8-K' and concern > 5 order by value desc, filing_id limit 50 offset 100")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.plans.screener import paged

    rows = B.filings(spark, sf_dir).where("filing_type <> '8-K' and concern > 5")
    return paged(rows, [F.col("value").desc(), F.col("filing_id")], 3).select("filing_id", "value", "total_count")


@query("K8_largest_and_smallest", "select filing_type, list_sort(list(actual))[-3:][::-1] as largest, list_sort(list(actual))[1:3] as smallest from filing group by 1".replace("list_sort(list(actual))[-3:][::-1]", "list_reverse_sort(list(actual))[1:3]"))
def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each end by type, ranked with a limit that Spark applies before the shuffle too."""
    rows = B.filings(spark, sf_dir).select("filing_type", "actual", "filing_id")

    def three(order, name: str) -> DataFrame:
        w = Window.partitionBy("filing_type").orderBy(order, "filing_id")
        kept = rows.withColumn("k", F.row_number().over(w)).where("k <= 3")
        return kept.groupBy("filing_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "actual"))), lambda x: x["actual"]).alias(name))

    return three(F.col("actual").desc(), "largest").join(three(F.col("actual").asc(), "smallest"), "filing_type")


@query("M14_factor_flags", "select filing_id, concern between 5 and 10 as some_short, concern * 2 > 15 as much_short, confidence < 0.8 as quiet, confidence * 2 > 1.3 as busy, concern * 2 > 15 and confidence * 2 > 1.3 as suspicious from filing")
def factor_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v = F.col("concern"), F.col("confidence")
    much, busy = c * 2 > 15, v * 2 > 1.3
    return B.filings(spark, sf_dir).select("filing_id", c.between(5, 10).alias("some_short"), much.alias("much_short"), (v < 0.8).alias("quiet"), busy.alias("busy"), (much & busy).alias("suspicious"))


@query("F41_guidance_shift", "select filing_id, round((predicted + 8 - actual - 8.5) * 100 / nullif(actual + 8.5, 0), 6) as delta, case when (predicted + 8 - actual - 8.5) * 100 / nullif(actual + 8.5, 0) > 1 then 'up' when (predicted + 8 - actual - 8.5) * 100 / nullif(actual + 8.5, 0) < -1 then 'down' else 'flat' end as shift from filing")
def guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of the guidance against the consensus, in per cent; over 1 either way is a shift."""
    middle, consensus = F.col("predicted") + 8, F.col("actual") + 8.5
    delta = percent_change(middle, consensus)
    return B.filings(spark, sf_dir).select("filing_id", F.round(delta, 6).alias("delta"), F.when(delta > 1, "up").when(delta < -1, "down").otherwise("flat").alias("shift"))
