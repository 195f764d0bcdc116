"""Registered readers and writers: tables are landed in the sources' formats and read again; the SQL says what has to come back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.plans import bindings as B
from finlark.sources import days, filings, market
from finlark.streaming.ingest import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = run, B.WITH + sql
        return run

    return register


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


def land(texts: DataFrame, alone: bool = False, between: str = "\n") -> str:
    """Rows of one text column as files, with ``between`` after each; each row a file of its own if asked."""
    path = folder(texts.sparkSession)
    texts.write.option("maxRecordsPerFile", 1 if alone else 0).option("lineSep", between).text(path)
    return path


BUNDLE = 500  # items a document


def parts_of(rows: DataFrame, key: str) -> Column:
    """The document of a row, so that one has about BUNDLE rows however many there are."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // BUNDLE))))


def gathered(rows: DataFrame, item: Column, key: str) -> DataFrame:
    """JSON arrays of ``item``, a row for each of some parts of the keys."""
    return rows.groupBy(parts_of(rows, key)).agg(F.to_json(F.collect_list(item)).alias("value")).select("value")


def accession(company: Column, filing: Column) -> Column:
    return F.concat_ws("-", F.lpad(company.cast("string"), 10, "0"), F.lit("25"), F.lpad((filing % 1000000).cast("string"), 6, "0"))


ACCESSION = "lpad(company_id::varchar, 10, '0') || '-25-' || lpad((filing_id % 1000000)::varchar, 6, '0')"
URL = "'https://www.sec.gov/Archives/edgar/data/' || company_id || '/' || lpad(company_id::varchar, 10, '0') || '25' || lpad((filing_id % 1000000)::varchar, 6, '0')"


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies' submission documents, with their filings in parallel arrays."""
    rows = B.filings(spark, sf_dir).select("company_id", F.struct(
        accession(F.col("company_id"), F.col("filing_id")).alias("accessionNumber"), F.date_format("filing_date", "yyyy-MM-dd").alias("filingDate"), F.when(F.col("filing_id") % 3 == 0, "").otherwise(F.date_format("filing_date", "yyyy-MM-dd")).alias("reportDate"),
        F.col("filing_type").alias("form"), F.concat(F.lit("d"), "filing_id", F.lit(".htm")).alias("primaryDocument"),
    ).alias("f")).groupBy("company_id").agg(F.collect_list("f").alias("f"))
    recent = F.struct(*[F.col(f"f.{c}").alias(c) for c in filings.RECENT])
    named = rows.join(B.companies(spark, sf_dir).select("company_id", "ticker", "name"), "company_id")
    doc = F.struct(F.col("company_id").cast("string").alias("cik"), "name", F.array("ticker").alias("tickers"), F.struct(recent.alias("recent")).alias("filings"))
    return gathered(named, doc, "company_id")


@query("S5_S6_submissions", f"select lpad(company_id::varchar, 10, '0') as cik, name, ticker, {ACCESSION} as accession_number, cast(filing_date as date) as filing_date, case when filing_id % 3 <> 0 then cast(filing_date as date) end as report_date, filing_type, {URL} || '/d' || filing_id || '.htm' as filing_url from filing join company using (company_id) where filing_type in ('10-K', '10-Q') and filing_date >= date '1996-01-01'")
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of documents with a broken file among them, which gives no rows."""
    broken = spark.range(1).select(F.lit("{broken").alias("value"))
    return filings.submissions(spark, land(submitted(spark, sf_dir).unionByName(broken), alone=True), ["10-K", "10-Q"], "1996-01-01")


@query("S7_feed", f"select filing_type, name as company_name, lpad(company_id::varchar, 10, '0') as cik, {ACCESSION} as accession_number, cast(filing_date as date) as filing_date, 'http://x/' || filing_id as filing_url from filing join company using (company_id)")
def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = B.filings(spark, sf_dir).join(B.companies(spark, sf_dir).select("company_id", "name"), "company_id")
    entry = F.concat(F.lit("<entry><title>"), "filing_type", F.lit(" - "), "name", F.lit(" ("), F.lpad(F.col("company_id").cast("string"), 10, "0"), F.lit(") (Filer)</title><updated>"), F.date_format("filing_date", "yyyy-MM-dd"), F.lit('T06:01:26-04:00</updated><link rel="alternate" href="http://x/'), "filing_id", F.lit('"/><id>urn:'), accession(F.col("company_id"), F.col("filing_id")), F.lit("</id></entry>"))
    # Entries without a company are passed over.
    odd = spark.range(3).select(F.lit("<entry><title>odd</title></entry>").alias("value"))
    return filings.feed(spark, land(met.select(entry.alias("value")).unionByName(odd)))


@query("S8_daily_index", f"select lpad(company_id::varchar, 10, '0') as cik, name as company_name, filing_type, cast(filing_date as date) as filing_date, {ACCESSION} as accession_number, 'https://www.sec.gov/Archives/edgar/data/' || company_id || '/' || {ACCESSION} || '.txt' as filing_url from filing join company using (company_id)")
def daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = B.filings(spark, sf_dir).join(B.companies(spark, sf_dir).select("company_id", "name"), "company_id")
    number = accession(F.col("company_id"), F.col("filing_id"))
    line = F.concat_ws("|", F.col("company_id").cast("string"), "name", "filing_type", F.date_format("filing_date", "yyyyMMdd"), F.concat(F.lit("edgar/data/"), "company_id", F.lit("/"), number, F.lit(".txt")))
    head = spark.createDataFrame([("Description: daily index",), ("",), ("CIK|Company Name|Form Type|Date Filed|File Name",), ("-" * 40,), ("<html>an error page</html>",)], "value string")
    return filings.daily_index(spark, land(head.unionByName(met.select(line.alias("value")))))


CAUGHT_UP = f"""select cast(filing_date as date) as day, true as found, lpad(company_id::varchar, 10, '0') as cik, filing_type, {ACCESSION} as accession_number from filing where filing_date >= date '1996-01-01' and filing_date < date '1996-04-01' and isodow(filing_date) < 6 and month(filing_date) * day(filing_date) % 4 <> 0
union all select d, false, null, null, null from (select cast(unnest(generate_series(date '1996-01-01', date '1996-03-31', interval 1 day)) as date) as d) where isodow(d) < 6 and (month(d) * day(d) % 4 = 0 or d not in (select cast(filing_date as date) from filing))"""


@query("S9_index_days", CAUGHT_UP)
def index_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of the days of three months, of which some are missing, read by day; days without one come out as not found."""
    met = B.filings(spark, sf_dir).where("filing_date >= '1996-01-01' and filing_date < '1996-04-01'").join(B.companies(spark, sf_dir).select("company_id", "name"), "company_id")
    number = accession(F.col("company_id"), F.col("filing_id"))
    line = F.concat_ws("|", F.col("company_id").cast("string"), "name", "filing_type", F.date_format("filing_date", "yyyyMMdd"), F.concat(F.lit("edgar/data/"), "company_id", F.lit("/"), number, F.lit(".txt")))
    path = folder(spark)
    there = met.where(F.month("filing_date") * F.dayofmonth("filing_date") % 4 != 0)
    there.select(F.date_format("filing_date", "yyyyMMdd").alias("day"), line.alias("value")).repartition("day").write.partitionBy("day").text(path)
    lines = days.catch_up(spark, path, "1996-01-01", "1996-03-31", "day=%Y%m%d")
    rows = filings.index_rows(lines.where("found"), "day", "found").select("day", "found", "cik", "filing_type", "accession_number")
    return rows.unionByName(days.skipped(lines).withColumn("found", F.lit(False)), allowMissingColumns=True)


@query("S10_tickers", "select ticker, lpad(company_id::varchar, 10, '0') as cik, name as title from company")
def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.companies(spark, sf_dir)
    item = F.struct(F.col("company_id").cast("string"), F.struct(F.col("company_id").alias("cik_str"), F.lower("ticker").alias("ticker"), F.col("name").alias("title")))
    docs = rows.groupBy(parts_of(rows, "company_id")).agg(F.to_json(F.map_from_entries(F.collect_list(item))).alias("value")).select("value")
    return filings.tickers(spark, land(docs, alone=True))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact documents of the nations: orders and customers of each year, in two units."""
    rows = B.table(spark, sf_dir, "orders").join(B.table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    years = rows.groupBy(F.col("c_nationkey").alias("cik"), F.year("o_orderdate").alias("fy")).agg(F.count("*").cast("double").alias("n"), F.countDistinct("o_custkey").cast("double").alias("k"))
    value = lambda v: F.struct(F.concat("fy", F.lit("-12-31")).alias("end"), v.alias("val"), F.concat(F.lit("a"), "cik", F.lit("-"), "fy").alias("accn"), "fy", F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.concat(F.col("fy") + 1, F.lit("-02-01")).alias("filed"))
    each = years.groupBy("cik").agg(F.collect_list(value(F.col("n"))).alias("n"), F.collect_list(value(F.col("k"))).alias("k"))
    facts = F.create_map(F.lit("Revenues"), F.struct(F.lit("orders").alias("label"), F.create_map(F.lit("USD"), F.col("n"), F.lit("shares"), F.col("k")).alias("units")), F.lit("Assets"), F.struct(F.lit("customers").alias("label"), F.create_map(F.lit("USD"), F.col("k")).alias("units")))
    return each.select(F.to_json(F.struct("cik", F.struct(facts.alias("us-gaap")).alias("facts"))).alias("value"))


YEARS = ", y as (select c_nationkey as cik, year(o_orderdate) as fy, count(*)::double as n, count(distinct o_custkey)::double as k from orders join customer on o_custkey = c_custkey group by 1, 2), facts as (select cik, fy, 'Revenues' as concept, 'USD' as unit, n as val from y union all select cik, fy, 'Revenues', 'shares', k from y union all select cik, fy, 'Assets', 'USD', k from y)"


@query("S11_company_facts", YEARS + " select lpad(cik::varchar, 10, '0') as cik, concept, unit, fy::int as fy, val, 'a' || cik || '-' || fy as accn from facts")
def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.company_facts(spark, land(reported(spark, sf_dir), alone=True)).select("cik", "concept", "unit", "fy", "val", "accn")


@query("J27_year_on_year", YEARS + " select lpad(a.cik::varchar, 10, '0') as cik, a.concept, a.unit, a.fy::int as fy, round((a.val - b.val) / abs(b.val) * 100, 8) as yoy from facts a join facts b on a.cik = b.cik and a.concept = b.concept and a.unit = b.unit and b.fy = a.fy - 1 where b.val <> 0")
def year_on_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = filings.company_facts(spark, land(reported(spark, sf_dir), alone=True))
    return filings.year_on_year(facts).select("cik", "concept", "unit", "fy", F.round("yoy", 8).alias("yoy"))


@query("J28_J29_value_of_filing", YEARS + " select lpad(cik::varchar, 10, '0') as cik, 'a' || cik || '-' || fy as accn, coalesce(case when fy % 2 = 0 then null else n end, k) as val from y")
def value_of_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each filing one value a concept, the best unit's; then the first concept that is there, revenues only in odd years."""
    facts = filings.company_facts(spark, land(reported(spark, sf_dir), alone=True)).where("concept <> 'Revenues' or fy % 2 <> 0")
    wide = filings.fact_of_filing(facts).groupBy("cik", "accn").pivot("concept", ["Revenues", "Assets"]).agg(F.first("val"))
    return wide.select("cik", "accn", filings.concept_or(wide, ["Sales", "Revenues", "Assets"]).alias("val"))


@query("S12_F66_inline_facts", "select 'us-gaap:Revenues' as name, 'c' || filing_id as context, 'usd' as unit, 3 as scale, case when filing_id % 2 = 0 then -1 else 1 end * (filing_id + 1000) * 1000.0::double as value from filing union all select 'us-gaap:Assets', 'c' || filing_id, null, 0, case when filing_id % 5 <> 0 then (filing_id % 7 + 0.5)::double end from filing")
def inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("filing_id")
    page = F.concat(
        F.lit('<p>Sales of <ix:nonFraction name="us-gaap:Revenues" contextRef="c'), k, F.lit('" unitRef="usd" scale="3"'), F.when(k % 2 == 0, ' sign="-"').otherwise(""), F.lit(">"), F.format_number(k + 1000, 0), F.lit('</ix:nonFraction> and <ix:NONFRACTION NAME="us-gaap:Assets" contextRef="c'), k,
        F.lit('"><b>'), F.when(k % 5 == 0, "none").otherwise((k % 7 + F.lit(0.5)).cast("string")), F.lit("</b></ix:NONFRACTION></p>"),
    )
    return filings.inline_facts(spark, land(B.filings(spark, sf_dir).select(page.alias("value")))).select("name", "context", "unit", "scale", "value")


@query("S13_chart", "select upper('t' || ticker) as ticker, date, low as open, high, low, close, volume::bigint as volume from price where day % 10 <> 0")
def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without an open price fall away."""
    rows = B.prices(spark, sf_dir).withColumn("p", F.struct((F.col("day").cast("bigint") * 86400).alias("timestamp"), F.when(F.col("day") % 10 != 0, F.col("low")).alias("open"), "high", "low", "close", F.col("volume").cast("bigint").alias("volume")))
    each = rows.groupBy("ticker").agg(F.collect_list("p").alias("p"))
    quote = F.struct(*[F.col(f"p.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    item = F.struct(F.struct(F.concat(F.lit("t"), "ticker").alias("symbol")).alias("meta"), F.col("p.timestamp").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    docs = each.groupBy(parts_of(each, "ticker")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("value")).select("value")
    return market.chart(spark, land(docs, alone=True)).select("ticker", "date", "open", "high", "low", "close", "volume")


@query("S14_price_csv", "select date, low as open, high, low, close, close as adj_close, volume::bigint as volume from price where day % 9 <> 0")
def price_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = lambda c: F.when(F.col("day") % 9 != 0, F.col(c).cast("string")).otherwise("null")
    rows = B.prices(spark, sf_dir).select(F.col("date").alias("Date"), gone("low").alias("Open"), gone("high").alias("High"), gone("low").alias("Low"), gone("close").alias("Close"), gone("close").alias("Adj Close"), F.when(F.col("day") % 9 != 0, F.col("volume").cast("bigint").cast("string")).otherwise("null").alias("Volume"))
    path = folder(spark)
    rows.write.csv(path, header=True)
    return market.price_csv(spark, path)


@query("S15_rates", "select 'DGS' || ticker as series, date, case when day % 8 <> 0 then volume::double end as value from price")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.col("date").cast("string").alias("date"), F.when(F.col("day") % 8 != 0, F.col("volume").cast("string")).otherwise(".").alias("value"))
    each = B.prices(spark, sf_dir).groupBy("ticker").agg(F.collect_list(point).alias("observations"))
    doc = F.struct(F.concat(F.lit("DGS"), "ticker").alias("series_id"), "observations")
    return market.rates(spark, land(gathered(each, doc, "ticker"), alone=True))


@query("S16_quotes", "select ticker, current_price, market_cap, pe_ratio, round(dividend_yield, 10) as dividend_yield, beta, fifty_two_week_high, fifty_two_week_low, analyst_target_price from company")
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.companies(spark, sf_dir)
    doc = F.struct(F.lower("ticker").alias("symbol"), F.col("current_price").alias("regularMarketPrice"), F.col("market_cap").alias("marketCap"), F.col("pe_ratio").alias("trailingPE"), (F.col("dividend_yield") * 100).alias("dividendYield"), "beta", F.col("fifty_two_week_high").alias("fiftyTwoWeekHigh"), F.col("fifty_two_week_low").alias("fiftyTwoWeekLow"), F.col("analyst_target_price").alias("targetMeanPrice"))
    got = market.quotes(spark, land(rows.select(F.to_json(doc).alias("value"))))
    return got.select("ticker", "current_price", "market_cap", "pe_ratio", F.round("dividend_yield", 10).alias("dividend_yield"), "beta", "fifty_two_week_high", "fifty_two_week_low", "analyst_target_price")


HISTORIES = "select 'T' || company_id as ticker, "


def histories(spark: SparkSession, sf_dir: str) -> str:
    event = F.struct(F.floor(F.unix_micros("ts") / 1_000_000).alias("epochGradeDate"), F.concat(F.lit("firm "), "event_id").alias("firm"), F.col("action").alias("toGrade"), F.lit("Hold").alias("fromGrade"), F.lit("up").alias("action"))
    quarter = F.struct((F.unix_date(F.col("ts").cast("date")) * 86400).cast("bigint").alias("quarter"), F.col("value").alias("epsActual"), (F.col("value") / 2).alias("epsEstimate"))
    each = B.activity(spark, sf_dir).groupBy("company_id").agg(F.collect_list(event).alias("e"), F.collect_list(quarter).alias("q"))
    doc = F.struct(F.concat(F.lit("T"), "company_id").alias("symbol"), F.struct(F.col("e").alias("history")).alias("upgradeDowngradeHistory"), F.struct(F.col("q").alias("history")).alias("earningsHistory"))
    return land(each.select(F.to_json(doc).alias("value")))


@query("S17_analyst_events", HISTORIES + "'firm ' || event_id as firm, action as \"toGrade\", 'Hold' as \"fromGrade\", date_trunc('second', ts) as activity_date from activity")
def analyst_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.analyst_events(spark, histories(spark, sf_dir)).select("ticker", "firm", "toGrade", "fromGrade", "activity_date")


@query("S17_earnings", HISTORIES + "value as \"epsActual\", value / 2 as \"epsEstimate\", cast(ts as date) as period_end from activity")
def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.earnings(spark, histories(spark, sf_dir))


@query("S18_daily_series", "select 'T' || ticker as ticker, date, low as open, high, low, close, volume::bigint as volume from price")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    day = F.struct(text("low").alias("1. open"), text("high").alias("2. high"), text("low").alias("3. low"), text("close").alias("4. close"), F.col("volume").cast("bigint").cast("string").alias("5. volume"))
    each = B.prices(spark, sf_dir).groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), day))).alias("Time Series (Daily)"))
    docs = each.select(F.to_json(F.struct(F.struct(F.concat(F.lit("t"), "ticker").alias("2. Symbol")).alias("Meta Data"), "Time Series (Daily)")).alias("value"))
    failed = spark.range(1).select(F.lit('{"Error Message": "no such call"}').alias("value"))
    return market.daily_series(spark, land(docs.unionByName(failed), between=market.RECORD))


@query("S19_news", "select 'Filing ' || filing_id || ' of ' || filing_type as title, 'Paper ' || (filing_id % 7) as publisher, 'http://x/' || filing_id as link from filing")
def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The title ends at the first dash, so that of the form is written otherwise.
    title = F.concat(F.lit("Filing "), "filing_id", F.lit(" of "), F.replace("filing_type", F.lit("-"), F.lit("~")), F.lit(" - Paper "), F.col("filing_id") % 7)
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://x/"), "filing_id", F.lit("</link></item>"))
    return market.news(spark, land(B.filings(spark, sf_dir).select(item.alias("value")))).withColumn("title", F.replace("title", F.lit("~"), F.lit("-")))


@query("S20_S21_S22_csv", "select company_id, case when company_id % 3 = 0 then null else name || ', \"' || sector || '\"' end as name, market_cap, (company_id % 2)::int as odd, case when company_id % 4 = 0 then null else sector end as sector from company")
def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with quotes, commas, nulls and booleans, read again with inferred types."""
    k = F.col("company_id")
    rows = B.companies(spark, sf_dir).select("company_id", F.when(k % 3 != 0, F.concat("name", F.lit(', "'), "sector", F.lit('"'))).alias("name"), "market_cap", (k % 2 != 0).alias("odd"), F.when(k % 4 == 0, "undefined").otherwise(F.col("sector")).alias("sector"))
    path = folder(spark)
    market.write_csv(rows, path)
    return market.csv_table(spark, path).withColumn("company_id", F.col("company_id").cast("bigint"))
