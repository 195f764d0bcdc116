"""Readers and writers of market data: price charts, price CSVs, rate series, quotes, analyst histories, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.sources.xml import elements

CHART = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>>>>"


def chart(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices from chart files; days without an open or close fall away."""
    r = spark.read.schema(CHART).option("multiLine", True).json(path).select(F.explode("chart.result").alias("r"))
    q = F.element_at("r.indicators.quote", 1)
    zipped = F.arrays_zip(F.col("r.timestamp").alias("ts"), *[q[c].alias(c) for c in ("open", "high", "low", "close", "volume")])
    return r.select(F.upper("r.meta.symbol").alias("ticker"), F.inline(zipped)).dropna(subset=["open", "close"]).withColumn("date", F.timestamp_seconds("ts").cast("date")).drop("ts")


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded price tables; rows whose close is missing fall away."""
    rows = spark.read.csv(path, header=True, schema="Date date, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint", nullValue="null", ignoreLeadingWhiteSpace=True)
    return rows.dropna(subset=["Close"]).toDF("date", "open", "high", "low", "close", "adj_close", "volume")


def rates(spark: SparkSession, path: str) -> DataFrame:
    """series, date and value from observation files; a lone point is no value."""
    raw = spark.read.schema("series_id string, observations array<struct<date:string,value:string>>").option("multiLine", True).json(path)
    return raw.select("series_id", F.inline("observations")).select(F.col("series_id").alias("series"), F.to_date("date").alias("date"), F.nullif("value", F.lit(".")).try_cast("double").alias("value"))


QUOTE = "symbol string, regularMarketPrice double, marketCap double, trailingPE double, forwardPE double, dividendYield double, beta double, fiftyTwoWeekHigh double, fiftyTwoWeekLow double, targetMeanPrice double, regularMarketVolume bigint"


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of quotes; the yield comes in per cent and leaves as a share."""
    raw = spark.read.schema(QUOTE).json(path)
    return raw.select(F.upper("symbol").alias("ticker"), F.col("regularMarketPrice").alias("current_price"), F.col("marketCap").alias("market_cap"), F.col("trailingPE").alias("pe_ratio"), F.col("forwardPE").alias("forward_pe"), (F.col("dividendYield") / 100).alias("dividend_yield"), "beta", F.col("fiftyTwoWeekHigh").alias("fifty_two_week_high"), F.col("fiftyTwoWeekLow").alias("fifty_two_week_low"), F.col("targetMeanPrice").alias("analyst_target_price"), F.col("regularMarketVolume").alias("volume"))


HISTORY = "symbol string, upgradeDowngradeHistory struct<history:array<struct<epochGradeDate:bigint,firm:string,toGrade:string,fromGrade:string,action:string>>>, earningsHistory struct<history:array<struct<quarter:bigint,epsActual:double,epsEstimate:double>>>"


def analyst_events(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(HISTORY).json(path)
    return raw.select(F.col("symbol").alias("ticker"), F.inline("upgradeDowngradeHistory.history")).withColumn("activity_date", F.timestamp_seconds("epochGradeDate")).drop("epochGradeDate")


def earnings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(HISTORY).json(path)
    return raw.select(F.col("symbol").alias("ticker"), F.inline("earningsHistory.history")).withColumn("period_end", F.timestamp_seconds("quarter").cast("date")).drop("quarter")


def news(spark: SparkSession, path: str) -> DataFrame:
    """Titles of RSS items, split into title and publisher at the first dash between spaces. Files are read in splits, an item a row."""
    item = elements(spark, path, "item", "title string, link string").where("corrupt is null")
    part = lambda k: F.coalesce(F.regexp_extract("title", r"^(.+?)\s*-\s*(.+?)$", k), F.lit(""))
    return item.select(part(1).alias("title"), part(2).alias("publisher"), F.coalesce("link", F.lit("")).alias("link"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; '', null and undefined are null. Without a schema the types are inferred in a further pass."""
    rows = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None, nullValue="", escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    missing = ["null", "undefined"]
    return rows.select(*[F.when(~F.col(c).isin(missing), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    """Header, empty for null, quotes doubled, booleans as 1 and 0."""
    plain = rows.select(*[F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in rows.dtypes])
    plain.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def describe(rows: DataFrame, date: str, buckets: dict[str, str]) -> DataFrame:
    """One row of metadata: number of rows, first and last date, and the size of each bucket (a condition by name)."""
    return rows.agg(F.count("*").alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"), F.struct(*[F.count_if(F.expr(c)).alias(n) for n, c in buckets.items()]).alias("buckets"))


RECORD = "\x1e"
SERIES = "struct<`Meta Data`:struct<`2. Symbol`:string>,`Time Series (Daily)`:map<string,struct<`1. open`:string,`2. high`:string,`3. low`:string,`4. close`:string,`5. volume`:string>>>"


def daily_series(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices from time-series objects with their days as keys; those with an error message give no rows.

    A file holds one object, or many as a JSON text sequence (RFC 7464): apart by RECORD, which no JSON text may
    contain as it is. So symbols need no files of their own, of which opening and listing cost more than what is in them.
    """
    doc = F.from_json("value", SERIES)
    raw = spark.read.option("lineSep", RECORD).text(path).select(doc.alias("d"))
    days = raw.select(F.upper(F.col("d.Meta Data").getField("2. Symbol")).alias("ticker"), F.explode(F.col("d.Time Series (Daily)")).alias("day", "p"))
    at = lambda name, kind: F.col("p").getField(name).try_cast(kind)
    return days.select("ticker", F.to_date("day").alias("date"), at("1. open", "double").alias("open"), at("2. high", "double").alias("high"), at("3. low", "double").alias("low"), at("4. close", "double").alias("close"), at("5. volume", "bigint").alias("volume"))
