"""The star-schema tables in the roles of the filing and market tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Companies: customers with metrics derived from their key and balance. Both engines read these expressions.
COMPANY = {
    "company_id": "c_custkey",
    "ticker": "concat('T', cast(c_custkey as varchar(20)))",
    "name": "c_name",
    "sector": "c_mktsegment",
    "nation": "n_name",
    "market_cap": "c_acctbal * 1e7",
    "current_price": "case when c_acctbal > 0 then c_acctbal / 1.6e1 end",
    "analyst_target_price": "case when c_custkey % 6 <> 0 then abs(c_acctbal) / 1.6e1 * (7.5e-1 + (c_custkey % 5) * 1.25e-1) end",
    "pe_ratio": "case when c_custkey % 5 <> 0 then cast(c_custkey % 45 as double) end",
    "dividend_yield": "case when c_custkey % 4 <> 0 then (c_custkey % 9) / 1.28e2 end",
    "beta": "case when c_custkey % 7 <> 0 then (c_custkey % 23) / 8e0 end",
    "latest_revenue_yoy": "cast(c_custkey % 50 - 10 as double)",
    "latest_net_income": "(c_acctbal - 1e3) * 1e6",
    "latest_operating_margin": "(c_custkey % 31) / 6.4e1",
    "fifty_two_week_high": "abs(c_acctbal) / 1.6e1 * (1e0 + (c_custkey % 8) / 6.4e1)",
    "fifty_two_week_low": "abs(c_acctbal) / 1.6e1 * 5e-1",
}

FILING = {
    "filing_id": "o_orderkey",
    "company_id": "o_custkey",
    "filing_date": "o_orderdate",
    "filing_type": "case when o_orderpriority like '1%' then '10-K' when o_orderpriority like '2%' or o_orderpriority like '3%' then '10-Q' else '8-K' end",
    "status": "o_orderstatus",
    "sentiment": "((o_orderkey * 37) % 201 - 100) / 1.28e2",
    "concern": "((o_orderkey * 53) % 101) / 1e1",
    "predicted": "((o_orderkey * 7919) % 2001 - 1000) / 1.28e2",
    "actual": "((o_orderkey * 10473) % 2001 - 1000) / 1.28e2",
    "confidence": "((o_orderkey * 31) % 100) / 1e2",
    "value": "o_totalprice",
}

PRICE_SQL = """
    select l_suppkey as ticker, cast(l_shipdate as date) as date,
        {day} as day,
        max_by(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) as close,
        max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low, sum(l_quantity) as volume
    from lineitem group by all"""

COMPANY_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in COMPANY.items()) + " from customer join nation on c_nationkey = n_nationkey"
FILING_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in FILING.items()) + ", datediff('day', date '1970-01-01', cast(o_orderdate as date)) as day from orders"

WITH = f"with company as ({COMPANY_SQL}), filing as ({FILING_SQL}), price as ({PRICE_SQL.format(day="datediff('day', date '1970-01-01', cast(l_shipdate as date))")}), activity as (select event_id, user_id as company_id, ts, event_type as action, value, cast(floor(epoch(ts) / 3600) as bigint) as hour from events)"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return joined.select(*[F.expr(e.replace("cast(c_custkey as varchar(20))", "cast(c_custkey as string)")).alias(c) for c, e in COMPANY.items()])


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*[F.expr(e).alias(c) for c, e in FILING.items()], F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier and ship date: the last sale's unit price as close, the range, and the volume."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.max_by(unit, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume"))
        .withColumn("day", F.unix_date("date"))
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst events: company_id, ts, action, value and the hour as a number."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("company_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("bigint").alias("hour"))
