"""Readers of filing archives: submissions, feeds, daily indexes, tickers, company facts.

Each reader takes a path (or a DataFrame of raw text) and declares its schema;
corrupt records give no rows. Fetching is left to whatever lands the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.functions.text import basename, cik10, filing_url
from finlark.sources.xml import elements

RECENT = ["accessionNumber", "filingDate", "reportDate", "form", "primaryDocument"]
SUBMISSIONS = f"cik string, name string, tickers array<string>, filings struct<recent:struct<{','.join(f'{c}:array<string>' for c in RECENT)}>>, _corrupt string"


def submissions(spark: SparkSession, path: str, forms: list[str] | None = None, since: str | None = None) -> DataFrame:
    """One row a filing, zipped from the parallel arrays of each company's file."""
    raw = spark.read.schema(SUBMISSIONS).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null")
    zipped = F.arrays_zip(*[F.col(f"filings.recent.{c}").alias(c) for c in RECENT])
    rows = raw.select("cik", "name", F.try_element_at("tickers", F.lit(1)).alias("ticker"), F.inline(zipped))
    rows = rows.where(F.col("form").isin(forms)) if forms else rows
    rows = rows.where(F.col("filingDate") >= since) if since else rows
    return rows.select(
        cik10(F.col("cik")).alias("cik"), "name", "ticker", F.col("accessionNumber").alias("accession_number"), F.to_date("filingDate").alias("filing_date"), F.to_date(F.nullif("reportDate", F.lit(""))).alias("report_date"),
        F.col("form").alias("filing_type"), filing_url(F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")).alias("filing_url"),
    )


ENTRY = "title string, updated string, id string, summary string, link array<struct<_href:string>>"


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of current-filings Atom files: form, company, cik, accession, filing date and link.

    Files are read in splits, an entry a row; entries that are no XML, and those whose title names no company, give no rows.
    """
    entry = elements(spark, path, "entry", ENTRY).where("corrupt is null")
    at = lambda k: F.regexp_extract("title", r"^([^-]+(?:-[A-Z0-9]+)?)\s+-\s+(.+?)\s*\((\d+)\)", k)
    link = F.coalesce(F.try_element_at("link", F.lit(1))["_href"], F.lit(""))
    number = F.nullif(F.regexp_extract(F.concat_ws(" ", "id", "summary", "title", link), r"(\d{10}-\d{2}-\d{6})", 1), F.lit(""))
    return entry.select(F.trim(at(1)).alias("filing_type"), at(2).alias("company_name"), cik10(at(3)).alias("cik"), number.alias("accession_number"), F.to_date(F.substring_index("updated", "T", 1)).alias("filing_date"), link.alias("filing_url"), at(3).alias("_cik")).where("_cik <> ''").drop("_cik")


def daily_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of daily form indexes: five fields between bars; header lines and error pages fall away."""
    return index_rows(spark.read.text(path))


def index_rows(lines: DataFrame, *beside: str) -> DataFrame:
    """The rows among the lines (value) of daily indexes, with the columns beside them."""
    part = F.split("value", r"\|")
    rows = lines.where((F.size(part) == 5) & F.col("value").rlike(r"^\d+\|"))
    return rows.select(*beside, cik10(part[0]).alias("cik"), part[1].alias("company_name"), part[2].alias("filing_type"), F.to_date(part[3], "yyyyMMdd").alias("filing_date"), F.replace(basename(part[4]), F.lit(".txt"), F.lit("")).alias("accession_number"), F.concat(F.lit("https://www.sec.gov/Archives/"), part[4]).alias("filing_url"))


def index_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The weekdays from first to last, for which there are indexes."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias("day")).where(F.weekday("day") < 5)


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik and title from the map of numbered objects."""
    raw = spark.read.option("wholetext", True).text(path)
    entries = F.from_json("value", "map<string,struct<cik_str:bigint,ticker:string,title:string>>")
    return raw.select(F.explode(F.map_values(entries)).alias("c")).select(F.upper("c.ticker").alias("ticker"), cik10(F.col("c.cik_str").cast("string")).alias("cik"), "c.title")


FACT = "array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>"


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row a reported value: cik, concept, unit, period and accession, with its place in the file."""
    raw = spark.read.option("wholetext", True).text(path)
    doc = F.from_json("value", f"cik bigint, facts struct<`us-gaap`:map<string,struct<label:string,units:map<string,{FACT}>>>>")
    concepts = raw.select(doc.alias("d")).where("d.cik is not null").select(cik10(F.col("d.cik").cast("string")).alias("cik"), F.explode(F.col("d.facts").getField("us-gaap")).alias("concept", "c"))
    units = concepts.select("cik", "concept", F.explode("c.units").alias("unit", "vals"))
    return units.select("cik", "concept", "unit", F.posexplode("vals").alias("place", "v")).select("cik", "concept", "unit", "place", "v.*")


#: Units in the order in which a value is looked for.
UNITS = ["USD", "shares", "pure"]


def fact_of_filing(facts: DataFrame) -> DataFrame:
    """One value a filing and concept: the best unit's first."""
    rank = F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col("unit"))
    return facts.where(rank > 0).groupBy("cik", "accn", "concept").agg(F.min_by("val", F.struct(rank.alias("rank"), F.col("place"))).alias("val"))


def year_on_year(facts: DataFrame) -> DataFrame:
    """Per cent against the same concept and fiscal period of the year before (its first value, if not 0)."""
    keys = ["cik", "concept", "unit", "fp"]
    one = facts.groupBy(*keys, "fy").agg(F.min_by("val", "place").alias("val"))
    before = one.select(*keys, (F.col("fy") + 1).alias("fy"), F.col("val").alias("before"))
    return one.join(before, [*keys, "fy"]).where("before <> 0").withColumn("yoy", (F.col("val") - F.col("before")) / F.abs("before") * 100)


def concept_or(values: DataFrame, concepts: list[str]) -> Column:
    """Of wide columns the first that is there."""
    return F.coalesce(*[F.col(c) for c in concepts if c in values.columns])


def inline_facts(spark: SparkSession, path: str) -> DataFrame:
    """file, name, context, unit, scale, sign and value of each tagged number of inline-tagged pages, in order of place. Values are scaled; what is no number is null."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    tags = raw.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<ix:nonFraction\b[^>]*>.*?</ix:nonFraction>"), F.lit(0))).alias("place", "tag"))
    at = lambda name: F.nullif(F.regexp_extract("tag", rf'(?i)\b{name}="([^"]*)"', 1), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("tag", r"(?is)^<ix:nonFraction\b[^>]*>(.*)</ix:nonFraction>$", 1), r"<[^>]*>", ""), r"[,\s]", "")
    scale = F.coalesce(at("scale").try_cast("int"), F.lit(0))
    value = body.try_cast("double") * F.pow(F.lit(10.0), scale) * F.when(at("sign") == "-", -1.0).otherwise(1.0)
    return tags.select("file", "place", at("name").alias("name"), at("contextRef").alias("context"), at("unitRef").alias("unit"), scale.alias("scale"), value.alias("value"))
