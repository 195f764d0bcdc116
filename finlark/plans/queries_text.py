"""Registered text, date, number and JSON functions (F), and content predicates (P15 to P17), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.functions import math as M
from finlark.functions import text as X
from finlark.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def on_filings(name: str, columns: Callable[..., dict[str, Column]], sql: dict[str, str]) -> None:
    """columns: of the filings' value, predicted, actual, sentiment and day."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = columns(*map(F.col, ("value", "predicted", "actual", "sentiment")), F.col("filing_date").cast("date"))
        return B.filings(spark, sf_dir).select("filing_id", *[c.alias(n) for n, c in made.items()])

    QUERIES[name], SQL[name] = run, B.WITH + " select filing_id, " + ", ".join(f"{e} as {n}" for n, e in sql.items()) + " from filing"


def on_table(name: str, source: str, key: str, columns: dict[str, Callable[[], Column]], sql: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return B.table(spark, sf_dir, source).select(key, *[c().alias(n) for n, c in columns.items()])

    QUERIES[name], SQL[name] = run, f"select {key}, " + ", ".join(f"{e} as {n}" for n, e in sql.items()) + f" from {source}"


on_filings("F1_F2_F3_identifiers", lambda v, p, a, s, day: {"cik": X.cik10(F.col("company_id").cast("string")), "acc": X.accession(F.lpad(F.col("filing_id").cast("string"), 18, "7"))}, {"cik": "lpad(cast(company_id as varchar), 10, '0')", "acc": "regexp_replace(lpad(cast(filing_id as varchar), 18, '7'), '^(\\d{10})(\\d{2})(\\d+)$', '\\1-\\2-\\3')"})
on_filings("F4_url_basename", lambda v, p, a, s, day: {"url": X.filing_url(F.lpad(F.col("company_id").cast("string"), 10, "0"), F.lit("0000000001-22-000003"), F.lit("a.htm")), "base": X.basename(F.concat(F.lit("x/y/"), F.col("filing_id").cast("string")))}, {"url": "'https://www.sec.gov/Archives/edgar/data/' || company_id || '/000000000122000003/a.htm'", "base": "cast(filing_id as varchar)"})
on_filings("F11_percent_number", lambda v, p, a, s, day: {"n": X.percent_number(F.concat(F.lit("+"), F.col("confidence").cast("string"), F.lit("%"))), "none": X.percent_number(F.lit("n/a"))}, {"n": "confidence", "none": "cast(null as double)"})
on_filings("F13_visitor_id", lambda v, p, a, s, day: {"id": X.visitor_id(F.col("filing_id").cast("string"), F.lit("agent"), F.lit("en"))}, {"id": "sha256(filing_id || '|agent|en')"})
on_filings("F10_title_case", lambda v, p, a, s, day: {"t": X.title_case(F.lit("concern_level"))}, {"t": "'Concern Level'"})
on_filings("F12_short_number", lambda v, p, a, s, day: {"t": X.short_number(F.floor(v).cast("double") * 1000 + 1)}, {"t": "case when floor(value) * 1000 >= 1e9 then printf('%.2fB', (floor(value) * 1000 + 1) / 1e9) when floor(value) * 1000 >= 1e6 then printf('%.2fM', (floor(value) * 1000 + 1) / 1e6) else printf('%.2fK', (floor(value) * 1000 + 1) / 1e3) end"})
on_filings("F20_F22_dates", lambda v, p, a, s, day: {"back": F.date_sub(day, 30), "q": X.quarter_label(day), "doy": F.dayofyear(day), "weekday": X.is_weekday(day)}, {"back": "cast(filing_date as date) - 30", "q": "'Q' || quarter(filing_date) || ' ' || year(filing_date)", "doy": "dayofyear(filing_date)", "weekday": "isodow(filing_date) < 6"})
on_filings("F21_quarter_range", lambda v, p, a, s, day: {"first": X.quarter_range(F.year(day), F.quarter(day))[0], "past": X.quarter_range(F.year(day), F.quarter(day))[1]}, {"first": "cast(date_trunc('quarter', filing_date) as date)", "past": "cast(date_trunc('quarter', filing_date) + interval 3 month as date)"})
on_filings("F23_whole_days", lambda v, p, a, s, day: {"d": X.whole_days(F.lit("2001-08-01 12:00:00").cast("timestamp"), F.col("filing_date").cast("timestamp"))}, {"d": "cast(floor((epoch(timestamp '2001-08-01 12:00:00') - epoch(filing_date)) / 86400) as bigint)"})
on_filings("F25_epoch_guard", lambda v, p, a, s, day: {"d": X.epoch_date(F.col("filing_id") * 1_000_000).cast("date")}, {"d": "case when year(to_timestamp(filing_id * 1000000)) between 1970 and 2100 then cast(to_timestamp(filing_id * 1000000) as date) end"})
on_filings("F30_surprise", lambda v, p, a, s, day: {"x": F.round(M.surprise_percent(a, s), 6)}, {"x": "round(greatest(-1000, least(1000, case when sentiment = 0 then actual * 100 else (actual - sentiment) * 100 / abs(sentiment) end)), 6)"})
on_filings("F31_F32_classes", lambda v, p, a, s, day: {"c": M.surprise_class(p), "m": M.surprise_size(p)}, {"c": "case when predicted > 2 then 'beat' when predicted < -2 then 'miss' else 'inline' end", "m": "case when abs(predicted) >= 20 then 'massive' when abs(predicted) >= 10 then 'large' when abs(predicted) >= 5 then 'moderate' when abs(predicted) >= 2 then 'small' else 'inline' end"})
on_filings("F33_winsorised", lambda v, p, a, s, day: {"x": M.winsorised(F.nullif(p * 10, F.lit(0.0)))}, {"x": "case when predicted = 0 then 0 else least(50, greatest(-50, predicted * 10)) end"})
on_filings("F34_cap_tiers", lambda v, p, a, s, day: {"t": M.cap_tier(v * 1e6), "e": M.cap_tier_export(v * 1e6), "c": M.cap_category(v * 1e6)}, {"t": "case when value >= 200000 then 'mega' when value >= 10000 then 'large' when value >= 2000 then 'mid' else 'small' end", "e": "case when value >= 500000 then 'mega' when value >= 200000 then 'large' when value >= 50000 then 'mid' else 'small' end", "c": "case when value < 10000 then 'microCap' when value < 200000 then 'smallCap' when value < 500000 then 'largeCap' else 'megaCap' end"})
on_filings("F36_consensus", lambda v, p, a, s, day: {"x": M.consensus_score(*[(F.col("filing_id") + i) % (5 + i) for i in range(5)])}, {"x": "floor((100.0 * (filing_id % 5) + 75.0 * ((filing_id + 1) % 6) + 50.0 * ((filing_id + 2) % 7) + 25.0 * ((filing_id + 3) % 8)) / nullif(filing_id % 5 + (filing_id + 1) % 6 + (filing_id + 2) % 7 + (filing_id + 3) % 8 + (filing_id + 4) % 9, 0) + 0.5)"})
on_filings("F37_F38_upside_rounding", lambda v, p, a, s, day: {"u": F.round(M.percent_change(v, v - p), 6), "h": M.half_up(p * 2) / 2}, {"u": "round((value - (value - predicted)) * 100 / (value - predicted), 6)", "h": "floor(predicted * 2 + 0.5) / 2"})
on_filings("F39_yield_curve", lambda v, p, a, s, day: {"c": M.yield_curve(p, a), "d": M.change_bps(p, a)}, {"c": "floor((predicted - actual) * 1000 + 0.5) / 1000", "d": "floor((predicted - actual) * 1000 + 0.5) / 10"})
on_filings("F42_abnormal", lambda v, p, a, s, day: {"x": F.round(M.abnormal_return(a, p, F.nullif(s, F.lit(0.0))), 6)}, {"x": "round(actual - coalesce(nullif(sentiment, 0), 1) * predicted, 6)"})
on_filings("F45_F49_ladders", lambda v, p, a, s, day: {"m": M.pe_multiplier(F.col("concern") * 5), "c": M.confidence_number(F.when(F.col("confidence") > 0.9, "high").when(F.col("confidence") > 0.7, "medium"))}, {"m": "case when concern * 5 < 15 then 0.8 when concern * 5 < 25 then 1.0 when concern * 5 < 40 then 1.2 else 1.5 end::double", "c": "case when confidence > 0.9 then 0.85 when confidence > 0.7 then 0.65 else 0.5 end::double"})
on_filings("F46_F47_trades", lambda v, p, a, s, day: {"size": M.position_value(F.col("confidence"), p, F.lit(0.05)), "pnl": F.round(M.trade_pnl(F.when(p > 0, "LONG").otherwise("SHORT"), v, v + a, F.lit(2.0)), 6)}, {"size": "least(confidence * abs(predicted) / 100, 0.05)", "pnl": "round(case when predicted > 0 then value + actual - value else value - (value + actual) end - 2, 6)"})

html = lambda: F.col("html")
on_table("F5_html_tags", "pages", "page_id", {"title": lambda: F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), "scripts": lambda: F.regexp_count("html", F.lit("<script")), "bare": lambda: F.length(F.regexp_replace("html", "<[^>]+>", ""))}, {"title": "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)", "scripts": "len(regexp_extract_all(html, '<script'))", "bare": "length(regexp_replace(html, '<[^>]+>', '', 'g'))"})
ENT = "regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis')"
for entity, plain in X.ENTITIES:
    ENT = f"replace({ENT}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
for pattern, plain in (("<br\\s*/?>", "chr(10)"), ("</p>", "chr(10) || chr(10)"), ("</div>", "chr(10)"), ("<[^>]+>", "' '"), ("\\t", "' '"), (" {2,}", "' '"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\s+|\\s+$", "''")):
    ENT = f"regexp_replace({ENT}, '{pattern}', {plain}, 'gi')"
on_table("F5_html_text", "pages", "page_id", {"t": lambda: X.html_text(F.col("html"))}, {"t": ENT})
on_filings("F14_sector_name", lambda v, p, a, s, day: {"s": X.sector_name(F.when(F.col("status") == "F", "Financial Services").otherwise(F.col("status")))}, {"s": "case when status = 'F' then 'Financials' else status end"})
on_table("P17_keyword_any", "documents", "doc_id", {"hit": lambda: X.holds_any(F.col("text"), ["license", "token", "stupid"])}, {"hit": "contains(lower(text), 'license') or contains(lower(text), 'token') or contains(lower(text), 'stupid')"})
on_table("F8_event_kind", "conversations", "conv_id, turn".split(",")[0], {"turn_no": lambda: F.col("turn"), "kind": lambda: X.event_kind(F.col("text"))}, {"turn_no": "turn", "kind": "case when contains(lower(text), 'announcing') and contains(lower(text), 'earnings c') then '8-K-earnings-announcement' when contains(lower(text), 'item 2.02') and contains(lower(text), 'earnings') then '8-K-earnings-release' else '8-K-other' end"})
on_table("V12_keyword_risk", "documents", "doc_id", {"risk": lambda: X.keyword_risk(F.col("text"), ["risk", "trash", "worthless", "disgusting"])}, {"risk": "case when length(text) = 0 then null when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) = 0 then 5.0 else round(greatest(0.0, least(10.0, len(regexp_extract_all(lower(text), 'risk|trash|worthless|disgusting')) * 1000.0 / len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 10)), 1) end"})
on_table("F60_F61_json_path", "events", "event_id", {"k": lambda: F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)), "deep": lambda: F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.a.b", "int"), F.lit(0))}, {"k": "coalesce(cast(props->>'$.k' as int), -1)", "deep": "0"})
on_table("F62_F63_json_overlay", "events", "event_id", {"j": lambda: F.to_json(F.struct(F.from_json("props", "k int")["k"].alias("k"), F.when(F.col("value") > 50, F.lit("big")).alias("size")))}, {"j": "case when value > 50 then '{\"k\":' || (props->>'$.k') || ',\"size\":\"big\"}' else '{\"k\":' || (props->>'$.k') || '}' end"})
on_table("F64_F65_arrays", "conversations", "conv_id", {"turn_no": lambda: F.col("turn"), "first": lambda: F.array_join(F.slice(F.split("text", " "), 1, 3), " "), "found": lambda: F.try_element_at(F.filter(F.split("text", " "), lambda w: F.contains(w, F.lit("th"))), F.lit(1))}, {"turn_no": "turn", "first": "array_to_string(string_split(text, ' ')[1:3], ' ')", "found": "list_filter(string_split(text, ' '), lambda w: contains(w, 'th'))[1]"})
on_table("F67_first_object", "events", "event_id", {"o": lambda: X.first_object(F.concat(F.lit("before "), F.col("props"), F.lit(" after")))}, {"o": "props"})
on_table("P15_P16_content", "events", "event_id", {"has": lambda: (F.col("event_type") != "view") | (F.from_json("props", "k int")["k"] > 50)}, {"has": "event_type <> 'view' or cast(props->>'$.k' as int) > 50"})
