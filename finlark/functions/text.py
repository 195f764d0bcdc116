"""String, date and JSON column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def cik10(cik: Column) -> Column:
    return F.lpad(cik, 10, "0")


def accession(raw: Column) -> Column:
    """18 digits as 10-2-6."""
    return F.regexp_replace(raw, r"^(\d{10})(\d{2})(\d+)$", "$1-$2-$3")


def filing_url(cik: Column, accession_number: Column, document: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession_number, F.lit("-"), F.lit("")), F.lit("/"), document)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: Entities that are turned into text, in this order.
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def entities_as_text(text: Column) -> Column:
    """ENTITIES turned into text, as by one replacement after another; what follows each & is looked at once.

    An & that &amp; stands for may begin one of the entities behind it in the order.
    """
    at = ENTITIES.index(("&amp;", "&"))
    after = [(f"&amp;{entity[1:]}", value) for entity, value in ENTITIES[at + 1 :]]

    def replaced(part: Column) -> Column:
        found = F.concat(F.lit("&"), part)
        for entity, value in reversed([*ENTITIES[:at], *after, *ENTITIES[at:]]):
            found = F.when(F.startswith(part, F.lit(entity[1:])), F.concat(F.lit(value), F.substring(part, len(entity), 2**31 - 1))).otherwise(found)
        return found

    def joined(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, "&"), lambda part, i: F.when(i == 0, part).otherwise(replaced(part))), "")

    return once(text, lambda text: F.when(F.contains(text, F.lit("&")), joined(text)).otherwise(text))


def html_text(html: Column) -> Column:
    """Readable text of a page: scripts and styles go, entities are turned into text, breaks become line breaks, tags become spaces."""
    out = F.regexp_replace(html, r"(?s)<(?i:(script|style)[^>]*>.*?</(script|style)>)", "")
    out = entities_as_text(out)
    out = F.regexp_replace(out, r"(?i)<(?:br\s*/?|/div)>", "\n")
    out = F.regexp_replace(out, r"(?i)</p>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("\t"), F.lit(" ")), " {2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def percent_number(text: Column) -> Column:
    """+15.3% as 15.3; null if it is no number."""
    return F.regexp_replace(text, "[%,]", "").try_cast("double")


def short_number(x: Column) -> Column:
    """1.50T, 2.00B, 3.10M, 4.00K; N/A for null."""
    return (
        F.when(x.isNull(), "N/A").when(F.abs(x) >= 1e12, F.format_string("%.2fT", x / 1e12)).when(F.abs(x) >= 1e9, F.format_string("%.2fB", x / 1e9))
        .when(F.abs(x) >= 1e6, F.format_string("%.2fM", x / 1e6)).when(F.abs(x) >= 1e3, F.format_string("%.2fK", x / 1e3)).otherwise(F.format_string("%.2f", x))
    )


def title_case(snake: Column) -> Column:
    return F.initcap(F.replace(snake, F.lit("_"), F.lit(" ")))


def visitor_id(ip: Column, agent: Column, language: Column) -> Column:
    return F.sha2(F.concat_ws("|", ip, agent, language), 256)


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


#: What marks an earnings report.
EARNINGS_WORDS = ["earnings", "quarterly results", "financial results", "q1 20", "q2 20", "q3 20", "q4 20", "first quarter", "second quarter", "third quarter", "fourth quarter", "net income", "revenue", "eps", "diluted earnings"]


def event_kind(summary: Column) -> Column:
    """What an event filing is about."""
    announced = holds_any(summary, ["announcing"]) & holds_any(summary, ["earnings call", "earnings conference"])
    released = holds_any(summary, ["item 2.02", "results of operations"]) & holds_any(summary, ["financial results", "earnings", "press release", "quarterly results"])
    return F.when(announced, "8-K-earnings-announcement").when(released, "8-K-earnings-release").otherwise("8-K-other")


#: Sector names as they come, and as they are kept.
SECTOR_NAMES = {
    "Information Technology": "Technology", "Technology": "Technology", "Health Care": "Healthcare", "Healthcare": "Healthcare", "Financials": "Financials", "Financial Services": "Financials",
    "Consumer Discretionary": "Consumer Discretionary", "Consumer Cyclical": "Consumer Discretionary", "Consumer Staples": "Consumer Staples", "Consumer Defensive": "Consumer Staples", "Industrials": "Industrials",
    "Energy": "Energy", "Materials": "Materials", "Basic Materials": "Materials", "Real Estate": "Real Estate", "Utilities": "Utilities", "Communication Services": "Communication Services",
}


def sector_name(name: Column) -> Column:
    """The sector under the name that is kept; names that aren't known stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SECTOR_NAMES.items() for x in pair]), name), name)


def quarter_label(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"), F.lit(" "), F.year(date).cast("string"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two instants."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000))


def is_weekday(date: Column) -> Column:
    return F.weekday(date) < 5


def next_trading_day(date: Column) -> Column:
    """The day after, moved past a week-end."""
    after = F.date_add(date, 1)
    return F.when(F.weekday(after) == 5, F.date_add(after, 2)).when(F.weekday(after) == 6, F.date_add(after, 1)).otherwise(after)


def epoch_date(seconds: Column) -> Column:
    """The instant, if its year is between 1970 and 2100."""
    at = F.timestamp_seconds(seconds)
    return F.when(F.year(at).between(1970, 2100), at)


def quarter_range(year: Column, quarter: Column) -> tuple[Column, Column]:
    """First day, and the first day after."""
    first = F.make_date(year, quarter * 3 - 2, F.lit(1))
    return first, F.add_months(first, 3)


def first_object(text: Column) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(text, r"(\{[\s\S]*\})", 1), F.lit(""))


def xbrl_value(html: Column, concepts: list[str]) -> Column:
    """The first tag of the first concept that has one: commas stripped, scaled by its power of ten."""
    found = []
    for concept in concepts:
        tag = F.regexp_extract(html, rf'(?is)<ix:nonfraction[^>]*name="{concept}"[^>]*>([^<]*)</ix:nonfraction>', 0)
        body = F.regexp_extract(tag, r">([^<]*)<", 1)
        power = F.coalesce(F.nullif(F.regexp_extract(tag, r'(?i)scale="(-?\d+)"', 1), F.lit("")).try_cast("int"), F.lit(0))
        found.append(F.regexp_replace(body, "[, ]", "").try_cast("double") * F.pow(F.lit(10.0), power))
    return F.coalesce(*found)


#: Words that speak of risk.
RISK_WORDS = ["risk", "uncertainty", "adverse", "negative", "decline", "failure", "loss", "damage", "harm", "threat", "vulnerable", "litigation", "regulatory", "competition", "disruption"]


def keyword_risk(text: Column, words: list[str] = RISK_WORDS) -> Column:
    """Keywords for each thousand words, a tenth of it, within 0 to 10; null for no text, 5 for no words."""
    low = F.lower(text)
    hits = sum((F.regexp_count(low, F.lit(w)) for w in words[1:]), F.regexp_count(low, F.lit(words[0])))
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(F.length(text) == 0, None).when(n == 0, 5.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.try_divide(hits * 1000.0, n) / 10.0)), 1))


#: How the discussion begins and the headings that end it, and how much of it is kept.
DISCUSSION = r"(?i)(?:item\s+[27]\.?\s*)?management['’]?s\s+discussion\s+and\s+analysis(?:\s+of\s+financial\s+condition)?"
DISCUSSION_END, DISCUSSION_CHARS = r"(?=[iqfIQF])(?i:\bitem\s+(?:3|7a|8)\b\.?|quantitative\s+and\s+qualitative\s+disclosures|financial\s+statements\s+and\s+supplementary)", 15_000
#: White space other than a single blank: what is left to do where each stretch is to be a blank.
UNEVEN = r"\s(?:(?<! )|\s)\s*"


def discussion_text(html: Column) -> Column:
    """The management's discussion of a page as plain text, from its first heading to the next item; null if there is none."""
    def rest(plain: Column) -> Column:
        behind = lambda start: F.substring(plain, start + F.length(F.regexp_extract(plain, DISCUSSION, 0)), F.length(plain))
        return once(F.regexp_instr(plain, F.lit(DISCUSSION)), lambda start: F.when(start > 0, behind(start)))

    def kept(rest: Column) -> Column:
        found = once(F.regexp_instr(rest, F.lit(DISCUSSION_END)), lambda end: F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest))
        return F.trim(F.substring(found, 1, DISCUSSION_CHARS))

    return once(once(F.trim(F.regexp_replace(html_text(html), UNEVEN, " ")), rest), kept)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
