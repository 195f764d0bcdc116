"""Readers on small landed files."""

import json

from finlark.sources import filings, market


def put(folder, name, content):
    path = folder / name
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_submissions(spark, tmp_path):
    recent = {"accessionNumber": ["0000320193-25-000079", "0000320193-25-000001"], "filingDate": ["2025-10-31", "2025-01-02"], "reportDate": ["2025-09-27", ""], "form": ["10-K", "4"], "primaryDocument": ["a.htm", "b.htm"]}
    put(tmp_path, "CIK1.json", {"cik": "320193", "name": "Apple Inc.", "tickers": ["AAPL"], "filings": {"recent": recent}})
    put(tmp_path, "CIK2.json", "{broken")
    got = filings.submissions(spark, str(tmp_path / "CIK*.json"), ["10-K"], "2025-02-01").collect()
    assert [(r.cik, r.ticker, str(r.filing_date)) for r in got] == [("0000320193", "AAPL", "2025-10-31")]
    assert got[0].filing_url == "https://www.sec.gov/Archives/edgar/data/320193/000032019325000079/a.htm"
    assert filings.submissions(spark, str(tmp_path / "CIK*.json")).count() == 2


def test_feed(spark, tmp_path):
    path = put(tmp_path, "feed.xml", "<feed><entry><title>10-K - Apple Inc. (0000320193) (Filer)</title><updated>2025-10-31T06:01:26-04:00</updated><link href=\"http://x/1\"/><id>urn:0000320193-25-000079</id></entry><entry><title>odd</title></entry></feed>")
    got = filings.feed(spark, path).collect()
    assert [(r.filing_type, r.company_name, r.cik, r.accession_number, str(r.filing_date)) for r in got] == [("10-K", "Apple Inc.", "0000320193", "0000320193-25-000079", "2025-10-31")]


def test_daily_index(spark, tmp_path):
    path = put(tmp_path, "form.idx", "Description: index\n\nCIK|Company Name|Form Type|Date Filed|File Name\n-----\n320193|Apple Inc.|10-K|20251031|edgar/data/320193/0000320193-25-000079.txt\n")
    got = filings.daily_index(spark, path).collect()
    assert [(r.cik, r.filing_type, str(r.filing_date), r.accession_number) for r in got] == [("0000320193", "10-K", "2025-10-31", "0000320193-25-000079")]
    assert filings.daily_index(spark, put(tmp_path, "error.idx", "<html>no</html>")).count() == 0
    assert [str(r.day) for r in filings.index_days(spark, "2025-01-03", "2025-01-07").collect()] == ["2025-01-03", "2025-01-06", "2025-01-07"]


def test_tickers_and_facts(spark, tmp_path):
    path = put(tmp_path, "tickers.json", {"0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple"}})
    assert [(r.ticker, r.cik) for r in filings.tickers(spark, path).collect()] == [("AAPL", "0000320193")]
    value = lambda v, fy: {"end": f"{fy}-09-30", "val": v, "accn": f"a{fy}", "fy": fy, "fp": "FY", "form": "10-K", "filed": f"{fy}-10-30"}
    path = put(tmp_path, "facts.json", {"cik": 1, "facts": {"us-gaap": {"Revenues": {"label": "r", "units": {"USD": [value(100.0, 2023), value(120.0, 2024)], "shares": [value(5.0, 2024)]}}, "Empty": {"label": "e", "units": {"USD": [value(0.0, 2023), value(9.0, 2024)]}}}}})
    facts = filings.company_facts(spark, path)
    assert facts.count() == 5
    assert {(r.accn, r.concept): r.val for r in filings.fact_of_filing(facts).collect()}["a2024", "Revenues"] == 120.0
    assert {(r.concept, r.fy): round(r.yoy, 6) for r in filings.year_on_year(facts).collect()} == {("Revenues", 2024): 20.0}


def test_market_files(spark, tmp_path):
    path = put(tmp_path, "chart.json", {"chart": {"result": [{"meta": {"symbol": "spy"}, "timestamp": [86400, 172800], "indicators": {"quote": [{"open": [1.0, None], "high": [2.0, 2.0], "low": [1.0, 1.0], "close": [1.5, 1.5], "volume": [10, 20]}]}}]}})
    assert [(r.ticker, str(r.date), r.close) for r in market.chart(spark, path).collect()] == [("SPY", "1970-01-02", 1.5)]
    path = put(tmp_path, "p.csv", "Date,Open,High,Low,Close,Adj Close,Volume\n2025-01-02,1,2,1,1.5,1.5,10\n2025-01-03,null,null,null,null,null,null\n")
    assert market.price_csv(spark, path).count() == 1
    path = put(tmp_path, "rates.json", {"series_id": "DGS10", "observations": [{"date": "2025-01-02", "value": "4.5"}, {"date": "2025-01-03", "value": "."}]})
    assert [r.value for r in market.rates(spark, path).orderBy("date").collect()] == [4.5, None]
    path = put(tmp_path, "q.json", {"symbol": "aapl", "dividendYield": 0.5, "beta": 1.2})
    assert market.quotes(spark, path).first().dividend_yield == 0.005
    path = put(tmp_path, "h.json", {"symbol": "A", "upgradeDowngradeHistory": {"history": [{"epochGradeDate": 86400, "firm": "F", "action": "up"}]}, "earningsHistory": {"history": [{"quarter": 86400, "epsActual": 1.0}]}})
    assert market.analyst_events(spark, path).first().firm == "F" and str(market.earnings(spark, path).first().period_end) == "1970-01-02"
    path = put(tmp_path, "n.xml", "<rss><item><title>A rise - The Paper</title><link>http://x</link></item></rss>")
    assert market.news(spark, path).first().publisher == "The Paper"


def test_csv_round_trip(spark, tmp_path):
    path = put(tmp_path, "t.csv", "a,b,c\n1,null,true\n2,x,false\n,undefined,\n")
    rows = market.csv_table(spark, path)
    assert [r.b for r in rows.collect()] == [None, "x", None] and dict(rows.dtypes)["a"] == "int"
    market.write_csv(spark.createDataFrame([(1, 'say "so", twice', True), (2, None, False)], "i int, s string, f boolean").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part*")).read_text()
    assert text == 'i,s,f\n1,"say ""so"", twice",1\n2,,0\n'


def test_daily_series_alone_and_in_sequence(spark, tmp_path):
    doc = lambda name, day: {"Meta Data": {"2. Symbol": name}, "Time Series (Daily)": {day: {"1. open": "1.5", "2. high": "2", "3. low": "1", "4. close": "x", "5. volume": "7"}}}
    put(tmp_path, "one.json", json.dumps(doc("a", "2025-01-02"), indent=1))
    put(tmp_path, "two.json", "\x1e" + "\n\x1e".join([json.dumps(doc("b", "2025-01-03"), indent=1), json.dumps({"Error Message": "no such call"}), "{broken", json.dumps(doc("c", "2025-01-04"))]) + "\n")
    put(tmp_path, "none.json", "")
    got = market.daily_series(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r.ticker, str(r.date), r.open, r.close, r.volume) for r in got) == [("A", "2025-01-02", 1.5, None, 7), ("B", "2025-01-03", 1.5, None, 7), ("C", "2025-01-04", 1.5, None, 7)]


def test_series_share_files(spark, sf, tmp_path, monkeypatch):
    from finlark.plans import queries_sources

    monkeypatch.setattr(queries_sources, "folder", lambda spark: str(tmp_path / "landed"))
    symbols = queries_sources.daily_series(spark, sf).select("ticker").distinct().count()
    files = [p for p in (tmp_path / "landed").iterdir() if p.name.startswith("part-")]
    assert symbols > 5 and len(files) <= 6  # a file a task (and one of the failed call), however many symbols
