"""Operators on hand-made rows: joins, indicators, merges, functions, scoring, portfolios, jobs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from finlark.functions import math as M
from finlark.functions import text as X
from finlark.operators import aggregates as A
from finlark.operators import merge
from finlark.operators import windows as W
from finlark.operators.asof import asof_join, interval_aggregate, interval_join
from finlark.plans import market_state, portfolio, products, scoring, screener
from finlark.schemas import ANALYSIS, TABLES, schema
from finlark.streaming import alerts, ingest, jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def two_sides(spark):
    rnd = random.Random(1)
    left = [(i, rnd.choice("ab"), rnd.choice([None, *range(0, 900, 7)])) for i in range(150)] + [(900, None, 5), (901, "z", 5)]
    right = [(rnd.choice("ab"), rnd.randrange(0, 900), float(i)) for i in range(120)] + [("a", 30, 1.0), ("a", 30, 2.0), ("a", None, 3.0)]
    return left, right, spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v double")


@pytest.mark.parametrize("how", [{}, {"inclusive": False}, {"direction": "forward"}, {"direction": "forward", "inclusive": False}, {"direction": "nearest"}, {"direction": "nearest", "tie": "later"}, {"tolerance": 5}, {"direction": "nearest", "tolerance": 5, "strict_tolerance": True}])
@pytest.mark.parametrize("bins", [3, 100, 100_000])
def test_asof_join(two_sides, how, bins):
    left, right, l, r = two_sides
    got = {x.id: x.t_right for x in asof_join(l, r, by=["k"], on="t", take=["v"], bin_width=bins, **how).collect()}
    direction, inclusive = how.get("direction", "backward"), how.get("inclusive", True)
    for i, k, t in left:
        times = [u for q, u, _ in right if q == k and t is not None and u is not None and k is not None]
        if direction == "backward":
            times = [u for u in times if u < t or (u == t and inclusive)]
            best = max(times, default=None)
        elif direction == "forward":
            times = [u for u in times if u > t or (u == t and inclusive)]
            best = min(times, default=None)
        else:
            later = how.get("tie") == "later"
            best = min(times, key=lambda u: (abs(u - t), -u if later else u), default=None)
        tol = how.get("tolerance")
        if best is not None and tol is not None and not (abs(best - t) < tol if how.get("strict_tolerance") else abs(best - t) <= tol):
            best = None
        assert got[i] == best, (i, k, t)
    assert len(got) == len(left)


def test_asof_join_null_keys_and_neighbours(spark):
    """A null key meets nothing, in its own bin neither; what lies within the tolerance is found beyond the bin's edge; names and types stay."""
    left = spark.createDataFrame([(1, None, 5), (2, "a", 10), (3, "a", 29)], "id int, k string, t int")
    right = spark.createDataFrame([(None, 4, 1.0), ("a", 9, 2.0), ("a", 31, None)], "k string, t bigint, v double")
    back = asof_join(left, right, by=["k"], on="t", take=["v"], bin_width=10, tolerance=3)
    assert back.dtypes == [("id", "int"), ("k", "string"), ("t", "int"), ("t_right", "bigint"), ("v_right", "double")]
    assert sorted((x.id, x.t_right, x.v_right) for x in back.collect()) == [(1, None, None), (2, 9, 2.0), (3, None, None)]
    near = asof_join(left, right, by=["k"], on="t", take=["v"], bin_width=10, tolerance=3, direction="nearest")
    assert sorted((x.id, x.t_right) for x in near.collect()) == [(1, None), (2, 9), (3, 31)]


def test_interval_join(two_sides):
    left, right, l, r = two_sides
    for high, closed in ((0, True), (0, False), (4, True)):
        got = sorted((x.id, x.t_right, x.v_right) for x in interval_join(l, r, by=["k"], on="t", low=-20, high=high, closed_high=closed, bin_width=6).collect())
        want = sorted((i, u, v) for i, k, t in left for q, u, v in right if k == q and t is not None and u is not None and -20 <= u - t and (u - t <= high if closed else u - t < high))
        assert got == want
    counted = interval_aggregate(l, r, key="id", by=["k"], on="t", low=-20, high=0, aggregates=lambda: [F.count("*").alias("n")])
    assert counted.count() == len(left) and counted.where("id = 900").first().n is None


def series(spark, closes):
    return spark.createDataFrame([("t", i, float(c), float(c) + 1, float(c) - 1, 100) for i, c in enumerate(closes)], "ticker string, date int, close double, high double, low double, volume long")


def test_indicators_at_the_edges(spark):
    up = W.indicators(series(spark, range(1, 41))).orderBy("date").collect()
    assert up[29].ma30 == pytest.approx(15.5) and up[28].ma30 is None
    assert up[14].rsi14 == 100.0 and up[13].rsi14 is None and up[39].volatility30 > 0 and up[29].volatility30 is None
    flat = W.indicators(series(spark, [5] * 40)).orderBy("date").collect()
    assert flat[39].rsi14 == 100.0 and flat[39].return_7d == 0 and flat[39].atr14 == 2.0 and flat[6].return_7d is None and flat[7].return_7d == 0


def test_rsi_equals_the_definition(spark):
    rnd = random.Random(2)
    closes = [100 + rnd.random() for _ in range(60)]
    got = W.indicators(series(spark, closes)).orderBy("date").collect()
    for i in range(14, 60):
        steps = [b - a for a, b in zip(closes[i - 14 : i], closes[i - 13 : i + 1], strict=True)]
        up, down = sum(max(s, 0) for s in steps) / 14, sum(max(-s, 0) for s in steps) / 14
        assert got[i].rsi14 == pytest.approx(100 - 100 / (1 + up / down))


def test_ema_and_macd(spark):
    assert np.isnan(W.ema(np.arange(3.0), 5)).all()
    assert W.ema(np.array([1.0, 2, 3, 4]), 3).tolist()[2:] == [2.0, 3.0]
    got = W.macd(series(spark, range(40))).orderBy("date").collect()
    assert got[33].macd is None and got[34].macd is not None and got[10].ema_fast is None and got[11].ema_fast == pytest.approx(5.5)


def test_year_range_counts_days(spark):
    rows = spark.createDataFrame([("t", 20 * i, float(i), float(i) + 1, float(i) - 1) for i in range(60)], "ticker string, day int, close double, high double, low double")
    got = W.year_range(rows, least=10).orderBy("day").collect()
    assert got[8].high_52w is None and got[59].high_52w == 60.0 and got[59].low_52w == (59 * 20 - 365 + 19) // 20 - 1


def test_merges(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    as_dict = lambda df: {r.k: r.v for r in df.collect()}
    assert as_dict(merge.upsert(base, delta, ["k"])) == {1: "a", 2: "c", 3: "d"}
    assert as_dict(merge.insert_absent(base, delta, ["k"])) == {1: "a", 2: "b", 3: "d"}
    assert as_dict(merge.delete_matching(base, delta, ["k"])) == {1: "a"}
    assert as_dict(merge.update_where(base, F.col("k") == 1, {"v": F.lit("z")})) == {1: "z", 2: "b"}


def test_first_of_takes_one_row_a_key(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (1, 3, "a"), (None, 1, "n")], "k int, o int, v string")
    assert {(r.k, r.v) for r in A.first_of(rows, ["k"], [F.col("o"), F.col("v")]).collect()} == {(1, "a"), (None, "n")}


@pytest.mark.parametrize(("a", "e", "want"), [(1.1, 1.0, 10.0), (1.0, 0.0, 100.0), (-1.0, 2.0, -150.0), (100.0, 0.01, 1000.0), (None, 1.0, None)])
def test_surprise(spark, a, e, want):
    got = one(spark, M.surprise_percent(F.lit(a).cast("double"), F.lit(e)))
    assert got == (want if want is None else pytest.approx(want))


def test_numbers(spark):
    assert one(spark, M.half_up(F.lit(-2.5))) == -2.0 and one(spark, M.half_up(F.lit(2.5))) == 3.0
    assert one(spark, M.consensus_score(*[F.lit(x) for x in (10, 15, 10, 2, 1)])) == 70
    assert one(spark, M.consensus_from_mean(F.lit(2.0))) == 75 and one(spark, M.consensus_from_mean(F.lit(0.0))) is None
    assert one(spark, M.winsorised(F.lit(None).cast("double"))) == 0 and one(spark, M.winsorised(F.lit(80.0))) == 50
    assert one(spark, M.per(F.lit(1.0), F.lit(0.0))) is None
    assert [one(spark, M.concern_label(F.lit(x))) for x in (2.0, 4.1, 9.0)] == ["LOW", "ELEVATED", "CRITICAL"]
    assert one(spark, M.dispersion(F.lit(0.0), *[F.lit(1)] * 3)) is None


def test_texts(spark):
    assert one(spark, X.accession(F.lit("000032019325000079"))) == "0000320193-25-000079"
    assert one(spark, X.percent_number(F.lit("+1,015.3%"))) == 1015.3 and one(spark, X.percent_number(F.lit("n/a"))) is None
    assert one(spark, X.short_number(F.lit(3.1e12))) == "3.10T" and one(spark, X.short_number(F.lit(None).cast("double"))) == "N/A"
    assert one(spark, X.html_text(F.lit("<p>A&amp;B</p><script>x</script><div>c<br/>d</div>"))) == "A&B\n\n c\nd"
    assert str(one(spark, X.next_trading_day(F.lit("2025-01-03").cast("date")))) == "2025-01-06"
    assert str(one(spark, X.next_trading_day(F.lit("2025-01-04").cast("date")))) == "2025-01-06"
    page = '<ix:nonFraction name="us-gaap:Revenues" scale="6" sign="-">1,234</ix:nonFraction>'
    assert one(spark, X.xbrl_value(F.lit(page), ["us-gaap:Sales", "us-gaap:Revenues"])) == 1.234e9
    assert one(spark, X.first_object(F.lit('so {"a": {"b": 1}} it is'))) == '{"a": {"b": 1}}' and one(spark, X.first_object(F.lit("none"))) is None
    assert one(spark, X.keyword_risk(F.lit(""), ["risk"])) is None and one(spark, X.keyword_risk(F.lit("   "), ["risk"])) == 5.0


def test_schemas(spark):
    for name in TABLES:
        assert spark.createDataFrame([], schema(name)).columns
    doc = one(spark, F.from_json(F.lit('{"risks": {"riskScore": 4.5}, "financialMetrics": {"structuredData": {"epsYoY": "+3%"}}}'), f"struct<{ANALYSIS.replace(' struct', ': struct').replace(' string', ': string')}>"))
    assert doc.risks.riskScore == 4.5 and doc.financialMetrics.structuredData.epsYoY == "+3%" and doc.summary is None


MEAN = {f"f_{k}": v[0] for k, v in scoring.GLOBAL.items()}


def test_mean_features_score_zero_and_extremes_are_sure(spark):
    up = MEAN | {"f_analyst_upside": 80.0, "f_eps_surprise": 25.0, "f_spx_trend_30d": 4.0, "f_vix_level": 25.0, "f_concern_level": 8.0}
    down = MEAN | {"f_analyst_upside": 5.0, "f_eps_surprise": -40.0, "f_spx_trend_30d": -4.0, "f_vix_level": 14.0}
    rows = spark.createDataFrame([(n, "Energy", *r.values()) for n, r in (("mean", MEAN), ("up", up), ("down", down))], "name string, sector string, " + ", ".join(f"{k} double" for k in MEAN))
    got = {r.name: r for r in scoring.score(rows, scoring.global_expert(spark)).collect()}
    assert (got["mean"].raw_score, got["mean"].signal, got["mean"].confidence_label, got["mean"].predicted_30d) == (0.0, "NEUTRAL", "low", 0.8)
    assert got["up"].signal == "LONG" and got["up"].confidence_label == "high" and got["down"].signal == "SHORT" and got["down"].raw_score < -0.029
    for r in got.values():
        assert len(r.contributions) == 13 and sum(r.contributions.values()) == pytest.approx(r.raw_score, abs=1e-4)


def test_special_experts_come_first(spark):
    extra = scoring.global_expert(spark)
    experts = extra
    for name in ("Energy", "mega", "Energy:mega"):
        experts = experts.unionByName(extra.withColumn("expert", F.lit(name)))
    rows = spark.createDataFrame([("Energy", *(MEAN | {"f_market_cap": 3e11}).values()), ("Energy", *MEAN.values()), ("Retail", *(MEAN | {"f_market_cap": 3e11}).values()), ("Retail", *MEAN.values())], "sector string, " + ", ".join(f"{k} double" for k in MEAN))
    assert sorted(r.expert for r in scoring.score(rows, experts).collect()) == ["Energy", "Energy:mega", "global", "mega"]


def test_ridge_equals_numpy(spark):
    rnd = np.random.default_rng(0)
    x, y = rnd.normal(size=(200, 3)), rnd.normal(size=200)
    rows = spark.createDataFrame([(int(i % 2), *map(float, x[i]), float(y[i])) for i in range(200)], "g int, a double, b double, c double, y double")
    for r in scoring.ridge_by(rows, ["a", "b", "c"], "y", ["g"]).collect():
        z, t = x[r.g :: 2], y[r.g :: 2]
        assert r.beta == pytest.approx(np.linalg.solve(z.T @ z + 100 * np.eye(3), z.T @ t), abs=1e-9)


@pytest.mark.parametrize(("direction", "shares", "entry", "exit_"), [("LONG", 10, 150.0, 160.0), ("SHORT", 5, 200.0, 180.0)])
def test_trade_gains(spark, direction, shares, entry, exit_):
    assert one(spark, M.trade_pnl(F.lit(direction), F.lit(shares * entry), F.lit(shares * exit_), F.lit(2.0))) == 98.0
    value = shares * entry / 0.01
    rows = spark.createDataFrame([(1, 1, 7, direction, 10, 20, entry, exit_, 1.0, 1.0)], "portfolio_id long, trade_id long, ticker long, direction string, day int, exit_day int, entry double, exit double, confidence double, predicted double")
    got = portfolio.run(rows, start=value).first()
    assert (got.shares, got.pnl) == (shares, 98.0)
    again = rows.union(rows.withColumn("trade_id", F.lit(2)).withColumn("day", F.lit(25)))
    assert portfolio.run(again, start=value).count() == 2 and portfolio.run(rows.union(rows.withColumn("trade_id", F.lit(2))), start=value).count() == 1


def test_cash_is_whole_after_closing(spark):
    rows = [(1, i, i, "LONG" if i % 2 else "SHORT", 10 * i, 10 * i + 5, 50.0, 50.0 + i, 1.0, 5.0) for i in range(1, 6)]
    got = portfolio.run(spark.createDataFrame(rows, "portfolio_id long, trade_id long, ticker long, direction string, day int, exit_day int, entry double, exit double, confidence double, predicted double")).orderBy("day").collect()
    assert got[-1].cash_after == pytest.approx(100_000 + sum(r.pnl for r in got[:-1]) - got[-1].entry_value - 1)


def test_gate(spark):
    owners = spark.createDataFrame([(1, True, 0.6), (2, False, 0.0)], "portfolio_id int, is_active boolean, min_confidence double")
    held = spark.createDataFrame([(1, "HELD", "OPEN"), (1, "PAST", "CLOSED")], "portfolio_id int, ticker string, status string")
    signals = [(1, "A", 0.7, 2.0, "LONG"), (1, "B", 0.5, 2.0, "LONG"), (1, "C", 0.7, 0.4, "LONG"), (1, "D", 0.7, 2.0, "NEUTRAL"), (1, "HELD", 0.7, 2.0, "LONG"), (1, "PAST", 0.7, -2.0, "SHORT"), (2, "A", 0.9, 2.0, "LONG")]
    got = portfolio.gate(spark.createDataFrame(signals, "portfolio_id int, ticker string, confidence double, predicted double, signal string"), owners, held)
    assert {(r.portfolio_id, r.ticker) for r in got.collect()} == {(1, "A"), (1, "PAST")}


def test_alerts_take_the_first_rule(spark):
    rules = spark.createDataFrame([(1, 1, "BUILD", 6.0), (1, 2, None, 9.0)], "user_id int, rule int, word string, least double")
    events = spark.createDataFrame([(1, "BUILDING", 9.5), (2, "OTHER", 9.5), (3, "OTHER", 7.0)], "filing_id int, sector string, concern double")
    assert sorted((r.filing_id, r.rule) for r in alerts.matched(events, rules).collect()) == [(1, 1), (2, 2)]


def test_jobs(spark):
    runs = spark.createDataFrame([("a", "running", "2025-01-01 00:00:00", None, None), ("a", "success", "2024-12-30 00:00:00", "2024-12-30 00:01:00", None), ("b", "failed", "2024-12-31 00:00:00", None, "x")], "job_name string, status string, started_at string, completed_at string, error_message string")
    runs = runs.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "completed_at")})
    assert [r.status for r in jobs.with_stuck_failed(runs, "2025-01-01 00:15:00").where("job_name = 'a'").orderBy("started_at").collect()] == ["success", "failed"]
    assert [r.status for r in jobs.with_stuck_failed(runs, "2025-01-01 00:05:00").where("status = 'running'").collect()] == ["running"]
    assert {r.job_name: r.stale for r in jobs.stale(runs, "2025-01-01 00:00:00", {"a": 72}).collect()} == {"a": False, "b": True}


def test_streamed_merge_twice(spark, tmp_path):
    def land(name, rows):
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def pull():
        source = ingest.landed(spark, str(tmp_path / "in" / "*"), "k int, at int, v string")
        ingest.merge_into(source, str(tmp_path / "table"), ["k"], ["at"], str(tmp_path / "state")).awaitTermination()
        return {r.k: r.v for r in ingest.current(spark, str(tmp_path / "table")).collect()}

    land("one", [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    assert pull() == {1: "b", 2: "c"} == pull()
    land("two", [(2, 5, "d"), (3, 1, "e")])
    assert pull() == {1: "b", 2: "d", 3: "e"}


def test_catch_up(spark):
    rows = lambda *d: spark.createDataFrame([(x,) for x in d], "filing_date string")
    got = lambda df: tuple(map(str, ingest.catch_up(df, "2025-01-10").first()))
    assert got(rows("2025-01-03")) == ("2025-01-04", "2025-01-09") and got(rows("2025-01-09")) == ("2025-01-09", "2025-01-09") and got(rows().limit(0)) == ("2024-12-11", "2025-01-09")


@pytest.mark.parametrize(("question", "intent"), [
    ("market cap > 100b and beta < 1", "compound"), ("list companies with pe ratio < 15", "pe"), ("show companies with dividend yield > 3", "yield"), ("show undervalued companies", "undervalued"),
    ("show aapl filings in the last 30 days", "recent"), ("which companies filed 10-k in q1 2025", "period"), ("tech stocks", "sector"), ("real estate companies", "sector"), ("hello", "fallback"), ("8-Ks filed this week", "fallback"),
    ("show me AAPL target price history", "history"), ("track msft eps estimate over time", "history"), ("companies where analyst target price went down", "moves"), ("what's nvda's stock price", "metrics"), ("get tsla pe", "metrics"),
    ("show companies with market cap > $40b", "cap"), ("show companies with market cap > 40", "fallback"), ("find low beta stocks", "beta"), ("find beta under 0.5", "beta"), ("list companies with revenue growth above 20", "growth"),
    ("show companies with net income over $1b", "income"), ("get companies with operating margin > 25", "margin"), ("list volatile stocks", "volatile"), ("find companies near 52-week high", "near_high"), ("list all t3 filings", "filings"),
    ("find 10-k filed in q1 1998", "quarter"), ("which companies filed 8-k in march", "period"), ("list 10-q filed this month", "this"), ("find companies trading below target", "undervalued"), ("banking firms", "sector"),
    ("show 8-Ks filed this week", "this"), ("energy companies that are undervalued", "sector_undervalued"), ("compare T5 estimates before and after last filing", "around"),
])
def test_questions(spark, question, intent):
    fields = "company_id long, ticker string, name string, sector string, market_cap double, current_price double, analyst_target_price double, pe_ratio double, dividend_yield double, beta double, latest_revenue_yoy double, latest_net_income double, latest_operating_margin double, fifty_two_week_high double"
    companies = spark.createDataFrame([], fields)
    filings = spark.createDataFrame([], "filing_id long, company_id long, filing_type string, filing_date timestamp")
    snapshots = spark.createDataFrame([], "company_id long, snapshot_date timestamp, analyst_target_price double")
    assert screener.ask(screener.Tables(companies, filings, snapshots), question)[0] == intent


def test_moves_from_zero_and_below(spark):
    rows = [(1, 1, 0.0), (1, 2, 5.0), (2, 1, 10.0), (2, 2, 30.0), (3, 1, -10.0), (3, 2, -5.0), (4, 1, 0.0), (4, 2, -1.0), (5, 1, 0.0), (5, 2, 0.0), (6, 1, 4.0), (6, 2, 0.0), (7, 1, 9.0)]
    snapshots = spark.createDataFrame(rows, "company_id long, day int, analyst_target_price double").withColumn("snapshot_date", F.timestamp_seconds("day"))
    got = lambda up: [(r.company_id, r.change_pct) for r in screener.target_moves(screener.Tables(None, None, snapshots), up).collect()]
    assert got(True) == [(1, math.inf), (2, 200.0), (3, -50.0)]
    assert got(False) == [(4, -math.inf), (6, -100.0)]


def test_compound_bounds(spark):
    rows = spark.createDataFrame([(1, 2e11, 0.5, 10.0, "Energy"), (2, 2e11, 1.5, 30.0, "Energy"), (3, 1e9, 0.5, 3.0, "Technology")], "company_id int, market_cap double, beta double, latest_revenue_yoy double, sector string")
    got = lambda q: {r.company_id for r in rows.where(screener.compound(q)).collect()}
    assert got("show companies with market cap > 100b and beta < 1") == {1}
    assert got("market cap above 100b or beta under 1") == {1, 2, 3}
    assert got("revenue growth > 20% and beta > 1") == {2}
    assert got("tech companies with beta < 1 and market cap < 2b") == {3}
    assert math.isclose(screener.UNITS["t"], 1e12)


def test_drift_features_meet_macro_rows_by_day(spark, monkeypatch):
    """Events of a day share its macro row and its rate's changes: 60 events of two days ask for two rows, not for 60."""
    asked = []
    plain = products.asof_join
    monkeypatch.setattr(products, "asof_join", lambda rows, side, **how: (asked.append((how["by"], rows.count())), plain(rows, side, **how))[1])
    rnd = random.Random(3)
    close, rate = ([rnd.uniform(1, 9) for _ in range(101)] for _ in range(2))
    days = spark.createDataFrame([(1, d, close[d], rate[d]) for d in range(101)], "ticker int, day int, close double, treasury10y double")
    events = spark.range(60).select(F.col("id").alias("filing_id"), F.lit(1).alias("ticker"), F.when(F.col("id") % 2 == 0, 100).otherwise(20).alias("day"), *[F.lit(1.0).alias(c) for c in ("eps_actual", "guidance_low", "guidance_high")])
    firms = spark.createDataFrame([(1, "Energy", 5.0, 1.0, 9.0)], "ticker int, sector string, market_cap double, beta double, pe_ratio double")
    snapshots = days.select("ticker", "day", *[F.lit(2.0).alias(c) for c in products.SNAPSHOT[:-1]], F.col("close").alias("current_price"))
    technical = days.select("ticker", "day", *[F.lit(2.0).alias(c) for c in ("return_90d", "price_to_ma50", "price_to_ma200", "rsi14")])
    macro = days.select("day", "treasury10y", F.col("day").cast("double").alias("vix_close"), *[F.lit(2.0).alias(c) for c in ("spx_return_7d", "yield_curve", *products.SECTOR_RETURNS.values())])
    got = {r.filing_id: r for r in products.drift_features(events, firms, snapshots, technical, macro, days.select("ticker", "day", "close")).collect()}
    c, r = np.array(close[10:101]), np.array(rate[10:101])
    assert len(got) == 60 and [n for by, n in asked if by == ["_all"]] == [2]
    for k, row in got.items():
        assert row.vix == (100 if k % 2 == 0 else 20)
        assert math.isclose(row.interest_rate_sensitivity or 0, np.corrcoef(np.diff(c) / c[:-1], np.diff(r))[0, 1] if k % 2 == 0 else 0, abs_tol=1e-9)


@pytest.mark.parametrize("n", [1, 4, 7])
def test_long_means_have_no_wide_frames(spark, n):
    values = [None if i % 5 == 3 else math.inf if i == 11 else float(i * i % 13) for i in range(30)]
    rows = spark.createDataFrame([(k, i, v) for k in ("a", "b") for i, v in enumerate(values[: 30 if k == "a" else 3])], "ticker string, date int, close double")
    made = W.with_long_mean(rows, "close", n, "mean")
    for r in made.collect():
        kept = [v for v in values[max(0, r.date - n + 1) : r.date + 1] if v is not None]
        assert r.mean == (pytest.approx(sum(kept) / len(kept)) if kept else None)


def test_long_growth_query_has_no_wide_frame(spark, sf):
    """A frame of 275 rows was summed anew for each row."""
    from finlark.plans.queries_extra import QUERIES

    assert "-274, currentrow" not in QUERIES["W13_dollar_and_growth"](spark, sf)._jdf.queryExecution().analyzed().toString()


def test_sections_are_searched_for_once(spark):
    from finlark.plans.market_state import section

    prose = "Some of the following may happen. " + "Prices move. " * 30
    rows = spark.createDataFrame([(1, "Item 1A. Risk Factors" + prose), (2, "Item 1A. Risk Factors ......... 7\n" + "x" * 300), (3, None), (4, "The Risk factors\n" + prose + "\nItem 2. Properties")], "k int, text string")
    made = rows.select("k", section(F.col("text"), "risk_factors").alias("s"))
    assert "regexp_substr" not in made._jdf.queryExecution().analyzed().toString().lower()
    assert {r.k: r.s for r in made.collect()} == {1: prose.strip(), 2: None, 3: None, 4: prose.strip()}


@pytest.fixture(scope="module")
def closes(spark):
    rnd = random.Random(5)
    known = [(k, d, None if d % 11 == 0 else float(rnd.randrange(1, 500))) for k in "ab" for d in sorted(rnd.sample(range(0, 400), 90))]
    return known, spark.createDataFrame([*known, (None, 40, 1.0), (None, 72, 2.0), ("a", None, 3.0)], "ticker string, day int, close double")


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_value_back(spark, sf, closes):
    known, df = closes
    got = {(x.ticker, x.day): x.back for x in market_state.value_back(df, 30, 5).collect()}
    for k, d, _ in known:
        past = [(e, v) for q, e, v in known if q == k and d - 35 <= e <= d - 30]
        assert got[k, d] == (max(past)[1] if past else None)
    assert got[None, 72] is None and got["a", None] is None
    assert scans(entry.queries()["W22_value_days_back"](spark, sf)) == 1  # the series is made once


def test_horizon_returns(spark, sf, closes):
    known, df = closes
    got = {(x.ticker, x.day): (x.return_3, x.return_30) for x in market_state.horizon_returns(df, [3, 30]).collect()}
    for k, d, now in known:
        for n, have in zip((3, 30), got[k, d], strict=True):
            past = min(((abs(e - d + n), -e, v) for q, e, v in known if q == k))[2]
            assert have == (None if now is None or past is None else pytest.approx((now - past) * 100 / past))
    assert got[None, 72] == (None, None) == got["a", None]
    assert scans(entry.queries()["W10_horizon_returns"](spark, sf)) == 1  # one sort of the series serves all horizons


@pytest.mark.parametrize("inclusive", [True, False])
def test_positions(spark, sf, closes, inclusive):
    known, df = closes
    asked = [(i, k, d) for i, (k, d) in enumerate((k, d) for k in "ab" for d in range(-3, 400, 9))] + [(900, None, 5), (901, "a", None)]
    got = {x.id: (x.entry_day, x.entry, x.exit_day, x.exit) for x in portfolio.positions(spark.createDataFrame(asked, "id int, ticker string, day int"), df, 30, inclusive=inclusive).collect()}
    for i, k, d in asked:
        first = lambda at: min(((e, v) for q, e, v in known if q == k and e >= at), default=(None, None))
        entry = first(d + (not inclusive)) if d is not None else (None, None)
        out = first(entry[0] + 30) if entry[0] is not None else (None, None)
        assert got.get(i) == (None if entry[1] is None or out[1] is None else (*entry, *out))


def test_positions_make_the_series_and_the_join_once(spark, sf):
    plan = entry.queries()["T8s_portfolio_trades"](spark, sf)
    assert scans(plan) <= 4  # filings and prices, in the union and for the bins' guests; 11 with a join for either end


def test_drift_features_read_prices_once(spark, sf):
    """Snapshots, indicators, bands and returns each summed up and sent all prices; now they share one exchange, and macro rows are read apart."""
    from finlark.plans.queries_products import QUERIES

    plan = QUERIES["M19_F44_drift_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") <= 3


def test_returns_paired_by_place(spark):
    closes = [2.0, 3.0, 0.0, None, 4.0, 5.0, 2.5]
    rows = spark.range(1).select(F.array(*[F.struct(F.lit(c).cast("double").alias("close")) for c in closes]).alias("c"), F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0), F.lit(4.0), F.lit(7.0)).alias("r"))
    got = rows.select(products.price_changes(F.col("c")).alias("v"), products.paired_correlation(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0)), F.col("r")).alias("x"), products.paired_correlation(F.array(F.lit(0.1), F.lit(0.1), F.lit(0.1)), F.col("r")).alias("flat"), F.size(products.price_changes(F.slice("c", 1, 0))).alias("none")).first()
    assert got.v == [0.5, -1.0, 0.25, -0.5] and got.flat == 0 and got.none == 0
    assert math.isclose(got.x, np.corrcoef([1, 3, 2], [1, 2, 9])[0, 1])


def test_sections_are_found_by_one_compiled_search(spark):
    """The same texts as by splitting, which compiles its pattern for each row and goes on behind the first match: nulls, none, two headings, tables of contents, characters of two code units."""
    from finlark.plans import market_state as M

    prose = "Some of the following may happen. " + "Prices move. " * 30
    dots = "Item 1A. Risk Factors ......... 7\nItem 7. Management's Discussion and Analysis ......... 20\n"
    texts = [
        None, "", " ", dots, "Item 1A. Risk Factors", f"Item 1A. Risk Factors\n{prose[:200]}", f"Item 1A. Risk Factors\n{prose[:201]}", f"{dots}ITEM 1A - RISK  FACTORS\n{prose}\nItem 2. None.",
        f"Risk Factors {prose} Item 7. Management\u2019s Discussion and Analysis\n{prose}\nItem 8. x", f"\U0001f600 risk factors \U0001f600{prose}\U0001f600 risk factors {prose}", f"risk factors {'x' * 488}...... {prose}", f"risk factors {'x' * 495}...... {prose}",
        f"risk factors {'x' * 487}. Yes {'x' * 300}", f"risk factors {'x' * 500}. Yes", f"Item 7 management's discussion\r\n{prose}\n\n item 7A. {prose}",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    greedy = r"(?=.{201})(?!.{0,494}\.{6})(?=.{0,498}(?:\. [A-Z]|ollowing))"
    every = [p for some in M.SECTIONS.values() for p in some]
    found = rows.select("k", *[M._after(F.col("t"), f"(?s)(?i:{p}){M.PROSE}").alias(f"a{i}") for i, p in enumerate(every)], *[F.get(F.split("t", f"(?s)(?i:{p}){greedy}", 2), 1).alias(f"b{i}") for i, p in enumerate(every)])
    got = found.collect()
    for i in range(len(every)):
        assert [r[f"a{i}"] for r in got] == [r[f"b{i}"] for r in got]
        assert 0 < sum(r[f"a{i}"] is not None for r in got) < len(texts)
    made = rows.select(M.section(F.col("t"), "risk_factors").alias("s"))
    assert "split(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_read_in_fewer_passes(spark):
    """The same text as by a replacement for each entity and tag, one after another, over all texts of some pieces; what follows an & is looked at once."""
    def plain(html):
        out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
        for entity, value in X.ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(value))
        for pattern, value in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</div>", "\n"), (r"<[^>]+>", " "), (r"\t", " "), (" {2,}", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
            out = F.regexp_replace(out, pattern, value)
        return out

    def talk(html):
        text = F.trim(F.regexp_replace(plain(html), r"\s+", " "))
        start = F.regexp_instr(text, F.lit(X.DISCUSSION))
        rest = F.when(start > 0, F.substring(text, start + F.length(F.regexp_substr(text, F.lit(X.DISCUSSION))), F.length(text)))
        end = F.regexp_instr(rest, F.lit(r"(?i)\bitem\s+(?:3|7a|8)\b\.?|quantitative\s+and\s+qualitative\s+disclosures|financial\s+statements\s+and\s+supplementary"))
        return F.trim(F.substring(F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest), 1, 15_000))

    rnd = random.Random(8)
    signs = [*[e for e, _ in X.ENTITIES], "&", "amp;", "lt;", "#39;", "&#", ";", "<", ">", "/", "<br", "<BR />", "</p>", "</DIV>", "<div>", "<b x='1'>", "<Script>", "</STYLE>", "x", "é", "\U0001f600", "\u00a0", "\u2028", "\x85", " ", "  ", "\t", "\n", "\r", "\x0b", "\f"]
    words = [*signs, "Item 7. Management&#8217;s ", "discussion and analysis", "MANAGEMENT'S DISCUSSION\n AND ANALYSIS of financial condition", "item 7a", "xitem 8", " ITEM  3.", "Quantitative and qualitative disclosures", "financial statements  and supplementary"]
    texts = [None, "", "&", "&amp;", "&amp;&lt;&amp;amp;lt;&amp;nbsp;&", *("".join(rnd.choices(signs, k=rnd.randrange(1, 14))) for _ in range(1500)), *("".join(rnd.choices(words, k=rnd.randrange(3, 30))) for _ in range(700)), *("management's discussion and analysis" + "".join(rnd.choices(words, k=12)) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    html = F.col("t")
    got = rows.select("k", X.html_text(html).alias("a"), plain(html).alias("b"), X.discussion_text(html).alias("c"), talk(html).alias("d")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.c for r in got] == [r.d for r in got]
    assert sum(r.c is not None for r in got) > 300
    plan = rows.select(X.html_text(html).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?<!regexp_)replace\(", plan)) == 1  # that of tabs
