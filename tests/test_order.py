"""Order statistics, ranks, pages and composed moving averages against plain lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finlark.operators import aggregates as A
from finlark.operators import order as O
from finlark.operators import windows as W


def plain_quantile(values, p):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    at = (len(values) - 1) * p
    a, b = math.floor(at), math.ceil(at)
    return values[a] if values[a] == values[b] else (b - at) * values[a] + (at - a) * values[b]


SHARES = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("few", [10_000, 5])
def test_quantiles_by_group(spark, monkeypatch, few):
    """Few rows at once, or round after round; a hot value, a skewed group, a null group, values of all sizes."""
    monkeypatch.setattr(O, "FEW", few)
    rnd = random.Random(few)
    rows = [("hot", rnd.choice([7.0, rnd.uniform(-1, 1) * 10 ** rnd.randrange(-300, 300)])) for _ in range(3000)]
    rows += [("wide", v) for v in (1.7976931348623157e308, -1.7976931348623157e308, 5e-324, -5e-324, 0.0, 1.0, 2.0)] + [(None, float(i % 17)) for i in range(200)]
    rows += [("odd", v) for v in (float("nan"), None, float("inf"), float("-inf"), 1.0, 2.0, 3.0)] + [("one", 4.0), ("none", None), ("none", float("nan"))]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in O.grouped_quantiles(frame, ["g"], F.col("v"), SHARES, [f"q{i}" for i in range(6)]).collect()}
    assert got.keys() == {"hot", "wide", None, "odd", "one"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g]
        assert r.n == sum(v is not None and not math.isnan(v) for v in own)
        for i, p in enumerate(SHARES):
            want = plain_quantile(own, p)
            assert r[f"q{i}"] == pytest.approx(want, rel=1e-12, nan_ok=True), (g, p)


def test_places_beside_a_hot_value(spark, monkeypatch):
    """Nearly all rows repeat the bracket's ends, and the wanted places lie between them."""
    monkeypatch.setattr(O, "FEW", 5)
    values = [0.0] * 4000 + [i / 100 for i in range(1, 60)] + [1.0] * 4000
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    shares = [0.4965, 0.5, 0.5001, 0.503]
    assert A.exact_quantiles(frame, "v", shares, probes=8) == pytest.approx([plain_quantile(values, p) for p in shares])


def test_quantiles_end_on_odd_numbers(spark):
    values = [float(i) for i in range(1000)] + [float("nan"), float("inf"), None, 1.7e308, -1.7e308]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert A.exact_quantiles(frame, "v", [0.0, 0.5, 1.0]) == [-1.7e308, plain_quantile(values, 0.5), float("inf")]
    assert A.exact_quantiles(frame.where("v is null or isnan(v)"), "v", [0.5]) == [None]
    clipped = A.winsorised_at(frame, "v", 0.01, 0.99).where("v = 1.7e308").first().v_clipped
    assert clipped == plain_quantile(values, 0.99)


def test_upper_median_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(O, "FEW", 3)
    rows = [(i % 2, float(i * i % 91)) for i in range(500)] + [(9, 1.0), (9, 2.0)]
    got = {r.g: r.median for r in A.upper_median(spark.createDataFrame(rows, "g int, v double"), "g", F.col("v")).collect()}
    for g in (0, 1, 9):
        own = sorted(v for k, v in rows if k == g)
        assert got[g] == own[len(own) // 2]


def test_ranks(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1, 1, 1, rnd.randrange(50)]), rnd.choice("ab")) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, v int, g string").repartition(6)
    order = [F.col("v").desc_nulls_first(), F.col("id")]
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert {r.id: r["rank"] for r in O.ranked(frame, order).collect()} == {r[0]: i + 1 for i, r in enumerate(want)}
    got = {r.id: (r["rank"], r.n) for r in O.ranked_within(frame, ["g"], order).collect()}
    for g in "ab":
        own = [r for r in want if r[2] == g]
        assert all(got[r[0]] == (i + 1, len(own)) for i, r in enumerate(own))
    assert O.ranked(frame.limit(0), order).count() == 0


def test_pages_read_only_their_ranges(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v")).repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = O.Pages(rows, [F.col("v").desc(), F.col("id")], str(tmp_path / "p"), size=25)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((r.id, r.v) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    assert held.total == 20_000 and held.pages == 800 and len(held.starts) > 2
    for page in (1, 399, 400, 800):
        got = held.page(page)
        assert [(r.id, r.v, r.total_count) for r in got.collect()] == [(*r, 20_000) for r in want[25 * page - 25 : 25 * page]]
        assert len({f.split("_range=")[1].split("/")[0] for f in got.inputFiles()}) == len(held.ranges(page)) <= 2
    assert held.page(801).count() == 0


def test_deep_page_of_a_screen(spark, monkeypatch):
    from finlark.plans import screener

    rows = spark.range(300).select("id", (F.col("id") % 7).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    plain = [r.asDict() for r in screener.paged(rows, order, 5).collect()]
    monkeypatch.setattr(screener, "DEEP", 100)
    assert [r.asDict() for r in screener.paged(rows, order, 5).collect()] == plain and len(plain) == 50


@pytest.mark.parametrize("block", [4, 256])
def test_composed_averages_are_the_recursion(spark, monkeypatch, block):
    """Series over several blocks and blocks of blocks, short ones, values without a time or price."""
    monkeypatch.setattr(W, "BLOCK", block)
    rnd = np.random.default_rng(1)
    data = {"long": rnd.normal(0, 50, 150).cumsum(), "short": rnd.normal(0, 1, 9), "one": np.ones(1), "ten": rnd.normal(9, 1, 10)}
    rows = [(k, 3 * i, float(x)) for k, v in data.items() for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows + [("long", 4, None), ("long", None, 3.0)], "k string, t int, v double").repartition(5)
    got = {(r.k, r.t): r for r in W.moving_averages(frame, [1, 2, 5, 10], key="k", time="t", value="v").collect()}
    assert len(got) == len(rows)
    for k, v in data.items():
        for n in (1, 2, 5, 10):
            want = W.ema(v, n)
            for i in range(len(v)):
                have = got[k, 3 * i][f"ema{n}"]
                assert have is None if np.isnan(want[i]) else have == pytest.approx(want[i], rel=1e-9, abs=1e-9)


def test_no_python_in_the_averages(spark):
    rows = spark.range(100).select(F.lit("a").alias("ticker"), F.col("id").alias("date"), F.col("id").cast("double").alias("close"))
    plan = W.macd(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_neighbours_share_a_bracket(spark, monkeypatch):
    """Both places of a pair are found where they straddle a hot value, the ends, or two far values."""
    monkeypatch.setattr(O, "FEW", 5)
    values = [0.0] * 700 + [i / 7 for i in range(1, 900)] + [500.0] * 700 + [1e9]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    firsts = [0, 698, 699, 700, 1100, 1597, 1598, 1599, 2298]
    got = O.order_statistics(frame, [], F.col("v"), lambda n: [F.lit(k + j) for k in firsts for j in (0, 1)], cells=8, together=2).first()
    assert list(got["at"]) == [values[k + j] for k in firsts for j in (0, 1)]
