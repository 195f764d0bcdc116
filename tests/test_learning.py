"""Fits, quantiles, areas and folds beside plain NumPy and Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finlark.operators.aggregates import auc, exact_quantiles, winsorised_at
from finlark.plans import learning, portfolio, scoring
from finlark.plans.queries_learning import BASELINE, surprises


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 3))
    y = 1.5 * x[:, 0] - 0.5 * x[:, 1] ** 2 + rnd.normal(size=400)
    rows = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "day int, a double, b double, c double, y double").repartition(3)
    return rows, x, y


def test_lines_are_least_squares(table):
    rows, x, y = table
    got = {r.model: r for r in learning.lines(rows, {"plain": (["a", "b", "c"], 0.0), "two": (["c", "a"], 0.0), "ridge": (["a", "b"], 50.0)}, "y").collect()}
    for name, at, penalty in (("plain", [0, 1, 2], 0), ("two", [2, 0], 0), ("ridge", [0, 1], 50)):
        z = (x[:, at] - x[:, at].mean(0)) / x[:, at].std(0)
        beta = np.linalg.solve(z.T @ z + penalty * np.eye(len(at)), z.T @ (y - y.mean()))
        guess = z @ beta + y.mean()
        assert math.isclose(got[name].r2, 1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs_tol=1e-9)
        assert math.isclose(got[name].mae, np.abs(y - guess).mean(), rel_tol=1e-9) and math.isclose(got[name].direction, ((guess > 0) == (y > 0)).mean())


def test_polynomials_and_steps(table):
    rows, x, y = table
    got = {r.model: r.r2 for r in learning.polynomials(rows, "b", "y").collect()}
    for d in range(1, 6):
        guess = np.polyval(np.polyfit(x[:, 1], y, d), x[:, 1])
        assert math.isclose(got[f"degree_{d}"], 1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs_tol=1e-8)

    def r2(at):
        m = np.column_stack([np.ones(len(y)), x[:, at]])
        return 1 - ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    chosen = []
    for r in learning.stepwise(rows, ["a", "b", "c"], "y").orderBy("step").collect():
        best = max((i for i in range(3) if i not in chosen), key=lambda i: r2([*chosen, i]))
        chosen.append(best)
        assert r.column == "abc"[best] and math.isclose(r.r2, r2(chosen), abs_tol=1e-9)


def test_logistic_baseline_by_newton(spark, sf):
    rows = surprises(spark, sf)
    got = learning.logistic(rows, BASELINE, "up", order="day", gain="actual").first()
    data = rows.select("day", "up", "actual", *BASELINE).toPandas()
    cut = np.quantile(data["day"], 0.7)
    x, y = data[BASELINE].to_numpy(float), data["up"].to_numpy(float)
    train, test = (data["day"] <= cut).to_numpy(), (data["day"] > cut).to_numpy()
    sd = x[train].std(0, ddof=1)
    z = (x - x[train].mean(0)) / np.where(sd > 0, sd, 1)
    m = np.column_stack([np.ones(len(y)), z])
    w, free = np.zeros(m.shape[1]), np.diag([0.0] + [1.0] * len(BASELINE))
    for _ in range(30):
        p = 1 / (1 + np.exp(-m[train] @ w))
        w -= np.linalg.solve((m[train] * (p * (1 - p))[:, None]).T @ m[train] + free + 1e-9 * np.eye(len(w)), m[train].T @ (p - y[train]) + free @ w)
    p = m[test] @ w
    up = p > 0
    pairs = [(a > b) + (a == b) / 2 for a in p[y[test] == 1] for b in p[y[test] == 0]]
    assert got.n_test == test.sum() and abs(got.accuracy - (up == (y[test] == 1)).mean()) < 0.01 and abs(got.auc - np.mean(pairs)) < 0.005
    assert abs(got.spread - (data["actual"][test][up].mean() - data["actual"][test][~up].mean())) < 0.2


def test_linear_models_of_the_zoo(spark, table):
    rows, x, y = table
    got = {r.model: r for r in learning.compare(rows.withColumn("gone", F.when(F.col("day") % 3 == 0, 1.0)), ["a", "b", "c", "gone"], "y", order="day", n=5, models={k: v for k, v in learning.regressors().items() if k in ("ols", "ridge")}).collect()}
    ends = np.quantile(np.arange(400), [k / 6 for k in range(1, 6)])
    fold = np.array([(ends < d).sum() for d in range(400)])
    for name, penalty in (("ols", 0.0), ("ridge", 1.0)):
        mae, right = [], []
        for k in range(1, 6):
            t, s = fold < k, fold == k
            z = (x - x[t].mean(0)) / x[t].std(0, ddof=1)
            beta = np.linalg.solve(z[t].T @ z[t] + penalty * t.sum() * np.eye(3), z[t].T @ (y[t] - y[t].mean()))
            guess = z[s] @ beta + y[t].mean()
            mae.append(np.abs(guess - y[s]).mean())
            right.append((np.sign(guess) == np.sign(y[s])).mean())
        if name == "ols":
            assert math.isclose(got[name].mae, np.mean(mae), rel_tol=1e-4) and math.isclose(got[name].direction, np.mean(right), rel_tol=1e-3)
        assert got[name].folds == 5
    assert got["ridge"].mae > got["ols"].mae * 0.9


def test_trees_learn_and_all_models_run(spark, table):
    rows, _, _ = table
    small = learning.regressors(trees=5, depth=4, boosted_depth=3)
    got = {r.model: r for r in learning.compare(rows, ["a", "b", "c"], "y", order="day", n=2, models=small).collect()}
    assert set(got) == {"ols", "ridge", "lasso", "elastic_net", "forest", "boosted"} and got["boosted"].r2 > 0.3 and got["forest"].r2 > 0.3
    made = learning.classify(rows.withColumn("up", F.col("y") > 0), {k: (["a", "b", "c"], k) for k in ("logistic", "forest", "boosted")}, "up", order="day", gain="y", sizes={"trees": 5, "depth": 4, "boosted_depth": 3})
    assert {r.model for r in made.collect()} == {"logistic", "forest", "boosted"} and made.where("accuracy < 0.7 or auc < 0.7 or spread <= 0").count() == 0
    asked = learning.forecast(rows.where("day < 300"), rows.where("day >= 300").withColumn("predicted", F.lit(0)), ["a", "b", "c"], "y", trees=20, depth=5)
    assert asked.count() == 100 and asked.stat.corr("predicted", "y") > 0.7


def test_exact_quantiles(spark):
    rnd = np.random.default_rng(1)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for values in (rnd.normal(size=3000), np.repeat([1.0, 2.0, 5.0], [10, 900, 3]), np.array([7.0]), np.concatenate((rnd.normal(size=50), [1e12, -1e12])), rnd.integers(0, 50, 700).astype(float)):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        for probes in (3, 2048):
            assert np.allclose(exact_quantiles(rows, "v", shares, probes=probes), np.quantile(values, shares), rtol=1e-12)
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]
    assert winsorised_at(rows, "v", 0.1, 0.9).agg(F.max("v_clipped")).first()[0] == np.quantile(values, 0.9)


def test_auc_of_continuous_scores(spark):
    rnd = random.Random(4)
    data = [(rnd.choice([rnd.random(), 0.5]), rnd.random() < 0.4) for _ in range(900)]
    pairs = [(a > b) + (a == b) / 2 for (a, p), (b, q) in itertools.product(data, data) if p and not q]
    assert math.isclose(auc(spark.createDataFrame(data, "s double, l boolean").repartition(4), "s", "l").first().auc, sum(pairs) / len(pairs), rel_tol=1e-9)
    assert auc(spark.createDataFrame([(0.5, True)], "s double, l boolean"), "s", "l").first().auc is None


def test_walk_forward_with_a_gap(table):
    rows, x, y = table
    for gap in (0, 30, 100):
        got = {r.fold: r for r in scoring.walk_forward(rows, ["a", "b"], "y", order="day", n=4, gap=gap).collect()}
        ends = np.quantile(np.arange(400), [k / 5 for k in range(1, 5)])
        fold, day = np.array([(ends < d).sum() for d in range(400)]), np.arange(400)
        for k in range(1, 5):
            past, own = (fold < k) & (day < day[fold == k].min() - gap), fold == k
            if not past.any():
                assert k not in got
                continue
            beta = np.linalg.solve(x[past][:, :2].T @ x[past][:, :2] + 100 * np.eye(2), x[past][:, :2].T @ y[past])
            guess = x[own][:, :2] @ beta
            assert (got[k].n_train, got[k].n_test) == (past.sum(), own.sum()) and math.isclose(got[k].mae, np.abs(guess - y[own]).mean(), rel_tol=1e-9)
            assert math.isclose(got[k].direction, (np.sign(guess) == np.sign(y[own])).mean())


def test_global_expert_is_a_ridge(spark, sf):
    from finlark.plans.queries_model import inputs

    rows = scoring.features(inputs(spark, sf)).cache()
    made = {r.expert: r for r in scoring.train_experts(rows, "actual").collect()}
    data = rows.select(*[f"f_{f}" for f in scoring.FEATURES], "actual").toPandas().to_numpy(float)
    x, y = data[:, :-1], data[:, -1]
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(sd < 1e-8, 1, sd)
    beta = np.linalg.solve(z.T @ z + 100 * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(made["global"].weight, beta, atol=1e-6) and np.allclose(made["global"].mean, x.mean(0))
    low, high = np.quantile(z @ beta, [0.1, 0.9])
    assert abs(made["global"].p10 - low) < 0.02 and abs(made["global"].p90 - high) < 0.02
    scored = scoring.score(rows, scoring.train_experts(rows, "actual"))
    assert scored.where("expert is null").count() == 0 and {r.expert for r in scored.select("expert").distinct().collect()} <= set(made)


def test_portfolio_fold_beside_a_plain_one(spark):
    rnd = random.Random(2)
    rows = [(p, i, rnd.randrange(6), rnd.choice(["LONG", "SHORT"]), (d := rnd.randrange(100)), d + rnd.randrange(1, 15), rnd.uniform(5, 900), rnd.uniform(5, 900), rnd.random(), rnd.uniform(-9, 9)) for p in range(3) for i in range(120)]
    names = "portfolio_id bigint, trade_id bigint, ticker bigint, direction string, day int, exit_day int, entry double, exit double, confidence double, predicted double"
    got = {(r.portfolio_id, r.trade_id): r for r in portfolio.run(spark.createDataFrame(rows, names)).collect()}
    taken = 0
    for p in range(3):
        cash, held = 100_000.0, []
        for _, i, ticker, direction, day, exit_day, entry, exit_, sure, move in sorted((r for r in rows if r[0] == p), key=lambda r: (r[4], r[1])):
            for h in sorted(held):
                if h[0] <= day:
                    cash += h[2]
                    held.remove(h)
            n = int(min(sure * abs(move) / 100, 0.1) * (cash + sum(h[3] for h in held)) // entry)
            if n < 1 or n * entry + 1 > cash or any(h[4] == ticker for h in held):
                assert (p, i) not in got
                continue
            gain = (n * exit_ - n * entry if direction == "LONG" else n * entry - n * exit_) - 2
            cash -= n * entry + 1
            held.append((exit_day, i, n * entry + gain + 1, n * entry, ticker))
            taken += 1
            assert got[p, i].shares == n and math.isclose(got[p, i].pnl, gain, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[p, i].cash_after, cash, rel_tol=1e-9)
    assert taken == len(got) > 50


@pytest.mark.parametrize("fit", ["forecast", "compare", "classify"])
def test_fits_are_dealt_over_all_cores(spark, monkeypatch, fit):
    """A table of one split is no longer learnt from on one core."""
    seen = []
    kind = {"forecast": learning.RandomForestRegressor, "compare": learning.LinearRegression, "classify": learning.LogisticRegression}[fit]
    plain = kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, rows: (seen.append(rows.rdd.getNumPartitions()), plain(self, rows))[1])
    rows = spark.range(300).select(F.col("id").alias("day"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 - 2).cast("double").alias("y"), (F.col("id") % 2 == 0).alias("up")).coalesce(1)
    if fit == "forecast":
        assert learning.forecast(rows, rows, ["a"], "y", trees=2, depth=2).count() == 300
    elif fit == "compare":
        assert learning.compare(rows, ["a"], "y", order="day", n=2, models={"ols": learning.regressors()["ols"]}).first().folds == 2
    else:
        assert learning.classify(rows, {"one": (["a"], "logistic")}, "up", order="day").first().n_test == 90
    assert set(seen) == {spark.sparkContext.defaultParallelism}


def test_rows_alike_are_learnt_from_once(spark, monkeypatch):
    """A forest and boosted trees had each of the rows; ten copies of all give the same scores."""
    seen = []
    for kind in (learning.RandomForestClassifier, learning.GBTClassifier):
        plain = kind._fit
        monkeypatch.setattr(kind, "_fit", lambda self, rows, plain=plain: (seen.append(rows.count()), plain(self, rows))[1])
    rows = spark.range(600).select((F.col("id") % 100).alias("day"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 7 + F.col("id") % 3 + F.col("id") % 2 > 4).alias("up"), F.when(F.col("id") % 4 > 0, (F.col("id") % 9 - 4).cast("double")).alias("gain"))
    sets = {k: (["a", "b"], k) for k in ("logistic", "boosted", "forest")}
    once, often = ({r.model: r for r in learning.classify(r, sets, "up", order="day", gain="gain", sizes={"trees": 3, "depth": 3, "boosted_depth": 2}).collect()} for r in (rows, rows.crossJoin(spark.range(10).select(F.col("id").alias("copy")))))
    assert max(seen) <= 42 and often["logistic"].n_test == 10 * once["logistic"].n_test
    for c in ("accuracy", "auc", "precision", "recall", "f1", "spread"):
        assert math.isclose(once["boosted"][c], often["boosted"][c], rel_tol=1e-9)
