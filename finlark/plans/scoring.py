"""Alpha scoring: features, expert routing, linear scores, signals. Parameters are a table; training makes more of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finlark.functions.math import cap_tier, half_up, per, winsorised
from finlark.operators.aggregates import exact_quantiles
from finlark.operators.order import cut, grouped_quantiles

#: Mean, deviation and weight of each feature for the global expert, in the model's order.
GLOBAL = {
    "price_to_low": (1.3638, 0.3776, -0.0032),
    "major_downgrades": (0.0409, 0.2162, -0.0007),
    "analyst_upside": (29.5690, 55.1452, 0.0239),
    "price_to_high": (0.8381, 0.1401, -0.0002),
    "concern_level": (5.3333, 0.8027, 0.0050),
    "market_cap": (9.8179e10, 3.4064e11, 0.0001),
    "sentiment_score": (0.1095, 0.1893, 0.0007),
    "upgrades_30d": (0.1130, 0.3751, -0.0021),
    "filing_type_factor": (0.7378, 0.4399, -0.0058),
    "tone_change": (-0.0113, 0.2243, -0.0011),
    "eps_surprise": (3.8894, 14.2667, 0.0104),
    "spx_trend_30d": (1.8286, 3.4503, 0.0100),
    "vix_level": (18.1503, 4.4550, 0.0058),
}
#: Percentiles of the global expert's training scores.
GLOBAL_BOUNDS = {"p10": -0.0290, "p25": -0.0158, "p75": 0.0114, "p90": 0.0288}
#: Fixed value: the market's mean 30-day return, in per cent.
MARKET_30D = 0.8
FEATURES = list(GLOBAL)
EXPERT = "expert string, mean array<double>, std array<double>, weight array<double>, p10 double, p25 double, p75 double, p90 double"


def global_expert(spark: SparkSession) -> DataFrame:
    """The parameter table with the global expert alone; sector, tier and sector:tier experts come from training or a file."""
    mean, std, weight = (list(x) for x in zip(*GLOBAL.values(), strict=True))
    return spark.createDataFrame([("global", mean, std, weight, *GLOBAL_BOUNDS.values())], EXPERT)


def features(rows: DataFrame) -> DataFrame:
    """The 13 features beside the row's columns; what is missing takes the training mean, counts take 0."""
    mean = lambda name: F.lit(GLOBAL[name][0])
    price = F.nullif("current_price", F.lit(0.0))
    low, high, target = (F.nullif(F.col(c), F.lit(0.0)) for c in ("fifty_two_week_low", "fifty_two_week_high", "analyst_target_price"))
    made = {
        "price_to_low": per(price, low), "price_to_high": per(price, high), "analyst_upside": (per(target, price) - 1) * 100, "concern_level": F.col("concern"),
        "market_cap": F.nullif("market_cap", F.lit(0.0)), "sentiment_score": F.col("sentiment"), "tone_change": F.col("sentiment") - F.col("prior_sentiment"), "spx_trend_30d": F.col("spx_return_30d"),
    }
    made = {k: F.coalesce(v, mean(k) if k != "spx_trend_30d" else F.lit(0.0)) for k, v in made.items()}
    made |= {
        "major_downgrades": F.coalesce("downgrades", F.lit(0)).cast("double"), "upgrades_30d": F.coalesce("upgrades", F.lit(0)).cast("double"), "eps_surprise": winsorised(F.col("eps_surprise_raw")),
        "filing_type_factor": F.when(F.col("filing_type") == "10-K", 0.0).when(F.col("filing_type") == "10-Q", 1.0).otherwise(2.0), "vix_level": F.coalesce("vix_close", F.lit(20.0)),
    }
    return rows.withColumns({f"f_{k}": made[k] for k in FEATURES})


def score(rows: DataFrame, experts: DataFrame) -> DataFrame:
    """Rows with columns f_*, sector and f_market_cap, scored by the most special expert there is.

    Experts: sector:tier, sector, tier, global, in this order. The table of
    experts is a few hundred rows at most, as its keys are sectors and tiers. Adds expert, raw_score, signal,
    confidence, predicted_30d and contributions (feature to share of the score).
    """
    tier = cap_tier(F.col("f_market_cap"))
    names = [F.concat_ws(":", "sector", tier), F.col("sector"), tier, F.lit("global")]
    out = rows.withColumns({f"_n{i}": n for i, n in enumerate(names)})
    table = experts.agg(F.map_from_entries(F.collect_list(F.struct("expert", F.struct(*experts.columns)))).alias("_m"))  # one row
    out = out.join(F.broadcast(table), F.lit(True)).withColumn("_e", F.coalesce(*[F.try_element_at("_m", F.col(f"_n{i}")) for i in range(len(names))])).drop("_m")
    parts = {f: per(F.col(f"f_{f}") - F.col("_e.mean")[i], F.col("_e.std")[i]) * F.col("_e.weight")[i] for i, f in enumerate(FEATURES)}
    out = out.withColumn("contributions", F.create_map(*[x for f, c in parts.items() for x in (F.lit(f), c)]))
    raw = F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("raw_score", half_up(raw, 4))
    s = F.col("raw_score")
    signal = F.when(s > F.col("_e.p75"), "LONG").when(s < F.col("_e.p25"), "SHORT").otherwise("NEUTRAL")
    sure = F.when((s > F.col("_e.p90")) | (s < F.col("_e.p10")), "high").when(signal != "NEUTRAL", "medium").otherwise("low")
    made = out.withColumns({"expert": F.col("_e.expert"), "signal": signal, "confidence_label": sure, "predicted_30d": half_up(s + MARKET_30D, 2)})
    return made.drop("_e", *[f"_n{i}" for i in range(len(names))])


def gram(rows: DataFrame, x: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Sums of products (upper triangle, right side) and the count, in one pass, by group if asked."""
    p = len(x)
    g = F.array(*[F.sum(F.col(x[i]) * F.col(x[j])) for i in range(p) for j in range(i, p)]).alias("gram_sums")
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), g, F.array(*[F.sum(F.col(c) * F.col(y)) for c in x]).alias("cross_sums"))


def solve(g: list[float], c: list[float], penalty: float) -> list[float]:
    """(G + penalty I) b = c for one group's sums."""
    p = len(c)
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = g
    m = m + m.T - np.diag(np.diag(m)) + penalty * np.eye(p)
    return np.linalg.solve(m, np.asarray(c, float)).tolist()


def standardised(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """z_<column> with sample deviations; those under 1e-8 count as 1."""
    stats = rows.groupBy(*(by or [])).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    met = rows.join(stats, by) if by else rows.join(F.broadcast(stats), F.lit(True))
    sd: dict[str, Column] = {c: F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.coalesce(f"_s_{c}", F.lit(1.0))) for c in columns}
    return met.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / sd[c] for c in columns}).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def ridge_by(rows: DataFrame, x: list[str], y: str, by: list[str], *, penalty: float = 100.0, least: int = 30) -> DataFrame:
    """Weights without an intercept for each group of at least ``least`` rows: by, n and beta.

    Only the sums of a group, p(p + 3) / 2 numbers, meet in one place, however many rows it has.
    """
    @F.pandas_udf("array<double>")
    def solved(g: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([solve(list(a), list(b), penalty) for a, b in zip(g, c, strict=True)])

    return gram(rows, x, y, by).where(F.col("n") >= least).select(*by, "n", solved("gram_sums", "cross_sums").alias("beta"))


def folds(rows: DataFrame, order: str, n: int) -> DataFrame:
    """fold 0 to n by place in time: blocks of equal numbers of rows, found from exact quantiles of the order column."""
    ends = exact_quantiles(rows, order, [(i + 1) / (n + 1) for i in range(n)])
    return rows.withColumn("fold", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col(order))))


def walk_forward(rows: DataFrame, x: list[str], y: str, *, order: str, n: int = 5, penalty: float = 100.0, gap: int = 0) -> DataFrame:
    """For each fold from 1 on: a ridge fit on all rows at least ``gap`` before it, tested on the fold.

    fold, n_train, n_test, direction (share of equal signs) and mae. One pass gives the sums of
    the rows that each fold is the first to learn from; a fit adds up those of the folds up to its own. A second pass tests all folds.
    """
    dealt = folds(rows, order, n)
    start = {r.fold: r.at for r in dealt.groupBy("fold").agg(F.min(order).alias("at")).collect()}
    later = sorted(f for f in start if f > 0)
    first = F.lit(None).cast("int")
    for k in reversed(later):
        first = F.when((F.col("fold") < k) & (F.col(order) < start[k] - gap), k).otherwise(first)
    sums = {r["from"]: r for r in gram(dealt.withColumn("from", first).where(F.col("from").isNotNull()), x, y, ["from"]).collect()}
    fits, trained = {}, {}
    for k in later:
        past = [sums[f] for f in sums if f <= k]
        if past:
            trained[k] = sum(r.n for r in past)
            fits[k] = solve(np.sum([r.gram_sums for r in past], axis=0), np.sum([r.cross_sums for r in past], axis=0), penalty)
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, trained[k], beta) for k, beta in fits.items()], "fold int, n_train bigint, beta array<double>")
    guess = sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(x[1:], 1)), F.col(x[0]) * F.col("beta")[0])
    met = dealt.join(F.broadcast(table), "fold")  # a row a fold
    return met.groupBy("fold", "n_train").agg(F.count("*").alias("n_test"), F.avg((F.signum(guess) == F.signum(y)).cast("double")).alias("direction"), F.avg(F.abs(guess - F.col(y))).alias("mae"))


def train_experts(rows: DataFrame, y: str, *, penalty: float = 100.0, least: dict[str, int] | None = None) -> DataFrame:
    """The parameter table from rows with f_*, sector and a target: global, tier, sector and sector:tier experts.

    The percentiles of the scores are exact, by ``order_statistics``, so no task holds all scores of an expert. Experts are as many as sectors times tiers; their sums go to the driver.
    """
    least = least or {"sector": 50, "tier": 50, "both": 30}
    cols, p = [f"f_{f}" for f in FEATURES], len(FEATURES)
    # Sums by sector and tier, the finest key, from one pass; those of the other experts are sums of these few hundred rows. Centred, so that squares lose nothing.
    near = rows.select("sector", cap_tier(F.col("f_market_cap")).alias("tier"), F.lit(1.0).alias("one"), F.col(y).alias("y"), *[(F.col(c) - GLOBAL[f][0]).alias(c) for c, f in zip(cols, FEATURES, strict=True)])
    sums: dict[str, list] = {}
    for r in gram(near, ["one", *cols], "y", ["sector", "tier"]).collect():
        own = np.asarray([r.n, *r.gram_sums, *r.cross_sums], float)
        names = [("global", 1), (r.tier, least["tier"]), *([(r.sector, least["sector"]), (f"{r.sector}:{r.tier}", least["both"])] if r.sector is not None else [])]
        for name, need in names:
            sums[name] = [need, own + sums[name][1] if name in sums else own]
    found = []
    for name, (need, total) in sums.items():
        n = total[0]
        if n < need:
            continue
        g = np.zeros((p + 1, p + 1))
        g[np.triu_indices(p + 1)] = total[1 : -(p + 1)]
        g, c = g + np.triu(g, 1).T, total[-(p + 1) :]
        mean = g[0, 1:] / n
        cov = g[1:, 1:] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0) / max(n - 1, 1))
        scale = np.where(sd < 1e-8, 1.0, sd)
        weight = np.linalg.solve(cov / np.outer(scale, scale) + penalty * np.eye(p), (c[1:] - mean * c[0]) / scale)
        found.append((name, (mean + [GLOBAL[f][0] for f in FEATURES]).tolist(), np.where(sd > 0, sd, 1.0).tolist(), weight.tolist(), scale.tolist()))
    fitted = rows.sparkSession.createDataFrame(found, "expert string, mean array<double>, std array<double>, weight array<double>, scale array<double>")
    # Each row's scores by all of its experts, at most four.
    tier = cap_tier(F.col("f_market_cap"))
    names = F.array(F.lit("global"), tier, "sector", F.when(F.col("sector").isNotNull(), F.concat_ws(":", "sector", tier)))
    met = rows.select(*cols, F.explode(names).alias("expert")).join(F.broadcast(fitted), "expert")  # a few hundred rows
    guess = sum(((F.col(c) - F.col("mean")[i]) / F.col("scale")[i] * F.col("weight")[i] for i, c in enumerate(cols)), F.lit(0.0))
    scores = cut(met.select("expert", guess.alias("score")))  # read by each round, so worked out once
    bounds = grouped_quantiles(scores, ["expert"], F.col("score"), [0.1, 0.25, 0.75, 0.9], ["p10", "p25", "p75", "p90"]).drop("n")
    return fitted.join(bounds, "expert").select("expert", "mean", "std", "weight", "p10", "p25", "p75", "p90")


def tone_change(filings: DataFrame) -> DataFrame:
    w = Window.partitionBy("company_id", "filing_type").orderBy("filing_date", "filing_id")
    return filings.withColumn("prior_sentiment", F.lag("sentiment").over(w))
