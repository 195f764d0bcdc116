"""Registered model comparisons. MLlib's models have no SQL; tests compare what is linear with NumPy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.plans import bindings as B
from finlark.plans import learning
from finlark.plans.queries_aggregate import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = B.WITH + sql
        return run

    return register


BASELINE = ["eps_surprise", "surprise_size", "eps_beat", "eps_miss", "large_beat", "large_miss"]
ENHANCED = [*BASELINE, "risk_score", "sentiment", "guidance_raised", "guidance_lowered"]
FULL = [*ENHANCED, "profit_margin", "debt_to_assets"]
VOLUME = ["volume_ratio", "volume_trend", "volume_spike"]
FACTORS = [*BASELINE, "some_short", "much_short", "quiet", "busy", "suspicious", "beat_some_short", "beat_quiet"]


def surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with the models' inputs: surprise flags, scores, guidance, ratios, volume and short-interest factors."""
    s, k = F.col("predicted"), F.col("filing_id")
    short, volume = F.col("concern") * 2, F.col("confidence") * 2
    rows = B.filings(spark, sf_dir).withColumns({
        "eps_surprise": s, "surprise_size": F.abs(s), "eps_beat": (s > 2).cast("double"), "eps_miss": (s < -2).cast("double"), "large_beat": (s > 10).cast("double"), "large_miss": (s < -10).cast("double"), "risk_score": F.when(k % 4 != 0, F.col("concern")),
        "guidance_raised": (k % 3 == 0).cast("double"), "guidance_lowered": (k % 3 == 1).cast("double"), "profit_margin": F.when(k % 5 != 0, (k % 37 - 9).cast("double")), "debt_to_assets": (k % 91).cast("double"), "mostly_missing": F.when(k % 3 == 0, s),
        "volume_ratio": volume, "volume_trend": (k % 21 - 10).cast("double"), "volume_spike": (volume > 1.3).cast("double"), "up": F.col("actual") > 0,
        "some_short": short.between(5, 10).cast("double"), "much_short": (short > 15).cast("double"), "quiet": (volume < 0.8).cast("double"), "busy": (volume > 1.3).cast("double"),
    })
    return rows.withColumns({"suspicious": F.col("much_short") * F.col("busy"), "beat_some_short": F.col("eps_beat") * F.col("some_short"), "beat_quiet": F.col("eps_beat") * F.col("quiet")})


@query("M12_model_zoo")
def zoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six models over five folds; a column that is mostly missing is left out, the form becomes indicators."""
    rows = surprises(spark, sf_dir)
    return rounded(learning.compare(rows, ["eps_surprise", "sentiment", "risk_score", "confidence", "mostly_missing"], "actual", order="day", category="filing_type", values=["10-K", "10-Q"]))


@query("M13_logistic_baseline")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.logistic(surprises(spark, sf_dir), BASELINE, "up", order="day", gain="actual"))


@query("M14_factor_models")
def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.classify(surprises(spark, sf_dir), {kind: (FACTORS, kind) for kind in ("logistic", "forest", "boosted")}, "up", order="day", gain="actual"))


@query("M15_polynomials")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.polynomials(B.filings(spark, sf_dir), "sentiment", "actual"))


@query("M16_penalties_and_interactions")
def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge lines over five penalties, with and without interactions of the form with surprise and sentiment."""
    rows = surprises(spark, sf_dir)
    annual = (F.col("filing_type") == "10-K").cast("double")
    rows = rows.withColumns({"annual": annual, "annual_surprise": annual * F.col("eps_surprise"), "annual_sentiment": annual * F.col("sentiment"), "surprise_sentiment": F.col("eps_surprise") * F.col("sentiment")})
    plain = [*BASELINE, "sentiment", "annual"]
    sets = {f"{name}_{alpha:g}": (columns, alpha) for name, columns in (("plain", plain), ("interactions", [*plain, "annual_surprise", "annual_sentiment", "surprise_sentiment"])) for alpha in (0.01, 0.1, 1.0, 10.0, 100.0)}
    return rounded(learning.lines(rows, sets, "actual"))


@query("M16_stepwise")
def stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.stepwise(surprises(spark, sf_dir), [*BASELINE, "sentiment", "concern", "confidence"], "actual"))


@query("V16_feature_ladder")
def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.classify(surprises(spark, sf_dir), {"baseline": (BASELINE, "logistic"), "enhanced": (ENHANCED, "logistic"), "full": (FULL, "boosted")}, "up", order="day", gain="actual"))


@query("V17_volume_comparison")
def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = learning.classify(surprises(spark, sf_dir), {"baseline": (BASELINE, "logistic"), "volume": ([*BASELINE, *VOLUME], "logistic")}, "up", order="day", gain="actual")
    return rounded(made.select("model", "features", "n_test", "accuracy", "auc").join(made.agg(F.max_by("model", F.struct("accuracy", "model")).alias("best")), F.lit(True)))


@query("V18_single_forecasts")
def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings of the last year, from a forest on those before, and how sure each is."""
    rows = surprises(spark, sf_dir)
    last = rows.agg(F.max("day")).first()[0] - 365
    made = learning.forecast(rows.where(F.col("day") <= last), rows.where(F.col("day") > last), FULL, "actual")
    k = F.col("filing_id")
    return rounded(made.select("filing_id", "predicted", learning.certainty(F.col("predicted"), k % 4, k % 13, k % 11).alias("certainty")))


@query("V18_certainty", "select filing_id, round(least(0.95, 0.65 + case when filing_id % 4 >= 2 then 0.1 when filing_id % 4 = 1 then 0.05 else 0 end + case when filing_id % 13 >= 10 and filing_id % 11 > 5 then 0.08 when filing_id % 13 >= 5 then 0.04 else 0 end + case when abs(predicted) >= 5 then 0.1 when abs(predicted) >= 3 then 0.05 else 0 end), 6) as certainty from filing")
def certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("filing_id")
    return rounded(B.filings(spark, sf_dir).select("filing_id", learning.certainty(F.col("predicted"), k % 4, k % 13, k % 11).alias("certainty")))


@query("V19_target_comparison")
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elastic net on four targets: 7 and 30 days, plain and against the market."""
    rows = surprises(spark, sf_dir).withColumns({"actual_30d": F.col("actual") + F.col("predicted") / 4, "alpha_7d": F.col("actual") - F.col("sentiment"), "alpha_30d": F.when(F.col("filing_id") % 6 != 0, F.col("actual") * 2 - F.col("concern"))})
    net = {"elastic_net": learning.regressors()["elastic_net"]}
    made = [learning.compare(rows, ["eps_surprise", "sentiment", "concern", "confidence"], t, order="day", models=net).withColumn("target", F.lit(t)) for t in ("actual", "actual_30d", "alpha_7d", "alpha_30d")]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return rounded(out)
