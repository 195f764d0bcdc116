"""Aggregates: buckets, error and accuracy statistics, histograms, quantiles, correlation, sweeps, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlark.functions.math import per
from finlark.operators.order import CELLS, grouped_quantiles, order_statistics

RANGES = 256


def share_of_total(rows: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    """Rows and per cent of all for each bucket, from one pass: the total is summed from the few bucket counts."""
    counts = rows.groupBy(bucket.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total), F.lit(True)).select(name, "n", per(F.col("n") * 100.0, F.col("_total")).alias("pct"))


def error_statistics(predicted: Column, actual: Column) -> list[Column]:
    """n, mae, rmse, bias, direction accuracy in per cent, and counts of errors under 1, 2 and 4."""
    error = predicted - actual
    return [
        F.count(error).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"),
        (F.avg((F.signum(predicted) == F.signum(actual)).cast("double")) * 100).alias("direction"),
        F.count_if(F.abs(error) < 1).alias("excellent"), F.count_if((F.abs(error) >= 1) & (F.abs(error) < 2)).alias("good"), F.count_if((F.abs(error) >= 2) & (F.abs(error) < 4)).alias("fair"), F.count_if(F.abs(error) >= 4).alias("poor"),
    ]


def r_squared(predicted: Column, actual: Column) -> Column:
    """1 less residual over total squares; null where the actual values don't vary."""
    return 1 - F.try_divide(F.avg((actual - predicted) * (actual - predicted)), F.var_pop(actual))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's; 0 where one side doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def alpha_statistics(predicted: Column, actual: Column, confidence: Column, sure: float = 0.8) -> list[Column]:
    """Direction accuracy of non-zero predictions, overall and where sure; mean returns of both sides and their spread; 0 where there are none."""
    right = F.when(predicted != 0, (F.signum(predicted) == F.signum(actual)).cast("double"))
    long, short = F.avg(F.when(predicted > 0, actual)), F.avg(F.when(predicted < 0, actual))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [zero(F.avg(right) * 100).alias("direction"), zero(F.avg(F.when(confidence >= sure, right)) * 100).alias("sure_direction"), zero(long).alias("long"), zero(short).alias("short"), (zero(long) - zero(short)).alias("spread")]


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column and ratio of non-null values, fullest first."""
    wide = rows.agg(*[per(F.count(c) * 1.0, F.count(F.lit(1))).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "ratio").orderBy(F.col("ratio").desc(), "column")


def winsorised_at(rows: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The column clipped to two exact quantiles, as ``<column>_clipped``."""
    least, most = exact_quantiles(rows, column, [low, high])
    return rows.withColumn(f"{column}_clipped", F.greatest(F.lit(least), F.least(F.lit(most), F.col(column))))


def exact_quantiles(rows: DataFrame, column: str, shares: list[float], *, probes: int = CELLS) -> list[float | None]:
    """Exact quantiles, straight between neighbours; null if there are no values. Nulls and NaN are none; infinities are the ends of the order. probes: see ``order_statistics``."""
    names = [f"q{i}" for i in range(len(shares))]
    found = grouped_quantiles(rows, [], F.col(column), shares, names, probes).first()
    return [None] * len(shares) if found is None else [found[n] for n in names]


def sweep(rows: DataFrame, thresholds: list[float], *, confidence: str, predicted: str, actual: str) -> DataFrame:
    """For each threshold the rows at least as sure, their share, direction accuracy and mean return."""
    kept = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where(F.col(confidence) >= F.col("threshold"))
    total = rows.agg(F.count("*").alias("_all"))
    made = kept.groupBy("threshold").agg(F.count("*").alias("n"), F.avg((F.signum(predicted) == F.signum(actual)).cast("double")).alias("accuracy"), F.avg(actual).alias("mean_return"), F.avg(F.when(F.col(predicted) > 0, F.col(actual))).alias("long_return"))
    return made.join(F.broadcast(total), F.lit(True)).withColumn("coverage", per(F.col("n") * 1.0, F.col("_all"))).drop("_all")


def confusion(predicted: Column, actual: Column) -> list[Column]:
    """Counts and the scores made of them; null where a score's denominator is 0."""
    tp, fp, fn, tn = (F.count_if(c) for c in (predicted & actual, predicted & ~actual, ~predicted & actual, ~predicted & ~actual))
    precision, recall = per(tp * 1.0, tp + fp), per(tp * 1.0, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), precision.alias("precision"), recall.alias("recall"), per(2 * precision * recall, precision + recall).alias("f1"), per((tp + tn) * 1.0, tp + fp + fn + tn).alias("accuracy")]


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from the counts at each distinct score.

    Scores are dealt into ranges by approximate quantiles; a window runs within a range, and what lies below a range is added up over the ranges.
    """
    at = rows.groupBy(score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    bounds = sorted(set(at.agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []))
    ranged = at.withColumn("_range", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(score))) if bounds else F.lit(0))
    each = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("q").alias("q")).select("_range", F.coalesce(F.sum("q").over(each), F.lit(0)).alias("_under"))  # a row a range
    inside = Window.partitionBy("_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.join(F.broadcast(sums), "_range").withColumn("below", F.col("_under") + F.coalesce(F.sum("q").over(inside), F.lit(0)))
    return below.agg(per(F.sum(F.col("p") * (F.coalesce("below", F.lit(0)) + F.col("q") / 2.0)), F.sum("p") * F.sum("q") * 1.0).alias("auc"))


def upper_median(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """The element at place floor(n / 2) of each group's ascending values."""
    return order_statistics(rows, [group], value, lambda n: [F.floor(n / 2)]).select(group, F.col("at")[0].alias("median"))


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in a total order. The rest is combined on the map side."""
    least = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(least.alias("_r")).select("_r.*")

