"""Technical indicators and other window operators over (key, time) series.

Frames count rows, as trading days do. Windows are partitioned by the series'
key; a series is one instrument's history.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from finlark.functions.math import per, percent_change
from finlark.operators.order import ranked_within


def series(key: str = "ticker", time: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def when_full(value: Column, counted: Column, w: WindowSpec, n: int) -> Column:
    """The value, if the frame holds n rows that count."""
    return F.when(F.count(counted).over(last_rows(w, n)) == n, value)


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return when_full(F.avg(x).over(last_rows(w, n)), x, w, n)


def with_long_mean(rows: DataFrame, x: str, n: int, name: str, key: str = "ticker", time: str = "date") -> DataFrame:
    """``rows`` with the mean of ``x`` over the last n rows (fewer at a series' start), at a cost that doesn't grow with n.

    A series is cut into blocks of n rows: a frame is the end of one block and the beginning of the next, whose sums run
    along the blocks. Nothing is subtracted, so a value touches no frame but its own. Also adds _b and _i, the block and place.
    """
    numbered = rows.withColumn("_i", F.row_number().over(series(key, time)) - 1).withColumn("_b", F.floor(F.col("_i") / n))
    within = Window.partitionBy(key, "_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = lambda w: F.struct(F.coalesce(F.sum(x).over(w), F.lit(0.0)).alias("s"), F.count(x).over(w).alias("n"))
    summed = numbered.withColumn("_tail", sums(within.orderBy(F.col("_i").desc()))).withColumn("_head", sums(within.orderBy("_i")))
    before = F.when((F.col("_i") + 1) % n != 0, F.lag("_tail", n - 1).over(placed(key)))
    both = summed.withColumn("_before", before)
    total, count = (F.coalesce(F.col(f"_before.{c}"), F.lit(0)) + F.col(f"_head.{c}") for c in ("s", "n"))
    return both.withColumn(name, F.try_divide(total, count)).drop("_tail", "_head", "_before")


def placed(key: str = "ticker") -> WindowSpec:
    """``series`` for rows of ``with_long_mean``, in the order in which they already lie."""
    return Window.partitionBy(key).orderBy("_b", "_i")


def rsi(x: Column, change: Column, n: int, w: WindowSpec) -> Column:
    """Simple means of gains and losses; 100 where nothing was lost. ``change``: x less its lag."""
    gain = F.sum(F.greatest(change, F.lit(0.0))).over(last_rows(w, n)) / n
    loss = F.sum(F.greatest(-change, F.lit(0.0))).over(last_rows(w, n)) / n
    return when_full(F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + per(gain, loss))), change, w, n)


def true_range(high: Column, low: Column, before: Column) -> Column:
    return F.when(before.isNotNull(), F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


def volatility(log_return: Column, n: int, w: WindowSpec) -> Column:
    """Population deviation of the last n returns, a year's worth, in per cent."""
    return when_full(F.stddev_pop(log_return).over(last_rows(w, n)) * float(np.sqrt(252)) * 100, log_return, w, n)


def indicators(prices: DataFrame, *, key: str = "ticker", time: str = "date") -> DataFrame:
    """ma30, ma50, ma200 and ratios, rsi14, rsi30, atr14, volatility30, returns and volume ratio of each row."""
    w = series(key, time)
    lagged = prices.withColumn("_before", F.lag("close").over(w))
    step = lagged.withColumns({"_change": F.col("close") - F.col("_before"), "_log": F.ln(per(F.col("close"), F.col("_before"))), "_tr": true_range(F.col("high"), F.col("low"), F.col("_before"))})
    made = {f"ma{n}": sma(F.col("close"), n, w) for n in (30, 50, 200)}
    made |= {f"rsi{n}": rsi(F.col("close"), F.col("_change"), n, w) for n in (14, 30)}
    made |= {"atr14": sma(F.col("_tr"), 14, w), "volatility30": volatility(F.col("_log"), 30, w), "volume_ma30": sma(F.col("volume"), 30, w)}
    made |= {f"return_{n}d": percent_change(F.col("close"), F.lag("close", n).over(w)) for n in (7, 30, 90)}
    out = step.withColumns(made)
    ratios = {f"price_to_ma{n}": per(F.col("close"), F.col(f"ma{n}")) for n in (30, 50, 200)} | {"volume_ratio": per(F.col("volume"), F.col("volume_ma30"))}
    return out.withColumns(ratios).drop("_before", "_change", "_log", "_tr")


def ema(values: np.ndarray, n: int) -> np.ndarray:
    """Of one series in memory: seeded with the mean of the first n values; none before the n-th."""
    out = np.full(len(values), np.nan)
    if len(values) >= n:
        out[n - 1] = values[:n].mean()
        k = 2 / (n + 1)
        for i in range(n, len(values)):
            out[i] = (values[i] - out[i - 1]) * k + out[i - 1]
    return out


BLOCK = 256  # rows whose maps are composed by one window, and blocks by one fold


def composed(maps: Column) -> Column:
    """One map a x + b for an array of maps, applied in order."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, one, lambda m, x: F.struct((m["a"] * x["a"]).alias("a"), (m["b"] * x["a"] + x["b"]).alias("b")))


def positions(rows: DataFrame, *, key: str, time: str) -> DataFrame:
    """``rows`` in blocks of up to BLOCK in order of time: _part and _block (together ascending), and _i, the row's place in its series, from 0 on."""
    placed = ranked_within(rows, [key], [F.col(time)], "_i", "_n").drop("_n").withColumn("_i", F.col("_i") - 1)
    return placed.withColumn("_block", F.floor(F.col("_i") / BLOCK))


def moving_averages(rows: DataFrame, lengths: list[int], *, key: str, time: str, value: str) -> DataFrame:
    """``rows`` with _i and ema<n> for each length: seeded with the mean of the first n values, null before the n-th.

    A step x -> a x + b is a map, and maps compose: the first n rows add x / n each, later ones are (1 - k) e + k x. The maps of a
    block of rows are composed by a window, those of blocks by folds over at most BLOCK of them and over what is left, so a series
    of any length spreads over tasks. Rows without a value or time are left out.
    """
    placed = positions(rows.where(F.col(value).isNotNull() & F.col(time).isNotNull()), key=key, time=time)
    start = F.col("_block") * BLOCK
    w = Window.partitionBy(key, "_block").orderBy("_i")
    made = placed
    for n in lengths:
        k = 2 / (n + 1)
        # The product of the factors from the block's first row to this one; the sum of the addends, each freed of the factors up to it.
        fell = F.greatest(F.lit(0), F.col("_i") - F.greatest(F.lit(n), start) + 1)
        made = made.withColumn(f"_a{n}", F.pow(F.lit(1 - k), fell) if n > 1 else F.lit(1.0))
        made = made.withColumn(f"_s{n}", F.sum(F.when(F.col("_i") < n, F.col(value) / n).otherwise(F.col(value) * k) / F.col(f"_a{n}")).over(w))
    ends = [F.max_by(F.struct(F.col(f"_a{n}").alias("a"), (F.col(f"_a{n}") * F.col(f"_s{n}")).alias("b")), "_i").alias(f"_m{n}") for n in lengths]
    blocks = made.groupBy(key, "_block").agg(*ends).withColumn("_super", F.floor(F.col("_block") / BLOCK))
    before = Window.partitionBy(key, "_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_p{n}": composed(F.collect_list(f"_m{n}").over(before)) for n in lengths})
    whole = [F.max_by(F.struct((F.col(f"_p{n}.a") * F.col(f"_m{n}.a")).alias("a"), (F.col(f"_p{n}.b") * F.col(f"_m{n}.a") + F.col(f"_m{n}.b")).alias("b")), "_block").alias(f"_m{n}") for n in lengths]
    supers = blocks.groupBy(key, "_super").agg(*whole)
    first = Window.partitionBy(key).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(key, "_super", *[composed(F.collect_list(f"_m{n}").over(first))["b"].alias(f"_e{n}") for n in lengths])
    entry = blocks.join(supers, [key, "_super"]).select(key, "_block", *[(F.col(f"_p{n}.a") * F.col(f"_e{n}") + F.col(f"_p{n}.b")).alias(f"_e{n}") for n in lengths])
    out = made.join(entry, [key, "_block"])
    value_of = lambda n: F.col(value).cast("double") if n == 1 else F.when(F.col("_i") >= n - 1, F.col(f"_a{n}") * (F.col(f"_e{n}") + F.col(f"_s{n}")))
    return out.select(*rows.columns, "_i", *[value_of(n).alias(f"ema{n}") for n in lengths])


def macd(prices: DataFrame, *, key: str = "ticker", time: str = "date", fast: int = 12, slow: int = 26, least: int = 35) -> DataFrame:
    """key, time, ema_fast, ema_slow and macd (from the ``least``-th row on) of the rows with a price, by composed maps."""
    made = moving_averages(prices.select(key, time, "close"), [fast, slow], key=key, time=time, value="close")
    difference = F.when(F.col("_i") >= least - 1, F.col(f"ema{fast}") - F.col(f"ema{slow}"))
    return made.select(key, time, F.col(f"ema{fast}").alias("ema_fast"), F.col(f"ema{slow}").alias("ema_slow"), difference.alias("macd"))


def year_range(prices: DataFrame, *, key: str = "ticker", day: str = "day", days: int = 365, least: int = 20) -> DataFrame:
    """high_52w and low_52w over the days [d - 365, d], where at least 20 rows are there. day: an integer."""
    w = Window.partitionBy(key).orderBy(day).rangeBetween(-days, 0)
    enough = F.count("*").over(w) >= least
    return prices.withColumns({"high_52w": F.when(enough, F.max("high").over(w)), "low_52w": F.when(enough, F.min("low").over(w))})


def forward_return(n: int, w: WindowSpec, price: str = "close") -> Column:
    return percent_change(F.lead(price, n).over(w), F.col(price))


def drawdown(equity: DataFrame, *, key: str, time: str, value: str) -> DataFrame:
    """peak so far and drawdown in per cent."""
    w = series(key, time).rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", per((F.col("peak") - F.col(value)) * 100.0, F.col("peak")))


def forward_filled(observed: DataFrame, first: int, last: int, *, key: str, day: str, value: str, back: int = 5) -> DataFrame:
    """A row for each key and day from first to last, with the last value of the last ``back`` days. day: an integer."""
    spine = observed.select(key).distinct().withColumn(day, F.explode(F.sequence(F.lit(first), F.lit(last))))
    w = Window.partitionBy(key).orderBy(day).rangeBetween(-back, 0)
    return spine.join(observed.select(key, day, value), [key, day], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def change_of_rank(events: DataFrame, *, key: str, time: list[str], value: str) -> DataFrame:
    """For each key the latest and the one before of the rows with a value, and their difference."""
    w = Window.partitionBy(key).orderBy(*[F.col(t).desc() for t in time])
    rows = events.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    both = rows.groupBy(key).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("_k") == 2, F.col(value))).alias("previous"))
    return both.where("previous is not null").withColumn("change", F.col("latest") - F.col("previous")).withColumn("change_pct", percent_change(F.col("latest"), F.col("previous")))


def every_nth(rows: DataFrame, *, bucket: str, order: list[Column], target: int) -> DataFrame:
    """A systematic sample: in each bucket every (n // target)-th row, then the first ``target``."""
    placed = ranked_within(rows, [bucket], order, "_rank", "_n")
    step, i = F.greatest(F.lit(1), F.floor(F.col("_n") / target)), F.col("_rank") - 1
    return placed.where((i % step == 0) & (F.floor(i / step) < target)).select(*rows.columns)
