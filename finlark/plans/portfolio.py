"""Paper portfolios: gate, ordered fold over signals and prices, valuation, back-test statistics."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlark.functions.math import per
from finlark.operators.asof import asof_join
from finlark.operators.windows import drawdown

FEE = 1.0


def gate(signals: DataFrame, portfolios: DataFrame, open_trades: DataFrame, least_move: float = 0.5) -> DataFrame:
    """Signals that an active portfolio may trade: sure enough, large enough, not neutral, no open position in the ticker."""
    met = signals.join(portfolios.where("is_active").select("portfolio_id", "min_confidence"), "portfolio_id")
    kept = met.where((F.col("confidence") >= F.col("min_confidence")) & (F.abs("predicted") >= least_move) & (F.col("signal") != "NEUTRAL")).drop("min_confidence")
    return kept.join(open_trades.where("status = 'OPEN'").select("portfolio_id", "ticker"), ["portfolio_id", "ticker"], "left_anti")


def positions(asked: DataFrame, prices: DataFrame, hold: int, *, inclusive: bool = True) -> DataFrame:
    """asked (ticker, day and more) with entry_day, entry, exit_day and exit; what finds no close at either end is left out.

    Entry is at the first price from the day on (or after it), exit at the first from ``hold`` days after that: the
    exit hangs on the entry's row alone, so a window over each series, which has a row a day, gives it to all that enter there.
    """
    later = Window.partitionBy("ticker").orderBy(F.col("day").desc()).rangeBetween(Window.unboundedPreceding, -hold)
    out = prices.select("ticker", "day", "close", F.last(F.struct("day", "close")).over(later).alias("out"))
    side = out.select("ticker", "day", "close", F.col("out.day").alias("exit_day"), F.col("out.close").alias("exit"))
    met = asof_join(asked, side, by=["ticker"], on="day", take=["close", "exit_day", "exit"], direction="forward", inclusive=inclusive)
    return met.drop("day").where("close_right is not null and exit_right is not null").withColumnsRenamed({"day_right": "entry_day", "close_right": "entry", "exit_day_right": "exit_day", "exit_right": "exit"})


TRADE = "portfolio_id bigint, trade_id bigint, ticker bigint, direction string, day int, exit_day int, shares bigint, entry_value double, exit_value double, pnl double, pnl_pct double, cash_after double"


class Account:
    """The cash of one portfolio and what it holds: a heap of (exit day, trade, what it gives back, what it cost, ticker)."""

    def __init__(self, start: float, largest: float, fee: float):
        self.cash, self.invested, self.largest, self.fee = start, 0.0, largest, fee
        self.due: list[tuple] = []
        self.tickers: set = set()

    def resume(self, due: list[tuple]) -> None:
        self.due = sorted(due)
        self.tickers = {d[4] for d in due}

    def close(self, day: int) -> list[tuple]:
        """Takes out what is due by ``day``, in order of exit day and trade."""
        out = []
        while self.due and self.due[0][0] <= day:
            out.append(heapq.heappop(self.due))
            self.cash, self.invested = self.cash + out[-1][2], self.invested - out[-1][3]
            self.tickers.discard(out[-1][4])
        return out

    def open(self, trade: int, ticker: int, direction: str, exit_day: int, entry: float, exit_: float, confidence: float, predicted: float) -> tuple[tuple, tuple] | None:
        """What becomes due, and (shares, entry_value, exit_value, pnl, pnl_pct, cash_after); None if the trade isn't taken."""
        value = self.cash + (self.invested if self.due else 0.0)
        shares = int(min(confidence * abs(predicted) / 100.0, self.largest) * value // entry) if entry > 0 else 0
        paid = shares * entry
        if shares < 1 or paid + self.fee > self.cash or ticker in self.tickers:
            return None
        got = shares * exit_
        pnl = (got - paid if direction == "LONG" else paid - got) - 2 * self.fee
        self.cash -= paid + self.fee
        self.invested += paid
        self.tickers.add(ticker)
        due = (exit_day, trade, paid + pnl + self.fee, paid, ticker)
        heapq.heappush(self.due, due)
        return due, (shares, paid, got, pnl, pnl / paid * 100, self.cash)


def run(signals: DataFrame, *, start: float = 100_000.0, largest: float = 0.1, fee: float = FEE) -> DataFrame:
    """Trades of each portfolio, taken in order of day and id, with the cash that each leaves.

    signals: portfolio_id, trade_id, ticker, direction, day, exit_day, entry, exit, confidence and predicted.
    What a trade may spend depends on what earlier ones have left, so one portfolio is
    one sequential task, which holds its signals (some hundred bytes each); portfolios run side by side. A position is closed before
    later trades of its exit day or after are opened. Cash grows by what was paid plus the profit, for shorts too.
    """
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        account, out = Account(start, largest, fee), []
        for r in rows.sort_values(["day", "trade_id"]).itertuples():
            account.close(r.day)
            made = account.open(r.trade_id, r.ticker, r.direction, r.exit_day, r.entry, r.exit, r.confidence, r.predicted)
            if made is not None:
                out.append((r.portfolio_id, r.trade_id, r.ticker, r.direction, r.day, r.exit_day, *made[1]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRADE.split(", ")])

    return signals.groupBy("portfolio_id").applyInPandas(fold, TRADE)


def statistics(trades: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """trades, win rate, profit factor, mean gain, best and worst trade by portfolio; a gain of 0 is no win."""
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    return trades.groupBy(key).agg(
        F.count("*").alias("trades"), (F.avg(win.cast("double")) * 100).alias("win_rate"), F.try_divide(F.sum(F.when(win, F.col("pnl"))), -F.sum(F.when(loss, F.col("pnl")))).alias("profit_factor"),
        F.avg("pnl_pct").alias("mean_pct"), F.max_by("trade_id", "pnl").alias("best"), F.min_by("trade_id", "pnl").alias("worst"), F.avg(F.col("exit_day") - F.col("day")).alias("mean_days"),
    )


def sharpe(returns: DataFrame, key: str, value: str, periods: float = 252.0) -> DataFrame:
    """Mean over population deviation, a year's worth; null where nothing varies."""
    return returns.groupBy(key).agg((per(F.avg(value), F.stddev_pop(value)) * periods**0.5).alias("sharpe"))


def equity(trades: DataFrame, start: float = 100_000.0) -> DataFrame:
    """Value after each closed trade, its peak and drawdown."""
    w = Window.partitionBy("portfolio_id").orderBy("exit_day", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.select("portfolio_id", F.struct("exit_day", "trade_id").alias("at"), (F.sum("pnl").over(w) + start).alias("equity"))
    return drawdown(rows, key="portfolio_id", time="at", value="equity")


def marked(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Open trades at the last price of their ticker: market value and gain."""
    last = prices.groupBy("ticker").agg(F.max_by("close", "day").alias("price"))
    gain = F.when(F.col("direction") == "LONG", F.col("price") * F.col("shares") - F.col("entry_value")).otherwise(F.col("entry_value") - F.col("price") * F.col("shares"))
    return trades.where("status = 'OPEN'").join(last, "ticker").withColumns({"market_value": F.col("price") * F.col("shares"), "unrealised": gain})
