"""Keyed state with timers: quotas that refuse, and paper trades that open and close.

State lives in Spark's state store under the query's checkpoint, so a restarted query goes on where it was. Events are worked off in the order of
their time: a row waits until the watermark has passed it, and what comes later than the watermark allows is dropped by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from finlark.plans.portfolio import FEE, TRADE, Account

DAY = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Quota(StatefulProcessor):
    """Counts allowed calls of a key by local day; the counter goes at local midnight."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day int", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["call_at", "call_id"], ignore_index=True)
        allowed = pd.Series(False, index=calls.index)
        for day, own in calls.groupby("call_day", sort=True):
            before = self.used.getValue((int(day),))[0] if self.used.containsKey((int(day),)) else 0
            free = own["call_limit"].to_numpy()
            n, said = before, []
            for limit in free:
                said.append(n < limit)
                n += said[-1]
            allowed.loc[own.index] = said
            self.used.updateValue((int(day),), (int(n),))
            self.handle.registerTimer(int(own["call_reset"].iloc[0]))
        yield pd.DataFrame({"key": calls["call_key"], "id": calls["call_id"], "at": calls["call_at"], "day": calls["call_day"].astype("int32"), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Days that have ended by the timer's midnight are forgotten."""
        for (day,) in [k for k in self.used.keys()]:
            if self.resets(day) <= expiredTimerInfo.getExpiryTimeInMs():
                self.used.removeKey((day,))
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "at": pd.Series(dtype="datetime64[ns]"), "day": pd.Series(dtype="int32"), "allowed": pd.Series(dtype="bool")})

    def __init__(self, zone: str):
        self.zone = zone

    def resets(self, day: int) -> int:
        """The local midnight that ends a day, in milliseconds."""
        return int(pd.Timestamp((day + 1) * DAY, unit="ms").tz_localize(self.zone, ambiguous=True, nonexistent="shift_forward").timestamp() * 1000)

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, *, key: str, id: str, time: str, limit: str, zone: str = "UTC", delay: str = "1 day") -> DataFrame:
    """Each call of the stream with its local day and whether it is allowed: the first ``limit`` calls a key and local day are, by time, then id.

    limit: a column, as callers have different quotas. Refused calls don't count. Columns: key, id, at, day (days since 1970-01-01), allowed.
    """
    local = F.from_utc_timestamp(F.col(time), zone)
    reset = F.to_utc_timestamp(F.date_add(local.cast("date"), 1).cast("timestamp"), zone)
    rows = calls.withWatermark(time, delay).select(F.col(key).cast("bigint").alias("call_key"), F.col(id).cast("bigint").alias("call_id"), F.col(time).alias("call_at"), F.unix_date(local.cast("date")).alias("call_day"), F.unix_millis(reset).alias("call_reset"), F.col(limit).cast("bigint").alias("call_limit"))
    return rows.groupBy("call_key").transformWithStateInPandas(Quota(zone), "key bigint, id bigint, at timestamp, day int, allowed boolean", "append", "eventTime")


EVENT = f"{TRADE}, status string"
NAMES = [c.split()[0] for c in EVENT.split(", ")]
SIGNAL = "trade_id bigint, ticker bigint, direction string, day int, exit_day int, entry double, exit double, confidence double, predicted double"
HELD = "exit_day int, trade_id bigint, got double, cost double, ticker bigint, direction string, day int, shares bigint, entry_value double, exit_value double, pnl double, pnl_pct double, cash_after double"


class Trades(StatefulProcessor):
    """One portfolio: signals wait for their day, open or are cancelled, and are closed on their exit day."""

    def __init__(self, start: float, largest: float, fee: float):
        self.rule = (start, largest, fee)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cash = handle.getValueState("cash", "cash double, invested double")
        self.waiting = handle.getListState("waiting", SIGNAL)
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SIGNAL.split(", ")]
        new = [tuple(r) for part in rows for r in part.loc[part["trade_id"].notna(), names].astype(object).itertuples(index=False)]
        if new:
            self.waiting.appendList([(int(a), int(b), c, int(d), int(e), *map(float, rest)) for a, b, c, d, e, *rest in new])
            self.handle.registerTimer((min(int(r[3]) for r in new) + 1) * DAY - 1)
        yield self.said(key, [(int(r[0]), int(r[1]), r[2], int(r[3]), int(r[4]), None, None, None, None, None, None, "PENDING") for r in new])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All days that the watermark has passed: positions due are closed before a day's signals are taken, in order of their ids."""
        today = max(expiredTimerInfo.getExpiryTimeInMs() // DAY, (timerValues.getCurrentWatermarkInMs() + 1) // DAY - 1)
        account = Account(*self.rule)
        if self.cash.exists():
            account.cash, account.invested = self.cash.get()
        held = {r[1]: r for r in self.held.get()}
        account.resume([r[:5] for r in held.values()])
        waiting = [tuple(r) for r in self.waiting.get()]
        out = []

        def closed(due: list[tuple]) -> None:
            for _, trade, *_ in due:
                exit_day, _, _, _, ticker, direction, day, *money = held.pop(trade)
                out.append((trade, ticker, direction, day, exit_day, *money, "CLOSED"))

        for s in sorted((r for r in waiting if r[3] <= today), key=lambda r: (r[3], r[0])):
            trade, ticker, direction, day, exit_day, entry, exit_, confidence, predicted = s
            closed(account.close(day))
            made = account.open(trade, ticker, direction, exit_day, entry, exit_, confidence, predicted)
            if made is None:
                out.append((trade, ticker, direction, day, exit_day, None, None, None, None, None, None, "CANCELLED"))
                continue
            due, money = made
            held[trade] = (*due, direction, day, *money)
            out.append((trade, ticker, direction, day, exit_day, *money, "OPEN"))
        closed(account.close(today))
        self.cash.update((account.cash, account.invested))
        waiting = [r for r in waiting if r[3] > today]
        for state, rows in ((self.waiting, waiting), (self.held, list(held.values()))):
            state.put(rows) if rows else state.clear()
        if waiting or held:  # one timer is enough: it works off all that the watermark has passed
            self.handle.registerTimer((min([r[3] for r in waiting] + [r[0] for r in held.values()]) + 1) * DAY - 1)
        yield self.said(key, out)

    @staticmethod
    def said(key, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame([(key[0], *r) for r in rows], columns=NAMES)
        kinds = {c.split()[0]: c.split()[1] for c in EVENT.split(", ")}
        plain = {"bigint": "Int64", "int": "Int32", "double": "Float64", "string": "object"}
        return made.astype({c: plain[k] for c, k in kinds.items()})

    def close(self) -> None:
        pass


def traded(signals: DataFrame, *, time: str = "at", delay: str = "0 days", start: float = 100_000.0, largest: float = 0.1, fee: float = FEE) -> DataFrame:
    """The states that trades go through, from a stream of signals: PENDING, then OPEN or CANCELLED, and CLOSED on the exit day.

    signals: as for ``portfolio.run``, with ``time``, the event time of the signal's day. A row without trade_id only moves the time on. The
    OPEN rows are those of ``portfolio.run`` over the same signals, whatever batches they came in, if none is later than ``delay``.
    """
    names = [c.split()[0] for c in SIGNAL.split(", ")]
    rows = signals.withWatermark(time, delay).select("portfolio_id", time, *names)
    return rows.groupBy("portfolio_id").transformWithStateInPandas(Trades(start, largest, fee), EVENT, "append", "eventTime")
