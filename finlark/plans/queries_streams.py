"""Registered streams with keyed state, timers and listeners, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finlark.plans import bindings as B
from finlark.plans.queries_model import EVENTS, signals
from finlark.plans.queries_series import SIDE
from finlark.streaming import ingest, jobs, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = (B.WITH + sql).replace("with ", "with recursive ", 1)
        return run

    return register


ZONE = "America/New_York"


@query("T7s_quota_admission", f", c as (select event_id, company_id % 4 as caller, ts, cast(ts at time zone 'UTC' at time zone '{ZONE}' as date) as day from activity) select event_id as id, caller as key, day, row_number() over (partition by caller, day order by ts, event_id) <= case when caller % 2 = 0 then 20 else 100 end as allowed from c")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers, every other of them known: 100 calls a local day, 20 for the others."""
    caller = F.col("user_id") % 4
    calls = ingest.landed(spark, sf_dir, EVENTS, "events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), caller.alias("caller"), F.when(caller % 2 == 0, 20).otherwise(100).alias("quota"))
    with states.state_store(spark):
        said = ingest.drained(states.admitted(calls, key="caller", id="event_id", time="ts", limit="quota", zone=ZONE), f"quota_{uuid.uuid4().hex}", "append")
    return said.select("id", "key", F.date_from_unix_date("day").alias("day"), "allowed")


SIGNALS = SIDE + """, entered as (select f.filing_id, f.ticker, p.day, p.close as entry from f, lateral (select day, close from price p where p.ticker = f.ticker and p.day >= f.day order by p.day limit 1) p),
signal as (
  select g.company_id % 20 as portfolio_id, e.filing_id as trade_id, e.ticker, case when predicted > 0 then 'LONG' else 'SHORT' end as direction, e.day, x.day as exit_day, entry, x.close as exit, confidence, predicted,
    row_number() over (partition by g.company_id % 20 order by e.day, e.filing_id) as k
  from entered e join filing g using (filing_id), lateral (select day, close from price p where p.ticker = e.ticker and p.day >= e.day + 30 order by p.day limit 1) x where abs(predicted) >= 0.5 and confidence >= 0.4
)"""

# The fold as a recursion: a step a signal, all portfolios side by side; what is held is a sorted list.
FOLD = """, fold as (
  select portfolio_id, 0::bigint as k, 100000::double as cash, 0::double as invested, []::struct(exit_day int, trade_id bigint, got double, cost double, ticker bigint)[] as held, false as taken, 0::bigint as shares, 0::double as paid, 0::double as got, 0::double as pnl from signal group by 1
  union all
  select portfolio_id, k, case when taken then cash - (paid + 1) else cash end, case when taken then invested + paid else invested end,
    case when taken then list_sort(list_append(held, {'exit_day': exit_day, 'trade_id': trade_id, 'got': paid + pnl + 1, 'cost': paid, 'ticker': ticker})) else held end, taken, shares, paid, got, pnl
  from (select *, shares >= 1 and paid + 1 <= cash and not list_contains([h.ticker for h in held], ticker) as taken, case when direction = 'LONG' then got - paid else paid - got end - 2 as pnl
  from (select *, shares * entry as paid, shares * exit as got
  from (select *, case when entry > 0 then floor(least(confidence * abs(predicted) / 100, 0.1) * (cash + case when len(held) > 0 then invested else 0 end) / entry)::bigint else 0 end as shares
  from (select s.portfolio_id, s.k, s.trade_id, s.ticker, s.direction, s.exit_day::int as exit_day, s.entry, s.exit, s.confidence, s.predicted,
      list_reduce(list_prepend(f.cash, [h.got for h in f.held if h.exit_day <= s.day]), lambda a, b: a + b) as cash, list_reduce(list_prepend(f.invested, [h.cost for h in f.held if h.exit_day <= s.day]), lambda a, b: a - b) as invested, [h for h in f.held if h.exit_day > s.day] as held
    from fold f join signal s on s.portfolio_id = f.portfolio_id and s.k = f.k + 1))))
),
trade as (select portfolio_id, trade_id, s.ticker, direction, s.day::int as day, s.exit_day::int as exit_day, f.shares, f.paid as entry_value, f.got as exit_value, f.pnl, f.pnl / f.paid * 100 as pnl_pct, f.cash as cash_after from fold f join signal s using (portfolio_id, k) where f.taken)"""

RECURSIVE = SIGNALS + FOLD


MONEY = "portfolio_id, trade_id, ticker, direction, day, exit_day, shares, entry_value, exit_value, pnl, pnl_pct, cash_after"
STATES = " select 'OPEN' as status, " + MONEY + " from trade union all select 'CLOSED', " + MONEY + " from trade union all select 'PENDING', portfolio_id, trade_id, ticker, direction, day::int, exit_day::int, null, null, null, null, null, null from signal union all select 'CANCELLED', portfolio_id, trade_id, ticker, direction, day::int, exit_day::int, null, null, null, null, null, null from signal s where not exists (select 1 from trade t where t.portfolio_id = s.portfolio_id and t.trade_id = s.trade_id)"


@query("T8s_streamed_trades", RECURSIVE + STATES)
def streamed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals land by days, a file for a stretch of them, and the query stops and starts again half-way; at last the time moves beyond all exits."""
    top = f"{ingest.shared_folder(spark)}/trades_{uuid.uuid4().hex}"
    rows = signals(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("day") * 86400)).persist()
    first, last, end = rows.agg(F.min("day"), F.max("day"), F.max("exit_day")).first()
    bounds = [first, first + (last - first) // 3, first + 2 * (last - first) // 3, last + 1]
    with states.state_store(spark):
        for n, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
            rows.where(F.col("day").between(low, high - 1)).write.mode("append").parquet(f"{top}/signals")
            if n == len(bounds) - 2:
                late = rows.select("portfolio_id").distinct().withColumns({c: F.lit(None).cast(k) for c, k in rows.dtypes if c not in ("portfolio_id", "at")}).withColumn("at", F.lit((end + 2) * 86400).cast("timestamp"))
                late.select(rows.columns).write.mode("append").parquet(f"{top}/signals")
            source = ingest.landed(spark, f"{top}/signals", rows.schema.simpleString()[7:-1].replace(":", " "))
            ingest.append_to(states.traded(source), f"{top}/states", f"{top}/checkpoint").awaitTermination()
    rows.unpersist()
    return spark.read.parquet(f"{top}/states").drop("batch")


@query("T4s_supervised_streams", "select 'steady' as job_name, 'success' as status, count(*) as records, null as error, true as ended from activity union all select 'broken', 'failed', 0, 'row 13 is broken', true from activity having max(event_id) >= 13 union all select 'idle', 'failed', 0, 'timed out', true")
def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three streams over the events under one supervisor: one goes through, one fails on a row, one never gets a file and counts as stuck."""
    top = f"{ingest.shared_folder(spark)}/jobs_{uuid.uuid4().hex}"
    watch = jobs.JobRuns(spark, f"{top}/runs")

    def start(name: str, source: DataFrame, body: Callable, **trigger) -> StreamingQuery:
        return source.writeStream.queryName(name).foreachBatch(body).option("checkpointLocation", f"{top}/{name}").trigger(**trigger).start()

    def fails(batch: DataFrame, number: int) -> None:
        if batch.where("event_id >= 13").limit(1).count():
            raise ValueError("row 13 is broken")

    ids = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1)
    with watch:
        runs = [start("steady", ids.parquet(sf_dir), lambda batch, number: batch.write.format("noop").mode("overwrite").save(), availableNow=True), start("broken", ids.parquet(sf_dir), fails, availableNow=True)]
        spark.range(0).write.mode("overwrite").parquet(f"{top}/empty")
        idle = start("idle", ids.option("pathGlobFilter", "*.none").parquet(f"{top}/empty"), fails, processingTime="1 day")
        for run in runs:
            try:
                run.awaitTermination()
            except StreamingQueryException:
                pass  # the supervisor has it
        watch.settle([r.runId for r in runs])
        table = jobs.with_stuck_failed(watch.table(), (datetime.now(UTC) + timedelta(minutes=11)).isoformat())
        out = table.select("job_name", "status", "records", F.when(F.col("error_message").contains("row 13 is broken"), "row 13 is broken").otherwise(F.col("error_message")).alias("error"), F.col("completed_at").isNotNull().alias("ended"))
        rows = out.collect()  # a row a job
        idle.stop()
    return spark.createDataFrame(rows, out.schema)


SQL["T8s_portfolio_trades"] = (B.WITH + RECURSIVE + " select portfolio_id, trade_id, ticker, direction, day, exit_day, shares, entry_value, exit_value, pnl, pnl_pct, cash_after from trade").replace("with ", "with recursive ", 1)
SQL["T11s_backtest"] = (B.WITH + RECURSIVE + """, run as (select *, 100000 + sum(pnl) over (partition by portfolio_id order by exit_day, trade_id) as equity from trade),
high as (select *, max(equity) over (partition by portfolio_id order by exit_day, trade_id) as peak from run)
select portfolio_id, count(*) as trades, round(avg((pnl > 0)::int) * 100, 6) as win_rate, round(sum(pnl) filter (pnl > 0) / -sum(pnl) filter (pnl <= 0), 6) as profit_factor, round(avg(pnl_pct), 6) as mean_pct, arg_max(trade_id, pnl) as best, arg_min(trade_id, pnl) as worst, round(avg(exit_day - day), 6) as mean_days,
  round(max((peak - equity) * 100 / peak), 6) as max_drawdown, round(avg(pnl_pct) / stddev_pop(pnl_pct) * sqrt(252), 6) as sharpe from high group by 1""").replace("with ", "with recursive ", 1)
