"""Streams with keyed state: quotas, trades over restarts, the job table."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from finlark.plans import portfolio
from finlark.streaming import ingest, jobs, states

CALL = "id bigint, caller bigint, ts timestamp, quota int"
ZONE = "America/New_York"


def test_quota_over_restarts(spark, tmp_path):
    """Calls around a change of clocks land in three files; each run of the query goes on with the counters of the last."""
    rnd, first = random.Random(1), datetime(2024, 3, 9, 3, tzinfo=timezone.utc)
    calls = sorted((first + timedelta(minutes=rnd.randrange(4 * 1440)), i, rnd.randrange(3)) for i in range(240))
    for n in range(3):
        part = [(i, k, at, 5 + 20 * k) for at, i, k in calls[80 * n : 80 * n + 80]]
        spark.createDataFrame(part, CALL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
        with states.state_store(spark):
            said = states.admitted(ingest.landed(spark, f"{tmp_path}/calls", CALL), key="caller", id="id", time="ts", limit="quota", zone=ZONE)
            ingest.append_to(said, f"{tmp_path}/said", f"{tmp_path}/state").awaitTermination()
    used, want = Counter(), {}
    for at, i, k in calls:
        day = (k, at.astimezone(ZoneInfo(ZONE)).date())
        want[i] = used[day] < 5 + 20 * k
        used[day] += want[i]
    got = {r.id: r.allowed for r in spark.read.parquet(f"{tmp_path}/said").collect()}
    assert got == want and set(want.values()) == {True, False}


def test_counters_go_at_local_midnight():
    quota = states.Quota(ZONE)
    day = (datetime(2024, 3, 10) - datetime(1970, 1, 1)).days
    assert quota.resets(day) == int(datetime(2024, 3, 11, tzinfo=ZoneInfo(ZONE)).timestamp() * 1000)


SIGNAL = "portfolio_id bigint, trade_id bigint, ticker bigint, direction string, day int, exit_day int, entry double, exit double, confidence double, predicted double"


@pytest.mark.parametrize("stretches", [1, 4])
def test_streamed_trades_are_those_of_the_batch_fold(spark, tmp_path, stretches):
    rnd = random.Random(stretches)
    rows = [(i % 3, i, rnd.randrange(6), rnd.choice(["LONG", "SHORT"]), d := rnd.randrange(1, 100), d + rnd.choice([30, 31, 33]), rnd.uniform(0, 900), rnd.uniform(1, 900), rnd.random(), rnd.uniform(-9, 9)) for i in range(150)]
    batch = {r.trade_id: r for r in portfolio.run(spark.createDataFrame(rows, SIGNAL), start=3000.0, largest=0.4).collect()}
    step = 100 // stretches
    schema = SIGNAL + ", at timestamp"
    for n in range(stretches):
        part = [(*r, datetime(1970, 1, 1) + timedelta(days=r[4])) for r in rows if r[4] // step == n]
        if n == stretches - 1:
            part += [(p, *[None] * 9, datetime(1970, 1, 1) + timedelta(days=200)) for p in range(3)]
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/signals")
        with states.state_store(spark):
            ingest.append_to(states.traded(ingest.landed(spark, f"{tmp_path}/signals", schema), start=3000.0, largest=0.4), f"{tmp_path}/states", f"{tmp_path}/check").awaitTermination()
    said = spark.read.parquet(f"{tmp_path}/states").collect()
    by = {s: {r.trade_id: r for r in said if r.status == s} for s in ("PENDING", "OPEN", "CANCELLED", "CLOSED")}
    assert len(said) == sum(map(len, by.values())) and by["PENDING"].keys() == {r[1] for r in rows}
    assert by["OPEN"].keys() == by["CLOSED"].keys() == batch.keys() and by["CANCELLED"].keys() == by["PENDING"].keys() - batch.keys() != set()
    for i, r in batch.items():
        for state in ("OPEN", "CLOSED"):
            assert {k: v for k, v in by[state][i].asDict().items() if k in r.__fields__} == r.asDict()


def test_job_table(spark, tmp_path):
    """A query that goes through twice, one that fails, and one that still runs."""
    spark.range(30).write.parquet(f"{tmp_path}/in")
    ids = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def fail(batch, number):
        raise ValueError("broken on purpose")

    def start(name, body, **trigger):
        return ids.writeStream.queryName(name).foreachBatch(body).option("checkpointLocation", f"{tmp_path}/{name}").trigger(**trigger).start()

    with jobs.JobRuns(spark, f"{tmp_path}/log") as watch:
        good, again, bad = (start(n, b, availableNow=True) for n, b in (("good", lambda b, n: b.count()), ("again", lambda b, n: b.count()), ("bad", fail)))
        still = start("still", lambda b, n: None, processingTime="1 day")
        good.awaitTermination(), again.awaitTermination()
        with pytest.raises(StreamingQueryException):
            bad.awaitTermination()
        watch.settle([good.runId, again.runId, bad.runId])
        rows = {r.job_name: r for r in watch.table().collect()}
        assert {k: r.status for k, r in rows.items()} == {"good": "success", "again": "success", "bad": "failed", "still": "running"}
        assert rows["good"].records == 30 and rows["good"].batches >= 1 and "broken on purpose" in rows["bad"].error_message and rows["still"].completed_at is None
        now = datetime.now(timezone.utc)
        for minutes, status in ((1, "running"), (11, "failed")):
            made = jobs.with_stuck_failed(watch.table(), (now + timedelta(minutes=minutes)).isoformat()).where("job_name = 'still'").first()
            assert made.status == status
        still.stop()
        watch.settle([still.runId])
        assert {r.status for r in watch.table().where("job_name = 'still'").collect()} == {"success"}
        assert watch.table().where(F.col("status") == "running").count() == 0
