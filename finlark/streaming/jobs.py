"""Job runs: a listener that keeps their table, stuck runs, freshness, failure rates."""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

EVENT = "run_id string, job_name string, kind string, at timestamp, batch bigint, records bigint, error_message string"


class JobRuns(StreamingQueryListener):
    """Keeps a log of streaming queries: a small JSON file for each start, batch and end, in a folder that any session can read.

    Use it as a context. ``table`` folds the log into a row a run; a run is running until its end is logged, and one that has
    ended with an error has failed. ``with_stuck_failed`` then fails those that have stood still.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names = spark, path, {}

    def __enter__(self) -> JobRuns:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def log(self, run_id, kind: str, batch: int | None = None, records: int | None = None, error: str | None = None) -> None:
        row = (str(run_id), self.names.get(str(run_id)), kind, datetime.now(UTC).replace(tzinfo=None), batch, records, error)
        rows = self.spark.createDataFrame([row], EVENT.replace("at timestamp", "at timestamp_ntz")).withColumn("at", F.to_utc_timestamp(F.col("at").cast("string").cast("timestamp"), F.current_timezone()))
        rows.coalesce(1).write.json(f"{self.path}/event={uuid.uuid4().hex}")  # a folder of its own, as events of several queries come at once

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.names[str(event.runId)] = event.name
        self.log(event.runId, "started")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        self.log(event.progress.runId, "progress", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.log(event.runId, "ended", error=event.exception)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).json(self.path).drop("event")

    def settle(self, runs: list, seconds: float = 30) -> None:
        """Waits until the ends of the runs are in the log, as listeners hear of them a little later."""
        until = time.monotonic() + seconds
        while time.monotonic() < until and self.events().where((F.col("kind") == "ended") & F.col("run_id").isin([str(r) for r in runs])).select("run_id").distinct().count() < len(runs):
            time.sleep(0.2)

    def table(self) -> DataFrame:
        """run_id, job_name, status, started_at (of the last sign of life while it runs), completed_at, batches, records and error_message."""
        ended = F.max(F.when(F.col("kind") == "ended", F.col("at")))
        error = F.max("error_message")
        made = self.events().groupBy("run_id").agg(
            F.max("job_name").alias("job_name"), F.when(ended.isNull(), "running").when(error.isNotNull(), "failed").otherwise("success").alias("status"), F.when(ended.isNull(), F.max("at")).otherwise(F.min("at")).alias("started_at"),
            ended.alias("completed_at"), F.count("batch").alias("batches"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), error.alias("error_message"),
        )
        return made


def failing(runs: DataFrame, *, key: str, order: list[str], failed: Column, last: int = 10, least: int = 5, over: float = 0.5) -> DataFrame:
    """Jobs of whose last runs more than a share failed: key, n and rate."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    recent = runs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last)
    made = recent.groupBy(key).agg(F.count("*").alias("n"), F.avg(failed.cast("double")).alias("rate"))
    return made.where((F.col("n") >= least) & (F.col("rate") > over))


def with_stuck_failed(runs: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """Runs that are still running after so many minutes count as failed."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {minutes} minutes"))
    return runs.withColumns({"status": F.when(stuck, "failed").otherwise(F.col("status")), "error_message": F.when(stuck, "timed out").otherwise(F.col("error_message")), "completed_at": F.when(stuck, F.lit(as_of).cast("timestamp")).otherwise(F.col("completed_at"))})


def stale(runs: DataFrame, as_of: str, hours: dict[str, int], default: int = 30) -> DataFrame:
    """Jobs whose last success is longer ago than their hours allow, or that have none."""
    allowed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hours.items() for x in kv]), F.col("job_name")) if hours else F.lit(None), F.lit(default))
    last = runs.groupBy("job_name").agg(F.max(F.when(F.col("status") == "success", F.col("completed_at"))).alias("last_success"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_success")) / 3.6e9
    return last.withColumns({"age_hours": age, "stale": F.coalesce(age > allowed, F.lit(True))})
