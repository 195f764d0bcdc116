"""Incremental ingestion: landed files to a table keyed by accession, late data, and counters by day."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finlark.operators.merge import upsert

BUCKETS = 64


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a single machine whose session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="finlark-")


def landed(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def merge_into(source: DataFrame, target: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Whatever has landed since the last run is merged into the Parquet table at ``target``, a new version a batch.

    The last row of a key in ``order`` wins. Keys are dealt into BUCKETS by a hash, and a version holds only the buckets that
    its batch touches. It is written under the batch's number, so a batch that is run again reads what was
    before it and writes the same version again. Versions of which later ones hold every bucket go one batch later.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        newest = newest.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")).persist()
        touched = [r.bucket for r in newest.select("bucket").distinct().collect()]
        before = standing(spark, target, number)
        old = [path for bucket, path in before.items() if bucket in touched]
        merged = upsert(spark.read.option("basePath", target).parquet(*old).drop("version"), newest, key) if old else newest
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number:08d}")
        newest.unpersist()
        needed = {path.rpartition("/")[0] for path in before.values()}
        for path in versions(spark, target):
            if version_number(path) < number and path not in needed:
                delete(spark, path)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> list[str]:
    """Finished versions of a table, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath().toString() for s in files.listStatus(path)]
    return sorted(p for p in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def version_number(path: str) -> int:
    return int(path.rpartition("=")[2])


def standing(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Where each bucket stands: its folder in the newest version that has it, of those before a number."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found: dict[int, str] = {}
    for version in versions(spark, target):
        if before is None or version_number(version) < before:
            files = path(version).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            found |= {version_number(s.getPath().toString()): s.getPath().toString() for s in files.listStatus(path(version)) if s.isDirectory()}
    return found


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def current(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(*standing(spark, target).values()).drop("version", "bucket")


def daily_counts(events: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Events of each key and day, for quotas; days end when the watermark has passed them."""
    return events.withWatermark(time, delay).groupBy(key, F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("day"), "n")


def first_seen(events: DataFrame, key: str, time: str, delay: str = "2 days") -> DataFrame:
    """The first event of each key; a key's state goes when the watermark has passed it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What the stream gives once all that has landed is through: a Parquet table in the shared folder that each batch writes anew (or adds to, in append mode)."""
    top = f"{shared_folder(stream.sparkSession)}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/table" + (f"/batch={number}" if mode == "append" else ""))

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{top}/table").drop("batch")


def append_to(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """What is new since the last run is added to the table at ``target``; a batch that is run again writes the same folder again."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def invalidated(filings: DataFrame, touched: DataFrame, columns: list[str]) -> DataFrame:
    """Filings with cached columns emptied where their company was touched."""
    flag = touched.select("company_id").distinct().withColumn("_hit", F.lit(True))
    met = filings.join(flag, "company_id", "left")
    return met.withColumns({c: F.when(F.col("_hit").isNull(), F.col(c)) for c in columns}).drop("_hit")


def catch_up(filings: DataFrame, as_of: str, gap: int = 2, empty: int = 30) -> DataFrame:
    """One row: first and last day to fetch. More than ``gap`` days behind: from the day after the newest filing; none at all: ``empty`` days."""
    today = F.lit(as_of).cast("date")
    newest = F.max(F.col("filing_date").cast("date")).alias("newest")
    first = F.when(F.col("newest").isNull(), F.date_sub(today, empty)).when(F.datediff(today, "newest") > gap, F.date_add("newest", 1)).otherwise(F.date_sub(today, 1))
    return filings.agg(newest).select(first.alias("first"), F.date_sub(today, 1).alias("last"))
