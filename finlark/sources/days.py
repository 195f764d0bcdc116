"""Daily indexes as a data source: a partition for each weekday, absent days told apart from empty ones; batch and stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Day(InputPartition):
    def __init__(self, day: date):
        super().__init__(day.isoformat())
        self.day = day


def weekdays(first: date, last: date) -> list[date]:
    return [d for d in (first + timedelta(days=i) for i in range((last - first).days + 1)) if d.weekday() < 5]


def lines_of(folder: str, day: date, pattern: str) -> Iterator[tuple]:
    """day, found and value: a row a line; one row without a value for an empty day, and for an absent one."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{day.strftime(pattern)}"
    info = store.get_file_info(path)
    files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else None
    if files is None:
        yield day, False, None
        return
    some = False
    for f in sorted(files, key=lambda f: f.path):
        if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
            with store.open_input_stream(f.path) as stream:
                rest = b""
                while chunk := stream.read(1 << 20):
                    *whole, rest = (rest + chunk).split(b"\n")
                    for line in whole:
                        some = True
                        yield day, True, line.decode(errors="replace").rstrip("\r")
                if rest:
                    some = True
                    yield day, True, rest.decode(errors="replace").rstrip("\r")
    if not some:
        yield day, True, None


class _Days:
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern = options["path"], options.get("pattern", "%Y%m%d.idx")
        self.first, self.last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])

    def read(self, partition: Day) -> Iterator[tuple]:
        return lines_of(self.folder, partition.day, self.pattern)


class DaysReader(_Days, DataSourceReader):
    def partitions(self) -> list[Day]:
        return [Day(d) for d in weekdays(self.first, self.last)]


class DaysStreamReader(_Days, DataSourceStreamReader):
    """Offsets are days: what a query has read is in its checkpoint, and one that is started with a later ``last`` reads the days after."""

    def initialOffset(self) -> dict:
        return {"day": (self.first - timedelta(days=1)).isoformat()}

    def latestOffset(self) -> dict:
        return {"day": self.last.isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return [Day(d) for d in weekdays(date.fromisoformat(start["day"]) + timedelta(days=1), date.fromisoformat(end["day"]))]

    def commit(self, end: dict) -> None:
        pass


class DaysSource(DataSource):
    """Format ``days``. Options: path (a URI that every executor can open), first, last, pattern (of a day's file or folder, for strftime)."""

    @classmethod
    def name(cls) -> str:
        return "days"

    def schema(self) -> str:
        return "day date, found boolean, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DaysReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return DaysStreamReader(dict(self.options))


def catch_up(spark: SparkSession, folder: str, first: str, last: str, pattern: str = "%Y%m%d.idx") -> DataFrame:
    """day, found and value of all weekdays from first to last: the lines of each day's index; a day without one is a row that isn't found."""
    spark.dataSource.register(DaysSource)
    return spark.read.format("days").option("first", first).option("last", last).option("pattern", pattern).load(folder)


def catch_up_stream(spark: SparkSession, folder: str, first: str, last: str, pattern: str = "%Y%m%d.idx") -> DataFrame:
    spark.dataSource.register(DaysSource)
    return spark.readStream.format("days").option("first", first).option("last", last).option("pattern", pattern).load(folder)


def skipped(lines: DataFrame) -> DataFrame:
    """The weekdays that have no index."""
    return lines.where(~F.col("found")).select("day")
