"""Order statistics, ranks and pages of large tables: no task holds or sorts a whole group.

Order statistics narrow a bracket around each wanted place: a mergeable sketch gives 257 points between a bracket's
ends, and the cells around the place, wider than the sketch's error, are the next bracket. Once few different
values are inside all brackets these are counted, and the counts tell the value. All groups go through a round together.
Ranks come from one exchange by ranges of the order's columns, so that a value's repeats part by the columns after it; rows
are numbered within a range, and a range begins where the counts of those before it end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS, ACCURACY = 256, 5000  # the sketch errs by 1 / ACCURACY of the rows, far under a cell
FEW = 10_000  # values that a bracket may hold inside at the end, and rows of a side that may be broadcast; groups of up to 25 times as many go without brackets


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder, which ends its lineage."""
    from finlark.streaming.ingest import shared_folder

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def beside(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few``, a row a group; null groups meet. ``few`` is broadcast only after its rows are counted."""
    if not by:
        return rows.join(F.broadcast(few), F.lit(True))  # one row
    named = few.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], *[c for c in few.columns if c not in by])
    small = few.limit(FEW + 1).count() <= FEW
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
    return rows.join(F.broadcast(named) if small else named, same).drop(*[f"_by{i}" for i in range(len(by))])


def order_statistics(rows: DataFrame, by: list[str], value: Column, places: Callable[[Column], list[Column]], cells: int = CELLS, together: int = 1) -> DataFrame:
    """by, n (values of the group) and at: for each wanted place (0 to n - 1, from n) the value there, in ascending order.

    Nulls and NaN are no values; infinities are the least and the greatest. Groups without values give no row. The values are exact.
    cells: points of the sketch between a bracket's ends, 8 at least. What lies strictly inside a bracket is some 3 / cells of
    what lay inside the one before, however often the ends repeat, so the rounds come to an end.
    together: of the places each so many in a row are the same or neighbours, and share a bracket.
    """
    cells, accuracy = max(8, cells), max(ACCURACY, 4 * cells)
    data = rows.select(*by, value.cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    points = [i / cells for i in range(cells + 1)]
    counts = data.groupBy(*by).agg(F.count("*").alias("_n"))
    wanted = cut((counts if by else counts.where("_n > 0")).withColumn("_k", F.array(*[p.cast("bigint") for p in places(F.col("_n"))])))
    if not wanted.limit(1).count():
        return wanted.select(*by, F.col("_n").alias("n"), F.array().cast("array<double>").alias("at"))
    count = wanted.select(F.size("_k")).first()[0]
    shared = range(count // together)  # brackets
    spots = lambda i: (F.col("_k")[i * together], F.col("_k")[(i + 1) * together - 1])

    def cell(grid: Column, n: Column, k: Column, side: int) -> Column:
        at = F.floor(k * F.lit(cells) / F.greatest(n, F.lit(1))).cast("int")
        return F.element_at(grid, F.least(F.lit(cells), F.greatest(F.lit(0), at + side)) + 1)

    def listed(hit: DataFrame) -> DataFrame:
        made = hit.groupBy(*by, "_n").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_at"))  # one a place
        return made.select(*by, F.col("_n").alias("n"), F.transform("_at", lambda x: x["_v"]).alias("at"))

    def brackets(known: DataFrame, ends: list[tuple[Column, Column]]) -> DataFrame:
        return known.select(*by, "_n", "_k", F.array(*[low for low, _ in ends]).alias("_low"), F.array(*[high for _, high in ends]).alias("_high"))

    if not wanted.where(F.col("_n") > 25 * FEW).limit(1).count():
        values = data.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
        placed = beside(values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))), wanted, by)
        mine = F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (F.get("_k", i) >= F.col("_upto") - F.col("_c")) & (F.get("_k", i) < F.col("_upto")))
        return listed(placed.select(*by, "_n", "_v", F.explode(mine).alias("_i")))
    sketched = beside(wanted, cut(data.groupBy(*by).agg(F.percentile_approx("_v", points, accuracy).alias("_g"))), by)
    known = cut(brackets(sketched, [tuple(cell(F.col("_g"), F.col("_n"), k, side) for k, side in zip(spots(i), (-1, 2), strict=True)) for i in shared]))
    while True:
        met = beside(data, known.select(*by, "_low", "_high"), by)
        v = F.col("_v")
        each = []
        for i in shared:
            low, high = F.col("_low")[i], F.col("_high")[i]
            inner = F.when((v > low) & (v < high), v)
            each += [F.count_if(v < low).alias(f"_u{i}"), F.count_if(v == low).alias(f"_t{i}"), F.count(inner).alias(f"_m{i}"), F.percentile_approx(inner, points, accuracy).alias(f"_g{i}")]
        counted = beside(known, cut(met.groupBy(*by).agg(*each)), by)
        wide = counted.where(" or ".join(f"_m{i} > {FEW}" for i in shared)).limit(1).count()
        if not wide:
            break
        narrower = []
        for i in shared:
            low, high, m = F.col("_low")[i], F.col("_high")[i], F.col(f"_m{i}")
            first, last = (k - F.col(f"_u{i}") - F.col(f"_t{i}") for k in spots(i))
            narrower.append(tuple(F.when(place < 0, low).when(place >= m, high).otherwise(cell(F.col(f"_g{i}"), m, place, side)) for place, side in ((first, -1), (last, 2))))
        known = cut(brackets(counted, narrower))
    ends = counted.select(*by, "_n", "_k", "_low", "_high", F.array(*[f"_u{i}" for i in shared]).alias("_u"))
    spread = beside(data, ends.select(*by, "_low", "_high"), by)
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(shared) - 1)), lambda i: (F.col("_v") >= F.get("_low", i)) & (F.col("_v") <= F.get("_high", i)))
    values = spread.select(*by, "_v", F.explode(inside).alias("_i")).groupBy(*by, "_i", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy("_v"))
    placed = beside(values.withColumn("_upto", upto), ends, by)
    first = F.col("_i") * together
    before = F.col("_upto") + F.get("_u", F.col("_i"))  # values up to and with this one
    mine = F.filter(F.sequence(first, first + together - 1), lambda j: (F.get("_k", j) >= before - F.col("_c")) & (F.get("_k", j) < before))
    return listed(placed.select(*by, "_n", "_v", F.explode(mine).alias("_i")))


def grouped_quantiles(rows: DataFrame, by: list[str], value: Column, shares: list[float], names: list[str], cells: int = CELLS) -> DataFrame:
    """by, n and a column for each share: exact quantiles, straight between neighbours."""
    spot = lambda n, p: (n - 1) * F.lit(float(p))
    found = order_statistics(rows, by, value, lambda n: [x for p in shares for x in (F.floor(spot(n, p)), F.ceil(spot(n, p)))], cells, together=2)

    def between(i: int, p: float) -> Column:
        at, a, b = spot(F.col("n"), p), F.col("at")[2 * i], F.col("at")[2 * i + 1]
        return F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)

    return found.select(*by, "n", *[between(i, p).alias(name) for i, (p, name) in enumerate(zip(shares, names, strict=True))])


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their rank, 1, 2, 3 ... in ``order``, whose last column should be unique. Equal rows are ranked in any order.

    One exchange by ranges; as the ranges come from a sample the dealt rows are written once, so that all see the same.
    """
    return _numbered(rows, order, name)[0].drop("_range")


def ranked_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank", total: str = "n") -> DataFrame:
    """``rows`` with their rank in their group, and the group's rows; a group may be any share of all rows."""
    placed = ranked(rows, [*[F.col(b) for b in by], *order], name)
    groups = placed.groupBy(*by).agg(F.min(name).alias("_first"), F.count("*").alias(total))
    return beside(placed, groups, by).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def _numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows with _range and rank, and (range, rank before it, rows) of each range."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    number = F.shiftright("_id", 33).cast("int")
    counts = sorted((r.p, r.n) for r in dealt.groupBy(number.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a task
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before, n))
        before += n
    offsets = rows.sparkSession.createDataFrame([s[:2] for s in starts], "_range int, _before bigint")
    placed = dealt.withColumn("_range", number).join(F.broadcast(offsets), "_range")  # a row a task
    return placed.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, name, "_range"), starts


class Pages:
    """Any page of an ordered table, deep ones too: the ranges are written once and a page reads only the ranges that it touches."""

    def __init__(self, rows: DataFrame, order: list[Column], path: str, size: int = 50):
        self.spark, self.path, self.size = rows.sparkSession, path, size
        placed, self.starts = _numbered(rows, order, "_rank")
        placed.write.partitionBy("_range").parquet(path)
        self.total = sum(n for *_, n in self.starts)
        self.schema = self.spark.read.parquet(path).schema

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)

    def ranges(self, page: int) -> list[int]:
        low = (page - 1) * self.size
        return [p for p, before, n in self.starts if before < low + self.size and before + n > low]

    def page(self, page: int) -> DataFrame:
        """The rows of a page, from 1 on, in order, with the number of all rows; none beyond the last page."""
        low = (page - 1) * self.size
        held = [f"{self.path}/_range={p}" for p in self.ranges(page)]
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*held) if held else self.spark.createDataFrame([], self.schema)
        own = rows.where((F.col("_rank") > low) & (F.col("_rank") <= low + self.size)).orderBy("_rank")
        return own.drop("_rank", "_range").withColumn("total_count", F.lit(self.total).cast("bigint"))
