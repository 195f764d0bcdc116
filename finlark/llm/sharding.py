"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a 63-bit hash of the text, then by the key; equal texts
thus lie side by side, and a large group of them is cut between its keys. The
splitters come from histograms: count the weight below evenly spaced probes,
keep the probe nearest to each target if it is within tolerance, else put new
probes inside the one bucket that holds the target. Then rows move once.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlark.llm.common import count_at_most, cut

LOW, HIGH = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Span:
    """Keys from lo to hi: hashes, or the keys beneath one hash; below: the weight of all that comes before."""

    hash: int | None
    lo: int
    hi: int
    below: int


def _bucket(spans: list[Span], probes: int) -> Column:
    """Number of the row's span times ``probes`` plus its bucket there; null outside all spans. Spans ascend and don't overlap."""
    def array(values) -> Column:
        return F.expr(f"array({','.join(values)})")

    n = len(spans)
    starts = array(f"struct({s.lo if s.hash is None else s.hash}L as h, {_long(LOW if s.hash is None else s.lo)} as d)" for s in spans)
    ends = array(f"struct({s.hi if s.hash is None else s.hash}L as h, {_long(HIGH if s.hash is None else s.hi)} as d)" for s in spans)
    at = F.struct(F.col("h").alias("h"), F.col("d").alias("d"))
    place = count_at_most(starts, n, at)
    own = lambda values: F.element_at(array(values), F.greatest(place, F.lit(1)))
    big = lambda x: x.cast("decimal(20,0)")
    value = F.when(own("true" if s.hash is None else "false" for s in spans), F.col("h")).otherwise(F.col("d"))
    bucket = F.floor((big(value) - big(own(_long(s.lo) for s in spans))) / big(own(f"{_width(s, probes)}L" for s in spans))).cast("bigint")
    return F.when((place > 0) & (at <= F.element_at(ends, F.greatest(place, F.lit(1)))), (place - 1) * F.lit(probes).cast("bigint") + bucket)


def _width(s: Span, probes: int) -> int:
    return -(-(s.hi - s.lo + 1) // probes)


def splitters(keys: DataFrame, targets: list[tuple[float, float]], *, probes: int = 4096) -> list[tuple[int, int]]:
    """The (h, d) from which on rows lie beyond each target weight.

    keys: columns h (0 to 2**63 - 1), d and w (weight). targets: ascending
    (weight below, tolerance). Where one (h, d) alone holds the target, the
    nearer of its two sides is taken. A round sends a few thousand counts to the driver.
    """
    found: dict[int, tuple[int, int]] = {}
    waiting = {Span(None, 0, HIGH, 0): list(range(len(targets)))} if targets else {}
    while waiting:
        spans = sorted(waiting, key=lambda s: (s.lo, LOW) if s.hash is None else (s.hash, s.lo))
        each = max(16, probes // len(spans))
        counts: dict[int, list] = {i: [] for i in range(len(spans))}
        rows = keys.withColumn("b", _bucket(spans, each)).where("b is not null").groupBy("b").agg(F.sum("w").alias("w"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1")).collect()
        for r in sorted(rows, key=lambda r: r.b):
            counts[r.b // each].append(r)
        nexts: dict[Span, list[int]] = {}
        for i, s in enumerate(spans):
            ends = [s.below + x for x in accumulate(r.w for r in counts[i])]
            for t in waiting[s]:
                goal, near = targets[t]
                k = min(bisect_right(ends, goal), len(ends) - 1)
                r, after = counts[i][k], ends[k]
                before = after - r.w
                single = r.h0 == r.h1 and r.d0 == r.d1
                if min(abs(goal - before), abs(after - goal)) <= near or single:
                    if goal - before <= after - goal:
                        found[t] = (r.h0, LOW if s.hash is None and not single else r.d0)
                    else:
                        found[t] = (r.h1, r.d1 + 1) if s.hash is not None and r.d1 < HIGH else (r.h1 + 1, LOW) if not single or r.d1 == HIGH else (r.h1, r.d1 + 1)
                else:
                    nexts.setdefault(Span(None, r.h0, r.h1, before) if r.h0 < r.h1 else Span(r.h0, r.d0, r.d1, before), []).append(t)
        waiting = nexts
    return [found[t] for t in range(len(targets))]


def with_sort_key(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds size (UTF-8 bytes and 1), text_crc32, _h and _d. Null texts count as empty, null keys as the least."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(body) + 1).cast("bigint"), "text_crc32": F.crc32(body.cast("binary")), "_h": F.shiftrightunsigned(F.xxhash64(body), 1), "_d": F.coalesce(F.col(key).cast("bigint"), F.lit(LOW))})


def shard(docs: DataFrame, shards: int = 8, *, key: str = "doc_id", text: str = "text", law: str = "bytes", tolerance: float = 0.001, pieces: int | None = None) -> DataFrame:
    """Every row with size, text_crc32, law, shard and slot.

    law ``bytes``: shards' sums of size differ from the mean by ``tolerance``
    of it, or by one row where rows are larger than that; ``rows``: the numbers
    of rows are at most one apart. slot: the row's place in its shard, from 0 on, in
    sort order; where some rows repeat both key and text, equal texts are in order of
    the rows' numbers instead of their keys, and are cut apart like others. An empty table gives an empty one. Columns of the
    added names are replaced; others are kept.

    Each shard is dealt to several tasks (``pieces`` in all) by further, looser splitters.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(law)
    pieces = max(shards, pieces or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    per = -(-pieces // shards)
    rows = with_sort_key(docs.drop("size", "text_crc32", "law", "shard", "slot", "_h", "_d"), key, text)

    def weighed() -> DataFrame:
        return cut(rows.select(F.col("_h").alias("h"), F.col("_d").alias("d"), (F.col("size") if law == "bytes" else F.lit(1).cast("bigint")).alias("w")))

    keys = weighed()
    if keys.groupBy("h", "d").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # Rows that repeat key and text are told apart by their number, so that they can be cut apart; the numbers are written with the rows.
        rows = cut(rows.withColumn("_d", F.monotonically_increasing_id()))
        keys = weighed()
    total = keys.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    share = total / (shards * per)
    # A shard has two ends, so each may be off by half the tolerance; where a row is larger than that, by half a row.
    near = {True: share * per * tolerance / 2 if law == "bytes" else 0, False: share * 0.2}
    goals = [(i * share if law == "bytes" else round(i * share), near[i % per == 0]) for i in range(1, shards * per)] if total else []
    cuts = splitters(keys, goals)
    # A piece is the number of splitters at or below the row; a splitter may repeat.
    place = lambda h, d: F.lit(0)
    if cuts:
        listed = F.expr("array(" + ",".join(f"struct({h}L as h, {_long(d)} as d)" for h, d in cuts) + ")")

        def place(h: str, d: str) -> Column:
            return count_at_most(listed, len(cuts), F.struct(F.col(h).alias("h"), F.col(d).alias("d")))

    counted = {r.p: r.n for r in keys.withColumn("p", place("h", "d")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    offsets, at = [], 0
    for p in range(shards * per):
        at = 0 if p % per == 0 else at
        offsets.append(at)
        at += counted.get(p, 0)
    order = Window.partitionBy("_piece").orderBy("_h", "_d", "size")
    placed = rows.withColumn("_piece", place("_h", "_d")).withColumn("_rank", F.row_number().over(order))
    first = F.element_at(F.expr("array(" + ",".join(f"{x}L" for x in offsets) + ")"), F.col("_piece") + 1)
    return placed.select(*[c for c in rows.columns if c not in ("_h", "_d")], F.lit(law).alias("law"), F.expr(f"cast(_piece div {per} as int)").alias("shard"), (first + F.col("_rank") - 1).cast("bigint").alias("slot"))


def _long(x: int) -> str:
    return f"{x}L" if x > LOW else "(-9223372036854775807L - 1L)"
