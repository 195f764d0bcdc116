"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived:
an alternative of sets of trigrams that any matching text must hold. Postings
of the trigrams that some query mentions are kept in blocks of documents;
queries intersect and unite postings; the candidates are verified with the
expression itself. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STRINGS = 64
Query = frozenset  # of frozensets of trigrams: one of them has to be there in full


@dataclass(frozen=True)
class Rule:
    """kind: [A-Za-z]+; a match counts if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 24, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z]*\x20?PRIVATE KEY-----", 20),
)


def _strings(items) -> list[tuple[str, object]]:
    """The parsed items as ("exact", set of strings), ("query", Query) and ("any", None) parts."""
    parts: list[tuple[str, object]] = []
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            parts.append(("exact", {chr(arg)}))
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            parts.append(("exact", {chr(c) for _, c in arg}))
        elif name == "SUBPATTERN":
            parts += _strings(arg[-1])
        elif name == "BRANCH":
            sides = [_strings(x) for x in arg[1]]
            whole = [_joined(side) for side in sides]
            if all(w is not None for w in whole):
                parts.append(("exact", set().union(*whole)))
            else:
                asked = [_query(side) for side in sides]
                parts.append(("query", frozenset().union(*asked)) if None not in asked else ("any", None))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            whole = _joined(_strings(inner))
            if whole is not None and high == 1 and low == 0:
                parts.append(("exact", whole | {""}))
            elif whole is not None and low == high <= 8:
                parts += [("exact", whole)] * low
            else:
                parts += [*(_strings(inner) if low else []), ("any", None)]
        elif name != "AT":
            parts.append(("any", None))
    return parts


def _joined(parts) -> set[str] | None:
    """All strings of the parts, if they are exact and few."""
    found = {""}
    for kind, arg in parts:
        if kind != "exact" or len(found) * len(arg) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in arg}
    return found


def _query(parts) -> Query | None:
    """The query of consecutive parts; None if nothing is mandatory."""
    asked: list[Query] = []

    def close(run: set[str]) -> None:
        if run and min(map(len, run)) >= 3:
            asked.append(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run))

    run: set[str] = {""}
    for kind, arg in parts:
        if kind == "exact" and len(run) * len(arg) <= MAX_STRINGS:
            run = {a + b for a in run for b in arg}
            continue
        close(run)
        run = set(arg) if kind == "exact" else {""}
        if kind == "query":
            asked.append(arg)
    close(run)
    if not asked:
        return None
    whole = reduce(lambda a, b: frozenset(x | y for x in a for y in b) if len(a) * len(b) <= MAX_STRINGS else a, asked)
    return frozenset(x for x in whole if not any(y < x for y in whole))


def trigram_query(pattern: str) -> Query | None:
    """What a lower-cased text must hold to match ``pattern`` in any case; None: it can't be told."""
    return _query([(k, {s.lower() for s in a} if k == "exact" else a) for k, a in _strings(re._parser.parse(pattern))])


def build_index(docs: DataFrame, trigrams: list[str], *, key: str = "doc_id", text: str = "text", block_rows: int = 8192) -> DataFrame:
    """Postings: block, trigram and the sorted keys of the block's documents that hold it.

    Blocks go by a hash of the key; about ``block_rows`` documents share one.
    Keys that repeat count once, a null key is kept as null.
    """
    blocks = max(1, -(-docs.count() // block_rows))
    lowered = docs.select(F.col(key).alias("key"), F.lower(text).alias("low")).where("low is not null")
    held = lowered.select("key", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))).alias("trigram"))
    return held.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set(F.struct("key")).alias("keys"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key and kinds: the rules whose query the key's postings meet."""
    posted = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("m"))
    none = F.array().cast(index.schema["keys"].dataType)

    def meets(query: Query) -> Column:
        sides = [reduce(F.array_intersect, [F.coalesce(F.try_element_at("m", F.lit(t)), none) for t in sorted(side)]) for side in sorted(query, key=sorted)]
        return reduce(F.array_union, sides)

    def named(kind: str, query: Query) -> Column:
        return F.transform(meets(query), lambda k: F.struct(F.lit(kind).alias("kind"), k["key"].alias("key")))

    each = [named(kind, q) for kind, q in queries.items()]
    return posted.select(F.explode(F.concat(*each)).alias("k")).groupBy(F.col("k.key").alias("key")).agg(F.collect_set("k.kind").alias("kinds"))


def running(values: Column, start: Column, levels: int = 3) -> Column:
    """For each number of an array ``start`` and the sum of those before it.

    Appending copies an array, so sums are appended within blocks of BLOCK numbers, whose starts come from the blocks' sums in the
    same way, over ``levels`` levels: linear for up to BLOCK ** levels numbers, and nearly so for some times as many.
    """
    def plain(numbers: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        return F.aggregate(numbers, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    if levels == 1:
        return bound(values, lambda x: plain(x, start))

    def over_blocks(numbers: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda i: F.slice(numbers, i * BLOCK + 1, BLOCK))

        def zipped(parts: Column) -> Column:
            sums = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda t, v: t + v))
            return F.flatten(F.zip_with(parts, running(sums, start, levels - 1), plain))

        return F.when(F.size(numbers) <= BLOCK, plain(numbers, start)).otherwise(bound(blocks, zipped))

    return bound(values, over_blocks)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK = 64


def spans_of(rule: Rule, text: Column, ordinal: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, ordinal, kind, end>>, in code points.

    Matches and the gaps between them give the positions; matches that fail the rule's length are dropped afterwards.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    # The last gap, behind all matches, has no hit.
    sizes = F.filter(F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(matches, F.length).alias("hit"), F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part")), lambda x: x["hit"].isNotNull())

    def placed(found: Column) -> Column:
        starts = running(F.transform(found, lambda x: x["gap"] + x["hit"]), F.lit(0))
        spans = F.zip_with(found, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(ordinal).alias("ordinal"), F.lit(rule.kind).alias("kind"), (at + x["gap"] + x["hit"]).alias("end"), x["part"].alias("part")))
        return F.transform(F.filter(spans, lambda s: s["part"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["ordinal"].alias("ordinal"), s["kind"].alias("kind"), s["end"].alias("end")))

    return bound(sizes, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.expr(EMPTY)))


EMPTY = "cast(array() as array<struct<start:int,ordinal:int,kind:string,end:int>>)"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and spans (start, ordinal, kind, end; by start, then rule) of every row, those without any too.

    A null text is empty. Keys may be null or repeat: each row is scanned on
    its own, as the index only says which keys may match. Other columns are dropped.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if queries:
        wanted = sorted({t for q in queries.values() for side in q for t in side})
        found = candidates(build_index(rows, wanted, key="key"), queries).withColumnRenamed("key", "_key")
        rows = rows.join(found, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
    else:
        rows = rows.withColumn("kinds", F.expr("cast(array() as array<string>)"))
    each = []
    for i, rule in enumerate(rules):
        got = spans_of(rule, F.col("text"), i)
        each.append(F.when(F.array_contains("kinds", rule.kind), got).otherwise(F.expr(EMPTY)) if rule.kind in queries else got)
    return rows.select(F.col("key").alias(key), "text", F.array_sort(F.concat(*each)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
