"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel distance.

An item may occur in a text with up to k edits (a share of its length). Cut
into k + 1 pieces, one of them occurs unchanged, so an Aho-Corasick automaton
over all pieces finds every place to look at; there the least edit distance of
the item to any part of the text is taken from bit vectors.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from finlark.llm.common import cut, free_name, map_batches, mix

FILTER_BITS = 26
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
WIDEST, SHORTEST = 64, 4  # characters of a piece that are hashed at most, and that one must have left
MANY = 16  # items that may share a piece


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def ends(pattern: str, text: str, most: int) -> Iterable[tuple[int, int]]:
    """(distance, end) wherever an approximate occurrence of ``pattern`` with at most ``most`` edits ends in ``text``."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    plus, minus, score = mask, 0, m
    for at, c in enumerate(text, 1):
        e = eq.get(c, 0)
        v = e | minus
        h = (((e & plus) + plus) ^ plus) | e
        up = minus | (~(h | plus) & mask)
        down = plus & h
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & mask, (down << 1) & mask
        plus = down | (~(v | up) & mask)
        minus = up & v
        if score <= most:
            yield score, at


def best_in(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest part of ``text``; of equals the first end, then the longest."""
    found = min(ends(pattern, text, most), default=None)
    if found is None:
        return None
    distance, end = found
    _, back = max((-d, a) for d, a in ends(pattern[::-1], text[:end][::-1], distance) if d <= distance)
    return distance, end - back, end


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """Where the k + 1 pieces of n characters lie."""
    return [(n * i // (k + 1), n * (i + 1) // (k + 1)) for i in range(k + 1)]


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending ranges, those that touch made one."""
    found: list[tuple[int, int]] = []
    for a, b in ranges:
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


def occurrences(item: str, text: str, k: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of occurrences with at most k edits that don't overlap.

    The nearest is taken (of equals the first end, then the longest), then the nearest on either side of it as if
    that were all there is, until no part holds one. A hit cuts what may begin before it; so distances are
    taken anew for the ends within reach behind it, and each place is looked at some few times.
    """
    n, reach = len(item), len(item) + k
    taken: list[tuple[int, int, int]] = []  # start, end, distance; ascending
    at = text.find(item)
    while at >= 0:
        taken.append((at, at + n, 0))
        at = text.find(item, at + n)
    if not k:
        return [(d, a, b) for a, b, d in taken]
    heap: list[tuple[int, int, int]] = []  # distance, end, where the part begins for which it holds
    for low, high in zip([0, *[b for _, b, _ in taken]], [*[a for a, _, _ in taken], len(text)], strict=True):
        if high - low >= n - k:
            heap += [(d, low + e, low) for d, e in ends(item, text[low:high], k)]
    heapq.heapify(heap)
    while heap:
        distance, end, floor = heapq.heappop(heap)
        place = bisect.bisect_left(taken, (end,))  # hits from here on begin at or after the end
        low = taken[place - 1][1] if place else 0
        if end <= low or (floor != low and end - low < reach):
            continue  # inside a hit, or a hit has come before it and its distance was taken anew
        back = max(a for d, a in ends(item[::-1], text[max(low, end - reach) : end][::-1], distance) if d == distance)
        taken.insert(place, (end - back, end, distance))
        high = min(taken[place + 1][0] if place + 1 < len(taken) else len(text), end + reach)
        for d, e in ends(item, text[end:high], k) if high - end >= n - k else ():
            heapq.heappush(heap, (d, end + e, end))
    return [(d, a, b) for a, b, d in taken]


@dataclass(frozen=True)
class Items:
    """Test items, lower-cased, by place in ``keys``, and their budgets of edits. Empty ones can't be found."""

    keys: list
    texts: list[str]
    budgets: list[int]

    @classmethod
    def of(cls, rows: Iterable[tuple[object, str | None]], error_rate: float) -> Items:
        kept = sorted({(i, lowered(t)) for i, t in rows if i is not None and t})
        return cls([i for i, _ in kept], [t for _, t in kept], [int(len(t) * error_rate) for _, t in kept])

    def automaton(self) -> ahocorasick.Automaton:
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (text, k) in enumerate(zip(self.texts, self.budgets, strict=True)):
            for a, b in pieces(len(text), k):
                places.setdefault(text[a:b], []).append((i, b))
        found = ahocorasick.Automaton()
        for piece, held in places.items():
            found.add_word(piece, held)
        found.make_automaton()
        return found

    def search(self, automaton: ahocorasick.Automaton, text: str) -> list[dict]:
        """All occurrences that don't overlap: of each item the nearest, then the nearest of what is free, and so on."""
        text = lowered(text)
        seen: dict[int, set[int]] = {}
        for end, places in automaton.iter(text):
            for i, b in places:
                seen.setdefault(i, set()).add(end + 1 - b)
        found = []
        for i, begins in seen.items():
            item, k = self.texts[i], self.budgets[i]
            for a, b in merged((at - k, at + len(item) + k) for at in sorted(begins)):
                a = max(0, a)
                found += [{"item_id": self.keys[i], "distance": d, "start": a + x, "end": a + y} for d, x, y in occurrences(item, text[a:b], k)]
        return sorted(found, key=lambda x: (x["start"], x["item_id"], x["end"]))


@functools.lru_cache(maxsize=1)
def loaded(data: bytes) -> tuple[Items, ahocorasick.Automaton]:
    items = pickle.loads(data)
    return items, items.automaton()


def search(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", error_rate: float = 0.0625, block_chars: int = 1 << 22) -> DataFrame:
    """Every row with ``matches``: item_id, distance, start and end (code points) of each occurrence.

    An item with n characters may differ by int(n * error_rate) edits. Items of up to ``block_chars``
    characters in all go to each task as one automaton; more of them are joined
    with the texts on hashes of their pieces, so that no task holds the
    benchmark. Null texts, null keys and null or empty items have no matches; items of one
    key and different texts are all looked for; a column ``matches`` is replaced.
    """
    rest = docs.drop("matches")
    rows = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i is not null and length(t) > 0").distinct()
    kind = T.ArrayType(T.StructType([T.StructField("item_id", rows.schema["i"].dataType), *T.StructType.fromDDL("distance int, start int, end int").fields]))
    arrow = to_arrow_type(kind)
    schema = T.StructType([*rest.schema.fields, T.StructField("matches", kind)])
    if (rows.agg(F.sum(F.length("t"))).first()[0] or 0) > block_chars:
        met, items_of = with_candidates(rest, rows, text, error_rate), free_name(rest, "candidates")
        met = met.withColumnRenamed("_candidates", items_of)

        def verify(batch: pa.RecordBatch) -> pa.Table:
            found = []
            for t, near in zip(batch.column(text).to_pylist(), batch.column(items_of).to_pylist(), strict=True):
                known = Items.of(((x["i"], x["t"]) for x in near or ()), error_rate)
                found.append(known.search(known.automaton(), t) if near else [])
            return pa.Table.from_batches([batch]).drop_columns(items_of).append_column("matches", pa.array(found, arrow))

        return map_batches(met, verify, schema)
    data = pickle.dumps(Items.of([(r.i, r.t) for r in rows.collect()], error_rate))

    def run(batch: pa.RecordBatch) -> pa.Table:
        known, automaton = loaded(data)
        found = [known.search(automaton, t) if t and known.texts else [] for t in batch.column(text).to_pylist()]
        return pa.Table.from_batches([batch]).append_column("matches", pa.array(found, arrow))

    return map_batches(rest, run, schema)


def hashed(text: str, widths: Iterable[int]) -> Iterable[np.ndarray]:
    """For each width 63-bit hashes of as many characters from each place on: differences of one running sum."""
    codes = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    powers, back = (np.full(len(codes) + 1, f, np.uint64) for f in (BASE, pow(BASE, -1, 1 << 64)))
    powers[0] = back[0] = 1
    with np.errstate(over="ignore"):
        powers, back = np.cumprod(powers), np.cumprod(back)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1])))
        for width in widths:
            n = max(0, len(codes) - width + 1)
            window = (sums[width : width + n] - sums[:n]) * back[:n]
            yield (mix(window + np.uint64(width)) >> np.uint64(1)).astype(np.int64)


def cuts(n: int, k: int) -> list[list[tuple[int, int]]]:
    """Ways to cut n characters, or all but their beginning or end, into k + 1 pieces; the first is the whole.

    Of any part of an item with k edits one piece occurs unchanged, so each way finds all.
    """
    found = [pieces(n, k)]
    for eighths, end in itertools.product((1, 2, 3, 4), (False, True)):
        part = n - n * eighths // 8
        if part // (k + 1) >= SHORTEST:
            found.append([(a + (0 if end else n - part), b + (0 if end else n - part)) for a, b in pieces(part, k)])
    return found


def rarest_pieces(items: DataFrame, error_rate: float) -> DataFrame:
    """h (hash of up to WIDEST characters of a piece), width and the item's p and q, of the way to cut it that fewest items share.

    What many items have in common, a beginning say, would meet every text that holds it. Up to MANY items count as few.
    """

    def of_items(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, ways, found, widths = [], [], [], []
        for n, t in enumerate(map(lowered, batch.column("t").to_pylist())):
            for way, cut_at in enumerate(cuts(len(t), int(len(t) * error_rate))):
                for a, b in cut_at:
                    at.append(n)
                    ways.append(way)
                    widths.append(min(b - a, WIDEST))
                    found.append(next(iter(hashed(t[a : a + widths[-1]], [widths[-1]])))[0])
        places = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("p").take(places), batch.column("q").take(places), pa.array(ways, pa.int32()), pa.array(found, pa.int64()), pa.array(widths, pa.int32())], ["p", "q", "way", "h", "width"])

    every = cut(map_batches(items.select("p", "q", "t"), of_items, "p bigint, q bigint, way int, h bigint, width int").distinct())
    shared = every.join(every.select("h", "p", "q").distinct().groupBy("h").agg(F.count("*").alias("c")), "h")
    cost = F.ceil(F.log2(F.greatest(F.max("c"), F.lit(MANY))))
    best = shared.groupBy("p", "q", "way").agg(cost.alias("cost")).groupBy("p", "q").agg(F.min(F.struct("cost", "way")).alias("best"))
    return cut(every.join(best.select("p", "q", F.col("best.way").alias("way")), ["p", "q", "way"]).drop("way"))


def with_candidates(docs: DataFrame, items: DataFrame, text: str, error_rate: float) -> DataFrame:
    """docs with _candidates, the items (i, t) of which a piece may occur in the text.

    Hashes of pieces are joined with hashes at all places of the texts. What has no counterpart is kept from the
    exchange by a bitmap of 2**FILTER_BITS bits. Items go through the exchange by number; their texts come
    once it is known where they are needed. Equal texts are searched once.
    """
    items = cut(items.select(F.xxhash64("i", "t").alias("p"), F.xxhash64("t", "i", F.lit(1)).alias("q"), "i", "t"))
    held = rarest_pieces(items, error_rate)
    widths = [r.width for r in held.select("width").distinct().collect()]
    slot = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    words = held.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {(1 << FILTER_BITS) - 1}L) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
    known = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def of_docs(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = [], []
        for n, t in enumerate(batch.column("text").to_pylist()):
            for h in hashed(lowered(t), widths):
                at = h & ((1 << FILTER_BITS) - 1)
                h = np.unique(h[(known.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0])
                rows.append(np.full(len(h), n))
                found.append(h)
        at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["a", "b", "h"])

    ids = [F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b")]
    bodies = docs.where(F.length(text) > 0).select(*ids, F.col(text).alias("text"))
    hits = map_batches(bodies, of_docs, "a bigint, b bigint, h bigint").distinct().join(held, "h").select("a", "b", "p", "q").distinct()
    near = hits.join(items, ["p", "q"]).groupBy("a", "b").agg(F.collect_list(F.struct("i", "t")).alias("_candidates"))
    return docs.join(near, (ids[0] == near.a) & (ids[1] == near.b), "left").select(*[docs[c] for c in docs.columns], "_candidates")
