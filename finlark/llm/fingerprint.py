"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into LZ78 phrases; the set of phrases is
hashed and summed up by a one-permutation minimum-hash signature. The share of
equal places of two signatures estimates the Jaccard likeness of the phrase
sets, which is high for texts that compress well together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finlark.llm.common import count_at_most, mix

PLACES = 128
BASE = np.uint64(0x100000001B3 | 1)


def phrases(data: bytes, tree: dict[int, int], node: int = 0, at: int = 0) -> tuple[list[int], int]:
    """Ends of the phrases of ``data``, from a given dictionary and node on; the node left at the end.

    tree: (node * 256 + byte) to node; it grows.
    """
    ends, fresh = [], len(tree) + 1
    look = tree.get
    for c in data:
        at += 1
        key = node << 8 | c
        node = look(key, 0)
        if not node:
            tree[key] = fresh
            fresh += 1
            ends.append(at)
    return ends, node


def parse(data: bytes) -> list[int]:
    """Ends of all phrases; an unfinished last phrase counts."""
    ends, node = phrases(data, {})
    return [*ends, len(data)] if node else ends


class PhraseHasher:
    """Hashes of data[start:end] for many pieces, from one pass of prefix hashes."""

    def __init__(self):
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.inverses = np.ones(1, np.uint64)

    def __call__(self, data: bytes, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) <= n:
            size = max(2 * len(self.powers), n + 1)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate((self.powers[:1], np.full(size, BASE))), dtype=np.uint64)
                self.inverses = np.cumprod(np.concatenate((self.inverses[:1], np.full(size, self.inverse))), dtype=np.uint64)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64)))
            return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value in each of PLACES bins; an empty bin takes the next full one's, moved on."""
    found = np.full(PLACES, 0xFFFF, np.uint16)
    if not len(hashes):
        return found
    least = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, (hashes >> np.uint64(57)).astype(np.int64), ((hashes >> np.uint64(20)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    full = np.flatnonzero(least != 0xFFFFFFFF)
    source = full[np.searchsorted(full, np.arange(PLACES)) % len(full)]
    moved = (least[source].astype(np.uint64) + np.uint64(0x9E3779B9) * ((np.arange(PLACES) - source) % PLACES).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return (moved >> np.uint64(16)).astype(np.uint16)


def fingerprint_of(data: bytes, ends: list[int], hasher: PhraseHasher) -> str:
    """Hex of the signature; empty for no bytes."""
    if not data:
        return ""
    e = np.asarray(ends, np.int64)
    return signature(hasher(data, e, np.concatenate(([0], e[:-1])))).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal places; 1 for two empty texts, 0 if one is empty."""
    if not a or not b:
        return float(a == b)
    return float(np.mean(np.frombuffer(bytes.fromhex(a), ">u2") == np.frombuffer(bytes.fromhex(b), ">u2")))


def fingerprint(texts: Column) -> Column:
    """A fingerprint for each text; a null counts as empty."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        hasher = PhraseHasher()
        data = [(v or "").encode() for v in values.to_pylist()]
        return pa.array([fingerprint_of(d, parse(d), hasher) for d in data], pa.string())

    return run(texts)


def with_next(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows dealt into key ranges, each in order and followed by the row after it.

    Adds _range, _turn, _tie and _guest: a guest is the copy of the row that follows
    the range's last, and is there to be looked at only. Rows of one key follow one another in order of a hash
    of the rest (_tie), null keys come first. Ranges split at approximate quantiles of the key; a key that fills several
    has its rows dealt to these by the hash, and so have the nulls. So no task gets all rows.
    """
    spark, rest = docs.sparkSession, [c for c in docs.columns if c != key]
    tied = docs.withColumn("_tie", F.xxhash64(*rest))
    n, none, bounds = tied.select(F.count("*"), F.count_if(F.col(key).isNull()), F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 20 * parts)) if parts > 1 else F.array()).first()
    bounds, first = sorted(bounds or []), -(-none * parts // n) if n else 0
    cuts = F.array(*[F.lit(b) for b in bounds]) if bounds else F.lit(None)
    share = F.col("_tie").cast("double") / 2.0**64 + 0.5
    low, high = count_at_most(cuts, len(bounds), F.col(key), strict=True), count_at_most(cuts, len(bounds), F.col(key))
    spread = lambda k: F.least(F.floor(share * k), k - 1).cast("int")
    place = F.when(F.col(key).isNull(), spread(F.lit(max(1, first)))).otherwise(first + low + F.when(high > low, spread(high - low + 1)).otherwise(0)).cast("int")
    ranged = tied.withColumn("_range", place)
    heads = sorted((r for r in ranged.groupBy("_range").agg(F.min(F.struct(key, "_tie")).alias("h")).collect()), key=lambda r: r._range)
    home = ranged.select("*", F.lit(0).alias("_turn"), F.lit(False).alias("_guest"))
    if not heads:
        return home
    follow = [(r._range, r.h[0], r.h[1], heads[i - 1]._range) for i, r in enumerate(heads)]
    told = spark.createDataFrame(follow, T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_head", docs.schema[key].dataType), T.StructField("_head_tie", T.LongType()), T.StructField("_to", T.IntegerType())]))
    # A row a range: of rows that are alike in all, one.
    guests = ranged.join(F.broadcast(told), "_range").where(F.col(key).eqNullSafe(F.col("_head")) & (F.col("_tie") == F.col("_head_tie"))).dropDuplicates(["_range"])
    away = guests.select(*docs.columns, "_tie", F.col("_to").alias("_range"), F.lit(1).alias("_turn"), F.lit(True).alias("_guest"))
    return home.select(*away.columns).unionByName(away).repartition(parts, "_range").sortWithinPartitions("_range", "_turn", key, "_tie", *rest)


PART_BYTES, MOST_PARTS = 128 << 20, 10_000  # text of a key range, and how many ranges' bounds go with the plan

EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_phrases bigint"


def compare_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last quarter of the code points replaced by the
    first as many of the document next in order of the key (after the last:
    the first). A null text is empty; a lone document follows itself; rows
    of equal keys follow one another in order of a hash of their text; null keys come
    first. Extra columns are ignored. ``parts``: key ranges, by default one for PART_BYTES of text and as many as the session has partitions.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not parts:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // PART_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, out = PhraseHasher(), None, []

        def made(row, after):
            _, doc_id, text, tree, node, ends, keep, _, own, _ = row
            cut = len(text) // 4
            edited = keep + after[:cut].encode()
            if cut:
                more, last = phrases(edited[len(keep) :], tree, node, len(keep))
                all_ends = [*ends, *more]
                all_ends = [*all_ends, len(edited)] if last else all_ends
                print_ = fingerprint_of(edited, all_ends, hasher)
            else:
                print_ = own
            return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, print_, likeness(own, print_)

        def opened(range_, doc_id, text):
            """The row parsed, with the dictionary as it stands where the kept part ends."""
            keep = text[: len(text) - len(text) // 4].encode()
            data = text.encode()
            tree: dict[int, int] = {}
            ends, node = phrases(keep, tree)
            if len(keep) < len(data):
                before = len(tree)
                more, last = phrases(data[len(keep) :], tree, node, len(keep))
                while len(tree) > before:  # the tail's entries, newest first
                    tree.popitem()
            else:
                more, last = [], node
            all_ends = [*ends, *more, *([len(data)] if last else [])]
            return range_, doc_id, text, tree, node, ends, keep, data, fingerprint_of(data, all_ends, hasher), len(all_ends)

        def table():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_phrases"])

        for batch in batches:
            for range_, doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("_range", "doc_id", "text", "_guest")), strict=True):
                now = opened(range_, doc_id, text)
                if held is not None and held[0] == range_:
                    row = made(held, text)
                    out.append((*row, likeness(row[3], now[8]), held[9]))
                held = None if guest else now
                if len(out) >= 2000:
                    yield table()
                    out = []
        if out:
            yield table()

    return with_next(rows, "doc_id", parts).mapInArrow(run, EDITED)
