"""What several operators share: shared folders, Arrow tokenising and hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SLICE = 2500
NO_BOUND = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, made the session's checkpoint folder if it has none.

    Only a session on a single machine may go without: it gets a temporary folder. On a cluster that would be
    each machine's own, so ValueError is raised.
    """
    sc = spark.sparkContext
    named, held = spark.conf.get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="finlark-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """A folder that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that its lineage ends there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's text modulo ``modulus``; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def hash_bound(k: int, n: int) -> int:
    """A bound that about 3 k of n evenly spread 64-bit hashes are under; no bound for small n."""
    return NO_BOUND if n <= 6 * k else -(2**63) + (3 * k << 64) // n


def least_hashes(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k rows whose 64-bit hash in ``column`` is least.

    Rows over the bound are passed over where they stand, so the one task that
    orders what is left gets some 3 k rows, not k from each task before it.
    """
    near = rows.where(F.col(column) <= hash_bound(k, rows.count()))
    near = near if near.limit(k).count() == k else rows
    return near.orderBy(column, *[c for c in rows.columns if c != column]).limit(k)


def count_at_most(bounds: Column, n: int, x: Column, strict: bool = False) -> Column:
    """How many of n ascending bounds (a literal array) are at most x (under it, if strict), by halving."""
    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        bound = F.element_at(bounds, F.least(middle, F.lit(n - 1)) + 1)
        under = bound < x if strict else bound <= x
        more = s["low"] < s["high"]
        return F.struct(F.when(more & under, middle + 1).otherwise(s["low"]).alias("low"), F.when(more & ~under, middle).otherwise(s["high"]).alias("high"))

    if not n:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve, lambda s: s["low"])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | T.StructType) -> DataFrame:
    """``fn`` on each Arrow batch of ``df``, cut to SLICE rows so that what it makes of them stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                out = fn(whole.slice(at, SLICE))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def with_fields(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` and the fields that are to be added."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer while ``df`` has such a column."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


class Tokens:
    """Words of a text column as a dictionary and one code a word.

    words: the distinct words; codes: int32 for each word in order; rows: the
    number of words of each text. Words are runs of what isn't ASCII white
    space (x20, x09 to x0D), with A-Z lower-cased unless ``lower`` is false.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = texts.fill_null("")
        texts = pc.ascii_lower(texts) if lower else texts
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        starts = np.asarray(parts.offsets)
        full = np.asarray(pc.not_equal(flat, ""), dtype=bool)
        held = np.concatenate(([0], np.cumsum(full)))
        self.rows = np.diff(held[starts - starts[0]])
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.words = coded.dictionary
        self.codes = np.asarray(coded.indices)
        self.ends = np.cumsum(self.rows)
        self.starts = self.ends - self.rows

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.rows)), self.rows)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the distinct words."""
        return hash_words(self.words)


def hash_words(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
