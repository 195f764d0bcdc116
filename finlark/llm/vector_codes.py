"""Product codes of vectors: each part of a vector is replaced by the index of the nearest entry of that part's codebook.

The search for the nearest entry goes through a ball tree over the entries of each part. A ball is left out only if its
bound is certainly beyond the best found: centres and radii are doubles, radii rounded up and bounds down, and a ball
whose bound equals the best is still visited, as an entry of a lower index might tie. Distances
that decide are integers. A task walks the tree with a batch at a time; at a ball the rows part by the nearer half.

Codebooks have at most ``entries`` rows a part, whatever the input, and go to the tasks with the function. A round sends
their sums and counts only: a row a part and entry from each batch run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finlark.llm.common import cut

SCALE = 1024
LEAF = 16
MOST = 1 << 27  # components up to here have squared distances that fit a long, for up to 256 dimensions
SLACK = 1e-9  # far over the rounding of a double's distance, relatively


@dataclass(frozen=True)
class Ball:
    """Entries (their indexes, ascending, and coordinates) around a centre; two halves, or none for a leaf."""

    centre: np.ndarray
    radius: float
    index: np.ndarray
    points: np.ndarray
    halves: tuple[Ball, ...]


def ball_tree(points: np.ndarray, index: np.ndarray | None = None) -> Ball:
    index = np.arange(len(points)) if index is None else index
    own = points[index]
    centre = own.mean(axis=0)
    radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1)).max()) * (1 + SLACK) + SLACK
    halves: tuple[Ball, ...] = ()
    spread = own.max(axis=0) - own.min(axis=0)
    if len(index) > LEAF and spread.max() > 0:
        order = np.argsort(own[:, spread.argmax()], kind="stable")
        middle = len(order) // 2
        halves = (ball_tree(points, np.sort(index[order[:middle]])), ball_tree(points, np.sort(index[order[middle:]])))
    return Ball(centre, radius, index, own, halves)


def nearest(tree: Ball, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index and squared distance of the nearest entry of each row (int64), the least index among equals."""
    best, at = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).max)
    most = max(np.abs(rows).max(initial=0), np.abs(tree.points).max())
    small = 4 * rows.shape[1] * int(most) ** 2 < 1 << 53  # whole numbers that doubles hold
    squares, doubles = (rows * rows).sum(axis=1), rows.astype(np.float64)

    def distances(who: np.ndarray, points: np.ndarray) -> np.ndarray:
        if small:
            return (squares[who][:, None] - 2 * (doubles[who] @ points.T.astype(np.float64)) + (points * points).sum(axis=1)).astype(np.int64)
        return ((rows[who][:, None, :] - points[None]) ** 2).sum(axis=2)

    def from_centre(ball: Ball, who: np.ndarray) -> np.ndarray:
        return np.sqrt(((doubles[who] - ball.centre) ** 2).sum(axis=1))

    def visit(ball: Ball, who: np.ndarray, far: np.ndarray) -> None:
        bound = np.maximum(0.0, far * (1 - SLACK) - SLACK - ball.radius)
        who = who[bound * bound * (1 - SLACK) <= best[who]]
        if not len(who):
            return
        if ball.halves:
            left, right = (from_centre(h, who) for h in ball.halves)
            for first, chosen in ((0, left <= right), (1, left > right)):
                for k in (first, 1 - first):
                    visit(ball.halves[k], who[chosen], (left, right)[k][chosen])
            return
        apart = distances(who, ball.points)
        nearby = apart.argmin(axis=1)
        found, index = apart[np.arange(len(who)), nearby], ball.index[nearby]
        better = (found < best[who]) | ((found == best[who]) & (index < at[who]))
        best[who[better]], at[who[better]] = found[better], index[better]

    everyone = np.arange(len(rows))
    visit(tree, everyone, from_centre(tree, everyone))
    return at, best


def whole_vectors(column: pa.Array, width: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and floor(scale x) of these: those of ``width`` components, all of them numbers of fitting size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.list_value_length(column).fill_null(-1))
    right = np.flatnonzero(lengths == width)
    values = np.asarray(column.take(pa.array(right)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, width)
    grid = np.floor(values * scale)
    good = (np.abs(grid) <= MOST).all(axis=1)
    return right[good], grid[good].astype(np.int64)


def _first(vectors: DataFrame, entries: int, scale: int) -> list[list[int]]:
    """The vectors of the ``entries`` least keys that are kept, as integers."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.floor(F.when(F.abs(v) < 1e15, v).otherwise(1e15).cast("double") * scale)) <= MOST))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(good, F.lit(False)))
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.size("embedding"), "embedding").select(x.alias("x")).limit(entries).collect()
    return [[int(c) for c in r.x] for r in rows]


def _parts(width: int, parts: int) -> list[slice]:
    return [slice(p * width // parts, (p + 1) * width // parts) for p in range(parts)]


def train(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks, one array of integers a part: ``rounds`` times all parts are assigned and each entry becomes the floored mean of its parts.

    vectors: vec_id and embedding. Codebooks begin as the parts of the ``entries`` least vec_ids that are kept; the
    least one's number of components is the width of all. No kept vectors: no codebooks.
    """
    first = _first(vectors, entries, scale)
    if not first:
        return []
    width = len(first[0])
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    grid = np.array([r for r in first if len(r) == width], np.int64)
    cuts = _parts(width, parts)
    books = [grid[:, c].copy() for c in cuts]
    for _ in range(rounds):
        trees = [ball_tree(b) for b in books]

        def sums(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            held = [(np.zeros(t.index.shape, np.int64), np.zeros(t.points.shape, np.int64)) for t in trees]
            for batch in batches:
                rows = whole_vectors(batch.column("embedding"), width, scale)[1]
                for (count, total), tree, c in zip(held, trees, cuts, strict=True):
                    at = nearest(tree, rows[:, c])[0]
                    np.add.at(count, at, 1)
                    np.add.at(total, at, rows[:, c])
            for p, (count, total) in enumerate(held):
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        made = vectors.select("embedding").mapInArrow(sums, "part int, entry int, n bigint, total array<bigint>")
        added = made.select("part", "entry", "n", F.posexplode("total").alias("i", "t")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect()
        for r in added:
            books[r.part][r.entry, r.i] = int(r.t) // r.n
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], *, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits a part at most 256 entries need, more for larger codebooks) and error of every kept row."""
    if not books:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, label string, code string, error bigint").withColumn("label", F.col("label").cast(vectors.schema["label"].dataType))
    trees = [ball_tree(b) for b in books]
    width = sum(b.shape[1] for b in books)
    digits = max(2, *[(len(b) - 1).bit_length() + 3 >> 2 for b in books])
    cuts = _parts(width, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = whole_vectors(batch.column("embedding"), width, scale)
            found = [nearest(t, rows[:, c]) for t, c in zip(trees, cuts, strict=True)]
            codes = ["".join(f"{x:0{digits}x}" for x in r) for r in zip(*[f[0].tolist() for f in found], strict=True)]
            own = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])

    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that is kept; other columns are dropped.

    Rows go whose vector is null, empty, of another length than the vector of the least kept key, or holds a null, an infinite number, NaN, or a
    component over 2**27 / scale, whose squared distance wouldn't fit a long. error: squared distances summed over parts;
    label_error: error summed over the rows of equal labels, nulls together. Repeated and null keys are rows of their own. No kept rows give none.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    books = train(rows, parts=parts, entries=entries, rounds=rounds, scale=scale)
    coded = cut(encode(rows, books, scale=scale))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    both = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
