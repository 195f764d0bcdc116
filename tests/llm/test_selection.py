"""Exact duplicates, target resampling and vector codes: against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finlark.llm import dedup, queries, resample, vector_codes


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- exact duplicates


def plain_classes(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[lower(text)].append(key)
    out = []
    for key, text in rows:
        own = groups[lower(text)]
        keep = max((k for k in own if k is not None), default=None)
        out.append((key, keep, len(own), key == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def classes_of(df, **names):
    return sorted((tuple(r) for r in dedup.classes(df, **names).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_dedup_query(spark, sf, texts):
    got = sorted((tuple(r) for r in queries.op13_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == plain_classes(list(texts.items()))


def test_texts_that_part_late(spark):
    """Texts of one length that differ in one byte: at each digit's border, in the last byte, in a byte of a code point; and a hot group of copies."""
    base = "Ab é" * 30000
    marks = [0, 15, 16, 17, 255, 256, 257, 4095, 4096, 65535, 65536, 119999]
    made = [base] * 40 + [base[:m] + ("#" if m % 2 else "$") + base[m + 1 :] for m in marks] * 2 + [base.lower(), base[:-1], base[:16], base[:16].upper(), base[:17], "é", "è", "É", "", None]
    rows = list(enumerate(made))
    random.Random(1).shuffle(rows)
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain_classes(rows)


def test_dedup_odd_rows(odd, none, spark):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert classes_of(odd) == plain_classes(rows)
    renamed = odd.select(F.col("doc_id").alias("path"), F.col("text").alias("length"), F.lit(1).alias("body"))
    assert classes_of(renamed, key="path", text="length") == plain_classes(rows)
    assert dedup.classes(none).count() == 0 and dedup.classes(none).columns == dedup.classes(odd).columns
    nulls = spark.createDataFrame([(None, "a"), (None, "A"), (4, "b"), (None, "B")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in dedup.classes(nulls).where("keep_id is not null").collect() if r.doc_id is not None) == [(4, 4, True)]
    assert dedup.classes(nulls).where("keep_id is null and kept").count() == 2
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    kept = dedup.dedup(unique)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 9]


# --- resampling


def grams(text, orders=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def plain_draw(docs, target, percent=25, least=20, orders=2, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text, orders)[1]))
    for text in target:
        t.update(map(bucket, grams(text, orders)[1]))
    n_s, n_t = float(s.total()), float(t.total())
    out = []
    for key, text in docs:
        n, fs = grams(text, orders)
        gains = [math.floor(1000.0 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in map(bucket, fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(fs), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))])
    ranked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(ranked):
        r.append(i + 1 if i < percent * len(ranked) // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in out), key=repr)


def drawn(df, target, **more):
    return sorted((tuple(r) for r in resample.resample(df, target, **more).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resample_query(spark, sf, texts):
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(a, c, d, e, f) for a, _, c, d, e, f in plain_draw(list(texts.items()), target)]
    assert sorted((tuple(r) for r in queries.op11_resample(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("orders", [1, 3])
def test_other_orders_and_ties(spark, orders):
    """Ranks go by key where scores are equal; few buckets collide."""
    rnd = random.Random(orders)
    rows = [(i, " ".join(rnd.choice(["Alpha", "beta", "ГАММА", "δ9", "x_y", "-", "7"]) for _ in range(rnd.randrange(60)))) for i in range(400)]
    target = ["alpha beta alpha beta 7"]
    got = drawn(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string"), orders=orders, buckets=5, percent=60)
    assert got == plain_draw(rows, target, percent=60, orders=orders, buckets=5)


def test_resample_odd_rows(odd, none, spark):
    rows, target = [tuple(r) for r in odd.select("doc_id", "text").collect()], spark.createDataFrame([("the hand said more",), (None,), ("",)], "text string")
    want = plain_draw(rows, ["the hand said more", None, ""], least=8, percent=50)
    assert drawn(odd, target, least_words=8, percent=50) == want
    assert drawn(odd.withColumns({"_row": F.lit(0), "b1": F.lit(1)}), target.withColumn("key", F.lit("x")), least_words=8, percent=50) == want
    assert drawn(odd, target.limit(0), least_words=8, percent=50) == plain_draw(rows, [], least=8, percent=50)
    assert drawn(none, target) == [] and "rank" in resample.resample(none, target).columns
    assert all(r[-1] is None for r in drawn(odd, target, percent=0))


# --- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(k, label, [math.floor(1024 * x) for x in v]) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][2]) // parts
    grid = np.array([r[2] for r in kept], object).reshape(len(kept), parts, width)
    books = [[list(x) for x in grid[:entries, p]] for p in range(parts)]

    def assign(p):
        book = np.array(books[p], object)
        apart = [((book - x) ** 2).sum(axis=1) for x in grid[:, p]]
        return [min(range(len(book)), key=lambda j: (d[j], j)) for d in apart], [min(d) for d in apart]

    for _ in range(rounds):
        for p in range(parts):
            at = assign(p)[0]
            for j in set(at):
                own = [grid[i, p] for i in range(len(at)) if at[i] == j]
                books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [assign(p) for p in range(parts)]
    error = [sum(last[p][1][i] for p in range(parts)) for i in range(len(kept))]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, error, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for x in b for c in x).encode()).hexdigest()
    return sorted((k, "".join(f"{last[p][0][i]:02x}" for p in range(parts)), error[i], by_label[label], sha) for i, (k, label, _) in enumerate(kept))


def codes_of(df, **more):
    return sorted(tuple(r) for r in vector_codes.compress(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in queries.op12_vector_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == plain_codes(rows)


@pytest.mark.parametrize("size", [3, 40, 1 << 20, vector_codes.MOST])
def test_ball_tree_finds_the_least_index_of_the_nearest(size):
    """Small grids are full of ties and repeated entries; large ones need whole numbers beyond a double's."""
    rnd = np.random.default_rng(size)
    points, rows = rnd.integers(-size, size + 1, (200, 5)), rnd.integers(-size, size + 1, (3000, 5))
    points[50:80] = points[20:50]
    rows[:200] = points
    at, best = vector_codes.nearest(vector_codes.ball_tree(points), rows)
    apart = ((rows[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (at == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_codes_of_odd_rows(spark):
    """Dropped vectors, ties, repeated rows, a hot label, fewer rows than entries, clashing names."""
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([0.0, 0.001, -0.0005, 0.25, 1.5]) for _ in range(8)], None if i % 3 else i % 2) for i in range(300)]
    bad = [(-5, None, 1), (-4, [0.5] * 7 + [None], 1), (-3, [0.5] * 7 + [float("nan")], None), (-2, [float("inf")] + [0.5] * 7, 1), (-1, [0.5] * 7 + [float("-inf")], 1)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
    frame = spark.createDataFrame(rows + bad, schema).repartition(4)
    for entries in (256, 16):
        assert codes_of(frame.withColumns({"code": F.lit("x"), "_label": F.lit(1), "part": F.lit(2)}), entries=entries) == plain_codes(rows, entries=entries)
    few = rows[:5] + rows[:2]
    assert codes_of(spark.createDataFrame(few, schema)) == plain_codes(few)
    assert codes_of(spark.createDataFrame(bad, schema)) == [] == codes_of(spark.createDataFrame([], schema))
    mixed = spark.createDataFrame([*rows[:20], (500, [0.5] * 4, 1), (501, [1e30] * 8, 1), (502, [], 1), (None, rows[0][1], 1)], schema)
    assert sorted(str(r.vec_id) for r in vector_codes.compress(mixed).collect()) == sorted([*map(str, range(20)), "None"])
    with pytest.raises(ValueError):
        vector_codes.compress(frame, parts=3)


def test_codes_of_equal_vectors(spark):
    rows = [(i, [0.5] * 8, 1) for i in range(400)]
    assert codes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")) == plain_codes(rows)
