"""Importance resampling towards a target: the documents whose n-grams look most like the target's are drawn.

A position table has a row for each word of each document, from ``posexplode``; ``lead`` over a document's window puts the
words that follow beside it, and their concatenations of each order are hashed into buckets. The table goes to the shared
folder once, as Parquet. Grouped, it gives the corpus' histogram; joined with the gains of the buckets, the weights.

Texts move once, dealt by row number before they are exploded, so neither the window nor the table needs another exchange
and a repeated or null key is no hot key. Draws are by Gumbel noise from the key, so they are the
same however the rows are dealt: the highest sums of weight and noise are a sample without replacement.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlark.llm.common import ascii_lower, cut, delete, shared_folder

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10000


def position_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text", orders: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """_row, key and, for each word, the buckets b1, b2 ... of the n-grams that begin there; null where the text ends before.

    A text without words, or a null one, has one row without buckets.
    """
    body = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias(text)).repartition("_row").sortWithinPartitions("_row")
    words = F.filter(F.split(body, NOT_WORD), lambda w: w != "")
    spread = rows.select("_row", "key", F.posexplode_outer(words).alias("pos", "w1"))
    order = Window.partitionBy("_row").orderBy("pos")
    for k in range(2, orders + 1):
        spread = spread.withColumn(f"next{k}", F.lead("w1", k - 1).over(order))
    grams = [F.col("w1")]
    for k in range(2, orders + 1):
        grams.append(F.concat(grams[-1], F.lit(" "), F.col(f"next{k}")))
    return spread.select("_row", "key", *[(F.crc32(g.cast("binary")) % buckets).cast("int").alias(f"b{k + 1}") for k, g in enumerate(grams)])


def _features(table: DataFrame, *columns: str) -> DataFrame:
    """One row a feature: its bucket and place among the orders, from 0 on."""
    return table.select(*columns, F.posexplode(F.array(*[c for c in table.columns if c.startswith("b")])).alias("order", "bucket"))


def histogram(table: DataFrame) -> DataFrame:
    """bucket and n; at most as many rows as there are buckets."""
    return _features(table).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, floor(1000 ln of the ratio of the target's smoothed share to the corpus'), for every bucket."""
    spark = corpus.sparkSession
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = cut(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]))
    whole = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    d = lambda x: x.cast("double")
    ratio = (d(F.col("t") + 1) * F.lit(float(whole.S + buckets))) / (d(F.col("s") + 1) * F.lit(float(whole.T + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("bigint").alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of seed and key; a null key is an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def weights(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", orders: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain of the features; none: 0) of every row of ``docs``."""
    spark = docs.sparkSession
    at = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    try:
        position_table(docs, key=key, text=text, orders=orders, buckets=buckets).write.parquet(at)
        table = spark.read.parquet(at)
        goal = position_table(target.withColumn("_none", F.lit(None)), key="_none", text=text, orders=orders, buckets=buckets)
        gain = gains(histogram(table), histogram(goal), buckets)
        # The gains have one row a bucket, whatever the input.
        told = _features(table, "_row", "key").join(F.broadcast(gain), "bucket", "left")
        n = F.count("bucket")
        each = told.groupBy("_row").agg(F.max("key").alias("doc_id"), F.count(F.when(F.col("order") == 0, F.col("bucket"))).alias("n_words"), n.alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
        mean = F.when(F.col("n_features") > 0, F.expr("(g - pmod(g, n_features)) div n_features")).otherwise(F.lit(0)).cast("bigint")
        return cut(each.select("doc_id", "n_words", "n_features", mean.alias("weight")))
    finally:
        delete(spark, at)


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, orders: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; other columns are dropped.

    rank: 1, 2, 3 ... by descending score, then ascending doc_id (nulls first), of the floor(percent n / 100) rows drawn from the n
    with at least ``least_words`` words; null for the others. Rows of equal key and score are ranked in any order. A null text has no
    words; a text without words weighs 0; an empty target leaves the smoothed shares of a uniform one. No rows give none.

    Scores are whole thousandths of a bounded range, some 200,000 values at most, and the noise spreads documents of one weight over
    them with at most 0.04 % on a value: their counts go to the driver, and each is ranked by itself.
    """
    known = weights(docs, target, key=key, text=text, orders=orders, buckets=buckets)
    scored = cut(known.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = F.col("n_words") >= least_words
    counts = sorted(((r.score, r.n) for r in scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = percent * sum(n for _, n in counts) // 100
    drawn, before = left, []
    for score, n in counts:
        if left <= 0:
            break
        before.append((score, drawn - left))
        left -= n
    none = F.lit(None).cast("bigint").alias("rank")
    if not before:
        return scored.select("*", none)
    near = enough & (F.col("score") >= before[-1][0])
    offsets = docs.sparkSession.createDataFrame(before, "score bigint, before bigint")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = scored.where(near).join(F.broadcast(offsets), "score").withColumn("rank", place.cast("bigint"))
    return ranked.select(*scored.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(scored.where(~near).select("*", none))
