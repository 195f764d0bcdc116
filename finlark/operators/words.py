"""Which words stand in which names, by an inverted index of grams: no word meets a name that lacks its rarest gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The different runs of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))


def index(names: DataFrame, name: str) -> DataFrame:
    """gram and name: each different name under its grams of 1 to GRAM characters and under the empty one, which every name holds."""
    none = F.array().cast("array<string>")
    held = [F.when(F.length(name) >= n, _grams(F.col(name), n)).otherwise(none) for n in range(1, GRAM + 1)]
    return names.select(name).distinct().select(name, F.explode(F.concat(F.array(F.lit("")), *[F.coalesce(h, none) for h in held])).alias("gram"))


def matches(words: DataFrame, word: str, names: DataFrame, name: str) -> DataFrame:
    """word and name of every pair of a different word and a different name that holds it.

    A word is looked up under its grams of GRAM characters (of its own length if it is shorter) and joined by the one that fewest names hold; the pairs are
    then verified. A null word, like an empty one, stands in every name, and in a null name; a word that isn't null stands in no null name.
    """
    posted = index(names, name)
    spread = posted.groupBy("gram").agg(F.count("*").alias("_held"))
    text = F.coalesce(F.col(word), F.lit(""))
    asked = words.select(word).distinct().select(word, F.explode(F.when(F.length(text) >= GRAM, _grams(text, GRAM)).otherwise(F.array(text))).alias("gram"))
    met = asked.join(spread, "gram", "left").groupBy(word).agg(F.min_by(F.struct("gram", "_held"), F.struct(F.coalesce("_held", F.lit(0)), "gram")).alias("r"))
    rarest = met.where("r._held is not null").select(word, F.col("r.gram").alias("gram"))
    return rarest.join(posted, "gram").where(F.col(word).isNull() | F.contains(name, word)).select(word, name)
