"""Rules met by events: each event goes once to each user, by the first rule that it meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlark.operators.words import matches


def matched(events: DataFrame, rules: DataFrame, *, key: str = "filing_id", level: str = "concern", name: str = "sector") -> DataFrame:
    """Events with a level of at least ``least`` whose name holds the rule's word (or any, if it has none).

    Rules: user_id, rule, word and least. Words find names by an inverted index, and events meet rules in equi-joins on names
    and words, however many there are. Of a user's rules the lowest number wins.
    """
    pairs = matches(rules.select(F.col("word").alias("_word")), "_word", events.select(F.col(name).alias("_name")), "_name")
    worded = rules.join(pairs, F.col("word").eqNullSafe(F.col("_word"))).drop("_word")
    hit = events.join(worded, F.col(name).eqNullSafe(F.col("_name"))).drop("_name").where(F.col(level) >= F.col("least"))
    first = Window.partitionBy("user_id", key).orderBy("rule")
    return hit.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
