"""Table changes as new DataFrames: upsert, insert if absent, update, delete, union by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_by_key(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """All left rows, and the right rows whose key the left doesn't have."""
    return left.unionByName(right.join(left.select(*key), key, "left_anti").select(*left.columns))


def upsert(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """The delta's rows, and the base rows that they don't replace."""
    return union_by_key(delta.select(*base.columns), base, key)


def insert_absent(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    return union_by_key(base, delta, key)


def update_where(rows: DataFrame, condition: Column, new: dict[str, Column]) -> DataFrame:
    """Columns replaced where the condition holds; a null condition changes nothing."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in new.items()})


def delete_matching(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(keys, key, "left_anti")


def upsert_whole(base: DataFrame, delta: DataFrame, key: list[str], valid: Column) -> DataFrame:
    """``upsert``, if every row of the delta is valid (a null isn't); else the base as it is. One flag decides, which is joined on as a row."""
    fine = delta.agg(F.coalesce(F.bool_and(F.coalesce(valid, F.lit(False))), F.lit(True)).alias("_fine"))
    kept = delta.join(F.broadcast(fine), F.lit(True)).where("_fine").select(*base.columns)
    return upsert(base, kept, key)
