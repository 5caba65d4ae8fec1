"""Joins that survive keys holding a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many keys are ever treated as hot.  A key with at least 1/64 of
#: the rows is always among the 64 most frequent ones, so no such key is missed.
MAX_HOT_KEYS = 64
#: A key is hot from this many rows on; below it one task handles it easily.
HOT_ROWS = 200_000
SALTS = 32


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list:
    """The (at most MAX_HOT_KEYS) values of `key` with `hot_rows` rows or more.

    Counts are combined before the shuffle; a top-k of fixed size comes back.
    """
    counted = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= hot_rows)
    return [r[0] for r in counted.orderBy(F.desc("count"), key).limit(MAX_HOT_KEYS).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None, salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join on `key` (same name on both sides); hot keys of `left` are spread.

    Rows of `left` with a hot key get one of `salts` numbers, rows of `right` with
    it are repeated once per number, all other rows keep number 0.  `how` is inner,
    left, left_semi or left_anti: kinds in which each left row decides for itself.
    Null keys of `left` match nothing.  An empty side gives what the plain join gives.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join can't do {how}")
    hot = hot_keys(left, key, hot_rows) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot: Column = reduce(lambda a, b: a | b, [F.col(key).eqNullSafe(F.lit(v)) for v in hot])
    spread = F.when(is_hot, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]) + F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    joined = left.withColumn("__salt", spread).join(right.withColumn("__salt", F.explode(copies)), [key, "__salt"], how)
    return joined.drop("__salt")
