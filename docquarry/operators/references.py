"""References to records that do not exist, are deleted or came later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import HOT_ROWS, salted_join

#: Characters taken off both ends of a key.
OUTER_SPACE = " \t\n\r\x0b\x0c 　"


def norm_key(c: Column | str) -> Column:
    """A key without outer white space and in lower case; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.btrim(c.cast("string"), F.lit(OUTER_SPACE)))
    return F.when(k != "", k)


def month_of_seconds(c: Column | str) -> Column:
    """`yyyy-MM` in UTC of epoch seconds, whatever the session's time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int")), "yyyy-MM")


def latest_state(df: DataFrame, key: str, version: str, keep: list[str]) -> DataFrame:
    """One row per key (as `norm_key` sees it) with the greatest `version`.

    Columns `__key` and `keep`.  Ties of `version` are broken by the greatest kept
    values, so the result is the same in any row order; null keys have no state; an
    empty table gives none.  The maximum is combined before the shuffle.
    """
    order = F.struct(F.col(version), *[F.col(c).cast("string") for c in keep])
    best = df.withColumn("__key", norm_key(key)).where("__key is not null").groupBy("__key").agg(F.max_by(F.struct(*keep), order).alias("__s"))
    return best.select("__key", *[F.col(f"__s.{c}").alias(c) for c in keep])


@dataclass(frozen=True)
class Target:
    """Rows referred to: their key columns, and if known a birth time and a deleted flag."""

    df: DataFrame
    keys: tuple[str, ...]
    born: str | None = None
    dead: str | None = None


def broken_references(refs: DataFrame, keys: tuple[str, ...], target: Target, match: str = "simple", made: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of `refs` whose key finds no valid row of `target`, with a `reason`.

    Keys are compared by `norm_key`; a null or blank part counts as null.  The
    references are grouped by their null mask and each mask is joined on its own
    non-null columns:

    * match "simple": a key with any null part is no reference,
    * match "full": all parts null is no reference, some null is `partial_null`,
    * match "partial": the non-null parts must occur together in one target row.

    `reason` is `missing` (no such row), `deleted` (all such rows are), or `late`
    (the oldest such row is younger than `refs.made`).  Null times are never late.
    Repeated references stay repeated.  Any other columns pass through, whatever
    their names; only one named `reason` gives way.  Empty `refs` give no rows; an empty target makes all `missing`.
    """
    if match not in ("simple", "full", "partial"):
        raise ValueError(match)
    n = len(keys)
    cols = [f"__k{i}" for i in range(n)]
    out = [c for c in refs.columns if c != "reason"]
    row = F.struct(*[F.col(f"`{c}`") for c in out]) if out else F.lit(None)
    asked = [norm_key(F.col(f"`{k}`")).alias(c) for c, k in zip(cols, keys)]
    tagged = refs.select(row.alias("__row"), *asked, *([F.col(f"`{made}`").alias("__made")] if made else []))
    mask = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    tagged = tagged.withColumn("__mask", mask)
    known = target.df.select(
        *[norm_key(F.col(f"`{k}`")).alias(c) for c, k in zip(cols, target.keys)],
        (F.col(f"`{target.born}`") if target.born else F.lit(None).cast("bigint")).alias("__born"),
        (F.coalesce(F.col(f"`{target.dead}`"), F.lit(False)) if target.dead else F.lit(False)).alias("__dead"),
    )
    reason = F.when(F.col("__found").isNull(), "missing").when(F.col("__all_dead"), "deleted")
    if made:
        reason = reason.when(F.col("__first") > F.col("__made"), "late")
    parts = []
    for m in range((1 << n) - 1):
        if m and match == "simple":
            continue
        mine = tagged.where(F.col("__mask") == m)
        if m and match == "full":
            parts.append(mine.select("__row", F.lit("partial_null").alias("reason")))
            continue
        on = [c for i, c in enumerate(cols) if not m >> i & 1]
        there = known.dropna(subset=on).groupBy(*on).agg(F.lit(1).alias("__found"), F.min("__born").alias("__first"), F.bool_and("__dead").alias("__all_dead"))
        key = on[0]
        if len(on) > 1:
            joint = F.to_json(F.array(*on))
            mine, there, key = mine.withColumn("__joint", joint), there.withColumn("__joint", joint).drop(*on), "__joint"
        joined = salted_join(mine, there, key, "left", hot_rows=hot_rows)
        parts.append(joined.withColumn("reason", reason).where("reason is not null").select("__row", "reason"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result.select(*[F.col(f"__row.`{c}`").alias(c) for c in out], "reason")
