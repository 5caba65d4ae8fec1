"""Comparing snapshots: changes, moves, upserts, re-rooting and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Bytes up to which a vanished file is looked for elsewhere; None looks for all.
MOVE_LIMIT = 10 << 20


def diff(before: DataFrame, now: DataFrame, keys: tuple[str, ...] = ("dir_id", "path")) -> DataFrame:
    """`change` of every key: created, modified (mtime or size), restored (was deleted), pending, unchanged or deleted.

    `before` are tracked rows (mtime, size, status, indexed), `now` what is there
    (mtime, size).  Both should have a key once.  A tracked deleted row that is still
    absent gives no row.
    """
    old = before.select(*keys, F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("status").alias("old_status"), F.col("indexed").alias("old_indexed"), F.lit(True).alias("was"))
    new = now.select(*keys, "mtime", "size", F.lit(True).alias("is"))
    both = old.join(new, list(keys), "full_outer")
    change = (
        F.when(F.col("was").isNull(), "created")
        .when(F.col("is").isNull(), F.when(F.col("old_status") != "deleted", "deleted"))
        .when(F.col("old_status") == "deleted", "restored")
        .when(~(F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size"))), "modified")
        .when(F.col("old_indexed") == 0, "pending")
        .otherwise("unchanged")
    )
    return both.select(*keys, "mtime", "size", change.alias("change")).where("change is not null")


def absent(tracked: DataFrame, there: DataFrame, keys: tuple[str, ...] = ("dir_id", "path")) -> DataFrame:
    """Tracked active rows that are not there any more."""
    return tracked.where("status = 'active'").join(there.select(*keys).distinct(), list(keys), "left_anti")


def moves(gone: DataFrame, new: DataFrame, limit: int | None = MOVE_LIMIT) -> DataFrame:
    """`id`, `old_path`, `new_path` of files that vanished and turned up elsewhere with the same name, size and hash.

    A vanished file takes the first new path and a new path the first file, both in order
    of path, so equal candidates are paired one to one.  Files above `limit` bytes and
    files without a hash are not looked at.
    """
    keys = ["name", "size", "md5"]
    small = F.lit(True) if limit is None else F.col("size") <= limit
    old = gone.where(small & F.col("md5").isNotNull()).select("id", F.col("path").alias("old_path"), S.file_name("path").alias("name"), "size", "md5")
    fresh = new.where(small & F.col("md5").isNotNull()).select(F.col("path").alias("new_path"), S.file_name("path").alias("name"), "size", "md5")
    old = old.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("old_path", "id")))
    fresh = fresh.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("new_path")))
    return old.join(fresh, [*keys, "n"]).select("id", "old_path", "new_path")


def upsert(state: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("dir_id", "path")) -> DataFrame:
    """The tracked rows after inserting or updating; an id stays, and `indexed` returns to 0 where mtime or size changed.

    `changes` has the keys, id, mtime, size, md5, updated_at; of several for a key the
    newest counts.  A hash is kept where the change has none.
    """
    ks = list(keys)
    order = F.struct("updated_at", "mtime", "size", F.coalesce("md5", F.lit("")), "id")
    last = changes.groupBy(*ks).agg(F.max_by(F.struct("id", "mtime", "size", "md5", "updated_at"), order).alias("n"))
    both = state.withColumn("was", F.lit(True)).join(last, ks, "full_outer")
    changed = ~(F.col("mtime").eqNullSafe(F.col("n.mtime")) & F.col("size").eqNullSafe(F.col("n.size")))
    touched = F.col("n").isNotNull()
    return both.select(
        *ks,
        F.coalesce("id", "n.id").alias("id"),
        F.when(touched, F.col("n.mtime")).otherwise(F.col("mtime")).alias("mtime"),
        F.when(touched, F.col("n.size")).otherwise(F.col("size")).alias("size"),
        F.when(touched, F.coalesce("n.md5", "md5")).otherwise(F.col("md5")).alias("md5"),
        F.when(touched, F.lit("active")).otherwise(F.col("status")).alias("status"),
        F.when(touched & (F.col("was").isNull() | changed), 0).otherwise(F.col("indexed")).cast("int").alias("indexed"),
        F.when(touched, F.col("n.updated_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def mark(state: DataFrame, events: DataFrame) -> DataFrame:
    """The tracked rows after events (`id`, `event`: extracted, indexed, failed, deleted); an unknown id is an error."""
    last = events.groupBy("id").agg(F.max_by("event", "at").alias("event") if "at" in events.columns else F.max("event").alias("event"))
    known = last.join(state.select("id"), "id", "left_anti").limit(1).collect()
    if known:
        raise KeyError(f"no file {known[0]['id']}")
    both = state.join(last, "id", "left")
    status = F.when(F.col("event") == "deleted", "deleted").otherwise(F.col("status"))
    return both.withColumn("status", status).withColumn("indexed", S.next_state("event", "indexed", F.lit(False))).drop("event").select(*state.columns)


def absorb(files: DataFrame, child: str, parent: str, prefix: str) -> DataFrame:
    """The tracked rows after a directory became part of another: path below `prefix`, new directory, to be indexed again."""
    mine = F.col("dir_id") == child
    return (
        files.withColumn("path", F.when(mine, F.concat(F.lit(prefix.rstrip("/") + "/"), "path")).otherwise(F.col("path")))
        .withColumn("indexed", F.when(mine, 0).otherwise(F.col("indexed")).cast("int"))
        .withColumn("dir_id", F.when(mine, F.lit(parent)).otherwise(F.col("dir_id")))
    )


def remove_directory(files: DataFrame, contents: DataFrame, directory: str) -> tuple[DataFrame, DataFrame]:
    """The files outside of a directory, and the contents that they still refer to."""
    rest = files.where(~F.col("dir_id").eqNullSafe(F.lit(directory)))
    return rest, contents.join(rest.select("md5").where("md5 is not null").distinct(), "md5", "left_semi")


def to_extract(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per content hash that has to be read: no stored content has it."""
    wanted = files.where("md5 is not null").groupBy("md5").agg(F.min("path").alias("path"))
    return wanted.join(contents.select("md5").distinct(), "md5", "left_anti")


def relocated(state: DataFrame, moved: DataFrame) -> DataFrame:
    """The tracked rows after moves (`id`, `dir_id`, `path`, `mtime`): a moved file keeps its id, hash and index state; a null part stays as it was."""
    new = moved.groupBy("id").agg(F.max(F.struct("dir_id", "path", "mtime")).alias("__m"))
    out = state.join(new, "id", "left")
    for c in ("dir_id", "path", "mtime"):
        out = out.withColumn(c, F.coalesce(F.col("__m")[c], F.col(c)))
    if "file_ext" in state.columns:
        out = out.withColumn("file_ext", F.when(F.col("__m").isNotNull(), S.extension_of("path")).otherwise(F.col("file_ext")))
    return out.select(*state.columns)


def without_contents(contents: DataFrame, hashes: DataFrame) -> DataFrame:
    """The stored contents without those of some `md5`, so that they are read anew."""
    return contents.join(hashes.select("md5").where("md5 is not null").distinct(), "md5", "left_anti")


def upserted(table: DataFrame, rows: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """A keyed table (embeddings, summaries) after new rows: the row with the greatest `version` of a key counts, without one any of the new ones."""
    rest = [c for c in table.columns if c != key]
    order = F.struct(*([F.col(version)] if version else []), *[F.col(c).cast("string") for c in rest])
    last = rows.select(*table.columns).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, *[F.col(f"__r.`{c}`").alias(c) for c in rest])
    return table.join(last.select(key), key, "left_anti").select(*table.columns).unionByName(last.select(*table.columns))


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """A keyed table without some keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def purged(state: DataFrame, globs: list[str], include: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The tracked rows that exclusions (and inclusions, if any) still allow, and the others."""
    out = S.is_excluded("path", globs)
    if include:
        out = out | ~F.coalesce(S.extension_of("path").isin([e.lower() for e in include]), F.lit(False))
    return state.where(~out), state.where(out)
