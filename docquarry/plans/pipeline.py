"""Scan, extract and index: the batch write path over a versioned store."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot
from ..operators.index import META, Index
from ..sources import files as S
from ..sources.store import Conflict, Store

FILES = "dir_id string, path string, id string, mtime bigint, size bigint, md5 string, status string, indexed int, updated_at bigint"
CONTENTS = "md5 string, text_content string, char_count bigint, error string"
WAITING = "id string, gone boolean"


class Busy(RuntimeError):
    """Another scan or rebuild is running."""


@contextmanager
def guarded(store: Store, what: str, stale_after: float = 6 * 3600):
    """One holder at a time over all drivers: a lock file beside the versions; one older than `stale_after` seconds was left by a dead driver."""
    path = store._path(f"{store.root}/_lock_{what}")
    if store._fs.exists(path) and time.time() - store._fs.getFileStatus(path).getModificationTime() / 1000 > stale_after:
        store._fs.delete(path, False)
    try:
        store._fs.create(path, False).close()
    except Exception as e:
        raise Busy(f"{what} is running") from e
    try:
        yield
    finally:
        store._fs.delete(path, False)


def scan(
    spark: SparkSession, roots: list[tuple[str, str]], state_root: str, index_root: str, now: int, globs: tuple[str, ...] = (), include: tuple[str, ...] | None = None, recursive: bool = True,
    progress: Callable[[str, float], None] = lambda step, seconds: None, cancelled: Callable[[], bool] = lambda: False, backends: dict | None = None,
) -> DataFrame:
    """Bring the tracked files, contents and index in line with the directories; `change`, `n` of what changed.

    The listing is compared once with the last published state.  Files that vanished and
    turned up elsewhere are moved and keep their id and index state; tracked files that
    the exclusions no longer allow are deleted.  Only new and changed files are hashed,
    only unknown hashes are read (once each) and added to the stored contents.  Files and
    contents are one commit, which also lists what the index lacks; a scan that dies
    before the index is written leaves that list, and the next scan works it off.

    `progress` is told each step and its seconds.  A scan that is `cancelled` between steps
    deletes nothing and commits what was read.  A second scan at the same time is `Busy`.
    """
    store = Store(spark, state_root)
    with guarded(store, "scan"):
        return _scan(spark, store, roots, index_root, now, globs, include, recursive, progress, cancelled, backends)


def _scan(spark, store, roots, index_root, now, globs, include, recursive, progress, cancelled, backends) -> DataFrame:
    began = time.monotonic()

    def done(step: str) -> None:
        nonlocal began
        progress(step, time.monotonic() - began)
        began = time.monotonic()

    if store.version() is None:
        store.publish(files=spark.createDataFrame([], FILES), **{"contents#0": spark.createDataFrame([], CONTENTS)}, waiting=spark.createDataFrame([], WAITING))
    work = f"{store.root}/_work/{uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    try:
        before, contents, waiting = (store.current(t) for t in ("files", "contents", "waiting"))
        listed = S.listing(spark, roots, globs, include, recursive).where("not is_dir").select("dir_id", "path", "size", "mtime")
        changes = kept(snapshot.diff(before, listed), "changes")
        done("listed")
        base = spark.createDataFrame(roots, "dir_id string, root string")
        touched = changes.where(F.col("change").isin("created", "modified", "restored", "pending")).join(base, "dir_id")
        hashed = S.with_hashes(touched.select("dir_id", F.col("path").alias("relative"), F.concat_ws("/", "root", "path").alias("path"), "mtime", "size", "change"))
        fresh = kept(hashed.select("dir_id", F.col("relative").alias("path"), F.md5(F.concat_ws("/", "dir_id", "relative")).alias("id"), "mtime", "size", "md5", F.lit(now).cast("bigint").alias("updated_at"), F.col("path").alias("absolute"), "change"), "fresh")
        done("hashed")
        stop = cancelled()
        absent = changes.where("change = 'deleted'" if not stop else "false").join(before.select("dir_id", "path", "id", "md5", F.col("size").alias("old_size")), ["dir_id", "path"])
        absent = absent.select("dir_id", "id", F.concat_ws("/", "dir_id", "path").alias("path"), F.col("old_size").alias("size"), "md5", F.col("path").alias("relative"))
        created = fresh.where("change = 'created'").select(F.concat_ws("/", "dir_id", "path").alias("path"), "size", "md5", "mtime", "dir_id", F.col("path").alias("relative"))
        found = snapshot.moves(absent, created).join(created.select(F.col("path").alias("new_path"), "dir_id", "relative", "mtime"), "new_path")
        moved = kept(found.select("id", "dir_id", F.col("relative").alias("path"), "mtime"), "moved")
        wanted = fresh.where("md5 is not null").groupBy("md5").agg(F.min("absolute").alias("path")).join(contents.select("md5"), "md5", "left_anti")
        read = kept(S.read_texts(wanted, backends), "read")
        done("read")
        after = snapshot.relocated(before, moved)
        after = snapshot.upsert(after, fresh.drop("absolute", "change").join(moved.select("dir_id", "path"), ["dir_id", "path"], "left_anti"))
        gone = absent.select("dir_id", F.col("relative").alias("path"), "id").join(moved.select("id"), "id", "left_anti").select("dir_id", "path", F.lit(True).alias("gone"))
        after = after.join(gone, ["dir_id", "path"], "left").withColumn("status", F.when(F.col("gone"), "deleted").otherwise(F.col("status"))).drop("gone")
        known = contents.unionByName(read).groupBy("md5").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"), F.lit(True).alias("read"))
        state = F.when(F.col("failed"), 2).when(F.col("read"), 1).otherwise(F.col("indexed")).cast("int")
        after = kept(after.join(known, "md5", "left").withColumn("indexed", state).select(*before.columns), "after")
        now_there = after.join(fresh.select("dir_id", "path"), ["dir_id", "path"], "left_semi").select("id", F.lit(False).alias("gone"))
        ended = after.join(gone.select("dir_id", "path"), ["dir_id", "path"], "left_semi").select("id", F.lit(True).alias("gone"))
        pending = kept(waiting.unionByName(now_there).unionByName(ended).unionByName(moved.select("id", F.lit(False).alias("gone"))).groupBy("id").agg(F.max("gone").alias("gone")), "pending")
        version = store.begin()
        after.write.parquet(store.path(version, "files"))
        pending.write.parquet(store.path(version, "waiting"))
        read.write.parquet(store.path(version, f"contents#{version}"))
        store.commit(version, store.manifest(store.version()))
        done("published")
        if not pending.isEmpty():
            index_waiting(spark, store, index_root)
        done("indexed")
        summary = [(r["change"], r["n"]) for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()]
        n_moved = moved.count()
        counted = {**dict(summary), **({"moved": n_moved} if n_moved else {})}
        for kind in ("created", "deleted") if n_moved else ():
            counted[kind] -= n_moved
        return spark.createDataFrame([(k, n) for k, n in counted.items() if n], "change string, n long")
    finally:
        store._fs.delete(store._path(work), True)


def index_waiting(spark: SparkSession, store: Store, index_root: str) -> None:
    """Bring the index in line with the files that wait for it, then empty their list."""
    files, contents, waiting = (store.current(t) for t in ("files", "contents", "waiting"))
    index = Index(spark, index_root)
    texts = contents.where("error is null").select("md5", "text_content").dropDuplicates(["md5"])
    first = index.store.version() is None
    rows = files.where("status = 'active'").join(texts, "md5")
    rows = rows if first else rows.join(waiting.where("not gone").select("id"), "id", "left_semi")
    docs = rows.select(
        F.col("id").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("file_ext"),
        "dir_id", "path", F.col("text_content").alias("content"), F.timestamp_micros("mtime").alias("mtime"), F.col("size").alias("file_size"),
    ).select(*META, "content")
    if first:
        index.build(docs)
    else:
        index.apply(docs, waiting.select(F.col("id").alias("file_id")))
    try:
        store.publish(waiting=spark.createDataFrame([], WAITING))
    except Conflict:  # another writer's list holds what it added; indexing these files once more changes nothing
        pass


def reindex(spark: SparkSession, ids: list[str], state_root: str, index_root: str, backends: dict | None = None, roots: list[tuple[str, str]] = ()) -> int:
    """Read some files anew, whatever their hashes: their contents are forgotten, and they wait for the next scan; how many there are."""
    store = Store(spark, state_root)
    files, contents = store.current("files"), store.current("contents")
    mine = files.where(F.col("id").isin(ids))
    version = store.begin()
    snapshot.without_contents(contents, mine).write.parquet(store.path(version, f"contents#{version}"))
    files.withColumn("indexed", F.when(F.col("id").isin(ids), 0).otherwise(F.col("indexed")).cast("int")).write.parquet(store.path(version, "files"))
    store.commit(version, {n: d for n, d in store.manifest(store.version()).items() if not n.startswith("contents")})
    return mine.count()


def status(files: DataFrame, contents: DataFrame, settings: DataFrame) -> DataFrame:
    """The index status in one row: counts by state, files whose content came from recognition, images and the last scan."""
    from ..operators import catalog

    parts = (catalog.status_counts(files), catalog.ocr_files(files, contents).withColumnRenamed("n", "ocr_files"), catalog.image_files(files).withColumnRenamed("n", "images"), catalog.last_scan(settings))
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out
