"""Change events: debouncing, routing to directories and upkeep of the tracked rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog, snapshot
from ..sources.store import Store

EVENTS = "path string, kind string, ts timestamp, mtime bigint, size bigint, md5 string"
#: Kinds of a file watcher that matter; others are dropped.
KINDS = {"create": "upsert", "modify": "upsert", "remove": "delete", "delete": "delete"}


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int = 100) -> DataFrame:
    """A stream of change events from JSON files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def debounced(events: DataFrame, quiet: str = "300 milliseconds", key: str = "path", watermark: str | None = None) -> DataFrame:
    """One row per key and burst: the last kind, begin, end and number of events of a burst that `quiet` ends.

    Works on a table and, with a `watermark`, on a stream; there a burst comes out when
    the watermark has passed it.  Other columns of the last event are kept.
    """
    if watermark:
        events = events.withWatermark("ts", watermark)
    rest = [c for c in events.columns if c not in (key, "ts")]
    grouped = events.groupBy(F.session_window("ts", quiet).alias("w"), F.col(key))
    last = [F.max_by(F.col(c), F.col("ts")).alias(c) for c in rest]
    return grouped.agg(*last, F.min("ts").alias("first_ts"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n_events")).drop("w")


def classified(events: DataFrame) -> DataFrame:
    """The events that matter, with `action` upsert or delete."""
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return events.withColumn("action", F.element_at(table, F.lower("kind"))).where("action is not null")


def routed(events: DataFrame, roots: DataFrame) -> DataFrame:
    """The events below a watched directory, with `dir_id` and the path relative to it."""
    found = catalog.under_root(events, roots, "path", "path", "id").where("root_id is not null")
    known = roots.select(F.col("id").alias("root_id"), F.rtrim(F.col("path"), F.lit("/")).alias("__root")).distinct()
    return found.join(known, "root_id").withColumn("path", F.substr("path", F.length("__root") + 2)).withColumnRenamed("root_id", "dir_id").drop("__root")


#: What is kept of the last event of each path, deletes and paths without a row included.
LAST = ("dir_id", "path", "ts", "action", "mtime", "size", "md5")


def last_events(events: DataFrame, seen: DataFrame) -> DataFrame:
    """The last event of each path among new ones and those `seen` (of LAST), and whether it is `new`; one that comes again is not."""
    keys, rest = list(LAST[:2]), LAST[2:]
    both = events.select(*LAST, F.lit(False).alias("old")).unionByName(seen.select(*LAST, F.lit(True).alias("old")))
    return both.groupBy(*keys).agg(F.max(F.struct(*rest, "old")).alias("e")).select(*keys, "e.*").withColumn("new", ~F.col("old")).drop("old")


def applied(state: DataFrame, events: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The tracked rows after a batch of routed events; of a path's events the last one counts.

    Nothing happens to a file whose extraction failed before (state 2) unless it is
    deleted or `retry_failed` is set.
    """
    keys = ["dir_id", "path"]
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*LAST[2:])).alias("e")).select(*keys, "e.*")
    if not retry_failed:
        failed = state.where("indexed = 2 and status = 'active'").select(*keys, F.lit(True).alias("failed"))
        last = last.join(failed, keys, "left").where("action = 'delete' or failed is null").drop("failed")
    up = last.where("action = 'upsert'").select(*keys, F.md5(F.concat_ws("/", *keys)).alias("id"), "mtime", "size", "md5", F.unix_seconds("ts").alias("updated_at"))
    after = snapshot.upsert(state, up)
    gone = last.where("action = 'delete'").select(*keys, F.lit(True).alias("gone"))
    return after.join(gone, keys, "left").withColumn("status", F.when(F.col("gone"), "deleted").otherwise(F.col("status"))).drop("gone")


#: Parts of the stored rows; a micro-batch rewrites only those that its events fall into.
BUCKETS = 64


def bucket_of(dir_id: str = "dir_id", path: str = "path", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(dir_id, path), F.lit(buckets)).cast("int")


def upkeep(events: DataFrame, roots: Callable[[], DataFrame], store: Store, checkpoint: str, table: str = "files", once: bool = True, every: str = "10 seconds", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep a stored table of tracked rows current from a stream of (debounced) events.

    Each micro-batch is one version of the store, in which only the buckets of its events
    are written anew.  A batch that was published already is skipped (its number is stored
    beside the table), so a restart applies nothing twice.  The last event of each path is
    stored in the same buckets (`<table>_last`), so one that comes after a later one, in
    whatever batch, changes nothing.  The query is returned: its `stop` ends the upkeep,
    and `roots` is asked anew in each batch.
    """
    kept = f"{table}_last"

    def merge(batch: DataFrame, number: int) -> None:
        done = store.current("batches").agg(F.max("batch")).first()[0]
        if done is not None and done >= number:
            return
        fresh, last = routed(classified(batch), roots()).withColumn("__b", bucket_of(buckets=buckets)).persist(), None
        try:
            whole = not store.bucketed(table)
            touched = list(range(buckets)) if whole else sorted(r[0] for r in fresh.select("__b").distinct().collect())  # at most `buckets`
            version = store.version()
            state = store.read(version, table, None if whole else touched)
            seen = store.read(version, kept, None if whole else touched) if store.has(kept) else fresh.select(*LAST).limit(0)
            last = last_events(fresh, seen).withColumn("__b", bucket_of(buckets=buckets)).persist()
            after = applied(state, last.where("new").drop("new", "__b")).select(*state.columns).withColumn("__b", bucket_of(buckets=buckets))
            store.publish_buckets(table, after, "__b", touched, beside={kept: last.drop("new")}, batches=batch.sparkSession.createDataFrame([(number,)], "batch long"))
        finally:
            if last is not None:
                last.unpersist()
            fresh.unpersist()

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def listing_events(before: DataFrame, now: DataFrame, at: str) -> DataFrame:
    """Change events (`path`, `kind`, `ts`, `mtime`, `size`, `md5`) from two listings of absolute paths: a source where no notifications exist."""
    changes = snapshot.diff(before.select("path", "mtime", "size", F.lit("active").alias("status"), F.lit(1).alias("indexed")), now, ("path",)).where("change <> 'unchanged'")
    kind = F.when(F.col("change") == "created", "create").when(F.col("change") == "deleted", "remove").otherwise("modify")
    return changes.select("path", kind.alias("kind"), F.lit(at).cast("timestamp").alias("ts"), "mtime", "size", F.lit(None).cast("string").alias("md5"))
