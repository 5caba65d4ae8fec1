import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docquarry.operators import catalog as C
from docquarry.operators import snapshot as N
from docquarry.sources.store import Store
from docquarry.streaming import watch

FILES = "id string, path string, dir_id string, mtime long, size long, md5 string, status string, indexed int, file_ext string, updated_at long"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def some(spark):
    return files(spark, [
        ("1", "a/x.pdf", "d1", 1, 10, "m1", "active", 1, "pdf", 5), ("2", "a/y.PDF", "d1", 2, 20, "m1", "active", 3, "PDF", 4), ("3", "b/z.wps", "d2", 3, 30, None, "active", 2, "wps", 3),
        ("4", "b/q.txt", "d2", 4, 40, "m2", "deleted", 1, "txt", 2), ("5", "n", "d2", 5, 50, " ", "active", 0, None, 1), ("6", "a,b.txt", "d2", 6, 60, "m1", "active", 0, "txt", 0),
    ])


def test_reports(spark):
    f = some(spark)
    assert C.status_counts(f).first()[:] == (5, 1, 3, 1)
    assert C.status_counts(f.limit(0)).first()[:] == (0, 0, 0, 0)
    assert {r["ext"]: tuple(r)[1:] for r in C.file_type_stats(f).collect()}["pdf"] == (2, 2, 0, 0)
    assert {r[0] for r in C.browse_types(f).collect()} == {"pdf", "txt"}
    assert [(r["md5"], r["n"], r["paths"]) for r in C.duplicates(f).collect()] == [("m1", 3, ["a,b.txt", "a/x.pdf", "a/y.PDF"])]
    assert C.duplicate_members(f).count() == 3
    contents = spark.createDataFrame([("m1", "t", 1), ("m9", "u", 1)], "md5 string, text_content string, ocr_used int")
    assert C.ocr_files(f, contents).first()[0] == 3 and [r["md5"] for r in C.orphan_contents(f, contents).collect()] == ["m9"]
    assert {(r["dir_id"], r["ext"], r["n"]) for r in C.unsupported(f).collect()} == {("d2", "wps", 1)}
    assert [r["id"] for r in C.needing_index(f, 2).collect()] == ["6", "5"]
    assert {r["path"]: r["n_files"] for r in C.directory_tree(f).collect()} == {"a": 2, "b": 2}
    stats = C.directory_stats(spark.createDataFrame([("d1", "/1"), ("d9", "/9")], "id string, path string"), f)
    assert {r["id"]: r["total"] for r in stats.collect()} == {"d1": 2, "d9": 0}


def test_paging(spark):
    rows = [(str(i), f"/tmp/f{i}.{'pdf' if i % 2 == 0 else 'docx'}", "d", i, i, None, "active", 2, None, i) for i in range(507)]
    f = files(spark, rows)
    assert C.browse(f, page=11, size=20).count() == 20 and C.browse(f, page=26, size=20).count() == 7
    assert C.browse(f, ext="PDF", page=11, size=20).count() == 20 and C.browse(f, ext="pdf", size=1000).count() == 254
    assert C.browse(f, state="failed", text="/TMP/F50", size=1000).count() == 8
    seen = [r["id"] for p in range(1, 27) for r in C.browse(f, sort="size", ascending=False, page=p, size=20).collect()]
    assert len(seen) == len(set(seen)) == 507 and seen[0] == "506"


def test_roots(spark):
    paths = spark.createDataFrame([("/d/docs/a.txt",), ("/d/docs2/a",), ("/d/docs/sub/b",), ("/other",), (None,)], "p string")
    roots = spark.createDataFrame([("1", "/d/docs"), ("2", "/d/docs/sub/")], "id string, path string")
    got = {r["p"]: r["root_id"] for r in C.under_root(paths, roots, "p", "path", "id").collect()}
    assert got == {"/d/docs/a.txt": "1", "/d/docs2/a": None, "/d/docs/sub/b": "2", "/other": None, None: None}


def test_words_and_logs(spark):
    t = spark.createDataFrame([("Ab ab 12 x é",), (None,), ("",)], "t string")
    assert [tuple(r) for r in C.top_words(t, "t", 5).collect()] == [("ab", 2), ("é", 1)]
    lines = spark.createDataFrame([(1, "start f"), (2, "x"), (3, "start f"), (4, "y")], "n int, l string")
    assert [r["n"] for r in C.log_session(lines, "n", "l", "start").orderBy("n").collect()] == [3, 4] and C.log_session(lines, "n", "l", "none").count() == 4
    kept = C.retained(spark.range(12).withColumn("at", F.col("id")), "at", "id", 10)
    assert kept.where("kept").count() == 10 and not kept.where("id = 1").first()["kept"]


def test_diff(spark):
    f = some(spark)
    now = spark.createDataFrame([("d1", "a/x.pdf", 1, 10), ("d1", "a/y.PDF", 9, 20), ("d2", "b/q.txt", 4, 40), ("d2", "n", 5, 50), ("d3", "new", 1, 1)], "dir_id string, path string, mtime long, size long")
    got = {(r["dir_id"], r["path"]): r["change"] for r in N.diff(f, now).collect()}
    assert got == {("d1", "a/x.pdf"): "unchanged", ("d1", "a/y.PDF"): "modified", ("d2", "b/q.txt"): "restored", ("d2", "n"): "pending", ("d3", "new"): "created", ("d2", "b/z.wps"): "deleted", ("d2", "a,b.txt"): "deleted"}
    assert {r["id"] for r in N.absent(f, now).collect()} == {"3", "6"}


def test_moves_pair_one_to_one(spark):
    gone = spark.createDataFrame([("1", "a/x.txt", 5, "m"), ("2", "b/x.txt", 5, "m"), ("3", "c/y.txt", 5, "m"), ("4", "big.txt", 1 << 30, "b"), ("5", "n.txt", 1, None)], "id string, path string, size long, md5 string")
    new = spark.createDataFrame([("q/x.txt", 5, "m"), ("r/y.txt", 5, "other"), ("s/big.txt", 1 << 30, "b"), ("t/n.txt", 1, None)], "path string, size long, md5 string")
    assert [tuple(r) for r in N.moves(gone, new).collect()] == [("1", "a/x.txt", "q/x.txt")]


def test_upsert_and_marks(spark):
    state = files(spark, [("1", "/a.txt", "d1", 1000, 42, "abc", "deleted", 1, "txt", 1)]).drop("file_ext")
    ch = spark.createDataFrame([("9", "d1", "/a.txt", 2000, 99, None, 3), ("8", "d1", "/a.txt", 1500, 50, "old", 2), ("7", "d2", "/a.txt", 1, 1, "n", 3)], "id string, dir_id string, path string, mtime long, size long, md5 string, updated_at long")
    after = N.upsert(state, ch)
    got = {r["dir_id"]: (r["id"], r["mtime"], r["size"], r["md5"], r["status"], r["indexed"]) for r in after.collect()}
    assert got == {"d1": ("1", 2000, 99, "abc", "active", 0), "d2": ("7", 1, 1, "n", "active", 0)}
    assert N.upsert(state, ch.limit(0)).first()["status"] == "deleted"
    marked = {r["id"]: (r["status"], r["indexed"]) for r in N.mark(after, spark.createDataFrame([("1", "failed"), ("7", "deleted")], "id string, event string")).collect()}
    assert marked == {"1": ("active", 2), "7": ("deleted", 0)}
    with pytest.raises(KeyError):
        N.mark(after, spark.createDataFrame([("nope", "failed")], "id string, event string"))


def test_absorb_and_remove(spark):
    f = files(spark, [("1", "foo.txt", "sub", 1, 1, "m", "active", 1, "txt", 1), ("2", "o.txt", "parent", 1, 1, "k", "active", 1, "txt", 1)])
    got = {r["id"]: (r["path"], r["dir_id"], r["md5"], r["indexed"]) for r in N.absorb(f, "sub", "parent", "B").collect()}
    assert got == {"1": ("B/foo.txt", "parent", "m", 0), "2": ("o.txt", "parent", "k", 1)}
    rest, contents = N.remove_directory(f, spark.createDataFrame([("m",), ("k",)], "md5 string"), "sub")
    assert [r["id"] for r in rest.collect()] == ["2"] and [r["md5"] for r in contents.collect()] == ["k"]
    assert [r["md5"] for r in N.to_extract(f, spark.createDataFrame([("k",)], "md5 string")).collect()] == ["m"]


def events(spark, rows):
    return spark.createDataFrame([(p, k, datetime(2024, 1, 1, 0, 0, s // 1000, s % 1000 * 1000), s, s, None) for p, k, s in rows], watch.EVENTS)


def test_debounce_classify_route(spark):
    e = events(spark, [("/d/docs/a", "create", 0), ("/d/docs/a", "modify", 200), ("/d/docs/a", "remove", 900), ("/x/b", "create", 0), ("/d/docs/c", "access", 0)])
    got = sorted((r["path"], r["kind"], r["n_events"]) for r in watch.debounced(e).collect())
    assert got == [("/d/docs/a", "modify", 2), ("/d/docs/a", "remove", 1), ("/d/docs/c", "access", 1), ("/x/b", "create", 1)]
    roots = spark.createDataFrame([("d1", "/d/docs")], "id string, path string")
    routed = watch.routed(watch.classified(e), roots)
    assert {(r["dir_id"], r["path"], r["action"]) for r in routed.collect()} == {("d1", "a", "upsert"), ("d1", "a", "delete")}


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark, [(f"/d/docs/{i % 5}", ["create", "modify", "remove"][i % 3 if i % 5 else 0], i * 400) for i in range(40)])
    roots = spark.createDataFrame([("d1", "/d/docs")], "id string, path string")
    state = files(spark, []).drop("file_ext")
    for lo in range(0, 16000, 4000):
        e.where((F.col("mtime") >= lo) & (F.col("mtime") < lo + 4000)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)
    store = Store(spark, str(tmp_path / "store"))
    store.publish(files=state, batches=spark.createDataFrame([], "batch long"))
    stream = watch.event_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    watch.upkeep(stream, lambda: roots, store, str(tmp_path / "cp")).awaitTermination()
    want = watch.applied(state, watch.routed(watch.classified(e), roots))
    cols = ["dir_id", "path", "mtime", "status"]
    got, one = (sorted(map(tuple, x.where("status = 'active'").select(cols).collect())) for x in (store.current("files"), want))
    assert got == one and got
    n = store.version()
    watch.upkeep(stream, lambda: roots, store, str(tmp_path / "cp")).awaitTermination()
    assert store.version() == n


def test_late_events_change_nothing(spark, tmp_path):
    """Files of events that come in the wrong order, also a delete before the creation of its file, give what one batch gives."""
    e = events(spark, [(f"/d/docs/{i % 5}", ["create", "modify", "remove"][i % 3 if i % 5 else 0], i * 400) for i in range(20)] + [("/d/docs/gone", "create", 100), ("/d/docs/gone", "remove", 7000), ("/d/docs/tie", "modify", 100), ("/d/docs/tie", "remove", 100)])
    roots = spark.createDataFrame([("d1", "/d/docs")], "id string, path string")
    state = files(spark, []).drop("file_ext")
    rows = sorted(e.collect(), key=lambda r: (r["ts"], r["kind"]), reverse=True)
    (tmp_path / "in").mkdir()
    for i in range(0, len(rows), 6):
        file = tmp_path / "in" / f"{i}.json"
        file.write_text("\n".join(json.dumps({**r.asDict(), "ts": r["ts"].isoformat()}) for r in rows[i : i + 6]))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    store = Store(spark, str(tmp_path / "store"))
    store.publish(files=state, batches=spark.createDataFrame([], "batch long"))
    watch.upkeep(watch.event_stream(spark, str(tmp_path / "in"), files_per_batch=1), lambda: roots, store, str(tmp_path / "cp")).awaitTermination()
    want = watch.applied(state, watch.routed(watch.classified(e), roots))
    cols = ["dir_id", "path", "mtime", "status"]
    got, one = (sorted(map(tuple, x.where("status = 'active'").select(cols).collect())) for x in (store.current("files"), want))
    assert got == one and {r[1] for r in got} >= {"0", "tie"} and "gone" not in {r[1] for r in got}


def test_stream_keeps_microseconds(spark, tmp_path):
    """stream_apply: of two events in one millisecond the later counts."""
    from docquarry.plans.engine_queries import stream_apply

    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=i // 2, microseconds=100 + 700 * (i % 2)), i // 2, ["click", "error"][(i + i // 4) % 2]) for i in range(8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert {tuple(r) for r in stream_apply(spark, str(tmp_path)).collect()} == {("d2", 1), ("d3", 1)}


def test_moves_purges_and_keyed_tables(spark):
    cols = "id string, dir_id string, path string, file_ext string, mtime long, size long, md5 string, status string, indexed int"
    state = spark.createDataFrame([("1", "d", "a/x.txt", "txt", 1, 5, "m", "active", 1), ("2", "d", "y.md", "md", 1, 5, None, "active", 2), ("3", "d", "IMG_1.png", "png", 1, 5, "k", "active", 1)], cols)
    moved = spark.createDataFrame([("1", "e", "b/x.pdf", None)], "id string, dir_id string, path string, mtime long")
    row = N.relocated(state, moved).where("id = '1'").first()
    assert (row["dir_id"], row["path"], row["file_ext"], row["mtime"], row["indexed"]) == ("e", "b/x.pdf", "pdf", 1, 1)
    assert N.relocated(state, moved.limit(0)).count() == 3 and N.relocated(state.limit(0), moved).count() == 0
    kept, gone = N.purged(state, ["IMG_*"], ["TXT"])
    assert [r["id"] for r in kept.collect()] == ["1"] and {r["id"] for r in gone.collect()} == {"2", "3"}
    contents = spark.createDataFrame([("m",), ("k",)], "md5 string")
    assert [r[0] for r in N.without_contents(contents, state.where("id in ('1', '2')")).collect()] == ["k"]
    vectors = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "k string, x double, at int")
    new = spark.createDataFrame([("b", 5.0, 2), ("b", 6.0, 3), ("c", None, 1)], "k string, x double, at int")
    assert {r["k"]: r["x"] for r in N.upserted(vectors, new, "k", "at").collect()} == {"a": 1.0, "b": 6.0, "c": None}
    assert [r["k"] for r in N.without_keys(vectors, new, "k").collect()] == ["a"]


def test_reports_on_small_tables(spark):
    files = spark.createDataFrame([("1", "d", "p/a.PNG", "PNG", "active", 1), ("2", "d", "b.txt", "txt", "active", 0), ("3", "e", "c.png", "png", "deleted", 1), ("4", "d", "d.jpeg", "jpeg", "active", None)], "id string, dir_id string, path string, file_ext string, status string, indexed int")
    assert C.image_files(files).first()["n"] == 2
    settings = spark.createDataFrame([("last_scan_a", "5"), ("last_scan_b", "12"), ("last_scan_c", "x"), ("other", "99")], "key string, value string")
    assert C.last_scan(settings).first()[0] == 12 and C.last_scan(settings.limit(0)).first()[0] is None
    assert C.file_detail(files, "1").first()["indexed"] is True and C.file_detail(files, "9").count() == 0
    assert [r["id"] for r in C.files_of(files, "d").collect()] == ["2", "4", "1"] and [r["id"] for r in C.list_files(files, 2, 2).collect()] == ["4", "1"] and C.list_files(files, 1, 0).count() == 0
    lines = spark.createDataFrame([(1, "start [scan]"), (2, "ERROR x"), (3, "an error"), (4, "end")], "n int, t string")
    assert [r["n"] for r in C.log_tail(lines, "n", 2).collect()] == [3, 4] and C.tagged_lines(lines, "t", "error").count() == 2 and C.tagged_lines(lines, "t", "scan").count() == 1
    assert C.log_session(lines, "n", "t", "an error").count() == 2 and C.log_session(lines, "n", "t", "none").count() == 4 and C.log_session(lines.limit(0), "n", "t", "x").count() == 0
    tree = C.directory_tree(spark.createDataFrame([("a/b/c/x",), ("a/bc/y",), ("z",)], "path string"))
    assert {r["path"] for r in C.subtree(tree, "a/b").collect()} == {"a/b", "a/b/c"} and {r["path"] for r in C.partly_selected(tree, ["a/b/c"]).collect()} == {"a", "a/b"}
    types = spark.createDataFrame([("txt", 2, True), ("doc", 0, False)], "ext string, n int, available boolean")
    assert [C.type_list(types, w).count() for w in ("all", "missing", "files")] == [2, 1, 1]
    listing = files.select("path", F.lit(False).alias("not_dir")).withColumn("is_dir", F.lit(False))
    assert C.count_files(listing, 30) == 4
    kept = C.retained(files.withColumn("at", F.lit(1)), "at", "id", 2, by="dir_id").where("kept").collect()
    assert sorted((r["id"], r["rank"]) for r in kept) == [("1", 1), ("2", 2), ("3", 1)] and C.retained(files.withColumn("at", F.lit(1)), "at", "id", 3).where("not kept").count() == 1


def test_paths_under_roots_follow_the_path(spark):
    """Repeated, null and reordered paths get the root of their own path."""
    rows = [(i, f"/r{i % 7}/sub/f{i}") for i in range(200)] * 2 + [(999, None), (998, "/none")]
    roots = spark.createDataFrame([(f"id{i}", f"/r{i}") for i in range(7)] + [("deep", "/r1/sub/")], "id string, path string")
    got = C.under_root(spark.createDataFrame(rows, "n int, p string").repartition(5), roots, "p", "path", "id").collect()
    assert len(got) == len(rows) and all(r["root_id"] == (None if r["n"] > 900 else "deep" if r["n"] % 7 == 1 else f"id{r['n'] % 7}") for r in got)


def test_failed_files_wait_and_listings_make_events(spark):
    cols = "dir_id string, path string, id string, mtime long, size long, md5 string, status string, indexed int, updated_at long"
    state = spark.createDataFrame([("d", "bad", "1", 1, 1, None, "active", 2, 1), ("d", "good", "2", 1, 1, None, "active", 1, 1)], cols)
    events = spark.createDataFrame([("d", p, a, 9, 9, None) for p, a in (("bad", "upsert"), ("good", "upsert"))], "dir_id string, path string, action string, mtime long, size long, md5 string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    after = {r["path"]: (r["indexed"], r["size"]) for r in watch.applied(state, events).collect()}
    assert after == {"bad": (2, 1), "good": (0, 9)}
    assert {r["path"]: r["indexed"] for r in watch.applied(state, events, retry_failed=True).collect()} == {"bad": 0, "good": 0}
    gone = watch.applied(state, events.where("path = 'bad'").withColumn("action", F.lit("delete")))
    assert {r["path"]: r["status"] for r in gone.collect()} == {"bad": "deleted", "good": "active"}
    before, now = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1), ("/c", 1, 1)], "path string, mtime long, size long"), spark.createDataFrame([("/a", 1, 1), ("/b", 2, 1), ("/d", 1, 1)], "path string, mtime long, size long")
    assert {(r["path"], r["kind"]) for r in watch.listing_events(before, now, "2024-01-01").collect()} == {("/b", "modify"), ("/c", "remove"), ("/d", "create")}
