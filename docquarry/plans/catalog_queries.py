"""Queries of the reports, snapshot, scalar, quality and streaming-like operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import scalars as S
from ..operators import catalog as C
from ..operators import snapshot as N
from ..streaming.watch import debounced
from ..session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return C.newest(table(spark, d, "file_tracking"), "id", "updated_at")


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_index").select("md5", "text_content", "indexed_at", "char_count", "ocr_used").dropDuplicates(["md5"])


_F = "f as (select * from (select *, row_number() over (partition by id order by updated_at desc) rn from file_tracking) where rn = 1)"
_A = f"{_F}, a as (select * from f where status = 'active')"
_COUNTS = "count(*) total, count(*) filter (\"indexed\" = 1) \"indexed\", count(*) filter (\"indexed\" in (0, 3)) pending, count(*) filter (\"indexed\" = 2) failed"
_NAME = "regexp_extract(path, '[^/\\\\]*$')"
_EXT = f"lower(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1))"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
_FAMILY = "case " + " ".join(f"when {{0}} in ({', '.join(repr(x) for x in names.split())}) then '{k}'" for k, names in S.FAMILIES.items()) + " else 'unknown' end"


def status_counts(s, d):
    return C.status_counts(_files(s, d))


def dir_stats(s, d):
    return C.directory_stats(table(s, d, "dir_config").select("id", "path").distinct(), _files(s, d))


def file_type_stats(s, d):
    return C.file_type_stats(_files(s, d))


def browse_types(s, d):
    return C.browse_types(_files(s, d))


def browse_list(s, d):
    return C.browse(_files(s, d), "pending", "pdf", "in", sort="mtime", ascending=False, page=2, size=20).select("id", "name", "ext", "size", "mtime")


def duplicates(s, d):
    return C.duplicates(_files(s, d)).select("md5", "n", F.array_join("paths", "|").alias("paths"))


def duplicate_members(s, d):
    return C.duplicate_members(_files(s, d))


def ocr_style_join(s, d):
    return C.ocr_files(_files(s, d), _contents(s, d))


def orphan_contents(s, d):
    return C.orphan_contents(_files(s, d), _contents(s, d)).select("md5")


def preview_join(s, d):
    return C.preview(_files(s, d), _contents(s, d))


def hotwords(s, d):
    return C.top_words(table(s, d, "search_history").select("id", "query").distinct(), "query", 30)


def unsupported_ext(s, d):
    return C.unsupported(_files(s, d))


def unsupported_totals(s, d):
    return C.unsupported(_files(s, d)).groupBy("ext").agg(F.sum("n").alias("n"))


def last_scan_max(s, d):
    return _files(s, d).groupBy("dir_id").agg(F.max("updated_at").alias("last")).agg(F.max("last").alias("last_scan"), F.count(F.lit(1)).alias("n_dirs"))


def history_recent(s, d):
    return C.recent(table(s, d, "search_history").distinct(), "created_at", "id", 100).select("id", "query", "result_count", "pinned", "created_at")


def errors_recent(s, d):
    return C.recent(table(s, d, "index_errors").distinct(), "created_at", "id", 50).select("id", "error_type", S.classify_error("error_msg").alias("error_class"), "created_at")


def needs_index(s, d):
    return C.needing_index(_files(s, d), 100).select("id", "path", "indexed", "updated_at")


def exclude_predicate(s, d):
    return _files(s, d).where(S.is_excluded("path", ["IMG_*", "*_0000000[1-5]*", "plan?*.md"])).select("id", "path")


def ext_of(s, d):
    return _files(s, d).select("id", S.file_name("path").alias("name"), S.extension_of("path").alias("ext"))


def type_name(s, d):
    return _files(s, d).select(S.file_type_name("file_ext").alias("type"), S.classify_ext("file_ext").alias("family")).groupBy("type", "family").agg(F.count(F.lit(1)).alias("n"))


def type_support(s, d):
    """Every supported extension with the number of active files that have it, zeros included."""
    exts = s.createDataFrame([(e,) for names in S.FAMILIES.values() for e in names.split()], "ext string")
    have = C.active(_files(s, d)).groupBy(F.lower("file_ext").alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    return exts.join(have, "ext", "left").select("ext", S.kind_name("ext").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))


def error_class(s, d):
    rows = table(s, d, "index_errors").distinct()
    return rows.groupBy(S.classify_error("error_msg").alias("error_class"), "error_type").agg(F.count(F.lit(1)).alias("n"))


def sizes(s, d):
    return _files(s, d).select("id", S.human_size("size").alias("shown"))


def relative_paths(s, d):
    rows = table(s, d, "dir_config").select("id", "path").distinct()
    return rows.select("id", S.to_relative(F.lit("/srv/"), "path").alias("relative"), S.to_absolute(F.lit("/data/"), S.to_relative(F.lit("/srv"), "path")).alias("moved"))


def ocr_languages(s, d):
    return table(s, d, "dir_config").select("id", "ocr_lang").distinct().select("id", S.ocr_language("ocr_lang", F.lit("fra")).alias("lang"))


def content_hashes(s, d):
    return table(s, d, "documents").select("doc_id", S.content_hash(F.encode("text", "UTF-8")).alias("hash"))


def repetition_ratio(s, d):
    return _contents(s, d).select("md5", F.round(Q.repetition_ratio("text_content"), 6).alias("ratio"), Q.is_repetitive("text_content").alias("repetitive"))


def garbled_ratio(s, d):
    return _contents(s, d).select("md5", F.round(Q.odd_ratio("text_content"), 6).alias("ratio")).where("ratio > 0")


def watermark_adjacent(s, d):
    """The part of a document's pages (paragraphs) that equal the page before, after what changes from page to page is taken away; the pages of one source are nothing but a stamp."""
    pages = table(s, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n\n")).alias("page", "body"))
    mark = F.format_string("Licensed to readers of %s only, 2024-01-%02d, page %d", "source", F.col("page") % 28 + 1, F.col("page") + 1)
    stamped = pages.withColumn("stamp", Q.page_stamps(F.when(F.col("source") == "team_share", mark).otherwise(F.col("body"))))
    w = Window.partitionBy("doc_id").orderBy("page")
    same = (F.col("stamp") == F.lag("stamp").over(w)) & (F.octet_length("stamp") > 20)
    return stamped.withColumn("same", same.cast("int")).groupBy("doc_id").agg(F.round(F.avg("same"), 6).alias("ratio")).where("ratio > 0")


def _halves(s, d):
    """What was there before 2025 and what is there at the end: a snapshot of newest states."""
    files = table(s, d, "file_tracking")
    old = C.newest(files.where(F.col("updated_at") < 1735689600), "id", "updated_at")
    return old, C.active(C.newest(files, "id", "updated_at"))


def snapshot_diff(s, d):
    old, now = _halves(s, d)
    return N.diff(old, now, ("id",)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def deleted_antijoin(s, d):
    """Tracked files that are gone with their directory: none of the directories there are holds them."""
    files = _files(s, d)
    there = files.join(table(s, d, "dir_config").select(F.col("id").alias("dir_id")).distinct(), "dir_id", "left_semi")
    return N.absent(files, there, ("id",)).select("id")


def move_detect(s, d):
    old, now = _halves(s, d)
    shifted = now.withColumn("path", F.concat(F.lit("moved/"), "path"))
    return N.moves(old, shifted)


def upsert_latest(s, d):
    old, _ = _halves(s, d)
    changes = table(s, d, "file_tracking").where(F.col("updated_at") >= 1735689600).select("id", "mtime", "size", "md5", "updated_at")
    return N.upsert(old.select("id", "mtime", "size", "md5", "status", "indexed", "updated_at").withColumn("k", F.col("id")), changes.withColumn("k", F.col("id")), ("k",)).select("id", "mtime", "size", "md5", "status", "indexed", "updated_at")


def absorb_reroot(s, d):
    hot = "5b03eb25-7b74-4b7a-aef1-19d461c63ff9"
    return N.absorb(_files(s, d), hot, "parent", "B").where("dir_id = 'parent'").select("id", "path", "dir_id", "md5", "indexed")


def to_extract(s, d):
    return N.to_extract(C.active(_files(s, d)), _contents(s, d))


def dir_tree(s, d):
    return C.directory_tree(_files(s, d).select("path")).select("path", "parent", "depth", "name", "n_files")


def route_to_root(s, d):
    roots = table(s, d, "dir_config").select("id", "path").distinct()
    paths = roots.select(F.concat("path", F.lit("/sub/a.txt")).alias("p")).union(roots.select(F.concat("path", F.lit("x/b.txt")).alias("p")))
    return C.under_root(paths, roots, "p", "path", "id").select("p", "root_id")


def retention_top10(s, d):
    rows = table(s, d, "search_history").select("id", "created_at", "pinned").distinct()
    return C.retained(rows, "created_at", "id", 10, by="pinned").where("kept").select("id", "pinned", "rank")


def _log_lines(s, d):
    return table(s, d, "documents").where(F.lower("file_ext") == "log").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def log_session(s, d):
    return C.log_session(_log_lines(s, d), "line_no", "line", "[scan]", by="doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def log_tail(s, d):
    lines = _log_lines(s, d).withColumn("at", F.col("doc_id") * 1_000_000 + F.col("line_no"))
    return C.log_tail(lines, "at", 50).select("doc_id", "line_no", "line")


def log_tagged(s, d):
    return C.tagged_lines(_log_lines(s, d), "line", "scan").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _settings(s, d):
    """Settings as the scans of the directories leave them."""
    return table(s, d, "dir_config").groupBy("id").agg(F.max("updated_at").alias("u")).select(F.concat(F.lit("last_scan_"), "id").alias("key"), F.col("u").cast("string").alias("value")).unionByName(s.createDataFrame([("ocr_lang", "9999999999"), ("last_scan_x", "never")], "key string, value string"))


def last_scan(s, d):
    return C.last_scan(_settings(s, d))


def image_count(s, d):
    return C.image_files(_files(s, d))


def index_status(s, d):
    from .pipeline import status

    return status(_files(s, d), _contents(s, d), _settings(s, d))


def file_detail(s, d):
    files = _files(s, d)
    return C.file_detail(files, files.agg(F.min("id")).first()[0]).select("id", "path", "dir_id", "size", "md5", "status", "indexed")


def files_of_dir(s, d):
    return C.files_of(_files(s, d), "5b03eb25-7b74-4b7a-aef1-19d461c63ff9").select("id", "path")


def list_files(s, d):
    return C.list_files(_files(s, d), page=3, size=25).select("id", "path")


def type_list(s, d):
    types = type_support(s, d).withColumn("available", F.col("kind") != "Image")
    return C.type_list(types, "missing").select("ext", F.lit("missing").alias("list")).unionByName(C.type_list(types, "files").select("ext", F.lit("files").alias("list")))


def unsupported_hints(s, d):
    return C.unsupported(_files(s, d)).withColumn("convertible", S.is_convertible("ext")).select("dir_id", "ext", "n", "convertible", S.unsupported_hint("ext", False).alias("hint"))


def tree_selection(s, d):
    """Directories below a chosen one, and those only partly chosen by it."""
    tree = C.directory_tree(table(s, d, "dir_config").select("path").distinct())
    return C.subtree(tree, "srv").select("path", F.lit("chosen").alias("state")).unionByName(C.partly_selected(tree, ["srv/share"]).select("path", F.lit("partly").alias("state")))


def dir_tree_deep(s, d):
    return C.directory_tree(table(s, d, "dir_config").select("path").distinct())


def moved_files(s, d):
    """The tracked rows after files moved: what was at one path before 2025 is now below another."""
    old, now = _halves(s, d)
    found = N.moves(old, now.withColumn("path", F.concat(F.lit("moved/"), "path")))
    return N.relocated(old, found.select("id", F.lit("d").alias("dir_id"), F.col("new_path").alias("path"), F.lit(None).cast("bigint").alias("mtime"))).where("dir_id = 'd'").select("id", "path", "md5", "indexed")


def purged_files(s, d):
    kept, gone = N.purged(_files(s, d), ["IMG_*", "plan?*.md"], ["pdf", "docx", "md"])
    return kept.select("id", F.lit(True).alias("kept")).unionByName(gone.select("id", F.lit(False).alias("kept")))


def contents_deleted(s, d):
    """The stored contents after those of failed files were forgotten."""
    return N.without_contents(_contents(s, d), _files(s, d).where("indexed = 2")).select("md5")


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


def embeddings_upserted(s, d):
    """Vectors after new ones of some documents and of others that had none."""
    new = table(s, d, "documents").where("source = 'team_share'").select(F.col("doc_id").alias("vec_id"), F.lit(9.0).alias("x"))
    return N.upserted(_vectors(s, d), new, "vec_id")


def embeddings_deleted(s, d):
    return N.without_keys(_vectors(s, d), table(s, d, "documents").where("source = 'team_share'").select(F.col("doc_id").alias("vec_id")), "vec_id").select("vec_id")


def scan_delta(s, d):
    old, now = _halves(s, d)
    per = N.diff(old, now, ("id",)).join(now.select("id", "dir_id"), "id", "left").groupBy("dir_id", "change").agg(F.count(F.lit(1)).alias("n"))
    return C.scan_delta(per)


def listing_first_dir(s, d):
    """Absolute paths of tracked files, each with the innermost configured directory above it and its index state."""
    dirs = table(s, d, "dir_config").select("id", "path").distinct()
    files = _files(s, d).select(F.col("id").alias("file"), F.col("path").alias("below"), "dir_id", "indexed")
    listed = files.join(dirs.select(F.col("id").alias("dir_id"), "path"), "dir_id").select("file", "indexed", F.concat_ws("/", "path", "below").alias("path"))
    return C.under_root(listed, dirs, "path", "path", "id").select("file", "indexed", "root_id")


def debounce_sessions(s, d):
    return debounced(table(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), "ts"), "30 minutes", "path").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("n_events").alias("n_events"))


def events_by_kind(s, d):
    return table(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def pricing_summary(s, d):
    """Conditional aggregates at volume."""
    li = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.count_if(F.col("l_tax") > 0.04).alias("taxed"), F.count(F.lit(1)).alias("n"))


def top_orders(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    top = o.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    return top.join(c.select("c_custkey", "c_name"), top["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "o_totalprice")


def idle_customers(s, d):
    """Customers without an order of more than 400 000."""
    c, o = table(s, d, "customer"), table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").select("c_custkey")


_OLD = "o as (select * from (select *, row_number() over (partition by id order by updated_at desc) rn from file_tracking where updated_at < 1735689600) where rn = 1)"
_DIFF = f"""with {_OLD}, {_A}, x as (select coalesce(o.id, a.id) id, case when o.id is null then 'created' when a.id is null then case when o.status <> 'deleted' then 'deleted' end
 when o.status = 'deleted' then 'restored' when a.mtime is distinct from o.mtime or a.size is distinct from o.size then 'modified' when o."indexed" = 0 then 'pending' else 'unchanged' end change from o full join a on o.id = a.id)
select change, count(*) n from x where change is not null group by 1"""
_ERR = "case " + " ".join(f"when {' or '.join(f'contains(error_msg, {w!r})' for w in words)} then '{k}'" for k, words in S.ERROR_CLASSES) + " else 'unknown' end"
_NAMES = "case " + " ".join(f"when lower(file_ext) = '{k}' then '{v}'" for k, v in S.TYPE_NAMES.items()) + " else upper(file_ext) end"
_EXCL = f"({_NAME} in ({', '.join(repr(x) for x in S.EXCLUDED_NAMES)}) or substr({_NAME}, 1, 1) in ({', '.join(repr(x) for x in S.EXCLUDED_FIRST)}) or {' or '.join(f'ends_with({_NAME}, {x!r})' for x in S.EXCLUDED_SUFFIXES)} or {_NAME} glob 'IMG_*' or {_NAME} glob '*_0000000[1-5]*' or {_NAME} glob 'plan?*.md')"
_C = "c as (select distinct on (md5) md5, text_content, ocr_used from content_index)"
_LINES = "list_filter(list_transform(string_split(text_content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"

_L = "l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from documents where lower(file_ext) = 'log')"
_TREE = "with p as (select distinct path from dir_config), s as (select list_filter(string_split(path, '/'), lambda x: x <> '') s from p), e as (select s, unnest(generate_series(1, len(s) - 1)) depth from s where len(s) > 1), t as (select array_to_string(s[1:depth], '/') path, coalesce(array_to_string(s[1:depth - 1], '/'), '') parent, cast(depth as int) depth, s[depth] \"name\", count(*) n_files from e group by all) "

_EXCL_FEW = _EXCL.replace(f" or {_NAME} glob '*_0000000[1-5]*'", "")

PAIRS = {
    "status_counts": (status_counts, f"with {_A} select {_COUNTS} from a"),
    "dir_stats": (dir_stats, f"with {_A}, d as (select distinct id, path from dir_config), s as (select lower(trim(dir_id, {_TRIM})) dir_id, {_COUNTS} from a group by 1) select d.id, d.path, coalesce(total, 0) total, coalesce(\"indexed\", 0) \"indexed\", coalesce(pending, 0) pending, coalesce(failed, 0) failed from d left join s on d.id = s.dir_id"),
    "file_type_stats": (file_type_stats, f"with {_A} select lower(coalesce(file_ext, '')) ext, count(*) total, count(*) filter (\"indexed\" in (1, 3)) \"indexed\", count(*) filter (\"indexed\" = 0) pending, count(*) filter (\"indexed\" = 2) failed from a group by 1"),
    "browse_types": (browse_types, f"with {_A} select distinct lower(file_ext) ext from a where {_FAMILY.format('lower(file_ext)')} <> 'unknown'"),
    "browse_list": (browse_list, f"with {_A} select id, {_NAME} \"name\", {_EXT} ext, size, mtime from a where \"indexed\" in (0, 3) and ends_with(lower(path), '.pdf') and contains(lower(path), 'in') order by mtime desc, path, id limit 20 offset 20"),
    "duplicates": (duplicates, f"with {_A} select md5, count(*) n, string_agg(path, '|' order by path) paths from a where trim(md5, {_TRIM}) <> '' group by 1 having count(*) > 1"),
    "duplicate_members": (duplicate_members, f"with {_A}, x as (select md5, id, count(*) over (partition by md5) n from a where trim(md5, {_TRIM}) <> '') select * from x where n > 1"),
    "ocr_style_join": (ocr_style_join, f"with {_A} select count(*) n from a where md5 in (select md5 from content_index where ocr_used = 1)"),
    "orphan_contents": (orphan_contents, f"with {_F} select distinct md5 from content_index where md5 not in (select md5 from f where md5 is not null)"),
    "preview_join": (preview_join, f"with {_F}, {_C} select f.id, {_FAMILY.format(_EXT)} kind, length(c.text_content) n_chars, c.ocr_used from f left join c on f.md5 = c.md5"),
    "hotwords": (hotwords, "with h as (select distinct id, query from search_history), w as (select unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) word from h) select word, count(*) n from w where strlen(word) >= 2 and not regexp_matches(word, '^[0-9]+$') group by 1 order by n desc, word limit 30"),
    "unsupported_ext": (unsupported_ext, f"with {_F} select dir_id, lower(file_ext) ext, count(*) n from f where file_ext <> '' and {_FAMILY.format('lower(file_ext)')} = 'unknown' group by 1, 2"),
    "unsupported_totals": (unsupported_totals, f"with {_F} select lower(file_ext) ext, count(*) n from f where file_ext <> '' and {_FAMILY.format('lower(file_ext)')} = 'unknown' group by 1"),
    "last_scan_max": (last_scan_max, f"with {_F} select max(updated_at) last_scan, count(distinct dir_id) n_dirs from f"),
    "history_recent": (history_recent, "select distinct id, query, result_count, pinned, created_at from search_history order by created_at desc, id limit 100"),
    "errors_recent": (errors_recent, f"with e as (select distinct * from index_errors) select id, error_type, {_ERR} error_class, created_at from e order by created_at desc, id limit 50"),
    "needs_index": (needs_index, f"with {_F} select id, path, \"indexed\", updated_at from f where \"indexed\" in (0, 2) order by updated_at, id limit 100"),
    "exclude_predicate": (exclude_predicate, f"with {_F} select id, path from f where {_EXCL}"),
    "ext_of": (ext_of, f"with {_F} select id, {_NAME} \"name\", {_EXT} ext from f"),
    "type_name": (type_name, f"with {_F} select {_NAMES} \"type\", {_FAMILY.format('lower(file_ext)')} family, count(*) n from f group by 1, 2"),
    "type_support": (type_support, f"with {_A}, e as (select unnest([{', '.join(repr(x) for names in S.FAMILIES.values() for x in names.split())}]) ext) select e.ext, case {' '.join(f'when e.ext in ({chr(44).join(repr(x) for x in v.split())}) then {k!r}' for k, v in S.KINDS.items())} else '' end kind, count(a.id) n from e left join a on lower(a.file_ext) = e.ext group by 1, 2"),
    "error_class": (error_class, f"with e as (select distinct * from index_errors) select {_ERR} error_class, error_type, count(*) n from e group by 1, 2"),
    "human_sizes": (sizes, f"with {_F} select id, case when size < 1024 then size || ' B' when size < 1048576 then printf('%.1f KB', round(size / 1024, 1)) else printf('%.1f MB', round(size / 1048576, 1)) end shown from f"),
    "log_tail": (log_tail, f"with {_L} select doc_id, line_no, line from l order by doc_id desc, line_no desc limit 50"),
    "log_tagged": (log_tagged, f"with {_L} select doc_id, count(*) n from l where contains(line, '[scan]') group by 1"),
    "last_scan": (last_scan, "select max(updated_at) last_scan from dir_config"),
    "image_count": (image_count, f"with {_A} select count(*) n from a where lower(file_ext) in {C.IMAGES!r}"),
    "index_status": (index_status, f"with {_A} select {_COUNTS}, (select count(*) from a where md5 in (select md5 from content_index where ocr_used = 1)) ocr_files, count(*) filter (lower(file_ext) in {C.IMAGES!r}) images, (select max(updated_at) from dir_config) last_scan from a"),
    "file_detail": (file_detail, f"with {_F} select id, path, dir_id, size, md5, status, \"indexed\" = 1 \"indexed\" from f where id = (select min(id) from f)"),
    "files_of_dir": (files_of_dir, f"with {_F} select id, path from f where dir_id = '5b03eb25-7b74-4b7a-aef1-19d461c63ff9'"),
    "list_files": (list_files, f"with {_F} select id, path from f order by path, id limit 25 offset 50"),
    "type_list": (type_list, f"with {_A}, e as (select unnest([{', '.join(repr(x) for names in S.FAMILIES.values() for x in names.split())}]) ext), t as (select ext, 'missing' \"list\" from e where ext in ({', '.join(repr(x) for x in S.KINDS['Image'].split())}) union all select ext, 'files' from e where ext in (select lower(file_ext) from a)) select * from t"),
    "unsupported_hints": (unsupported_hints, f"with {_F}, u as (select dir_id, lower(file_ext) ext, count(*) n from f where file_ext <> '' and {_FAMILY.format('lower(file_ext)')} = 'unknown' group by 1, 2) select *, ext in {S.CONVERTIBLE!r} convertible, case when ext in {S.CONVERTIBLE!r} then 'install a converter to index it' else 'no reader' end hint from u"),
    "dir_tree_deep": (dir_tree_deep, _TREE + "select * from t"),
    "tree_selection": (tree_selection, _TREE + "select path, 'chosen' state from t where path = 'srv' or starts_with(path, 'srv/') union all select path, 'partly' from t where path = 'srv'"),
    "moved_files": (moved_files, f"with {_OLD}, {_A}, x as (select id, {_NAME} nm, size, md5, \"indexed\", row_number() over (partition by {_NAME}, size, md5 order by path, id) n from o where size <= 10485760 and md5 is not null), y as (select 'moved/' || path new_path, {_NAME} nm, size, md5, row_number() over (partition by {_NAME}, size, md5 order by 'moved/' || path) n from a where size <= 10485760 and md5 is not null) select x.id, new_path path, x.md5, x.\"indexed\" from x join y using (nm, size, md5, n)"),
    "purged_files": (purged_files, f"with {_F} select id, not ({_EXCL_FEW} or coalesce({_EXT} not in ('pdf', 'docx', 'md'), true)) kept from f"),
    "contents_deleted": (contents_deleted, f"with {_F} select distinct md5 from content_index where md5 not in (select md5 from f where \"indexed\" = 2 and md5 is not null)"),
    "embeddings_upserted": (embeddings_upserted, "with n as (select doc_id from documents where source = 'team_share') select vec_id, round(embedding[1]::double, 6) x from embeddings where vec_id not in (select doc_id from n) union all select doc_id, 9.0 from n"),
    "embeddings_deleted": (embeddings_deleted, "select vec_id from embeddings where vec_id not in (select doc_id from documents where source = 'team_share')"),
    "scan_delta": (scan_delta, _DIFF),
    "listing_first_dir": (listing_first_dir, f"with {_F}, d as (select distinct id, path from dir_config), p as (select f.id file, d.path || '/' || f.path p, \"indexed\" from f join d on f.dir_id = d.id) select file, \"indexed\", (select arg_max(d.id, length(d.path)) from d where starts_with(p, d.path || '/')) root_id from p"),
    "relative_paths": (relative_paths, "with d as (select distinct id, path from dir_config) select id, case when starts_with(path, '/srv/') then substr(path, 6) end relative, case when starts_with(path, '/srv/') then '/data/' || substr(path, 6) end moved from d"),
    "ocr_languages": (ocr_languages, "with d as (select distinct id, trim(ocr_lang) l from dir_config) select id, case when l <> '' and l <> 'eng' then l else 'fra' end lang from d"),
    "content_hashes": (content_hashes, "select doc_id, md5(text) hash from documents"),
    "repetition_ratio": (repetition_ratio, f"with {_C}, l as (select md5, text_content, {_LINES} l from c) select md5, round(case when len(l) > 0 then (len(l) - len(list_distinct(l))) / len(l) else 0.0 end, 6) ratio, strlen(text_content) >= 100 and len(l) >= 3 and (len(l) - len(list_distinct(l))) / len(l) > 0.6 repetitive from l"),
    "garbled_ratio": (garbled_ratio, f"with {_C}, r as (select md5, round((length(text_content) - length(regexp_replace(text_content, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))) / length(text_content), 6) ratio from c where length(text_content) > 0) select md5, ratio from r where ratio > 0"),
    "watermark_adjacent": (watermark_adjacent, "select doc_id, 1.0 ratio from documents where source = 'team_share' and len(string_split(text, chr(10) || chr(10))) > 1"),
    "snapshot_diff": (snapshot_diff, _DIFF),
    "deleted_antijoin": (deleted_antijoin, f"with {_A} select id from a where dir_id is null or dir_id not in (select id from dir_config)"),
    "move_detect": (move_detect, f"with {_OLD}, {_A}, x as (select id, path old_path, {_NAME} nm, size, md5, row_number() over (partition by {_NAME}, size, md5 order by path, id) n from o where size <= 10485760 and md5 is not null), y as (select 'moved/' || path new_path, {_NAME} nm, size, md5, row_number() over (partition by {_NAME}, size, md5 order by 'moved/' || path) n from a where size <= 10485760 and md5 is not null) select x.id, old_path, new_path from x join y on x.nm = y.nm and x.size = y.size and x.md5 = y.md5 and x.n = y.n"),
    "upsert_latest": (upsert_latest, f"with {_OLD}, n as (select * from (select *, row_number() over (partition by id order by updated_at desc) rn from file_tracking where updated_at >= 1735689600) where rn = 1) select coalesce(o.id, n.id) id, case when n.id is null then o.mtime else n.mtime end mtime, case when n.id is null then o.size else n.size end size, case when n.id is null then o.md5 else coalesce(n.md5, o.md5) end md5, case when n.id is null then o.status else 'active' end status, case when n.id is not null and (o.id is null or n.mtime is distinct from o.mtime or n.size is distinct from o.size) then 0 else o.\"indexed\" end \"indexed\", case when n.id is null then o.updated_at else n.updated_at end updated_at from o full join n on o.id = n.id"),
    "absorb_reroot": (absorb_reroot, f"with {_F} select id, 'B/' || path path, 'parent' dir_id, md5, 0 \"indexed\" from f where dir_id = '5b03eb25-7b74-4b7a-aef1-19d461c63ff9'"),
    "to_extract": (to_extract, f"with {_A} select md5, min(path) path from a where md5 is not null and md5 not in (select md5 from content_index) group by 1"),
    "dir_tree": (dir_tree, f"with {_F} select split_part(path, '/', 1) path, '' parent, 1 depth, split_part(path, '/', 1) \"name\", count(*) n_files from f where contains(path, '/') group by 1"),
    "route_to_root": (route_to_root, "with d as (select distinct id, path from dir_config), p as (select path || '/sub/a.txt' p from d union all select path || 'x/b.txt' from d) select p, (select arg_max(d.id, length(d.path)) from d where starts_with(p, d.path || '/')) root_id from p"),
    "retention_top10": (retention_top10, "with h as (select distinct id, created_at, pinned from search_history), r as (select id, pinned, row_number() over (partition by pinned order by created_at desc, id) rank from h) select * from r where rank <= 10"),
    "log_session": (log_session, "with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from documents where lower(file_ext) = 'log'), m as (select *, max(line_no) filter (contains(line, '[scan]')) over (partition by doc_id) last from l) select doc_id, count(*) n_lines from m where last is null or line_no >= last group by 1"),
    "debounce_sessions": (debounce_sessions, "with e as (select cast(user_id as varchar) path, ts, lag(ts) over (partition by user_id order by ts) p from events) select path, count(*) filter (p is null or ts - p > interval 30 minutes) n, count(*) n_events from e group by 1"),
    "events_by_kind": (events_by_kind, "select event_type, strftime(ts, '%Y-%m-%d') \"day\", count(*) n, round(sum(value), 2) total from events group by 1, 2"),
    "pricing_summary": (pricing_summary, "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice * (1 - l_discount)), 2) net, count(*) filter (l_tax > 0.04) taxed, count(*) n from lineitem where l_shipdate <= timestamp '2001-09-02' group by 1, 2"),
    "top_orders": (top_orders, "select o_orderkey, c_name, o_totalprice from (select * from orders order by o_totalprice desc, o_orderkey limit 50) join customer on o_custkey = c_custkey"),
    "idle_customers": (idle_customers, "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)"),
}

QUERIES = {name: pair[0] for name, pair in PAIRS.items()}
ORACLE = {name: pair[1] for name, pair in PAIRS.items() if pair[1]}
