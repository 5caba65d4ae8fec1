"""Queries that run whole paths of the engine: a persisted index, streams and versions."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators.index import Index
from ..operators.search import Corpus, SearchParams, hits
from ..session import shared_root, table
from ..sources.store import Store
from ..streaming import watch
from .search_queries import PAIRS as SCANS
from .search_queries import _DOCS, _any, _bm25_sql, _both, corpus


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_BUILT: dict[tuple, Index] = {}


def built(spark: SparkSession, d: str, cjk: bool = False) -> Index:
    """The index of a folder's documents; built once per session and folder."""
    key = (spark.sparkContext.applicationId, d, cjk)
    if key not in _BUILT:
        index = Index(spark, shared_folder(spark, "index"), buckets=8, cjk=cjk)
        index.build(corpus(spark, d).docs)
        _BUILT[key] = index
    return _BUILT[key]


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """Build and publish an index, then search its postings."""
    index = Index(spark, shared_folder(spark, "index"), buckets=8)
    index.build(corpus(spark, d).docs)
    return index.search("(museum OR scanned) AND ledger NOT garden", 20)


def index_health(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words of an index, and whether its tables fit together."""
    return built(spark, d).health().select("docs", "terms", "healthy")


def _probe(cols: tuple[str, ...] = ("file_id", "score"), **request):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return built(spark, d).reader().hits(SearchParams(**request)).select(*cols)

    return run


def index_total(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).reader().total(SearchParams("budget OR garden"))


def index_suggest(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).reader().suggest("insur")


def index_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of a page of hits; only the texts of the page are read (rows only: the window depends on the highlighter)."""
    return built(spark, d).reader().snippets(SearchParams("photo album")).select("file_id", "snippet")


def index_cjk(spark: SparkSession, d: str) -> DataFrame:
    """A Chinese word inside of longer runs, found by pairs of characters."""
    return built(spark, d, cjk=True).reader().hits(SearchParams("报告")).select("file_id", "score")


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """German documents with one more word, and the documents of a source that goes away."""
    docs = corpus(spark, d).docs
    german = table(spark, d, "documents").where(F.lower("lang") == "de").select(F.col("doc_id").alias("file_id"))
    gone = docs.where("dir_id = 'team_share'").select("file_id")
    return docs.join(german, "file_id", "left_semi").where("dir_id is null or dir_id <> 'team_share'").withColumn("content", F.concat(F.lit("museum "), "content")).select(*docs.columns), gone


def index_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """A search after documents were replaced and deleted: a second segment, exact statistics."""
    index = Index(spark, shared_folder(spark, "index"), buckets=8)
    index.build(corpus(spark, d).docs)
    index.apply(*_changed(spark, d))
    return index.reader().hits(SearchParams("museum ledger")).select("file_id", "score")


def index_after_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same after its segments became one."""
    index = Index(spark, shared_folder(spark, "index"), buckets=8)
    index.build(corpus(spark, d).docs)
    index.apply(*_changed(spark, d))
    index.merge(everything=True)
    return index.reader().hits(SearchParams("museum ledger")).select("file_id", "score")


def content_only(spark: SparkSession, d: str) -> DataFrame:
    return hits(Corpus(corpus(spark, d).docs, fields=("content",)), SearchParams("(museum OR scanned) AND ledger NOT garden")).select("file_id", "score")


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type").isin("click", "view"), "modify").when(F.col("event_type") == "error", "delete").otherwise("ignored")
    return table(spark, d, "events").select(F.concat(F.lit("/w/"), (F.col("user_id") % 7).cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"), F.col("event_id").alias("size"), F.lit(None).cast("string").alias("md5"))


def _roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"d{i}", f"/w/{i}") for i in range(6)], "id string, path string")


def events_applied(spark: SparkSession, d: str) -> DataFrame:
    """The tracked rows after all change events, in one batch: the last event of a path decides."""
    from .pipeline import FILES

    state = spark.createDataFrame([], FILES)
    after = watch.applied(state, watch.routed(watch.classified(_events(spark, d)), _roots(spark)))
    return after.select("dir_id", "path", "size", "status")


#: JSON has milliseconds otherwise, and events would tie.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def stream_apply(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream over files of events, each micro-batch a published version."""
    from .pipeline import FILES

    base = shared_folder(spark, "stream")
    _events(spark, d).repartitionByRange(4, "ts").write.option("timestampFormat", MICROS).json(f"{base}/events")
    store = Store(spark, f"{base}/store")
    store.publish(files=spark.createDataFrame([], FILES), batches=spark.createDataFrame([], "batch long"))
    stream = watch.event_stream(spark, f"{base}/events", files_per_batch=2)
    query = watch.upkeep(stream, lambda: _roots(spark), store, f"{base}/progress")
    query.awaitTermination()
    return C.active(store.current("files")).groupBy("dir_id").agg(F.count(F.lit(1)).alias("n"))


def routed_counts(spark: SparkSession, d: str) -> DataFrame:
    return watch.routed(watch.classified(_events(spark, d)), _roots(spark)).groupBy("dir_id", "action").agg(F.count(F.lit(1)).alias("n"))


def versions_kept(spark: SparkSession, d: str) -> DataFrame:
    """Publish several versions, keep the newest three, restore the oldest kept."""
    store = Store(spark, shared_folder(spark, "store"))
    for _ in range(5):
        store.publish(types=C.browse_types(C.newest(table(spark, d, "file_tracking"), "id", "updated_at")))
    store.retain(3)
    store.restore(3)
    return store.status().select("version", "published")


_EV = "e as (select event_id, ts, user_id % 7 r, user_id, case when event_type = 'signup' then 'upsert' when event_type in ('click', 'view') then 'upsert' when event_type = 'error' then 'delete' end action from events), g as (select * from e where action is not null and r < 6)"

_LEDGER = _bm25_sql("(list_contains(t, 'museum') or list_contains(t, 'scanned')) and list_contains(t, 'ledger') and not list_contains(t, 'garden')", [("content", w) for w in ("museum", "scanned", "ledger")])

_HAN = r"list_concat(\1, flatten(list_transform(list_filter(\1, lambda x: regexp_full_match(x, '\\p{Han}{3,}')), lambda x: list_transform(generate_series(1, length(x) - 1), lambda i: substr(x, cast(i as int), 2)))))"
#: The documents with words cut into pairs of Han characters, too.
_DOCS_CJK = re.sub(r"(regexp_extract_all\([^)]*\)\), '[^']*'\)) (t\b|tn\b)", _HAN + r" \2", _DOCS)
#: The documents after the changes of index_after_delete.
_DOCS_AFTER = _DOCS.replace("from documents)", "from (select * replace (case when lower(lang) = 'de' then 'museum ' || text else text end as text) from documents where source is null or source <> 'team_share'))")


def _over(docs: str, sql: str) -> str:
    return sql.replace(_DOCS, docs)


_CJK = _over(_DOCS_CJK, _bm25_sql(_any("报告"), _both("报告")))
_AFTER = _over(_DOCS_AFTER, _bm25_sql(f"({_any('museum')} or {_any('ledger')})", _both("museum", "ledger")))

PAIRS = {
    "index_or": (_probe(query="budget garden"), SCANS["bm25_or"][1]),
    "index_phrase": (_probe(query='"photo album"'), SCANS["bm25_phrase"][1]),
    "index_prefix": (_probe(query="insur*"), SCANS["bm25_prefix"][1]),
    "index_fuzzy": (_probe(query="budgte", fuzzy=True), SCANS["bm25_fuzzy"][1]),
    "index_field": (_probe(query="content:museum file_name:report"), SCANS["bm25_field"][1]),
    "index_filename": (_probe(query="filename:report museum"), SCANS["filename_term"][1]),
    "index_filter_dir": (_probe(query="museum", dir_ids=("team_share", "lab_mail")), SCANS["filter_dir"][1]),
    "index_filter_ext": (_probe(query="museum", exts=("PDF", "txt")), SCANS["filter_ext"][1]),
    "index_filter_path": (_probe(query="album", path_prefixes=("/team_share/", "/office_")), SCANS["filter_path_prefix"][1]),
    "index_filter_date": (_probe(query="album", date_from="2025-01-01", date_to="2025-06-30"), SCANS["filter_date_range"][1]),
    "index_sort_date": (_probe(cols=("file_id", "score", "rank"), query="", sort="date", ascending=True, size=10, page=2), SCANS["sort_date"][1]),
    "index_page": (_probe(cols=("file_id", "score", "rank"), query="museum", size=7, page=3), SCANS["page_offset"][1]),
    "index_total": (index_total, SCANS["total_hits"][1]),
    "index_suggest": (index_suggest, SCANS["suggest_prefix"][1]),
    "index_snippets": (index_snippets, None),
    "index_cjk": (index_cjk, _CJK),
    "index_after_delete": (index_after_delete, _AFTER),
    "index_after_merge": (index_after_merge, _AFTER),
    "index_search": (index_search, _LEDGER),
    "content_only": (content_only, _LEDGER),
    "index_health": (index_health, f"with {_DOCS} select (select count(*) from docs) docs, (select count(distinct term) from (select unnest(list_concat(t, tn)) term from docs)) terms, true healthy"),
    "events_applied": (events_applied, f"with {_EV}, l as (select *, row_number() over (partition by user_id order by ts desc, action desc) rn from g), u as (select *, row_number() over (partition by user_id order by ts desc, action desc) k from g) select 'd' || r dir_id, cast(user_id as varchar) path, event_id size, 'active' status from l where rn = 1 and action = 'upsert'"),
    "routed_counts": (routed_counts, f"with {_EV} select 'd' || r dir_id, action, count(*) n from g group by 1, 2"),
    "stream_apply": (stream_apply, f"with {_EV}, l as (select *, row_number() over (partition by user_id order by ts desc, action desc) rn from g) select 'd' || r dir_id, count(*) n from l where rn = 1 and action = 'upsert' group by 1"),
    "versions_kept": (versions_kept, "select * from (values (3, true), (4, false), (5, false)) v(version, published)"),
}

QUERIES = {name: pair[0] for name, pair in PAIRS.items()}
ORACLE = {name: pair[1] for name, pair in PAIRS.items() if pair[1]}
