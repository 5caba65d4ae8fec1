"""Queries of the search operators over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions import vectors as V
from ..operators import fusion, index
from ..operators.search import Corpus, SearchParams, hits, scored, suggest, total
from ..session import table


def corpus(spark: SparkSession, d: str, cjk: bool = False) -> Corpus:
    """The documents as a search corpus."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), "file_name", F.lower("file_ext").alias("file_ext"), F.col("source").alias("dir_id"),
        F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("file_name")).alias("path"),
        F.col("text").alias("content"), "mtime", F.col("n_chars").alias("file_size"),
    )
    return Corpus(docs, cjk)


def _hits(cols: tuple[str, ...] = ("file_id", "score"), **request):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return hits(corpus(spark, d), SearchParams(**request)).select(*cols)

    return run


W = r"[\p{L}\p{N}]+"
_DOCS = rf"""docs as (select doc_id file_id, file_name, lower(file_ext) file_ext, source dir_id, '/' || coalesce(source, 'none') || '/' || file_name path, text content, mtime, n_chars file_size,
 regexp_extract_all(lower(coalesce(text, '')), '{W}') t, regexp_extract_all(lower(coalesce(file_name, '')), '{W}') tn from documents)"""
_TOK = {"content": "t", "file_name": "tn"}


def _bm25_sql(where: str, pairs: list[tuple[str, str]], flat: float = 0.0, rest: str = "select file_id, score from s order by score desc, file_id limit 20") -> str:
    stats = ", ".join(f"count(*) filter (list_contains({_TOK[f]}, '{w}')) df{i}" for i, (f, w) in enumerate(pairs))
    parts = [f"{flat}"] + [
        f"ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) * 2.2 * len(list_filter({_TOK[f]}, lambda x: x = '{w}')) / (len(list_filter({_TOK[f]}, lambda x: x = '{w}')) + 1.2 * (0.25 + 0.75 * len({_TOK[f]}) / avg_{_TOK[f]}))"
        for i, (f, w) in enumerate(pairs)
    ]
    return f"with {_DOCS}, st as (select cast(count(*) as double) n, avg(len(t)) avg_t, avg(len(tn)) avg_tn{', ' + stats if stats else ''} from docs), s as (select docs.*, round({' + '.join(parts)}, 6) score from docs, st where {where}) {rest}"


def _any(w: str) -> str:
    return f"(list_contains(t, '{w}') or list_contains(tn, '{w}'))"


def _phrase(*w: str) -> str:
    p = " ".join(w)
    return f"(contains(' ' || array_to_string(t, ' ') || ' ', ' {p} ') or contains(' ' || array_to_string(tn, ' ') || ' ', ' {p} '))"


def _both(*w: str) -> list[tuple[str, str]]:
    return [(f, x) for x in w for f in ("content", "file_name")]




def _all_sql(where: str) -> str:
    return f"with {_DOCS}, s as (select *, 1.0 score from docs where {where}) "


_TOP = "select file_id, score from s order by score desc, file_id limit 20"


def _sorted_sql(key: str, where: str = "true", size: int = 10, page: int = 1, score: str | None = None) -> str:
    first = size * (page - 1)
    value = score or f"round(1.0 - (rank - 1.0) / {size * page}, 6)"
    return _all_sql(where) + f", o as (select file_id, row_number() over (order by {key}, file_id) rank from s) select file_id, {value} score, rank from o where rank > {first} and rank <= {first + size}"


def total_hits(spark, d):
    return total(corpus(spark, d), SearchParams("budget OR garden"))


def suggest_prefix(spark, d):
    return suggest(corpus(spark, d), "insur")


def snippets(spark, d):
    """Snippets of the best hits (rows only: the window depends on the highlighter)."""
    c = corpus(spark, d)
    top = hits(c, SearchParams("photo album", size=20)).select("file_id", "score")
    return top.join(c.docs.select("file_id", "content"), "file_id").select("file_id", A.snippet("content", ["photo", "album"]).alias("snippet"))


def corpus_stats(spark, d):
    return index.corpus_stats(corpus(spark, d).docs).withColumn("avg_dl", F.round("avg_dl", 6))


def term_df(spark, d):
    return index.term_stats(index.postings(corpus(spark, d).docs)).orderBy(F.desc("df"), "term").limit(200)


def postings_positions(spark, d):
    """Postings of two words with their places."""
    post = index.postings(corpus(spark, d).docs).where(F.col("term").isin("budget", "album"))
    return post.select("term", "file_id", "tf", "dl", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("places"))


def match_counts(spark, d):
    """How often the distinct terms occur in each text, overlapping ones included."""
    return corpus(spark, d).docs.select("file_id", A.match_count("content", ["an", "ana"]).alias("n")).where("n > 0")


def _vector(k: int) -> list[float]:
    return [((7 * i + 3 * k) % 11 - 5) / 5.0 for i in range(64)]


def cosine_topk(spark, d):
    return fusion.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _vector(1), 20)


def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"), F.round(V.norm(V.normalized("embedding")), 6).alias("unit"))


def _lists(spark, d):
    found = hits(corpus(spark, d), SearchParams("garden OR budget", size=50)).select("file_id", "score")
    near = fusion.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _vector(1), 50)
    return [(found, "score"), (near.withColumnRenamed("vec_id", "file_id"), "similarity")]


def rrf_fusion(spark, d):
    return fusion.fused(_lists(spark, d), "file_id", "union")


def rerank_only(spark, d):
    return fusion.fused(_lists(spark, d), "file_id", "rerank")


def live_vectors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return fusion.live_only(table(spark, d, "embeddings"), "vec_id", docs).agg(F.count(F.lit(1)).alias("n"))


def ask_context(spark, d):
    return fusion.context(corpus(spark, d).docs, [3, 5, 8, 13])


_Q = f"[{', '.join(str(x) for x in _vector(1))}]::double[]"
_NEAR = f"select vec_id, round(list_cosine_similarity(embedding::double[], {_Q}), 6) similarity from embeddings order by similarity desc, vec_id limit "
_RRF = _bm25_sql(f"({_any('garden')} or {_any('budget')})", _both("garden", "budget"), rest="select file_id, score from s order by score desc, file_id limit 50")
_FUSE = f"with a as (select file_id, row_number() over (order by score desc, file_id) - 1 r from ({_RRF})), b as (select vec_id file_id, row_number() over (order by similarity desc, vec_id) - 1 r from ({_NEAR}50)), u as (select file_id, 1.0 / (60 + r) w, 1 f from a union all select file_id, 1.0 / (60 + r), 0 from b) select file_id, round(sum(w), 9) rrf from u group by 1"

#: name: (query, SQL or None)
PAIRS = {
    "bm25_or": (_hits(query="budget garden"), _bm25_sql(f"({_any('budget')} or {_any('garden')})", _both("budget", "garden"))),
    "bm25_and": (_hits(query="budget AND garden AND photo"), _bm25_sql(f"{_any('budget')} and {_any('garden')} and {_any('photo')}", _both("budget", "garden", "photo"))),
    "bm25_not": (_hits(query="budget NOT garden"), _bm25_sql(f"{_any('budget')} and not {_any('garden')}", _both("budget"))),
    "bm25_group": (_hits(query="(museum OR scanned) AND ledger -garden"), _bm25_sql(f"({_any('museum')} or {_any('scanned')}) and {_any('ledger')} and not {_any('garden')}", _both("museum", "scanned", "ledger"))),
    "bm25_phrase": (_hits(query='"photo album"'), _bm25_sql(_phrase("photo", "album"), _both("photo", "album"))),
    "bm25_prefix": (_hits(query="insur*"), _bm25_sql("(len(list_filter(t, lambda x: starts_with(x, 'insur'))) > 0 or len(list_filter(tn, lambda x: starts_with(x, 'insur'))) > 0)", [], 1.0)),
    "bm25_fuzzy": (_hits(query="budgte", fuzzy=True), _bm25_sql("(len(list_filter(t, lambda x: damerau_levenshtein(x, 'budgte') <= 1)) > 0 or len(list_filter(tn, lambda x: damerau_levenshtein(x, 'budgte') <= 1)) > 0)", [], 1.0)),
    "bm25_field": (_hits(query="content:museum file_name:report"), _bm25_sql("(list_contains(t, 'museum') or list_contains(tn, 'report'))", [("content", "museum"), ("file_name", "report")])),
    "filename_term": (_hits(query="filename:report museum"), _bm25_sql(f"{_any('museum')} and list_contains(tn, 'report')", _both("museum"))),
    "filter_dir": (_hits(query="museum", dir_ids=("team_share", "lab_mail")), _bm25_sql(f"{_any('museum')} and dir_id in ('team_share', 'lab_mail')", _both("museum"))),
    "filter_ext": (_hits(query="museum", exts=("PDF", "txt")), _bm25_sql(f"{_any('museum')} and file_ext in ('pdf', 'txt')", _both("museum"))),
    "filter_ids": (_hits(query="", file_ids=(1, 2, 3, 5, 8, 13, 21, 999999)), _all_sql("file_id in (1, 2, 3, 5, 8, 13, 21, 999999)") + _TOP),
    "filter_path_prefix": (_hits(query="album", path_prefixes=("/team_share/", "/office_")), _bm25_sql(f"{_any('album')} and (starts_with(path, '/team_share/') or starts_with(path, '/office_'))", _both("album"))),
    "filter_date_range": (_hits(query="album", date_from="2025-01-01", date_to="2025-06-30"), _bm25_sql(f"{_any('album')} and mtime >= timestamptz '2025-01-01 00:00:00+00' and mtime <= timestamptz '2025-06-30 00:00:00+00'", _both("album"))),
    "match_all_page": (_hits(cols=("file_id", "score", "rank"), query="", size=15, page=3), _all_sql("true") + ", o as (select file_id, score, row_number() over (order by file_id) rank from s) select file_id, score, rank from o where rank > 30 and rank <= 45"),
    "sort_date": (_hits(cols=("file_id", "score", "rank"), query="", sort="date", ascending=True, size=10, page=2), _sorted_sql("mtime asc nulls last", page=2)),
    "sort_size": (_hits(cols=("file_id", "score", "rank"), query="", sort="size", size=10), _sorted_sql("file_size desc nulls last")),
    "sort_name_capped": (_hits(cols=("file_id", "rank"), query="", sort="name", ascending=True, size=10, name_cap=300), _all_sql("true") + ", c as (select * from s order by score desc, file_id limit 300), o as (select file_id, row_number() over (order by lower(file_name), file_id) rank from c) select file_id, rank from o where rank <= 10"),
    "page_offset": (_hits(cols=("file_id", "score", "rank"), query="museum", size=7, page=3), _bm25_sql(_any("museum"), _both("museum"), rest=", o as (select file_id, score, row_number() over (order by score desc, file_id) rank from s) select file_id, score, rank from o where rank > 14 and rank <= 21")),
    "total_hits": (total_hits, f"with {_DOCS} select count(*) total from docs where {_any('budget')} or {_any('garden')}"),
    "suggest_prefix": (suggest_prefix, f"with {_DOCS}, f as (select file_id, file_name from docs where len(list_filter(t, lambda x: starts_with(x, 'insur'))) > 0 order by file_id limit 10) select file_name, min(file_id) first_id from f group by 1"),
    "snippet": (snippets, None),
    "corpus_stats": (corpus_stats, f"with {_DOCS} select count(*) n_docs, round(avg(len(t)), 6) avg_dl, cast(sum(len(t)) as bigint) n_tokens from docs"),
    "term_df": (term_df, f"with {_DOCS}, e as (select file_id, unnest(t) term from docs) select term, count(distinct file_id) df, count(*) cf from e group by 1 order by df desc, term limit 200"),
    "postings": (postings_positions, f"with {_DOCS}, e as (select file_id, len(t) dl, unnest(t) term, generate_subscripts(t, 1) - 1 p from docs) select term, file_id, count(*) tf, dl, string_agg(cast(p as varchar), ',' order by p) places from e where term in ('budget', 'album') group by term, file_id, dl"),
    # each "ana" is an "an" with an "a" or another "an" after it
    "match_counts": (match_counts, "with p as (select doc_id file_id, string_split(replace(lower(text), 'an', chr(1)), chr(1)) x from documents), c as (select file_id, len(x) - 1 + len(list_filter(x[2:], lambda y: starts_with(y, 'a'))) + len(list_filter(x[2:-2], lambda y: y = '')) n from p) select file_id, n from c where n > 0"),
    "cosine_topk": (cosine_topk, _NEAR + "20"),
    "vector_norms": (vector_norms, "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) norm, 1.0 unit from embeddings"),
    "rrf_fusion": (rrf_fusion, _FUSE),
    "rerank_only": (rerank_only, _FUSE + " having max(f) = 1"),
    "live_vectors": (live_vectors, "select count(*) n from embeddings where vec_id in (select doc_id from documents)"),
    "ask_context": (ask_context, "select substr(string_agg('【/' || coalesce(source, 'none') || '/' || file_name || '】' || chr(10) || substr(text, 1, 2000), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by doc_id), 1, 24000) context from documents where doc_id in (3, 5, 8, 13) and length(trim(text)) > 0"),
}

QUERIES = {name: pair[0] for name, pair in PAIRS.items()}
ORACLE = {name: pair[1] for name, pair in PAIRS.items() if pair[1]}
