"""Ranked keyword search: BM25 over two fields, boolean matching, filters, sorts and pages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis as A
from .parser import Node, Query, parse

K1, B = 1.2, 0.75
NAME_SORT_CAP = 10_000


@dataclass(frozen=True)
class SearchParams:
    """A search request; every part may be left out."""

    query: str = ""
    fuzzy: bool = False
    dir_ids: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    file_ids: tuple = ()
    path_prefixes: tuple[str, ...] = ()
    date_from: datetime | str | None = None
    date_to: datetime | str | None = None
    sort: str = "score"  # score, date, size, name
    ascending: bool = False
    page: int = 1
    size: int = 20
    name_cap: int | None = NAME_SORT_CAP


@dataclass(frozen=True)
class Corpus:
    """Documents to search: file_id, file_name, file_ext, dir_id, path, content, mtime, file_size."""

    docs: DataFrame
    cjk: bool = False
    fields: tuple[str, ...] = ("content", "file_name")
    stats: dict = field(default_factory=dict)

    def tokens(self, name: str) -> Column:
        return A.tokens_cjk(name) if self.cjk else A.tokens(name)


_BEFORE, _AFTER, _BETWEEN = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])", r"[^\p{L}\p{N}]+"


def _pattern(words: tuple[str, ...], prefix: bool = False) -> str:
    """A regular expression for words in a row in lower-case text; a word is a maximal run of letters and digits."""
    return _BEFORE + _BETWEEN.join(words) + ("" if prefix else _AFTER)


def _found(low: Column, words: tuple[str, ...], prefix: bool = False) -> Column:
    first = reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])
    return first & low.rlike(_pattern(words, prefix))


def _matches(node: Node, corpus: Corpus, fuzzy: bool) -> Column:
    """Whether a document matches a node.

    Over the lower-case text in `__l_<field>`; with Han pairs, and for fuzzy words, over
    the words in `__t_<field>` (and `__j_<field>`, those joined).
    """
    if node.kind == "and":
        return reduce(lambda a, b: a & b, [_matches(c, corpus, fuzzy) for c in node.children])
    if node.kind == "or":
        return reduce(lambda a, b: a | b, [_matches(c, corpus, fuzzy) for c in node.children])
    if node.kind == "not":
        return ~_matches(node.children[0], corpus, fuzzy)
    if node.kind == "maybe":
        return F.lit(True)
    if node.kind == "none":
        return F.lit(False)
    fields = [node.field] if node.field else list(corpus.fields)
    tests = []
    for f in fields:
        t = F.col(f"__t_{f}") if corpus.cjk or (fuzzy and node.kind == "word") else None
        if t is None:
            tests.append(_found(F.col(f"__l_{f}"), node.words, node.kind == "prefix"))
        elif node.kind == "word" and fuzzy:
            tests.append(F.exists(t, lambda x: A.within_one_edit(x, node.words[0])))
        elif node.kind == "word":
            tests.append(F.array_contains(t, node.words[0]))
        elif node.kind == "prefix":
            tests.append(F.exists(t, lambda x: F.startswith(x, F.lit(node.words[0]))))
        else:
            tests.append(A.contains_phrase(F.col(f"__j_{f}"), list(node.words)))
    return reduce(lambda a, b: a | b, tests)


def _possible(node: Node, corpus: Corpus, fuzzy: bool) -> Column:
    """What a match implies for the lower-case text: cheap to test before any text is cut into words."""
    if node.kind in ("and", "or") and node.children:
        parts = [_possible(c, corpus, fuzzy) for c in node.children]
        return reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), parts)
    if node.kind not in ("word", "prefix", "phrase") or (fuzzy and node.kind == "word"):
        return F.lit(node.kind != "none")
    tests = []
    for f in [node.field] if node.field else corpus.fields:
        low = F.lower(F.coalesce(F.col(f), F.lit("")))
        tests.append(reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in node.words]))
    return reduce(lambda a, b: a | b, tests)


def _scoring(query: Query, corpus: Corpus) -> tuple[list[tuple[str, str]], int]:
    """(field, word) pairs that score by BM25, and how many leaves score a constant 1 (prefixes)."""
    pairs, flat = [], 0
    for leaf in query.root.leaves() if query.root else []:
        if leaf.kind in ("word", "phrase"):
            pairs += [(f, w) for f in ([leaf.field] if leaf.field else corpus.fields) for w in leaf.words]
        elif leaf.kind == "prefix":
            flat += 1
    return list(dict.fromkeys(pairs)), flat


def filtered(docs: DataFrame, p: SearchParams) -> DataFrame:
    """The filters of a request; they don't score."""
    if p.dir_ids:
        docs = docs.where(F.col("dir_id").isin(list(p.dir_ids)))
    if p.exts:
        docs = docs.where(F.lower("file_ext").isin([e.lower() for e in p.exts]))
    if p.file_ids:
        docs = docs.where(F.col("file_id").isin(list(p.file_ids)))
    if p.date_from is not None:
        docs = docs.where(F.col("mtime") >= F.lit(p.date_from).cast("timestamp"))
    if p.date_to is not None:
        docs = docs.where(F.col("mtime") <= F.lit(p.date_to).cast("timestamp"))
    if p.path_prefixes:
        docs = docs.where(reduce(lambda a, b: a | b, [F.startswith(F.col("path"), F.lit(x)) for x in p.path_prefixes]))
    return docs


def _leaves(node: Node | None) -> list[Node]:
    return [] if node is None else [node] if not node.children else [x for c in node.children for x in _leaves(c)]


def statistics(corpus: Corpus, pairs: list[tuple[str, str]]) -> dict:
    """N, mean length of each field and document frequency of each pair, in one pass; one row comes back."""
    fields = sorted({f for f, _ in pairs})
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in fields:
        length = F.size(corpus.tokens(f)) if corpus.cjk else F.regexp_count(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(A.WORD))
        aggs.append(F.avg(length).alias(f"avg_{f}"))
    for i, (f, w) in enumerate(pairs):
        has = F.array_contains(corpus.tokens(f), w) if corpus.cjk else _found(F.lower(F.col(f)), (w,))
        aggs.append(F.count_if(has).alias(f"df_{i}"))
    row = corpus.docs.agg(*aggs).first()
    return {"n": row["n"], **{f"avg_{f}": row[f"avg_{f}"] or 1.0 for f in fields}, **{p: row[f"df_{i}"] for i, p in enumerate(pairs)}}


def occurrences(tok: Column, word: str) -> Column:
    return F.size(F.filter(tok, lambda x: x == word)).cast("double")


def bm25(tf: Column, df: int, n: int, length: Column, mean: float) -> Column:
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.lit(float(df)) + 0.5) / (F.lit(float(df)) + 0.5))
    return idf * F.lit(K1 + 1) * tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(float(mean))))


def scored(corpus: Corpus, p: SearchParams) -> DataFrame:
    """All matching documents with `score` (rounded to 6 places), not yet cut to a page.

    An empty query matches everything with score 1.  Word frequencies are counted
    over all documents; filters are applied before any text is tokenised.  A fuzzy
    search takes single-word queries within one edit, with score 1.  Null texts have no
    words; an empty corpus gives no hits.
    """
    query = parse(p.query)
    docs = filtered(corpus.docs, p)
    fuzzy = p.fuzzy and " " not in p.query.strip()
    pairs, flat = ([], 1) if fuzzy else _scoring(query, corpus)
    leaves = _leaves(query.root)
    if query.root is not None:
        docs = docs.where(_possible(query.root, corpus, fuzzy))
    for w in query.names:
        docs = docs.where(F.contains(F.lower("file_name"), F.lit(w)))
    used = sorted({f for x in leaves if x.words for f in ([x.field] if x.field else corpus.fields)} | ({"file_name"} if query.names else set()))
    split = corpus.cjk or fuzzy
    for f in used:
        docs = docs.withColumn(f"__l_{f}", F.lower(F.coalesce(F.col(f), F.lit(""))))
        if split:
            docs = docs.withColumn(f"__t_{f}", corpus.tokens(f))
        if corpus.cjk and any(x.kind == "phrase" for x in leaves):
            docs = docs.withColumn(f"__j_{f}", A.joined(F.col(f"__t_{f}")))
    if query.root is not None:
        docs = docs.where(_matches(query.root, corpus, fuzzy))
    for w in query.names:
        docs = docs.where(F.array_contains("__t_file_name", w) if corpus.cjk else _found(F.col("__l_file_name"), (w,)))
    if query.root is None:
        score = F.lit(1.0)
    else:
        stats = statistics(corpus, pairs) if pairs else {}
        parts = []
        for f, w in pairs:
            if corpus.cjk:
                tf, length = occurrences(F.col(f"__t_{f}"), w), F.size(f"__t_{f}").cast("double")
            else:
                tf, length = (F.regexp_count(f"__l_{f}", F.lit(x)).cast("double") for x in (_pattern((w,)), A.WORD))
            parts.append(bm25(tf, stats[f, w], stats["n"], length, stats[f"avg_{f}"]))
        score = reduce(lambda a, b: a + b, parts, F.lit(float(flat)))
    return docs.withColumn("score", F.round(score, 6)).drop(*[f"__{k}_{f}" for k in "ltj" for f in used])


HIT = ("file_id", "file_name", "file_ext", "dir_id", "path", "mtime", "file_size", "score")


def hits(corpus: Corpus, p: SearchParams) -> DataFrame:
    """One page of hits in order, with `rank` from 1 on; pages count from 1, a size of 0 gives none."""
    found = scored(corpus, p)
    return paged(found.select(*[c for c in HIT if c in found.columns]), p)


def paged(found: DataFrame, p: SearchParams) -> DataFrame:
    """The page of a request among all matches."""
    if p.sort == "name":
        if p.name_cap is not None:
            found = found.orderBy(F.desc("score"), "file_id").limit(p.name_cap)
        keys = [F.asc(F.lower("file_name")) if p.ascending else F.desc(F.lower("file_name")), F.asc("file_id")]
    elif p.sort in ("date", "size"):
        c = F.col("mtime" if p.sort == "date" else "file_size")
        keys = [c.asc_nulls_last() if p.ascending else c.desc_nulls_last(), F.asc("file_id")]
    else:
        keys = [F.desc("score"), F.asc("file_id")]
    first = (max(1, p.page) - 1) * p.size
    page = found.orderBy(*keys).limit(first + p.size)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))  # a page's rows, not the table's
    if p.sort in ("date", "size"):
        fetched = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
        ranked = ranked.withColumn("score", F.round(F.lit(1.0) - (F.col("rank") - 1) / fetched, 6))
    return ranked.where(F.col("rank") > first)


def total(corpus: Corpus, p: SearchParams) -> DataFrame:
    """One row: `total`, the number of matching documents."""
    return scored(corpus, replace(p, sort="score")).agg(F.count(F.lit(1)).alias("total"))


def suggest(corpus: Corpus, prefix: str, limit: int = 10) -> DataFrame:
    """Distinct file names of the first `limit` documents with a content word that begins with `prefix`; none for an empty one."""
    start = (A.query_words(prefix) or [""])[-1]
    found = corpus.docs.where(F.lit(bool(start)) & F.exists(corpus.tokens("content"), lambda x: F.startswith(x, F.lit(start))))
    first = found.orderBy("file_id").limit(limit).select("file_id", "file_name")
    return first.groupBy("file_name").agg(F.min("file_id").alias("first_id"))
