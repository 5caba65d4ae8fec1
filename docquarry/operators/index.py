"""The inverted index: postings and statistics as tables, and searching in them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..sources.store import Store
from .parser import Node, parse
from .search import HIT, SearchParams, bm25, filtered, paged

BUCKETS = 64
#: Buckets of the stored texts by document, segments from which on small ones are merged, and words of a prefix or fuzzy term up to which they are looked up one by one.
TEXT_BUCKETS, MAX_SEGMENTS, EXPANDED = 16, 8, 512
#: Documents up to which those that are replaced are looked up by name; more are joined.
NAMED = 1000
FIELDS = ("content", "file_name")
META = ("file_id", "file_name", "file_ext", "dir_id", "path", "mtime", "file_size")


def bucket(term, buckets: int = BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, text: str = "content", cjk: bool = False) -> DataFrame:
    """`term`, `file_id`, `tf`, `positions` (from 0), `dl` of every word of every document.

    Words are grouped within their document, so no shuffle takes place.  Documents
    without words have no postings.
    """
    tok = (A.tokens_cjk if cjk else A.tokens)(text)
    kind = docs.schema["file_id"].dataType.simpleString()
    schema = f"term string, file_id {kind}, positions array<int>, dl int, tf int"
    return docs.select("file_id", tok.alias("t")).mapInArrow(_grouped, schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each document of a batch grouped by one sort of (document, word, place)."""
    for b in batches:
        lists = b.column(1)
        offs = np.asarray(lists.offsets).astype(np.int64)
        offs, flat = offs - offs[0], lists.flatten()
        if not len(flat):
            continue
        lengths = np.diff(offs)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        coded = flat.dictionary_encode()
        word = np.asarray(coded.indices).astype(np.int64)
        order = np.argsort(doc * len(coded.dictionary) + word, kind="stable")
        doc, word, place = doc[order], word[order], (np.arange(len(flat)) - offs[doc])[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]))
        ends = np.append(first, len(flat))
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
        columns = [coded.dictionary.take(pa.array(word[first])), b.column(0).take(pa.array(doc[first])), places, pa.array(lengths[doc[first]], pa.int32()), pa.array(np.diff(ends), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "file_id", "positions", "dl", "tf"])


def term_stats(post: DataFrame) -> DataFrame:
    """`term`, `df`, `cf`: in how many documents a word is, and how often in all."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row: `n_docs`, `avg_dl`, `n_tokens`."""
    dl = docs.select(F.size(A.tokens(text)).alias("dl"))
    return dl.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"), F.sum("dl").cast("bigint").alias("n_tokens"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def han_pairs(word: str) -> tuple[str, ...] | None:
    """The overlapping pairs of a word of three or more Han characters, as `tokens_cjk` cuts it; None for any other."""
    import regex

    return tuple(word[i : i + 2] for i in range(len(word) - 1)) if regex.fullmatch(r"\p{Han}{3,}", word) else None


class Index:
    """A persisted index of immutable segments; every commit publishes a version and readers keep theirs.

    A segment has `docs` (without text), `texts` (by document bucket), `postings` (by term
    bucket, sorted by term), `terms` (document and word counts), `corpus` (sums) and
    `deletes`.  A change writes one segment of the changed documents only: the documents
    it replaces are marked, and their counts are taken off as negative rows, so statistics
    stay exact.  Small segments are merged when there are many.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, cjk: bool = False):
        self.spark, self.store, self.buckets, self.cjk = spark, Store(spark, root), buckets, cjk
        self._reader: Reader | None = None

    def _postings(self, docs: DataFrame) -> DataFrame:
        return _union([postings(docs, f, self.cjk).withColumn("field", F.lit(f)) for f in FIELDS])

    def _write(self, version: int, docs: DataFrame, dead: DataFrame | None = None, gone: DataFrame | None = None, counted: bool = True) -> None:
        """One segment: documents (META and content), and the documents and names that it takes away; `counted` says whether with its sums."""
        at = self.store.path
        seg = F.lit(version).alias("seg")
        post = self._postings(docs).withColumn("bucket", bucket("term", self.buckets)).withColumn("seg", F.lit(version))
        post.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "file_id").write.partitionBy("bucket").parquet(at(version, f"postings#{version}"))
        docs.select(*META, seg).hint("rebalance").sortWithinPartitions("file_id").write.parquet(at(version, f"docs#{version}"))
        texts = docs.select("file_id", "content", seg, bucket(F.col("file_id").cast("string"), TEXT_BUCKETS).alias("fb"))
        texts.hint("rebalance", "fb").sortWithinPartitions("fb", "file_id").write.partitionBy("fb").parquet(at(version, f"texts#{version}"))
        if not counted:
            return
        kind = docs.schema["file_id"].dataType.simpleString()
        counts = self._read_postings([f"v={version}/postings#{version}"], kind).groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        sums = self._sums(docs)
        if dead is not None:
            away = self._postings(dead).groupBy("term", "field").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("cf"))
            counts = counts.unionByName(away).groupBy("term", "field").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
            sums = sums.unionByName(self._sums(dead, -1)).agg(*(F.sum(c).alias(c) for c in sums.columns))
        counts.hint("rebalance").sortWithinPartitions("term").write.parquet(at(version, f"terms#{version}"))
        sums.withColumn("cjk", F.lit(self.cjk)).write.parquet(at(version, f"corpus#{version}"))
        if gone is not None:
            gone.select("file_id", F.lit(version).alias("gone_at")).write.parquet(at(version, f"deletes#{version}"))

    def _sums(self, docs: DataFrame, sign: int = 1) -> DataFrame:
        tok = A.tokens_cjk if self.cjk else A.tokens
        return docs.agg((F.lit(sign) * F.count(F.lit(1))).alias("n_docs"), *((F.lit(sign) * F.coalesce(F.sum(F.size(tok(f))), F.lit(0))).cast("bigint").alias(f"n_{f}") for f in FIELDS))

    def _read_postings(self, dirs: list[str], kind: str) -> DataFrame:
        """Postings by their known schema, as a segment without words has no file to tell it."""
        schema = f"term string, file_id {kind}, positions array<int>, dl int, tf int, field string, seg int, bucket int"
        return _union([self.spark.read.schema(schema).parquet(f"{self.store.root}/{d}") for d in dirs])

    def build(self, docs: DataFrame) -> int:
        """A new version of these documents only."""
        version = self.store.begin()
        self._write(version, docs.select(*META, "content"))
        self.store.commit(version)
        return version

    def apply(self, changed: DataFrame, deleted: DataFrame | None = None) -> int:
        """A new version with documents added, replaced by `file_id`, or deleted.

        Only the changed documents and those they replace are read and written.
        """
        reader = self.reader()
        gone = (changed.select("file_id") if deleted is None else changed.select("file_id").unionByName(deleted.select("file_id"))).distinct()
        dead = reader.documents(gone)
        version = self.store.begin()
        self._write(version, changed.select(*META, "content"), dead, gone)
        self.store.commit(version, self.store.manifest(reader.version))
        if len(self.reader().segments) > MAX_SEGMENTS:
            return self.merge()
        return version

    def merge(self, everything: bool = False) -> int:
        """Rewrite the live documents of the small segments (all but one that holds half of the documents) as one."""
        reader = self.reader()
        sizes = {r["seg"]: r["n"] for r in reader.docs.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per segment
        largest = max(reader.segments, key=lambda s: sizes.get(s, 0))
        small = [s for s in reader.segments if everything or s != largest or 2 * sizes.get(s, 0) < sum(sizes.values())]
        if len(small) < 2:
            return reader.version
        version = self.store.begin()
        docs = reader.live().where(F.col("seg").isin(small)).drop("gone_at").join(reader.texts.drop("fb"), ["file_id", "seg"]).drop("seg")
        self._write(version, docs, counted=False)
        # counts of what was taken away may belong to any segment, so sums are carried and not counted anew
        for name, keys in (("terms", ["term", "field"]), ("corpus", ["cjk"])):
            old = _union([self.spark.read.parquet(f"{self.store.root}/{reader.names[f'{name}#{s}']}") for s in small])
            values = [c for c in old.columns if c not in keys]
            total = old.groupBy(*keys).agg(*(F.sum(c).cast("bigint").alias(c) for c in values))
            total = total.where("df <> 0 or cf <> 0") if name == "terms" else total
            total.hint("rebalance").write.parquet(self.store.path(version, f"{name}#{version}"))
        if reader.deletes is not None and not set(small) == set(reader.segments):
            reader.deletes.groupBy("file_id").agg(F.max("gone_at").alias("gone_at")).write.parquet(self.store.path(version, f"deletes#{version}"))
        self.store.commit(version, {n: d for n, d in reader.names.items() if int(n.partition("#")[2]) not in small and not n.startswith("deletes#")})
        return version

    def reader(self) -> "Reader":
        """A reader of the published version; one version is opened once."""
        version = self.store.version()
        if version is None:
            raise FileNotFoundError(f"nothing is published under {self.store.root}")
        if self._reader is None or self._reader.version != version:
            self._reader = Reader(self, version)
        return self._reader

    def health(self) -> DataFrame:
        """One row: version, files, documents, terms, and whether the tables fit together."""
        r = self.reader()
        n_docs, terms = r.live().count(), r.terms.groupBy("term", "field").agg(F.sum("df").alias("df")).where("df > 0").select("term").distinct().count()
        orphans = r.postings.select("file_id", "seg").distinct().join(r.docs.select("file_id", "seg"), ["file_id", "seg"], "left_anti").limit(1).count()
        wrong = r.terms.groupBy("term", "field").agg(F.sum("df").alias("df")).where("df < 0").limit(1).count()
        row = (r.version, len(r.postings.inputFiles()), n_docs, terms, n_docs == r.stats["n_docs"] and not orphans and not wrong)
        return self.spark.createDataFrame([row], "version int, files int, docs long, terms long, healthy boolean")

    def search(self, query: str, k: int = 20) -> DataFrame:
        """`file_id`, `score` of the best `k` documents by BM25 over the content."""
        return self.reader().hits(SearchParams(query, size=k), ("content",)).select("file_id", "score")


class Reader:
    """One published version of an index, opened for searching."""

    def __init__(self, index: Index, version: int):
        self.index, self.version, spark, root = index, version, index.spark, index.store.root
        self.names = index.store.manifest(version)
        self._expanded: dict[tuple[str, bool], list[str] | None] = {}
        self.segments = sorted(int(n.partition("#")[2]) for n in self.names if n.startswith("docs#"))

        def table(name: str, kind: str | None = None) -> DataFrame | None:
            dirs = [f"{root}/{self.names[n]}" for n in sorted(self.names) if n.startswith(f"{name}#")]
            if not dirs:
                return None
            return spark.read.parquet(*dirs) if kind is None else _union([spark.read.schema(kind).parquet(d) for d in dirs])

        self.docs, self.terms, self.deletes = table("docs"), table("terms"), table("deletes")
        self.kind = self.docs.schema["file_id"].dataType.simpleString()
        self.postings = index._read_postings([d for n, d in sorted(self.names.items()) if n.startswith("postings#")], self.kind)
        self.texts = table("texts", f"file_id {self.kind}, content string, seg int, fb int")
        sums = table("corpus").agg(F.sum("n_docs").alias("n_docs"), *(F.sum(f"n_{f}").alias(f) for f in FIELDS), F.bool_or("cjk").alias("cjk")).first()
        self.stats = {"n_docs": sums["n_docs"], "cjk": sums["cjk"], **{f: (sums[f] / sums["n_docs"] if sums["n_docs"] else 0) or 1.0 for f in FIELDS}}

    def live(self) -> DataFrame:
        """The documents that no later segment replaces or deletes."""
        if self.deletes is None:
            return self.docs
        last = self.deletes.groupBy("file_id").agg(F.max("gone_at").alias("gone_at"))
        return self.docs.join(last, "file_id", "left").where("gone_at is null or seg >= gone_at").drop("gone_at")

    def documents(self, ids: DataFrame) -> DataFrame:
        """The live documents with these `file_id`s and their texts; few are looked up in their buckets only."""
        some = [r[0] for r in ids.limit(NAMED + 1).collect()]
        texts, docs = self.texts, self.live()
        if len(some) <= NAMED:
            at = self._buckets([str(x) for x in some], TEXT_BUCKETS)
            texts, docs = texts.where(F.col("fb").isin(at) & F.col("file_id").isin(some)), docs.where(F.col("file_id").isin(some))
        else:
            docs = docs.join(ids, "file_id", "left_semi")
        return docs.join(texts.drop("fb"), ["file_id", "seg"]).select(*META, "content")

    def _buckets(self, words: list[str], buckets: int) -> list[int]:
        if not words:
            return []
        known = self.index.spark.range(1).select(F.array(*[bucket(F.lit(w), buckets) for w in words])).first()[0]
        return sorted(set(known))

    def _expand(self, node: Node, fuzzy: bool) -> list[str] | None:
        """The words of the index that a prefix or fuzzy word stands for; None if they are more than EXPANDED."""
        if (node.words[0], fuzzy) in self._expanded:
            return self._expanded[node.words[0], fuzzy]
        test = A.within_one_edit(F.col("term"), node.words[0]) if fuzzy else F.startswith(F.col("term"), F.lit(node.words[0]))
        found = [r[0] for r in self.terms.where(test).select("term").distinct().limit(EXPANDED + 1).collect()]
        self._expanded[node.words[0], fuzzy] = found if len(found) <= EXPANDED else None
        return self._expanded[node.words[0], fuzzy]

    def scored(self, p: SearchParams, fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """All matching documents with `score`: from the postings of the query's words and the documents table, without any text.

        Only the buckets of the words are read, and places only for phrases.  Results are
        those of `search.scored` over the live documents.
        """
        query = parse(p.query)
        docs = filtered(self.live(), p)
        fuzzy = p.fuzzy and " " not in p.query.strip()
        if query.root is None and not query.names:
            return docs.withColumn("score", F.lit(1.0))
        words: list[tuple[str, str]] = []
        any_of: list[tuple[str, tuple[str, ...], list[str] | None, bool]] = []  # column, fields, words, fuzzy

        def in_fields(n: Node) -> tuple[str, ...]:
            return (n.field,) if n.field else fields

        def at(f: str, w: str) -> int:
            if (f, w) not in words:
                words.append((f, w))
            return words.index((f, w))

        aggs: list = []
        seen: dict[str, Column] = {}

        def has(n: Node) -> Column:
            if n.kind in ("and", "or"):
                return reduce((lambda a, b: a & b) if n.kind == "and" else (lambda a, b: a | b), map(has, n.children))
            if n.kind == "not":
                return ~has(n.children[0])
            if n.kind in ("maybe", "none"):
                return F.lit(n.kind == "maybe")
            tests = []
            pairs = han_pairs(n.words[0]) if self.stats["cjk"] and n.kind == "word" and not fuzzy else None
            for f in in_fields(n):
                if n.kind == "prefix" or (fuzzy and n.kind == "word"):
                    name = f"s{len(any_of)}"
                    any_of.append((name, (f,), self._expand(n, n.kind == "word"), n.kind == "word"))
                    exact = A.within_one_edit(F.col("term"), n.words[0]) if n.kind == "word" else F.startswith(F.col("term"), F.lit(n.words[0]))
                    aggs.append(F.max((F.col("field") == f) & exact).alias(name))
                    tests.append(F.coalesce(F.col(name), F.lit(False)))
                elif n.kind == "word" and not pairs:
                    tests.append(F.col(f"tf{at(f, n.words[0])}").isNotNull())
                else:
                    parts = pairs or n.words
                    columns = [at(f, w) for w in parts]
                    for i in columns:
                        seen[f"p{i}"] = F.max_by("positions", F.when((F.col("term") == words[i][1]) & (F.col("field") == words[i][0]), 1)).alias(f"p{i}")
                    here = F.col(f"p{columns[0]}")
                    for i in columns[1:]:
                        here = F.array_intersect(F.transform(here, lambda x: x + 1), F.col(f"p{i}"))
                    whole = reduce(lambda a, b: a & b, [F.col(f"tf{i}").isNotNull() for i in columns]) & (F.size(here) > 0)
                    tests.append(whole | F.col(f"tf{at(f, n.words[0])}").isNotNull() if pairs else whole)
            return reduce(lambda a, b: a | b, tests)

        match = has(query.root) if query.root is not None else F.lit(True)
        for w in query.names:
            match = match & F.col(f"tf{at('file_name', w)}").isNotNull()
        leaves = query.root.leaves() if query.root is not None else []
        scoring = list(dict.fromkeys((f, w) for x in leaves if x.kind in ("word", "phrase") and not fuzzy for f in in_fields(x) for w in x.words))
        for f, w in scoring:
            at(f, w)
        for i, (f, w) in enumerate(words):
            aggs.append(F.max(F.when((F.col("term") == w) & (F.col("field") == f), F.col("tf"))).alias(f"tf{i}"))
        aggs += [F.max(F.when(F.col("field") == f, F.col("dl"))).alias(f"dl_{f}") for f in fields] + list(seen.values())
        named = sorted({w for _, w in words} | {w for _, _, found, _ in any_of for w in found or ()})
        if all(found is not None for _, _, found, _ in any_of):
            where = F.col("term").isin(named) & F.col("bucket").isin(self._buckets(named, self.index.buckets))
        else:  # a prefix of very many words: their postings are filtered and not looked up
            wide = [A.within_one_edit(F.col("term"), n.words[0]) if fuzzy else F.startswith(F.col("term"), F.lit(n.words[0])) for n in _leaves(query.root) if n.kind == "prefix" or fuzzy]
            where = reduce(lambda a, b: a | b, wide, F.col("term").isin(named))
        by_doc = self.postings.where(where).groupBy("file_id", "seg").agg(*aggs).where(match)
        df = {(r["field"], r["term"]): r["df"] for r in self.terms.where(F.col("term").isin([w for _, w in scoring])).groupBy("term", "field").agg(F.sum("df").alias("df")).collect()} if scoring else {}
        parts = [F.coalesce(bm25(F.col(f"tf{words.index((f, w))}").cast("double"), df.get((f, w), 0), self.stats["n_docs"], F.col(f"dl_{f}").cast("double"), self.stats[f]), F.lit(0.0)) for f, w in scoring]
        flat = 1.0 if fuzzy or query.root is None else float(sum(x.kind == "prefix" for x in leaves))
        score = reduce(lambda a, b: a + b, parts, F.lit(flat))
        return by_doc.select("file_id", "seg", F.round(score, 6).alias("score")).join(docs, ["file_id", "seg"])

    def hits(self, p: SearchParams, fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """One page of hits, as `search.hits`."""
        return paged(self.scored(p, fields).select(*HIT), p)

    def total(self, p: SearchParams, fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """One row: `total`, the number of matching documents."""
        return self.scored(p, fields).agg(F.count(F.lit(1)).alias("total"))

    def snippets(self, p: SearchParams, width: int = 150, fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """A page of hits with a `snippet` of each; only the texts of the page are read."""
        page = self.hits(p, fields)
        rows = page.collect()  # at most `size` of the request
        local = self.index.spark.createDataFrame(rows, page.schema)
        terms = [w for x in _leaves(parse(p.query).root) for w in x.words]
        at = self._buckets([str(r["file_id"]) for r in rows], TEXT_BUCKETS)
        texts = self.texts.where(F.col("fb").isin(at) & F.col("file_id").isin([r["file_id"] for r in rows])).join(self.live().select("file_id", "seg"), ["file_id", "seg"])
        return local.join(texts.select("file_id", A.snippet("content", terms, width).alias("snippet")), "file_id", "left")

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        """As `search.suggest`: distinct names of the first `limit` documents with a content word that begins with `prefix`."""
        start = (A.query_words(prefix) or [""])[-1]
        named = self._expand(Node("prefix", (start,)), False) if start else []
        where = F.startswith(F.col("term"), F.lit(start)) if named is None else F.col("term").isin(named) & F.col("bucket").isin(self._buckets(named, self.index.buckets))
        found = self.postings.where(where & (F.col("field") == "content")).select("file_id", "seg").distinct()
        first = found.join(self.live(), ["file_id", "seg"]).orderBy("file_id").limit(limit)
        return first.groupBy("file_name").agg(F.min("file_id").alias("first_id"))


def _leaves(node: Node | None) -> list[Node]:
    return [] if node is None else [node] if not node.children else [x for c in node.children for x in _leaves(c)]
