from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docquarry.functions import analysis as A
from docquarry.operators import fusion
from docquarry.operators.index import Index
from docquarry.operators.parser import parse
from docquarry.operators.search import Corpus, SearchParams, hits, scored, suggest, total

DOCS = [
    ("uuid-1", "harvest.pdf", "pdf", "dir-a", "yearly harvest ledger of 2019 with orchard yields and cider", 1700000000, 204800),
    ("uuid-2", "minutes.txt", "txt", "dir-a", "minutes on garden planning and tool sharing by neighbours", 1700000100, 4096),
    ("uuid-3", "loom.rs", "rs", "dir-b", "weaving pattern for the loom shuttle with narrow threading", 1700000200, 8192),
    ("uuid-4", "目录.txt", "txt", "dir-a", "博物馆目录里有旧地图和航海日志的清单", 1700000300, 1024),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(a, b, c, d, f"/home/user/{b}", e, datetime.fromtimestamp(t), n) for a, b, c, d, e, t, n in DOCS]
    return Corpus(spark.createDataFrame(rows, "file_id string, file_name string, file_ext string, dir_id string, path string, content string, mtime timestamp, file_size long"), cjk=True)


def ids(corpus, query="", **more):
    return [r["file_id"] for r in hits(corpus, SearchParams(query, **more)).orderBy("rank").collect()]


def test_terms_and_filters(corpus):
    assert "uuid-1" in ids(corpus, "orchard ledger")
    assert ids(corpus, dir_ids=("dir-b",)) == ["uuid-3"]
    assert ids(corpus, exts=("PDF",)) == ["uuid-1"]
    assert ids(corpus, file_ids=("uuid-2", "none")) == ["uuid-2"]
    assert ids(corpus, path_prefixes=("/home/user/loom",)) == ["uuid-3"]
    assert ids(corpus, "ORCHARD") == ["uuid-1"]
    assert ids(corpus, "nothinglikeit") == []


def test_cjk(corpus):
    assert ids(corpus, "航海")[0] == "uuid-4"


def test_pages(corpus):
    one, two = ids(corpus, sort="date", ascending=True, size=2), ids(corpus, sort="date", ascending=True, size=2, page=2)
    assert (one, two) == (["uuid-1", "uuid-2"], ["uuid-3", "uuid-4"])
    assert total(corpus, SearchParams()).first()["total"] == 4
    assert ids(corpus, size=0) == []
    assert ids(corpus, sort="size") == ["uuid-1", "uuid-3", "uuid-2", "uuid-4"]
    assert ids(corpus, sort="name", ascending=True)[0] == "uuid-1"


def test_boolean(corpus):
    assert ids(corpus, "ledger AND cider") == ["uuid-1"]
    assert ids(corpus, "ledger AND minutes") == []
    assert set(ids(corpus, "ledger OR minutes")) == {"uuid-1", "uuid-2"}
    assert ids(corpus, "garden NOT cider") == ["uuid-2"]
    assert ids(corpus, '"orchard yields"') == ["uuid-1"] and ids(corpus, '"yields orchard"') == []
    assert ids(corpus, "shar*") == ["uuid-2"]
    assert ids(corpus, "orhcard", fuzzy=True) == ["uuid-1"]
    assert ids(corpus, "filename:harvest") == ["uuid-1"] and ids(corpus, 'filename:"minutes" garden') == ["uuid-2"]
    assert ids(corpus, "NOT ledger") == [] and ids(corpus, "-ledger") == []
    assert ids(corpus, "(loom OR yearly) AND +threading") == ["uuid-3"]
    assert ids(corpus, "file_name:loom") == ["uuid-3"] and ids(corpus, "content:rs") == []


def test_and_is_within_or(corpus):
    for a, b in (("ledger", "cider"), ("garden", "shuttle"), ("the", "loom")):
        assert set(ids(corpus, f"{a} AND {b}")) <= set(ids(corpus, f"{a} OR {b}"))


@pytest.mark.parametrize("text", ["", "(", ")", '"', "AND", "a AND", "((a)", "a ) b", "- +", "filename:", "NOT NOT a", '""'])
def test_parser_survives(text):
    parse(text)


def test_suggest(corpus):
    assert [r["file_name"] for r in suggest(corpus, "orch").collect()] == ["harvest.pdf"]
    assert suggest(corpus, "").count() == 0


def test_null_and_empty_texts(spark):
    rows = [("a", None, None, None, None, None, None, None), ("b", "x.txt", "txt", "d", "/x", "", None, 0)]
    c = Corpus(spark.createDataFrame(rows, "file_id string, file_name string, file_ext string, dir_id string, path string, content string, mtime timestamp, file_size long"))
    assert ids(c, "x") == ["b"] and len(ids(c)) == 2
    assert scored(Corpus(c.docs.limit(0)), SearchParams("x")).count() == 0


def test_snippet_and_highlight(spark):
    df = spark.createDataFrame([("a <b> Report about reports & the REPORT",), (None,)], "t string")
    got = [r[0] for r in df.select(A.snippet("t", ["report"])).collect()]
    assert got[0].count("<b>") == 2 and "&lt;b&gt;" in got[0] and "&amp;" in got[0] and got[1] == ""
    assert df.select(A.match_count(F.lit("aaaa"), ["aa"])).first()[0] == 3


def test_persisted_index(spark, corpus, tmp_path):
    index = Index(spark, str(tmp_path))
    index.build(corpus.docs)
    assert [r["file_id"] for r in index.search("orchard ledger").collect()] == ["uuid-1"]
    assert [r["file_id"] for r in index.search('"garden planning" OR loom').orderBy("file_id").collect()] == ["uuid-2", "uuid-3"]
    assert index.search('"planning garden"').count() == 0 and index.search("shar*").count() == 1 and index.search("loom NOT shuttle").count() == 0
    plain = {r["file_id"]: r["score"] for r in hits(Corpus(corpus.docs, fields=("content",)), SearchParams("garden OR shuttle OR the")).collect()}
    stored = {r["file_id"]: r["score"] for r in index.search("garden OR shuttle OR the").collect()}
    assert stored == pytest.approx(plain, abs=1e-5)
    change = corpus.docs.where("file_id = 'uuid-1'").withColumn("content", F.lit("now something else"))
    index.apply(change, corpus.docs.where("file_id = 'uuid-2'"))
    assert index.search("orchard").count() == 0 and index.search("something").count() == 1 and index.search("minutes").count() == 0
    assert index.health().first()["healthy"]
    index.store.restore(1)
    assert index.search("orchard").count() == 1


REQUESTS = [
    dict(query="garden OR loom OR harvest"), dict(query='"orchard yields"'), dict(query="shar*"), dict(query="orhcard", fuzzy=True), dict(query="filename:minutes garden"),
    dict(query="file_name:loom content:pattern"), dict(query="with", exts=("PDF", "rs")), dict(query="with", dir_ids=("dir-a",)), dict(query="", path_prefixes=("/home/user/l",)), dict(query="with", date_from="2023-11-14 22:13:30"),
    dict(query="", sort="date", ascending=True, size=2, page=2), dict(query="with OR on", sort="size", size=3), dict(query="", sort="name", ascending=True, name_cap=3), dict(query="garden NOT cider"), dict(query="+garden loom"), dict(query="航海"),
]


def same(reader, corpus, request):
    p = SearchParams(**request)
    got, want = ([(r["file_id"], r["file_name"], r["score"], r["rank"]) for r in x.orderBy("rank").collect()] for x in (reader.hits(p), hits(corpus, p)))
    assert got == want, request
    if p.size < 20:  # more than the page
        assert reader.total(p).first()["total"] == total(corpus, p).first()["total"]


@pytest.mark.parametrize("request_", REQUESTS, ids=str)
def test_index_answers_as_the_scan(corpus, stored, request_):
    same(stored[0].reader(), corpus, request_)


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    index = Index(spark, str(tmp_path_factory.mktemp("index")), buckets=4, cjk=True)
    index.build(corpus.docs)
    return index, corpus


def test_han_words_longer_than_a_pair(stored):
    index, _ = stored
    assert [r["file_id"] for r in index.search("航海日志").collect()] == ["uuid-4"] and index.search("航海地图").count() == 0


def test_wide_prefixes_are_filtered_and_not_looked_up(stored, corpus, monkeypatch):
    from docquarry.operators import index as module

    monkeypatch.setattr(module, "EXPANDED", 1)
    reader = module.Reader(stored[0], stored[0].store.version())
    for request in (dict(query="w*"), dict(query="ga* OR loom"), dict(query="gardem", fuzzy=True)):
        same(reader, corpus, request)
    assert {r["file_name"] for r in reader.suggest("w").collect()} == {r["file_name"] for r in suggest(corpus, "w").collect()}


def test_index_after_many_changes_equals_a_new_one(spark, corpus, tmp_path, monkeypatch):
    """Segments, replacements, deletions and merges: results and statistics are those of the documents that are left."""
    from docquarry.operators import index as module

    monkeypatch.setattr(module, "MAX_SEGMENTS", 3)
    index, docs = Index(spark, str(tmp_path), buckets=4, cjk=True), corpus.docs
    index.build(docs)
    written = set()
    for i in range(4):
        change = docs.where(f"file_id = 'uuid-{1 + i % 3}'").withColumn("content", F.concat(F.lit(f"turn{i} garden "), "content"))
        fresh = change.withColumn("file_id", F.lit(f"new-{i}")).withColumn("file_name", F.lit(f"new{i}.txt"))
        away = docs.where("file_id = 'new-1'") if i == 3 else None
        index.apply(change.unionByName(fresh), None if away is None else away.select("file_id"))
        ids_ = [r[0] for r in change.unionByName(fresh).select("file_id").collect()] + (["new-1"] if i == 3 else [])
        docs = spark.createDataFrame(docs.where(~F.col("file_id").isin(ids_)).unionByName(change).unionByName(fresh).collect(), docs.schema)
        written.add(len(index.reader().segments))
    after = Corpus(docs, cjk=True)
    assert max(written) <= 3 and index.health().first()["healthy"] and index.health().first()["docs"] == docs.count()
    for request in (dict(query="garden"), dict(query="turn1"), dict(query="turn3 OR orchard"), dict(query="turn*")):
        same(index.reader(), after, request)
    one = Index(spark, str(tmp_path / "one"), buckets=4, cjk=True)
    one.build(docs)
    assert one.reader().stats == index.reader().stats
    index.merge(everything=True)
    same(index.reader(), after, dict(query="garden turn2"))
    counts = [sorted(map(tuple, x.reader().terms.groupBy("term", "field").agg(F.sum("df"), F.sum("cf")).where("`sum(df)` <> 0").collect())) for x in (index, one)]
    assert counts[0] == counts[1]


def test_one_added_document_does_not_rewrite_the_others(spark, corpus, tmp_path):
    index = Index(spark, str(tmp_path), buckets=4)
    index.build(corpus.docs)
    first = index.store.manifest(index.store.version())
    index.apply(corpus.docs.limit(1).withColumn("file_id", F.lit("x")))
    assert first.items() <= index.store.manifest(index.store.version()).items()


def test_index_snippets(stored):
    got = {r["file_id"]: r["snippet"] for r in stored[0].reader().snippets(SearchParams("orchard")).collect()}
    assert list(got) == ["uuid-1"] and "<b>orchard</b>" in got["uuid-1"]


def test_fusion(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 2.0)], "k string, s double")
    b = spark.createDataFrame([("y", 9.0), ("w", 8.0)], "k string, s double")
    union = {r["k"]: r["rrf"] for r in fusion.fused([(a, "s"), (b, "s")], "k").collect()}
    assert union == pytest.approx({"x": 1 / 60, "y": 1 / 61 + 1 / 60, "z": 1 / 62, "w": 1 / 61}, abs=1e-8)
    assert {r["k"] for r in fusion.fused([(a, "s"), (b, "s")], "k", "rerank").collect()} == {"x", "y", "z"}


def test_ask_context(spark, corpus):
    text = fusion.context(corpus.docs, ["uuid-2", "uuid-1"], per_doc=10).first()["context"]
    assert text == "【/home/user/harvest.pdf】\nyearly har\n\n---\n\n【/home/user/minutes.txt】\nminutes on"


def test_index_of_nothing(spark, corpus, tmp_path):
    index = Index(spark, str(tmp_path))
    index.build(corpus.docs.limit(0))
    assert index.search("loom").count() == 0 and index.search("").count() == 0 and index.health().first()["healthy"]
