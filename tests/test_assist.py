import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import config, schema
from docquarry.functions import media, udtf
from docquarry.functions import scalars as S
from docquarry.operators import assist, fusion
from docquarry.sources.store import Store

DOCS = [("1", "/a", "garden plan and garden tools"), ("2", "/b", "budget draft"), ("3", "/c", " "), ("4", "/d", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "file_id string, path string, content string")


def test_embeddings(spark, docs):
    embed = assist.hashing_embedder()
    made = assist.embedded(docs, embed)
    assert made.count() == 2 and assist.embedded(docs, None).count() == 0
    assert fusion.nearest(made, "file_id", "embedding", embed(["garden tools"])[0], 1).first()["file_id"] == "1"
    assert fusion.live_only(made, "file_id", docs.where("file_id = '2'")).count() == 1


def test_summaries(spark, docs):
    cache = spark.createDataFrame([("1", "kept"), ("9", "of a deleted file")], "file_id string, summary string")
    got = {r["file_id"]: r["summary"] for r in assist.summarised(docs, cache, lambda how, text: text[:6]).collect()}
    assert got == {"1": "kept", "2": "budget"} and assist.summarised(docs, cache, None).count() == 1
    assert assist.ask(docs, ["1", "2"], "what?", lambda how, text: text) == "【/a】\ngarden plan and garden tools\n\n---\n\n【/b】\nbudget draft"
    assert assist.ask(docs, ["3"], "what?", lambda how, text: text) is None


def test_udtf(spark):
    udtf.register(spark)
    rows = spark.sql("select term, kind from query_terms('budget AND \"photo album\" NOT draft ins*')").collect()
    assert sorted(map(tuple, rows)) == [("album", "phrase"), ("budget", "word"), ("ins", "prefix"), ("photo", "phrase")]


def test_schema(spark):
    assert schema.empty(spark, "settings").columns == ["key", "value"] and "md5" in schema.struct("content_index").names
    old = spark.createDataFrame([("1", "a/B.TXT"), ("2", "none")], "id string, path string")
    once = schema.migrated(old)
    assert [r["file_ext"] for r in once.orderBy("id").collect()] == ["txt", ""] and schema.migrated(once).collect() == once.collect()


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path) == config.Config()
    config.save(config.Config(data_dir="/data/x", language="de"), path, ["/docs"])
    assert config.load(path).language == "de"
    with pytest.raises(ValueError):
        config.save(config.Config(data_dir="/docs/x"), path, ["/docs"])


def test_media(spark):
    got = [r[0] for r in spark.createDataFrame([(60.0,), (0.0,), (None,)], "s double").select(media.audio_chunks("s")).collect()]
    assert [(c["start"], c["stop"]) for c in got[0]] == [(0, 28), (28, 56), (56, 60)] and got[1] == [] and got[2] == []
    page = np.full((40, 40), 220.0)
    page[10:20, 10:20] = 10
    page[30, 30] = 0
    out = media.cleaned_page(page)
    assert out.shape == (80, 80) and (out[22:38, 22:38] == 0).any() and set(np.unique(out)) <= {0, 255}


def test_gates(spark):
    good, line = "Some text that is long enough to count. " * 5, "the same line over and over again, again\n"
    df = spark.createDataFrame([("short", line * 5, good), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(S.first_good(F.col("a"), F.col("b"), F.col("c"))).collect()] == [good, None]
    e = spark.createDataFrame([("file Encrypted",), ("corrupted",), (None,)], "m string").select(S.extract_error("m"), S.engine("m")).collect()
    assert [r[0] for r in e] == ["encrypted", "damaged", "failed"]


def test_copy_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    store.publish(t=spark.range(3), u=spark.range(2))
    there = store.copy_to(str(tmp_path / "b"))
    assert there.version() == 1 and there.current("t").count() == 3 and there.current("u").count() == 2
