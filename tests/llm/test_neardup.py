import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import neardup
from docquarry.llm.text import shingle_codes, word_codes, words

RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def corpus():
    rows = []
    for i in range(40):
        base = [RNG.choice(VOCAB) for _ in range(RNG.randint(25, 90))]
        rows.append((f"{i}-0", " ".join(base)))
        for k in range(RNG.choice([0, 1, 2, 3])):
            edit = list(base)
            for _ in range(k):
                edit[RNG.randrange(len(edit))] = "CHANGED"
            rows.append((f"{i}-{k + 1}", ("  ".join(edit)).upper() if k else ", ".join(edit)))
    return rows + [("short", "a b c"), ("null", None), ("empty", ""), ("0-0", rows[0][1])]


def grams(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 20 else frozenset()


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, t string")
    links, members = neardup.similar_pairs(df, "id", "t", n=3, threshold=0.6, min_words=20)
    cls = {r["id"]: r["same"] for r in members.collect()}
    sets = {k: grams(t) for k, t in rows if grams(t)}
    assert set(cls) == set(sets)
    got = {frozenset((r["a"], r["b"])) for r in links.collect()}
    want = {frozenset((cls[a], cls[b])) for a in sets for b in sets if cls[a] != cls[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got <= want and len(got) >= 0.97 * len(want) and want
    for a in sets:
        for b in sets:
            assert (cls[a] == cls[b]) == (sets[a] == sets[b])
    groups = {r["id"]: r["group_id"] for r in neardup.classes(links, members, "id").collect()}
    for pair in got:
        a, b = tuple(pair)
        assert groups[next(k for k in cls if cls[k] == a)] == groups[next(k for k in cls if cls[k] == b)]
    assert len(set(groups.values())) >= 38


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, t string")
    links, members = neardup.similar_pairs(df, "id", "t")
    assert links.count() == 0 and members.count() == 0
    assert neardup.classes(links, members, "id").count() == 0


def test_many_copies_leave_a_task_once(spark):
    df = spark.range(2000).selectExpr("cast(id as string) id", "'one two three four five six seven eight' t").coalesce(2)
    assert neardup.bucketed(df, "t", 5, 5, neardup.Banding()).count() == 2 * 90
    links, members = neardup.similar_pairs(df, "id", "t")
    assert links.count() == 0 and members.count() == 2000 and members.select("same").distinct().count() == 1


def test_long_chain_is_one_group(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    members = spark.createDataFrame([(str(i), i) for i in range(61)] + [("x", 99)], "id string, same long")
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in neardup.classes(links, members, "id").collect()}
    assert got.pop("x") == (99, 0) and {g for g, _ in got.values()} == {0} and got["0"][1] == 1 and got["7"][1] == 2


def test_tensoring_needs_few_hashes():
    b = neardup.Banding(collections=9, rows=3, groups=1)
    flat, offs = words(pa.array(["a b c d e f g"]))
    g, o = shingle_codes(word_codes(flat), offs, 3)
    sig = neardup.signatures(g, o, b)
    assert sig.shape == (1, 54) and neardup.table_keys(sig, b).shape == (1, 81)


@pytest.mark.parametrize("s", [0.75, 0.9])
def test_minhash_agreement_estimates_similarity(s):
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    own = int(len(shared) * (1 - s) / s / 2)
    a, c = (np.concatenate([shared, rng.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2))
    b = neardup.Banding(collections=60, rows=4, groups=1)
    sig = neardup.signatures(np.concatenate([a, c]), np.array([0, len(a), len(a) + len(c)]), b)
    assert abs((sig[0] == sig[1]).mean() - s) < 0.07


def test_words_are_letters_and_digits():
    flat, offs = words(pa.array(["Éa_b-2c\nÄ’x", None, "", "中文，字"]))
    assert flat.to_pylist() == ["éa", "b", "2c", "ä", "x", "中文", "字"] and offs.tolist() == [0, 5, 5, 5, 7]
    assert words(pa.array(["éa­b"]), fold=True)[0].to_pylist()[0].startswith("ea")


def test_large_buckets_are_paired_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(7, i) for i in range(50)] + [(8, i) for i in range(20)], "bucket long, a long")
    monkeypatch.setattr(neardup, "BLOCK", 6)
    got = sorted(map(tuple, neardup.block_pairs(rows.where("bucket = 7")).collect()))
    assert got == [(i, j) for i in range(50) for j in range(i + 1, 50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(s), pa.array([0] * len(k))], names=["bucket", "same", "salt"]) for k, s in (([1, 1, 2], [5, 9, 1]), ([2, 2, 2, 2], [1, 2, 3, 4]), ([2] * 6, [5, 6, 7, 8, 9, 9]), ([3, 4, 4], [1, 2, 3]))]
    out = pa.Table.from_batches(neardup._meet(iter(batches))).to_pylist()
    assert sorted((r["a"], r["b"]) for r in out if r["b"] is not None) == [(2, 3), (5, 9)]
    assert sorted(r["a"] for r in out if r["b"] is None) == list(range(1, 10)) and {r["bucket"] for r in out if r["b"] is None} == {2}


def test_same_links_with_small_blocks(spark):
    base = [RNG.choice(VOCAB) for _ in range(40)]
    rows = [(str(i), " ".join(base[:30] + [f"x{i}"] + base[30:])) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, t string")
    links, _ = neardup.similar_pairs(df, "id", "t", n=3, threshold=0.6, min_words=20)
    assert links.count() == 30 * 29 // 2


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_default_banding_reaches_the_threshold(threshold):
    b = neardup.banding_for(threshold)
    assert b.chance(threshold) >= 0.999
    assert neardup.Banding(9, 3, 1).chance(0.6) < 0.8 and neardup.Banding().chance(0.6) >= 0.999


def test_pairs_at_the_threshold_are_kept(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        base = [f"b{i}x{k}" for k in range(40)]
        edit = list(base)
        for at in rng.sample([1, 5, 10, 15, 20, 25, 30, 35], 3):
            edit[at] = "new"
        rows += [(f"{i}-0", " ".join(base)), (f"{i}-1", " ".join(edit))]
    sets = {k: grams(t) for k, t in rows}
    want = sum(len(sets[f"{i}-0"] & sets[f"{i}-1"]) / len(sets[f"{i}-0"] | sets[f"{i}-1"]) >= 0.6 for i in range(120))
    links, _ = neardup.similar_pairs(spark.createDataFrame(rows, "id string, t string"), "id", "t", n=3, threshold=0.6, min_words=20)
    assert want > 100 and links.count() == want


def test_bitmap_is_a_lower_bound():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for own in (0, 1, 40, 900):
        a, c = (np.concatenate([shared, rng.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2))
        p = neardup._parity(np.concatenate([a, c]), np.array([0, len(a), len(a) + len(c)]))
        bits = sum(int(x).bit_count() for x in (p[0] ^ p[1]).view(np.uint64))
        assert bits <= 2 * own and (bits > 0) == (own > 0)


@pytest.mark.parametrize("similarity", [0.6, 0.65, 0.7, 0.8])
def test_recall_by_similarity(similarity):
    """Pairs of sets of a known similarity meet in some table; measured, not by the formula."""
    rng, n = np.random.default_rng(int(similarity * 100)), 400
    b, sets = neardup.banding_for(0.6), []
    for _ in range(n):
        both = rng.integers(0, 2**63, 120, dtype=np.uint64)
        own = round(120 * (1 - similarity) / similarity / 2)
        sets += [np.concatenate([both, rng.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2)]
    keys = neardup.table_keys(neardup.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), b), b)
    assert keys.shape == (2 * n, b.tables) and b.hashes < b.tables * 2 * b.rows / 2
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.99


def test_hot_and_streamed_buckets_give_the_same_links(spark, monkeypatch):
    """A bucket that a third of all rows share is salted or streamed past one task, and no link is lost."""
    base = [f"w{i}" for i in range(60)]
    rows = [(f"h{i}", " ".join(base[:40] + [f"x{i}"] + base[40:])) for i in range(60)] + [(f"o{i}", " ".join(f"o{i}y{k}" for k in range(30))) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, t string").repartition(4)

    def links():
        return {(r["a"], r["b"]) for r in neardup.similar_pairs(df, "id", "t", n=3, threshold=0.6, min_words=20)[0].collect()}

    want = links()
    assert len(want) == 60 * 59 // 2
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert links() == want
    monkeypatch.setattr(neardup, "HOT", 1 / 512)
    assert neardup.hot_buckets(df, "id", "t", 3, 20, neardup.banding_for(0.6)) and links() == want


def test_hub_of_a_component_is_salted(spark, monkeypatch):
    from docquarry.operators import skew

    monkeypatch.setattr(skew.hot_keys, "__defaults__", (20,))
    monkeypatch.setattr(skew.salted_join, "__defaults__", ("left", None, 4, 20))
    links = spark.createDataFrame([(0, i) for i in range(1, 80)] + [(200, 201)], "a long, b long")
    members = spark.createDataFrame([(str(i), i) for i in [*range(80), 200, 201]], "id string, same long")
    got = {r["id"]: r["group_id"] for r in neardup.classes(links, members, "id").collect()}
    assert {got[str(i)] for i in range(80)} == {0} and got["201"] == 200
