import random
import re
import unicodedata

import numpy as np
import pytest

from docquarry.llm import leakage
from docquarry.llm.leakage import leaks, tiles
from docquarry.operators import skew

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(60)] + ["Élan", "straße", "naïve"]


def fold(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", t.lower())


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        own = {tuple(w[i : i + n]) for w in [fold(t or "")] for i in range(len(w) - n + 1)}
        for k, x in items:
            w = fold(x or "")
            if any(tuple(w[i : i + n]) in own for i in range(len(w) - n + 1)):
                out.add((d, k))
    return out


def test_against_brute_force(spark):
    items = [(i, " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(8, 40)))) for i in range(30)] + [(98, None), (99, "too short"), (None, " ".join(WORDS[:15]))]
    docs = [(100, None), (101, "")]
    for i in range(60):
        t = [RNG.choice(WORDS) for _ in range(RNG.randint(5, 60))]
        if i % 2:
            w = items[RNG.randrange(30)][1].split()
            a = RNG.randrange(max(1, len(w) - 9))
            t[3:3] = [x.upper() + RNG.choice(["", ",", " -", "\n"]) for x in w[a : a + RNG.randint(9, 16)]]
        docs.append((i, " ".join(t)))
    docs.append((None, " ".join(WORDS[:20])))
    d, e = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(items, "item long, x string")
    for bits in (1 << 15, 1 << 22):
        got = {(r["doc"], r["item"]) for r in leaks(d, "doc", "t", e, "item", "x", 12, bits=bits).collect()}
        assert got == brute(docs, items, 12) and got


def test_accents_and_marks(spark):
    item = "un deux trois quatre cinq six sept huit neuf dix onze élève"
    doc = "avant UN, deux\ntrois - quatre cinq six sept huit neuf dix onze élève après"
    d, e = spark.createDataFrame([(1, doc)], "doc long, t string"), spark.createDataFrame([(7, item)], "item long, x string")
    r = leaks(d, "doc", "t", e, "item", "x").first()
    assert (r["doc"], r["item"], r["n_tiles"], r["longest"], r["covered"]) == (1, 7, 1, 12, 1.0)


def test_reordered_passages_count_together(spark):
    a, b = " ".join(f"a{i}" for i in range(15)), " ".join(f"b{i}" for i in range(15))
    d, e = spark.createDataFrame([(1, f"{b} x {a}")], "doc long, t string"), spark.createDataFrame([(7, f"{a} {b}")], "item long, x string")
    r = leaks(d, "doc", "t", e, "item", "x").first()
    assert (r["n_tiles"], r["longest"], r["covered"]) == (2, 15, 1.0)
    assert leaks(d, "doc", "t", e.limit(0), "item", "x").count() == 0 and leaks(d.limit(0), "doc", "t", e, "item", "x").count() == 0


def test_tiles_do_not_overlap():
    doc, item = np.array([1, 2, 3, 4, 1, 2, 3, 4, 5], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64)
    assert tiles(doc, item, 2) == [(4, 0, 5)]


def plain_tiling(doc, item, least):
    """Greedy string tiling as written down: all matches of unmarked words, the longest first."""
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in marked_d and b + n not in marked_i:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return sorted(out)
        marked_d |= set(range(a, a + n))
        marked_i |= set(range(b, b + n))
        out.append((a, b, n))


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_tiles_against_plain_tiling(letters, monkeypatch):
    rng = np.random.default_rng(letters)
    for listed in (0, 100_000):
        monkeypatch.setattr(leakage, "LISTED", listed)
        for _ in range(30):
            doc, item = (rng.integers(0, letters, rng.integers(3, 25)).astype(np.uint64) for _ in range(2))
            assert sum(t[2] for t in tiles(doc, item, 3)) == sum(t[2] for t in plain_tiling(doc, item, 3))


def test_repeated_words_stay_cheap():
    word = np.ones(3000, np.uint64)
    assert sum(1 for _ in leakage.runs(leakage._seeds(word, 12), leakage._seeds(word, 12))) < 6000
    assert tiles(word, word, 12) == [(0, 0, 3000)]


def test_hot_item_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (10,))
    monkeypatch.setattr(skew.salted_join, "__defaults__", ("left", None, 4, 10))
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(i, f"own{i} {passage} tail{i}") for i in range(60)] * 2
    d, e = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame([(7, passage), (7, passage), (8, " ".join(f"q{i}" for i in range(14)))], "item long, x string")
    got = [(r["doc"], r["item"]) for r in leaks(d, "doc", "t", e, "item", "x").collect()]
    assert sorted(got) == sorted([(i, 7) for i in range(60)] * 2)
