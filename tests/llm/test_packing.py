import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import packing

needs_vocabulary = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary file")


def check_plan(counts, capacity):
    done = packing.plan(counts, capacity)
    placed = Counter()
    for content, times in done:
        assert times > 0 and sum(s * n for s, n in content.items()) <= capacity
        for s, n in content.items():
            placed[s] += n * times
    assert placed == Counter({s: n for s, n in counts.items() if n})
    return sum(t for _, t in done)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 6), max_size=12))
def test_every_item_is_placed_once(counts):
    bins = check_plan(counts, 30)
    total = sum(s * n for s, n in counts.items())
    assert bins >= -(-total // 30) and (total == 0 or bins <= 2 * total / 30 + 1)


def optimum(items, capacity):
    best = len(items)
    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in sorted({r: i for i, r in enumerate(rooms)}.values()):
            if rooms[i] >= rest[0]:
                go(rest[1:], rooms[:i] + [rooms[i] - rest[0]] + rooms[i + 1 :])
        go(rest[1:], rooms + [capacity - rest[0]])
    go(sorted(items, reverse=True), [])
    return best


def test_close_to_the_optimum():
    rng = random.Random(2)
    worse = 0
    for _ in range(60):
        items = [rng.randint(2, 20) for _ in range(9)]
        got = check_plan(Counter(items), 20)
        best = optimum(items, 20)
        assert got <= best + 1
        worse += got > best
    assert worse <= 6


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(60):
        items = [rng.randint(3, 20) for _ in range(8)]
        counts = dict(Counter(items))
        fixed = packing.reduce_pairs(counts, 20)
        rest = [s for s, n in counts.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + optimum(rest, 20) == optimum(items, 20)


@needs_vocabulary
def test_frame(spark):
    texts = [" word" * n for n in [1, 5, 2048, 2049, 5000, 3000] + [700] * 50 + [10] * 300]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(9000, None, 1), (9001, "", 1)]
    df = spark.createDataFrame(rows, "id long, t string, window_id int")
    got = packing.pack(df, "id", "t").collect()
    by_window, by_doc = Counter(), Counter()
    for r in got:
        by_window[r["window_id"]] += r["n_tokens"]
        by_doc[r["id"]] += r["n_tokens"]
        assert r["n_tokens"] <= 2048
    assert max(by_window.values()) <= 2048 and set(by_window) == set(range(len(by_window)))
    assert by_doc == Counter({i: len(t) // 5 if t else 0 for i, t, _ in rows})
    pieces = Counter(r["id"] for r in got)
    assert pieces[2] == 1 and pieces[3] == 2 and pieces[4] == 3 and pieces[9000] == 1
    assert len(by_window) == 5 + 25 + 1  # full pieces, pairs of 700, the two long rests; the small ones fit beside them
    assert packing.pack(df.limit(0), "id", "t").count() == 0


@needs_vocabulary
def test_a_hot_size(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'same text here' else repeat('tok ', cast(id % 50 as int)) end t")
    got = packing.pack(df, "id", "t")
    assert got.groupBy("window_id").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048 and got.count() == 5000


@pytest.mark.parametrize("counts,want", [({1100: 1, 500: 1, 448: 1}, {1100: 1, 500: 1, 448: 1}), ({1500: 3, 548: 3}, {1500: 1, 548: 1}), ({1200: 1, 840: 1, 400: 1, 390: 1}, {1200: 1, 840: 1}), ({2000: 2, 100: 1}, {2000: 1})])
def test_dominating_sets(counts, want):
    """Exact pairs, one as large as any two, the best two of three, and sizes that stand alone."""
    fixed = packing.reduce_pairs(dict(counts), 2048)
    assert want in [content for content, _ in fixed]


def test_dominated_sets_are_in_a_best_packing():
    """Against the optimum by search: fixing the reduced bins never costs a bin."""
    rng = random.Random(8)
    three = 0
    for _ in range(400):
        items = [rng.choice([rng.randint(4, 20), rng.randint(5, 9)]) for _ in range(rng.randint(4, 8))]
        left = dict(Counter(items))
        fixed = packing.reduce_pairs(left, 20)
        three += any(sum(c.values()) == 3 for c, _ in fixed)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + (optimum(rest, 20) if rest else 0) == optimum(items, 20)
        assert packing.least_windows(Counter(items), 20) <= optimum(items, 20)
    assert three > 20


def test_reduction_of_large_histograms_is_fast():
    rng = random.Random(3)
    counts = Counter(min(2048, int(rng.lognormvariate(6.5, 0.8)) + 300) for _ in range(200_000))
    assert check_plan(counts, 2048) >= packing.least_windows(counts, 2048)
