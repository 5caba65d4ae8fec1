import random

import pytest

from docquarry.llm.chunking import Cutting, cuts, pieces

SMALL = Cutting(limit=100, overlap=10)


def rebuilt(text, spans, overlap):
    return text[: spans[0][1]] + "".join(text[max(s + overlap, 0) : e] if s else text[s:e] for s, e in spans[1:])


@pytest.mark.parametrize("text", ["x" * 1000, "word " * 300, "A sentence here. " * 60, "Para one is here.\n\n" * 40, "字" * 500, "短句。" * 200, "a" * 101, "\n" * 500, "mixed 字。 and words. \r\n\r\n" * 40])
def test_round_trip_and_limits(text):
    spans = cuts(text, SMALL)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(e - s <= 100 for s, e in spans)
    assert all(s2 == e1 - 10 for (_, e1), (s2, _) in zip(spans, spans[1:]))
    assert rebuilt(text, spans, 10) == text


def test_short_and_empty():
    assert cuts("") == [] and cuts("abc") == [(0, 3)] and cuts("a" * 4000) == [(0, 4000)] and len(cuts("a" * 4001)) == 2


def test_natural_boundaries_first():
    text = ("alpha beta gamma delta. " * 6 + "\n\n") * 8
    how = Cutting(limit=400, overlap=20)
    assert all(text[e - 2 : e] == "\n\n" for _, e in cuts(text, how)[:-1])
    text = "alpha beta gamma delta. " * 60
    assert all(text[e - 2] == "." for _, e in cuts(text, how)[:-1])
    text = "alpha beta gamma delta " * 60
    assert all(text[e - 1] == " " for _, e in cuts(text, how)[:-1])


def test_deepest_valley_wins():
    rng = random.Random(3)
    def topic(words, n):
        return "".join(f"{' '.join(rng.choice(words) for _ in range(8))}. " for _ in range(n))
    one, two = topic(["apple", "pear", "plum", "cherry"], 12), topic(["engine", "wheel", "brake", "clutch"], 12)
    first = cuts(one + two, Cutting(limit=len(one) + 150, overlap=20, block=5))[0]
    assert first[1] == len(one)


def test_frame(spark):
    rows = [("a", "word " * 2000, 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4), ("a", "word " * 2000, 1)]
    df = spark.createDataFrame(rows, "id string, t string, piece_no int")
    got = pieces(df, "id", "t").collect()
    assert {r["id"] for r in got} == {"a"} and len(got) == 2 * len(cuts("word " * 2000))
    assert all(len(r["piece"]) == r["stop"] - r["start"] <= 4000 for r in got)
    assert pieces(df.limit(0), "id", "t").count() == 0


def test_chinese_topics_are_parted():
    """Scripts without spaces have valleys by pairs of characters."""
    rng = random.Random(4)

    def topic(words, n):
        return "".join(f"{''.join(rng.choice(words) for _ in range(6))}。" for _ in range(n))

    one, two = topic(["苹果", "香蕉", "樱桃", "葡萄"], 14), topic(["引擎", "车轮", "刹车", "油箱"], 14)
    assert cuts(one + two, Cutting(limit=len(one) + 120, overlap=20, block=5))[0][1] == len(one)


def test_giant_text_in_time_that_grows_with_it():
    text = "alpha beta gamma. " * 200_000
    got = cuts(text)
    assert got[-1][1] == len(text) and all(b - a <= 4000 for a, b in got)
