from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from docquarry.operators.references import Target, broken_references, latest_state, month_of_seconds
from docquarry.operators.skew import hot_keys, salted_join


def brute(refs, targets, n, match):
    def norm(x):
        x = x.strip().lower() if x is not None else None
        return x or None

    out = []
    for row, *key in refs:
        key = [norm(k) for k in key]
        if match == "simple" and None in key or key == [None] * n:
            continue
        if match == "full" and None in key:
            out.append((row, "partial_null"))
            continue
        hits = [t for t in targets if all(k is None or k == norm(x) for k, x in zip(key, t[:n]))]
        if not hits:
            out.append((row, "missing"))
        elif all(t[n] for t in hits):
            out.append((row, "deleted"))
    return sorted(out)


REFS = [(1, "A", "x"), (2, " a ", "y"), (3, None, "x"), (4, "b", None), (5, None, None), (6, "", " "), (7, "c", "z"), (7, "c", "z"), (8, "d", "q")]
TARGETS = [("a", "X", False), ("a", "y", True), ("b", "k", False), ("d", "q", True), ("d", "q", False), (None, "z", False)]


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_composite_keys(spark, match):
    refs = spark.createDataFrame([(*r, "extra", 1) for r in REFS], "row int, k1 string, k2 string, __k0 string, __row int")
    targets = spark.createDataFrame(TARGETS, "a string, b string, gone boolean")
    got = broken_references(refs, ("k1", "k2"), Target(targets, ("a", "b"), dead="gone"), match)
    assert got.columns == [*refs.columns, "reason"]
    assert sorted((r["row"], r["reason"]) for r in got.collect()) == brute(REFS, TARGETS, 2, match)


def test_late_and_null_times(spark):
    refs = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", None)], "row int, k string, at long")
    targets = spark.createDataFrame([("a", 6), ("a", 9), ("b", 5), ("c", 9)], "id string, born long")
    got = broken_references(refs, ("k",), Target(targets, ("id",), "born"), made="at")
    assert [(r["row"], r["reason"]) for r in got.collect()] == [(1, "late")]


def test_empty_tables(spark):
    refs, none = spark.createDataFrame([(1, "a")], "row int, k string"), spark.createDataFrame([], "id string")
    assert broken_references(refs.limit(0), ("k",), Target(none, ("id",))).count() == 0
    assert [r["reason"] for r in broken_references(refs, ("k",), Target(none, ("id",))).collect()] == ["missing"]


def test_hot_keys_are_spread(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k").distinct().where("k <> '1'").withColumn("v", F.length("k"))
    assert hot_keys(left, "k", 1000) == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        salted = salted_join(left, right, "k", how, hot_rows=1000).select(left.join(right, "k", how).columns)
        assert sorted(map(tuple, salted.collect()), key=str) == plain
    with pytest.raises(ValueError):
        salted_join(left, right, "k", "full")


def test_latest_state_ignores_order_and_spelling(spark):
    rows = [(" A", 1, "old"), ("a", 2, "new"), ("b", 1, "x"), ("b", 1, "y"), (None, 5, "z"), (" ", 5, "z")]
    for rs in (rows, rows[::-1]):
        got = latest_state(spark.createDataFrame(rs, "id string, v int, s string"), "id", "v", ["s"])
        assert sorted(map(tuple, got.collect())) == [("a", "new"), ("b", "y")]


def test_month_is_utc(spark):
    at = int(datetime(2024, 2, 29, 23, 59, 59, tzinfo=timezone.utc).timestamp())
    got = spark.createDataFrame([(at,), (at + 1,), (None,), (-1,)], "t long").select(month_of_seconds("t")).collect()
    assert [r[0] for r in got] == ["2024-02", "2024-03", None, "1969-12"]
