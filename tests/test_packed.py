import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.operators.packed import SEPARATORS, tokenize, unpack

CASES = [
    (None, []), ("", []), (" ,; ", []), ("a", ["a"]), ("a,b;c、d|e｜f，g；h\ti\nj\r\nk", list("abcdefghijk")),
    ("a b  c", ["a", "b", "c"]), ("a b, c d", ["a b", "c d"]), ('"a, b"; c', ["a, b", "c"]), ("'x;y' 'z'", ["x;y", "z"]),
    ('"size 6"" prints",*.tmp', ['size 6" prints', "*.tmp"]), ("Lena's box*,x", ["Lena's box*", "x"]), ('"team\'s, old",.git', ["team's, old", ".git"]),
    ("red\\; blue*", ["red; blue*"]), ("a\\,b,c", ["a,b", "c"]), ('"open, b', ['"open', "b"]), ('"a"b,c', ['"a"b', "c"]), ('  "red; blue*" ', ["red; blue*"]),
    ("[Bb]in", ["[Bb]in"]), ("a\\b", ["a\\b"]), ('"x" "y"', ["x", "y"]), ("''", []), ('"a, b" c', ["a, b", "c"]), ('"a, b" c, d', ['"a', 'b" c', "d"]), ('""""', ['"']),
]


@pytest.mark.parametrize("text,values", CASES)
def test_cases(text, values):
    assert tokenize(text) == values


def test_brackets_and_nesting():
    assert tokenize('["a","b"]', brackets=True) == ["a", "b"]
    assert tokenize(" [a b] ", brackets=True) == ["a", "b"]
    assert tokenize("[a", brackets=True) == ["[a"]
    assert tokenize("*.{a,b},c(d;e)", nested=True) == ["*.{a,b}", "c(d;e)"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab *.'\"\\;,|x\t", min_size=1, max_size=6), min_size=1, max_size=5))
def test_quoted_values_come_back(values):
    values = [v.strip() for v in values if v.strip()]
    packed = ", ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert tokenize(packed) == values


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_any_text_is_read(text):
    assert all(v and v == v.strip() for v in tokenize(text))


def test_unpack_keeps_other_columns(spark):
    df = spark.createDataFrame([("1", "a,,b", "p", 9), ("2", None, "q", 9), ("3", " ", "r", 9), ("1", "a,,b", "p", 9), ("4", "x" * 50_000 + ",y", "s", 9)], "id string, f string, __values string, pos int")
    got = unpack(df, "f").orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["val"][:1], r["__values"]) for r in got] == [("1", 1, "a", "p"), ("1", 1, "a", "p"), ("1", 2, "b", "p"), ("1", 2, "b", "p"), ("4", 1, "x", "s"), ("4", 2, "y", "s")]
    assert unpack(df.limit(0), "f").count() == 0
    assert set(SEPARATORS) >= set(",;|\t\n")
