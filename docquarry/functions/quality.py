"""Text-quality tests used during extraction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def odd_ratio(text: Column | str) -> Column:
    """The part of replacement and control characters (tab and line breaks aside) in a text; null if it is empty."""
    t = _c(text)
    odd = F.char_length(t) - F.char_length(F.regexp_replace(t, r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.try_divide(odd, F.char_length(t))


def is_garbled(text: Column | str) -> Column:
    """Over 30 % odd characters, or under 5 % that aren't blank; an empty or null text is not garbled."""
    t = _c(text)
    filled = F.try_divide(F.char_length(F.regexp_replace(t, r"\s", "")), F.char_length(t))
    return F.coalesce((odd_ratio(t) > 0.3) | (filled < 0.05), F.lit(False))


def repetition_ratio(text: Column | str) -> Column:
    """(lines - distinct lines) / lines over non-blank trimmed lines; 0 without lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    return F.when(F.size(lines) > 0, (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines)).otherwise(0.0)


def is_repetitive(text: Column | str) -> Column:
    """At least 100 bytes and three non-blank lines of which over 60 % repeat."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.size(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    return (F.octet_length(t) >= 100) & (n >= 3) & (repetition_ratio(t) > 0.6)


#: White space, addresses, long hexadecimal runs, dates and times, and numbers of up to four digits.
_PASSING = re.compile(r"\s+|http\S*|[0-9A-Fa-f]{30,}|(?=\d)(?:[\d.]*[-:][\d.:-]*|(?=[\d.]*\.)[\d.]{8,}|\d{1,4}(?![\d.:-]))")


def page_stamp(text: str | None, first: int | None = 300) -> str:
    """What is left of a page's `first` characters (None: of all) without what differs from page to page."""
    return re.sub(r"(?:\d*\.)+\Z", "", _PASSING.sub("", (text or "")[:first]))


@F.pandas_udf(T.StringType())
def page_stamps(text: pd.Series) -> pd.Series:
    return text.map(page_stamp)


def decode_bytes(raw: bytes | None, limit: int | None = 10 << 20) -> str:
    """Text of the first `limit` bytes (None: all) of a plain file: byte-order marks, UTF-8, binary (NUL early on) as '', GBK, else the reading with fewer losses."""
    if not raw:
        return ""
    raw = raw[:limit]
    for mark, codec in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace")
    try:
        text = raw.decode("utf-8")
        return "" if "\x00" in text[:8192] else text
    except UnicodeDecodeError:
        pass
    if b"\x00" in raw[:8192]:
        return ""
    try:
        return raw.decode("gbk")
    except UnicodeDecodeError:
        a, b = raw.decode("utf-8", "replace"), raw.decode("gbk", "replace")
        return b if b.count("�") < a.count("�") else a


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda x: decode_bytes(bytes(x)) if x is not None else None)
