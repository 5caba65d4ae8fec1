"""Several values packed in one text field."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separators of packed fields.
SEPARATORS = ",;、|\t\n\r，；｜"

_PLAIN = re.compile("[" + re.escape(SEPARATORS) + "]")
_SPECIAL = re.compile(r"[\"'\\]")
_OPENING, _CLOSING = "([{", ")]}"


def _quoted_end(text: str, start: int, stop: frozenset) -> tuple[int, str] | None:
    """Where the value quoted from `start` on ends, and its content; None if it isn't one."""
    quote, i, piece = text[start], start + 1, []
    while i < len(text):
        if text[i] != quote:
            piece.append(text[i])
            i += 1
        elif text[i + 1 : i + 2] == quote:
            piece.append(quote)
            i += 2
        else:
            i += 1
            while i < len(text) and text[i] not in stop and text[i].isspace():
                i += 1
            return (i, "".join(piece)) if i == len(text) or text[i] in stop else None
    return None


def _scan(text: str, stop: frozenset, nested: bool) -> tuple[list[str], bool]:
    """The values between the characters of `stop`, and whether any of SEPARATORS stood outside quotes."""
    values, piece, met, depth, fresh, i = [], [], False, 0, True, 0
    while i < len(text):
        ch = text[i]
        if ch in "\"'" and fresh and (found := _quoted_end(text, i, stop)):
            i, content = found
            values.append(content.strip())
            piece, fresh = [], True
            if i < len(text):
                met, i = met or text[i] in SEPARATORS, i + 1
            continue
        if ch == "\\" and i + 1 < len(text) and (text[i + 1] in SEPARATORS):
            met = True
            piece.append(text[i + 1])
            fresh, i = False, i + 2
            continue
        if nested and ch in _OPENING:
            depth += 1
        elif nested and ch in _CLOSING:
            depth = max(0, depth - 1)
        if ch in stop and not depth:
            met = met or ch in SEPARATORS
            values.append("".join(piece).strip())
            piece, fresh = [], True
        else:
            piece.append(ch)
            fresh = fresh and ch.isspace()
        i += 1
    values.append("".join(piece).strip())
    return values, met


_STOP = frozenset(SEPARATORS)
_STOP_SPACE = frozenset(SEPARATORS + " \x0b\x0c 　")


def tokenize(text: str | None, brackets: bool = False, nested: bool = False) -> list[str]:
    """The values of one packed field, in order, without empty ones.

    A finite-state scan with the states value, quoted value and escape.  Separators
    are SEPARATORS; spaces separate only where the field has none of those outside
    quotes.  A quote that opens a value and is closed before a separator encloses
    it, doubled inside it stands for itself; any other quote is an ordinary sign.
    A backslash before a separator makes it part of the value and goes away.
    `brackets` takes square brackets off the whole field, `nested` keeps separators
    inside (), [] and {} in the value.  None and blank fields have no values.
    """
    if text is None:
        return []
    if brackets:
        inner = text.strip()
        if len(inner) > 1 and inner[0] == "[" and inner[-1] == "]":
            text = inner[1:-1]
    if not nested and not _SPECIAL.search(text):
        values = _PLAIN.split(text)
        values = text.split() if len(values) == 1 else [v.strip() for v in values]
    else:
        values, met = _scan(text, _STOP, nested)
        by_space, beside = _scan(text, _STOP_SPACE, nested)
        if not met or not beside:
            values = by_space
    return [v for v in values if v]


def tokens(c: Column | str, brackets: bool = False, nested: bool = False) -> Column:
    """Array of the values of a packed column (an Arrow-batched function; null gives an empty array)."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda x: tokenize(x if isinstance(x, str) else None, brackets, nested))

    return split(c)


def unpack(df: DataFrame, field: str, brackets: bool = False, nested: bool = False, pos: str = "pos", val: str = "val") -> DataFrame:
    """One row per value of `field`, with its place from 1 on in `pos` and itself in `val`.

    All other columns stay (ones named like `pos` or `val` give way).  Rows without a value give none; repeated rows and values
    stay repeated; an empty table gives none; works within each row, without a shuffle.
    """
    rest = [c for c in df.columns if c not in (field, pos, val)]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None)
    split = df.select(row.alias("row"), tokens(F.col(f"`{field}`"), brackets, nested).alias("values"))
    each = split.select("row", F.posexplode("values").alias("pos", "val"))
    return each.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], (F.col("pos") + 1).alias(pos), F.col("val").alias(val))


def valid_globs(values: Column | str) -> Column:
    """The array's values that are patterns: those with an unclosed bracket are dropped."""
    c = F.col(values) if isinstance(values, str) else values
    return F.filter(c, lambda x: (x != "") & ~F.regexp_replace(x, r"\[[!^]?\]?[^\]]*\]", "").contains("["))
