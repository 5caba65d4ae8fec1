"""Oversized texts cut at topic boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARAGRAPH = re.compile(r"(?:\r?\n[ \t\x0c]*){2,}|\x0c")
_SENTENCE = re.compile(r"[.!?…][\"'»”’)\]]*(?=\s)\s+|[。！？][”」』）]*\s*")
_SPACE = re.compile(r"\s+")
# Scripts written without spaces count by pairs of characters, others by words of three letters or more.
_UNSPACED = "\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f"
_WORD, _RUN = re.compile(rf"(?:(?![{_UNSPACED}])[^\W_]){{3,}}"), re.compile(rf"[{_UNSPACED}]{{2,}}")


@dataclass(frozen=True)
class Cutting:
    """`limit` characters at most in a piece, the first `overlap` of them from the piece before.

    A cut is looked for from `low` of a piece's room on; cohesion compares `block`
    sentences on either side of a place.
    """

    limit: int = 4000
    overlap: int = 200
    low: float = 0.5
    block: int = 6


def _ends(pattern: re.Pattern, text: str) -> list[int]:
    return [m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text)]


def _bag(text: str) -> frozenset:
    low = text.lower()
    return frozenset(_WORD.findall(low)) | {run[i : i + 2] for run in _RUN.findall(low) for i in range(len(run) - 1)}


def _depths(text: str, gaps: list[int], block: int) -> dict[int, float]:
    """How far cohesion between the blocks around each gap falls below the peaks on both sides."""
    bounds = [0, *gaps, len(text)]
    bags = [_bag(text[a:b]) for a, b in zip(bounds, bounds[1:])]
    scores = []
    for i in range(1, len(bags)):
        left, right = frozenset().union(*bags[max(0, i - block) : i]), frozenset().union(*bags[i : i + block])
        both = len(left & right)
        scores.append(both / (len(left) * len(right)) ** 0.5 if both else 0.0)
    rising = list(scores)
    for i in range(1, len(scores)):
        rising[i] = max(scores[i], rising[i - 1] if scores[i - 1] >= scores[i] else scores[i])
    falling = list(scores)
    for i in range(len(scores) - 2, -1, -1):
        falling[i] = max(scores[i], falling[i + 1] if scores[i + 1] >= scores[i] else scores[i])
    return {g: rising[i] + falling[i] - 2 * s for i, (g, s) in enumerate(zip(gaps, scores))}


def cuts(text: str, how: Cutting = Cutting()) -> list[tuple[int, int]]:
    """(start, end) of each piece.  Pieces but the first begin `overlap` before the end of the last one.

    Within the room of a piece the paragraph ends are looked at first, then sentence
    ends, then word ends; of the first kind that has any, the deepest cohesion valley
    wins, the later one on a tie (word ends: the last).  Only where there is no end of
    any kind a word is cut.  A text within the limit is one piece, an empty one none.
    """
    if not text:
        return []
    if len(text) <= how.limit:
        return [(0, len(text))]
    paragraphs, sentences = _ends(_PARAGRAPH, text), _ends(_SENTENCE, text)
    depth = _depths(text, sorted({*paragraphs, *sentences}), how.block)
    out, start, done = [], 0, 0
    while len(text) - start > how.limit:
        high = start + how.limit
        low = done + max(1, int((high - done) * how.low))
        end = 0
        for kind in (paragraphs, sentences):
            fit = kind[bisect_left(kind, low) : bisect_right(kind, high)]
            if fit:
                end = max(fit, key=lambda g: (round(depth[g], 9), g))
                break
        if not end:
            spaces = [m.end() for m in _SPACE.finditer(text, low, high)]
            end = spaces[-1] if spaces else high
        out.append((start, end))
        done, start = end, max(end - how.overlap, start + 1)
    out.append((start, len(text)))
    return out


def pieces(df: DataFrame, key: str, text: str, how: Cutting = Cutting(), with_text: bool = True) -> DataFrame:
    """One row per piece of each text longer than the limit: key, piece_no (from 1), start, stop, piece.

    Lengths are Unicode code points of the text itself.  Null, empty and short texts
    give no row, repeated rows give repeated pieces, an empty table gives none; other
    columns are left out, whatever their names.  Each row is cut by itself, so there is no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, s, e, t[s:e] if with_text else None) for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]) for i, (s, e) in enumerate(cuts(t, how), 1)]
            yield pd.DataFrame(rows, columns=["key", "piece_no", "start", "stop", "piece"]).astype({"piece_no": "int32", "start": "int32", "stop": "int32", "piece": "object"})

    long = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.char_length("text") > how.limit)
    return long.mapInPandas(run, f"key {kind}, piece_no int, start int, stop int, piece string").withColumnRenamed("key", key)
