"""Text of scanned pages: furniture, broken words and misread letters found and repaired."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import log
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .text import mix, word_codes

# Fixed values: (printed, read) letters that recognition confuses.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("n", "u"), ("u", "n"), ("a", "o"), ("o", "0"), ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"), ("i", "|"), ("l", "|"),
    ("c", "("), ("k", "("), ("g", "q"), ("h", "b"), ("u", "ii"), ("ü", "ii"), ("m", "rn"), ("rn", "m"), ("y", "v"), ("ri", "n"), ("é", "6"), ("ó", "6"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("s", "5"), ("w", "vv"), ("o", "c"), ("b", "8"), ("d", "cl"), ("cl", "d"), ("in", "m"), ("ni", "m"), ("z", "2"), ("í", "l"), ("á", "o"), ("ä", "o"),
)
PAGE_WORDS = ("page", "seite", "página", "pagina", "pág", "p", "s", "blatt", "folio", "hoja", "pag")
BREAKS = "-‐¬­‑"

_NUM = r"(?:[0-9lIOoSB|]{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
_ROMAN = re.compile(r"^(?:[ivxlc]+|[IVXLC]+)$")
_PAGE = re.compile(rf"^(?:[\[(–—-]\s*({_NUM})\s*[\])–—-]|({_NUM})\s*/\s*{_NUM}|(?:([^\W\d_]{{1,7}})\.?\s+)?({_NUM})(?:\s+(?:of|sur|von|de|di|0f|o[fl]|vou|dc|sui)\s+{_NUM})?)$")
_LEAD = re.compile(rf"^({_NUM})(?:\s{{2,}}|\s*[|–—·-]\s+)(?=\S)")
_TRAIL = re.compile(rf"(\s{{2,}}|\s+[|–—·-]\s*|\s)(?:[^\W\d_]{{1,7}}\.?\s)?({_NUM})$")
_FIGURES = re.compile(r"^[\d\s.,%€$£+()-]*\d[\d\s.,%€$£+()-]*$")
_ENDED = re.compile(r"[.?!:;,。！？]$")
_CODE = re.compile(r"^[A-Z]{2}\d{3,5}$")
_STRIP = ".,;:?!»«\"“”„’'‘)]…"
_PARTS = re.compile(r"[’'\-‐–—/]")
_ODD = re.compile(r"[^\W_]|[(|]")
COST, ALLOWED, ALLOWED_SHORT = 0.3, 0.65, 0.35
#: Letters from which on a word may differ by one edit that is no confusion, where its letters are in no order that words have.
UNIT_LETTERS = 5


@dataclass(frozen=True)
class Lexicon:
    """Words of the corpus with their document counts, and counts of neighbouring words."""

    words: dict
    pairs: dict


def distance(printed: str, read: str, limit: float = ALLOWED) -> float:
    """Weighted edit distance from a word to its reading: COST for a confusion, 1 for any other edit."""
    n, m = len(printed), len(read)
    best = [[9.0] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row_best = 9.0
        for j in range(m + 1):
            x = best[i][j]
            if i and j and printed[i - 1] == read[j - 1]:
                x = min(x, best[i - 1][j - 1])
            if i and j:
                x = min(x, best[i - 1][j - 1] + 1)
            if i:
                x = min(x, best[i - 1][j] + 1)
            if j:
                x = min(x, best[i][j - 1] + 1)
            for a, b in CONFUSIONS:
                if i >= len(a) and j >= len(b) and printed.endswith(a, 0, i) and read.endswith(b, 0, j):
                    x = min(x, best[i - len(a)][j - len(b)] + COST)
            best[i][j] = x
            row_best = min(row_best, x)
        if row_best > limit + 2:
            return 9.0
    return best[n][m]


def _kept(read: str) -> bool:
    """Codes, numbers and single letters, which are never repaired."""
    return bool(_CODE.match(read) or read.isdigit() or len(read) < 2 or _ROMAN.match(read))


def deletes(word: str, depth: int = 2) -> set[str]:
    """The word and what is left of it without up to `depth` of its letters."""
    out = {word}
    for k in range(1, min(depth, len(word) - 1) + 1):
        out |= {"".join(word[i] for i in range(len(word)) if i not in gone) for gone in combinations(range(len(word)), k)}
    return out


def trigrams(word: str) -> set[str]:
    """Three letters in a row, the ends of the word marked."""
    marked = f"^{word}$"
    return {marked[i : i + 3] for i in range(len(word))}


class Repairer:
    """A symmetric-delete index over a lexicon that the caller brings (one learned from a table is joined instead)."""

    def __init__(self, lexicon: Lexicon):
        self.words, self.pairs = lexicon.words, lexicon.pairs
        self.index: dict[str, list[str]] = defaultdict(list)
        for w in self.words:
            if len(w) > 1:
                for x in deletes(w):
                    self.index[x].append(w)
        self.usual = {g for w in self.words for g in trigrams(w)}
        self.found = lru_cache(maxsize=100_000)(self._found)

    def _found(self, read: str) -> tuple[tuple[str, float], ...]:
        seen = {w for x in deletes(read) for w in self.index.get(x, ())}
        allowed = ALLOWED if len(read) >= 5 else ALLOWED_SHORT
        odd = read.isalpha() and not self.usual.issuperset(trigrams(read))
        out = [(w, d) for w in seen if abs(len(w) - len(read)) <= 2 and ((d := distance(w, read)) <= allowed or (d <= 1 and odd and len(w) >= UNIT_LETTERS))]
        return tuple(sorted(out, key=lambda x: (x[1], -self.words[x[0]], x[0])))

    def repair(self, read: str, before: str = "", after: str = "") -> str | None:
        """The lexicon word that was probably printed; None for a word of the lexicon and for names and codes."""
        low = read.lower()
        if low in self.words or _kept(read):
            return None
        found = self.found(low)
        if not found:
            return None

        def score(c: tuple[str, float]) -> float:
            return log(1 + self.pairs.get((before, c[0]), 0)) + log(1 + self.pairs.get((c[0], after), 0)) + 0.5 * log(self.words[c[0]]) - 8 * c[1]

        return max(found, key=score)[0]


def _like(pattern: str, word: str) -> str:
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word[0].upper() + word[1:] if pattern[:1].isupper() else word


_CANON = str.maketrans({**dict.fromkeys("i1|í", "l"), **dict.fromkeys("ec(o0a6éóáä", "o"), "t": "f", **dict.fromkeys("nuü", "n"), "q": "g", "b": "h", "8": "h", "v": "y", "5": "s"})


def _canon(s: str) -> str:
    s = re.sub(r"\s+", " ", s.lower()).replace("ﬁ", "fi").replace("ﬂ", "fl").replace("rn", "m").replace("vv", "w").replace("ii", "u").replace("ri", "n")
    return s.translate(_CANON)


def _number(s: str) -> bool:
    return any(c.isdigit() for c in s) or bool(_ROMAN.match(s))


def _page(s: str) -> bool:
    m = _PAGE.match(s)
    if not m:
        return False
    number = next(g for g in (m[1], m[2], m[4]) if g)
    if not _number(number):
        return False
    if m[3] and not any(m[3].lower() == w or (len(w) > 3 and distance(w, m[3].lower()) <= ALLOWED) for w in PAGE_WORDS):
        return False
    return not (_ROMAN.match(number) and len(number) == 1 and number in "cCLl") or bool(m[1] or m[3])


@dataclass
class Place:
    """A word that may be misread: its line, the line it goes on in, its letters before the break (0: none), its place in the line, the word, its neighbours."""

    line: int
    next: int
    head: int
    at: int
    read: str
    before: str
    after: str


@dataclass
class Page:
    """What one text shows by itself: lines and their classes, damage by line (from 0), broken words and the places to ask for."""

    lines: list[str]
    layout: list[str]
    width: int
    kinds: list[tuple[int, str]]
    joined: dict[int, int]
    places: list[Place]


def _layout(raw: list[str]) -> tuple[list[str], int]:
    """The class of each line (blank, page_no, header, figures, heading or text) and the usual width."""
    lines = [x.replace("\x0c", "").strip() for x in raw]
    long = sorted(len(x) for x in lines if len(x) > 20)
    width = long[int(len(long) * 0.8)] if long else 0
    kinds = ["blank" if not x else "figures" if _FIGURES.match(x) else "text" for x in lines]
    for i, x in enumerate(lines):
        if x and _page(x):
            near = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            if not (x.isdigit() and any(y.isdigit() for y in near)):
                kinds[i] = "page_no"
    groups: dict[str, list[int]] = defaultdict(list)
    numbered = set()
    for i, x in enumerate(lines):
        if kinds[i] != "text" or len(x) > width + 20 and len(x) > 80:
            continue
        base = x
        if (m := _LEAD.match(base)) and _number(m[1]):
            base = base[m.end() :]
            numbered.add(i)
        if (m := _TRAIL.search(base)) and _number(m[2]) and m.start():
            if len(m[1]) > 1:
                numbered.add(i)
            base = base[: m.start()]
        base = base.strip(" \t|–—·-")
        if not base or len(base) > 50 or _ENDED.search(x) or not (base[0].isupper() or not base[0].isalpha()) or len(base.split()) < 2 or re.match(r"^\d+[.)]\s", x) or not re.search(r"[^\W\d_]{4}", base):
            numbered.discard(i)
            continue
        groups[_canon(base)].append(i)
    for members in groups.values():
        if len(members) > 1 or members[0] in numbered:
            for i in members:
                kinds[i] = "header"
    for i, x in enumerate(lines):
        if kinds[i] == "text" and len(x) < 0.7 * width and not _ENDED.search(x) and (x[0].isupper() or x[0].isdigit()) and x[-1] not in BREAKS:
            after = next((lines[j] for j in range(i + 1, len(lines)) if kinds[j] in ("text", "figures")), "")
            if not after[:1].islower() and len(x.split()) <= 8 and not x.endswith((" -", " –")):
                kinds[i] = "heading"
    return kinds, width


def wrapped(text: str) -> int:
    """How often a line breaks within a sentence (also over one blank line)."""
    lines = text.split("\n")
    n = 0
    for i, x in enumerate(lines[:-1]):
        if len(x) > 25 and len(x := x.rstrip(" \t\r")) > 25 and x[-1] not in ".?!:;\x0c\x0b\xa0":
            after = lines[i + 1]
            if not after.strip(" \t\r") and i + 2 < len(lines):
                after = lines[i + 2]
            n += after[:1].islower()
    return n


def read_page(text: str, known: frozenset = frozenset(), ask: bool = True) -> Page:
    """The layout of a text and, unless told not to, every place whose word is not `known`."""
    raw = text.split("\n")
    lines = [x.replace("\x0c", "").strip() for x in raw]
    layout, width = _layout(raw)
    kinds = [(i, k) for i, k in enumerate(layout) if k in ("header", "page_no")]
    running = [i for i, k in enumerate(layout) if k == "text"]
    joined: dict[int, int] = {}
    for i, j in zip(running, running[1:]):
        x = lines[i]
        if len(x) > 2 and x[-1] in BREAKS and x[-2].isalpha() and lines[j][:1].isalpha() and lines[j][:1].islower():
            joined[i] = j
            kinds.append((i, "hyphen"))
    places: list[Place] = []
    cut = set(joined.values())
    for i in running if ask else ():
        words, low = lines[i].split(), lines[i].lower().split()
        for p, lw in enumerate(low):
            if lw in known or (i in cut and p == 0):
                continue
            core = words[p].strip(_STRIP)
            if not core or core.lower() in known:
                continue
            if i in joined and p == len(words) - 1:
                nxt = lines[joined[i]].split()
                head, tail = words[p].rstrip(BREAKS), nxt[0]
                left, right = low[p - 1] if p else "", nxt[1].lower().strip(_STRIP) if len(nxt) > 1 else ""
                places.append(Place(i, joined[i], len(head), p, (head + tail.strip(_STRIP)).lstrip(_STRIP + "("), left, right))
                continue
            left, right = low[p - 1].strip(_STRIP) if p else "", low[p + 1].strip(_STRIP) if p + 1 < len(low) else ""
            start = core if "(" in core and ")" not in words[p] else core.strip("(")
            for part in _PARTS.split(start):
                if len(part) > 1 and part.lower() not in known and _ODD.search(part):
                    places.append(Place(i, i, 0, p, part, left, right))
    return Page(lines, layout, width, sorted(set(kinds)), joined, places)


def misread(head: int, line: int, after: int, read: str, better: str) -> int:
    """The line of a repaired word: that of its first wrong letter."""
    if not head:
        return line
    same = next((q for q, (a, b) in enumerate(zip(better, read.lower())) if a != b), min(len(better), len(read)))
    return line if same < head else after


def mended(page: Page, repairs: list[tuple[int, int, int, str, str]]) -> list[str]:
    """The page as paragraphs after repairs (line, place in it, letters before a break, word as read, word printed), each at its own place only."""
    words = {i: page.lines[i].split() for i in {r[0] for r in repairs} | {page.joined[r[0]] for r in repairs if r[2]}}
    for i, p, head, read, better in repairs:
        better = _like(read, better)
        if head:
            j = page.joined[i]
            lead, tail = words[i][p][: len(words[i][p]) - len(words[i][p].lstrip(_STRIP + "("))], words[j][0]
            at = min(len(better) - 1, head - len(lead))
            words[i][p], words[j][0] = lead + better[:at] + "-", better[at:] + tail[len(tail.rstrip(_STRIP)) :]
        else:
            words[i][p] = words[i][p].replace(read, better, 1)
    fixed = [" ".join(words[i]) if i in words else x for i, x in enumerate(page.lines)]
    return _paragraphs(fixed, page.layout, page.joined, page.width)


def _paragraphs(fixed: list[str], kinds: list[str], joined: dict[int, int], width: int) -> list[str]:
    """Running lines in one line per paragraph; headings and figures stand alone; furniture is gone.

    A blank line ends a paragraph only after an ended sentence, so one that furniture
    interrupts goes on.  Dashes that stand alone between words of a scan are dropped.
    """
    out: list[str] = []
    now = ""
    glue = False
    for i, k in enumerate(kinds):
        if k in ("header", "page_no"):
            continue
        if k != "text":
            if now and not glue and now[-1:] in ".?!:":
                out.append(now)
                now = ""
            if k != "blank":
                out.append(fixed[i])
            continue
        line = re.sub(r"(?:^|(?<=\s))[-–](?:\s+|$)", "", fixed[i]).strip()
        now = now + line if glue else f"{now} {line}".strip()
        glue = i in joined
        if glue:
            now = now.rstrip(BREAKS)
        elif now[-1:] in ".?!" and len(line) < 0.7 * width:
            out.append(now)
            now = ""
    if now:
        out.append(now)
    return out


#: A word is known if it is in this many clean texts at least, and in no more scans than clean texts or not much rarer in clean texts than in scans.
CLEAN, RATE = 2, 0.2
#: A word can be what was printed if it is in this many texts at least, and in so many times those of what was read (the last for edits that are no confusion).
LEAST_TEXTS, RATIO, RATIO_UNIT = 5, 5, 20
#: The most frequent known words, which save asking for each of their places; all others are asked for by joins.
MAX_WORDS = 50_000
#: Pairs of words are counted if their code falls into a slot (a power of 2 of them) that some open decision needs.
SLOTS = 1 << 22

_LONGER = (("w", "vv"), ("d", "ox"), ("ﬁ", "fx"), ("ﬂ", "fx"))
_SAME = (("il1|rnuüím", "x"), ("ec(o0a6éóákä", "o"), ("t", "f"), ("q", "g"), ("b8", "h"), ("y", "v"), ("5", "s"), ("2", "z"))


def skeleton(word: Column) -> Column:
    """A form that no confusion changes, so that all possible words of a reading have its skeleton."""
    for a, b in _LONGER:
        word = F.replace(word, F.lit(a), F.lit(b))
    word = F.translate(word, "".join(a for a, _ in _SAME), "".join(b * len(a) for a, b in _SAME))
    return F.regexp_replace(word, "x+", "x")


def counted(df: DataFrame, text: str, ocr: str) -> DataFrame:
    """`word` in lower case, `n` texts that have it and `known`; no word is left out for being rare.

    Known are words of clean texts: those that can't be of scanned pages.  As
    counts are compared with those of the same word in scans, and later with those of words
    it can be confused with, the share of a language or source in the table has no influence.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(b.column(0).cast(pa.large_string()), "")), pattern=r"[^\p{L}]+")
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(split.offsets)))
            coded = split.values.dictionary_encode()
            size = max(1, len(coded.dictionary))
            once = np.unique(owner * size + np.asarray(coded.indices).astype(np.int64))
            clean = np.asarray(b.column(1).cast(pa.int8())).astype(bool)
            n, n_clean = np.bincount(once % size, minlength=size), np.bincount(once[clean[once // size]] % size, minlength=size)
            names = coded.dictionary.to_pylist()
            keep = [i for i, w in enumerate(names) if w]
            yield pa.RecordBatch.from_arrays([pa.array(["", *[names[i] for i in keep]]), pa.array([b.num_rows, *n[keep].tolist()], pa.int64()), pa.array([int(clean.sum()), *n_clean[keep].tolist()], pa.int64())], names=["word", "n", "n_clean"])

    clean = ~F.coalesce(_maybe(text, ocr), F.lit(False))
    total = df.select(text, clean.alias("clean")).mapInArrow(count, "word string, n bigint, n_clean bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean"))
    total = checkpointed(total)
    texts = total.where("word = ''").first()
    scans, cleans = (texts["n"] - texts["n_clean"], texts["n_clean"]) if texts else (0, 0)
    read = F.col("n") - F.col("n_clean")
    known = (F.col("n_clean") >= CLEAN) & ((F.col("n_clean") >= read) | (F.col("n_clean") * float(scans) >= RATE * cleans * read))
    return total.where("word <> ''").select("word", "n", known.alias("known"))


def _delete_keys(word: Column) -> Column:
    """The skeleton, and of words long enough for other edits also the word and what is left of it without one letter."""
    parts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.lit("-"), F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    unit = F.when(F.length(word) >= UNIT_LETTERS - 1, F.concat(F.array(F.concat(F.lit("-"), word)), parts)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(skeleton(word)), unit))


def _trigrams(word: Column) -> Column:
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(marked, i, F.lit(3))))


def _possible(asks: DataFrame, total: DataFrame) -> DataFrame:
    """`low`, `word`, `n`, `d`: all words that a reading which is no known word can stand for.

    Readings and words meet on the keys of a symmetric-delete index, which is a join: on
    their skeletons, where the weighted distance decides, and on what is left without one
    letter, where one edit of any kind is allowed if the reading has three letters in a
    row that no known word has (so a rare word is not turned into a frequent one).
    """
    reads = asks.select("low").distinct().join(total.select(F.col("word").alias("low"), F.col("n").alias("n_low"), "known"), "low", "left")
    reads = reads.where(~F.coalesce("known", F.lit(False))).select("low", F.coalesce("n_low", F.lit(0)).alias("n_low"), F.explode(_delete_keys(F.col("low"))).alias("form"))
    words = total.where((F.col("n") >= LEAST_TEXTS) & (F.length("word") > 1)).select("word", "n", F.explode(_delete_keys(F.col("word"))).alias("form"))
    met = reads.join(words, "form").where((F.col("n") >= RATIO * F.greatest("n_low", F.lit(1))) & (F.abs(F.length("low") - F.length("word")) <= 2) & (F.col("low") != F.col("word")))
    unit = F.startswith("form", F.lit("-"))
    near_unit = F.col("low").rlike(r"^\p{L}+$") & (F.length("word") >= UNIT_LETTERS) & (F.col("n") >= RATIO_UNIT * F.greatest("n_low", F.lit(1))) & (F.levenshtein("low", "word", 1) == 1)
    met = checkpointed(met.where(~unit | near_unit).select("low", "word", "n", unit.alias("unit")).distinct())

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(d=[distance(w, x) for x, w in zip(b["low"], b["word"])])
            yield b[b["d"] <= np.where(b["low"].str.len() >= 5, ALLOWED, ALLOWED_SHORT)]

    sure = met.where("not unit").select("low", "word", "n").mapInPandas(near, "low string, word string, n bigint, d double")
    usual = total.where("known").select(F.explode(_trigrams(F.col("word"))).alias("g")).distinct()
    odd = met.where("unit").select("low").distinct().select("low", F.explode(_trigrams(F.col("low"))).alias("g")).join(usual, "g", "left_anti").select("low").distinct()
    loose = met.where("unit").join(odd, "low", "left_semi").select("low", "word", "n", F.lit(1.0).alias("d"))
    found = checkpointed(sure.unionByName(loose).groupBy("low", "word", "n").agg(F.min("d").alias("d")))
    return found.join(found.select(F.col("low").alias("word")).distinct(), "word", "left_anti")  # what is itself a misreading was not printed


def _pair_codes(left: pa.Array, right: pa.Array) -> np.ndarray:
    return mix(word_codes(left) * np.uint64(3) + word_codes(right)).view(np.int64)


def _slots(codes: DataFrame) -> np.ndarray:
    """One bit for each of SLOTS, set if a wanted `code` falls into it; the driver gets at most SLOTS / 64 rows."""
    slot = F.pmod("code", F.lit(SLOTS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(code, {SLOTS}) % 64 as int))")
    bits = np.zeros(SLOTS // 64, np.int64)
    for at, mask in codes.groupBy(F.floor(slot / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("mask")).collect():
        bits[at] = mask
    return bits


def _pair_counts(df: DataFrame, text: str, codes: DataFrame) -> DataFrame:
    """`code`, `met`: how often each wanted pair of neighbouring words is met in all texts, once being enough; a text's ends are no neighbours."""
    bits = _slots(codes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)
        for b in batches:
            split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(b.column(0).cast(pa.large_string()), "")), pattern=r"[^\p{L}]+")
            hashed, owner = word_codes(split.values), np.repeat(np.arange(b.num_rows), np.diff(np.asarray(split.offsets)))
            full = np.asarray(pc.not_equal(split.values, ""))
            pair = mix(hashed[:-1] * np.uint64(3) + hashed[1:]).view(np.int64)[(owner[:-1] == owner[1:]) & full[:-1] & full[1:]]
            pair, n = np.unique(pair[slots[pair & (SLOTS - 1)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["code", "met"])

    met = df.select(text).mapInArrow(count, "code bigint, met bigint").groupBy("code").agg(F.sum("met").alias("met"))
    return met.join(codes, "code", "left_semi")


def decisions(df: DataFrame, text: str, asks: DataFrame, total: DataFrame) -> DataFrame:
    """`low`, `before`, `after`, `better`: the word that was probably printed, for each asked place that has one.

    Where several words are possible all counts of their pairs with the neighbours decide,
    however small and in whatever text; they are looked up by joins, and nothing of them is held by the driver
    but which of SLOTS are wanted.
    """
    can = _possible(asks, total)
    can = can.join(can.groupBy("low").agg((F.count(F.lit(1)) > 1).alias("open")), "low")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, word, after = (b.column(i).cast(pa.large_string()) for i in (1, 3, 2))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_pair_codes(before, word)), pa.array(_pair_codes(word, after))], names=[*b.schema.names, "l", "r"])

    places = asks.select("low", "before", "after").distinct().join(can, "low").select("low", "before", "after", "word", "n", "d", "open")
    places = checkpointed(places.mapInArrow(coded, "low string, before string, after string, word string, n bigint, d double, open boolean, l bigint, r bigint"))
    codes = places.where("open").select(F.explode(F.array("l", "r")).alias("code")).distinct()
    score = 0.5 * F.log("n") - 8 * F.col("d")
    if not codes.isEmpty():
        met = checkpointed(_pair_counts(df, text, codes))
        for side in "lr":
            places = places.join(met.select(F.col("code").alias(side), F.col("met").alias(f"met_{side}")), side, "left")
            score += F.log1p(F.coalesce(f"met_{side}", F.lit(0)))
    return places.groupBy("low", "before", "after").agg(F.max_by("word", F.struct(score, -F.col("d"), "n", "word")).alias("better"))


#: Lines that _page can take for a page number.
_PAGE_LINE = r"(?mU)^\s*[\[(–—-]?\s*(?:\p{L}{1,7}\.?\s+)?[0-9lIOoSB|ivxcVXLC]{1,7}(?:\s*[\])–—-]|\s*/\s*\w{1,7}|\s+\S{1,3}\s+\S{1,7})?\s*$"


def _maybe(text: str, ocr: str) -> Column:
    """Whether a text can be of scanned pages: `ocr` is 1, a line goes on within a sentence or one can be a page number; no transcripts, which have two time or speaker marks at line starts."""
    broken = F.col(text).rlike(r"[^\s.?!:;][ \t]*\r?\n(?:[ \t]*\r?\n)?\p{Ll}")
    marks = F.regexp_count(F.col(text), F.lit(r"(?m)^(?:[ \t]*[\d:.,]+[ \t]*-->[ \t]*\d|>>|\[\d\d:)"))
    return (F.col(text) != "") & (F.coalesce(F.col(ocr) == 1, F.lit(False)) | broken | F.col(text).rlike(_PAGE_LINE)) & (marks < 2)


def scanned(df: DataFrame, text: str, ocr: str) -> DataFrame:
    """Rows whose text can be of scanned pages."""
    return df.where(_maybe(text, ocr))


def _scan(text: str, ocr: int | None, kinds: list[tuple[int, str]]) -> bool:
    """Whether a text is of scanned pages by its line breaks, else by the damage in it: any where `ocr` is 1, headers and page numbers elsewhere."""
    return wrapped(text) >= (1 if ocr == 1 else 2) or (ocr == 1 and bool(kinds)) or {"header", "page_no"} <= {k for _, k in kinds}


def _asks(df: DataFrame, key: str, text: str, ocr: str, page: Column, total: DataFrame) -> DataFrame:
    """Of each scanned text its damage that the layout shows (`kind`), and every place whose word is not among the usual ones.

    A place has what is read there (`read`, in lower case `low`), its neighbours, its line
    and place in it and, for a word broken after `head` letters, the line it goes on in.
    """
    usual = frozenset(r[0] for r in total.where("known").orderBy(F.desc("n"), "word").limit(MAX_WORDS).select("word").collect())
    shared = df.sparkSession.sparkContext.broadcast(usual)  # bounded by MAX_WORDS
    source = scanned(df, text, ocr).select(page.alias("page"), F.col(f"`{key}`").alias("key"), F.col(text).alias("text"), F.col(ocr).alias("ocr"))
    schema = f"page {source.schema['page'].dataType.simpleString()}, key {source.schema['key'].dataType.simpleString()}, line int, next int, head int, at int, kind string, read string, low string, before string, after string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for b in batches:
            rows: list[tuple] = []
            for p, k, t, o in zip(b["page"], b["key"], b["text"], b["ocr"]):
                seen = read_page(t, words)
                if o == 1 or _scan(t, o, seen.kinds):
                    rows += [(p, k, i, i, 0, 0, kind, None, None, None, None) for i, kind in seen.kinds]
                    rows += [(p, k, x.line, x.next, x.head, x.at, None, x.read, x.read.lower(), x.before, x.after) for x in seen.places if x.read.lower() not in words and not _kept(x.read)]
            yield pd.DataFrame(rows, columns=names)

    return checkpointed(source.mapInPandas(run, schema))


_REPAIRERS: dict[str, Repairer] = {}


def _repairer(lexicon: Lexicon, token: str) -> Repairer:
    if token not in _REPAIRERS:
        _REPAIRERS.clear()
        _REPAIRERS[token] = Repairer(lexicon)
    return _REPAIRERS[token]


def repaired_page(text: str, repairer: Repairer) -> tuple[list[tuple[int, str]], list[str], int]:
    """All damage of one text by a given lexicon, its paragraphs, and the number of repairs."""
    page = read_page(text, frozenset(repairer.words))
    done = [(x, better) for x in page.places if (better := repairer.repair(x.read, x.before, x.after))]
    kinds = {*page.kinds, *((misread(x.head, x.line, x.next, x.read, better), "chars") for x, better in done)}
    return sorted(kinds), mended(page, [(x.line, x.at, x.head, x.read, better) for x, better in done]), len(done)


def _pages(df: DataFrame, key: str, text: str, ocr: str, lexicon: Lexicon, schema: str, rows_of) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # the caller's
    token = uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = _repairer(shared.value, token)
        for b in batches:
            rows = []
            for k, t, o in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2]):
                page = repaired_page(t, repairer)
                if _scan(t, o, page[0]):
                    rows += [(k, *r) for r in rows_of(*page)]
            yield pd.DataFrame(rows, columns=[x.strip().split()[0] for x in f"key {kind}, {schema}".split(",")])

    maybe = scanned(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{ocr}`").alias("ocr")), "text", "ocr")
    return maybe.mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def damage(df: DataFrame, key: str, text: str, ocr: str, lexicon: Lexicon | None = None) -> DataFrame:
    """`key`, `line_no` (from 1), `kind`: header, page_no, hyphen or chars, of every scanned text.

    A text is taken for scanned if lines break within sentences (once where `ocr` is 1,
    else twice), if `ocr` is 1 and there is any damage, or if it has both headers and page
    numbers.  Null, empty and other texts give no rows, repeated rows give repeated
    rows, an empty table gives none.  Without `lexicon` one is learned from the table.
    """
    if lexicon:
        return _pages(df, key, text, ocr, lexicon, "line_no int, kind string", lambda kinds, *_: [(i + 1, k) for i, k in kinds])
    total = counted(df, text, ocr)
    asks = _asks(df, key, text, ocr, F.monotonically_increasing_id(), total)
    places = asks.where("low is not null")
    found = places.join(decisions(df, text, places, total), ["low", "before", "after"])
    same = F.expr("coalesce(get(filter(sequence(1, least(length(better), length(low))), i -> substr(better, i, 1) <> substr(low, i, 1)), 0) - 1, least(length(better), length(low)))")
    line = F.when((F.col("head") == 0) | (same < F.col("head")), F.col("line")).otherwise(F.col("next"))
    chars = found.select("page", "key", line.alias("line"), F.lit("chars").alias("kind")).distinct()
    rows = asks.where("kind is not null").select("page", "key", "line", "kind").unionByName(chars)
    return rows.select(F.col("key").alias(key), (F.col("line") + 1).alias("line_no"), "kind")


def paragraphs(df: DataFrame, key: str, text: str, ocr: str, lexicon: Lexicon | None = None) -> DataFrame:
    """`key`, `repaired`, `n_repairs`: each scanned text as continuous paragraphs, and how many words were repaired.

    Repairs are applied at their own place, so one reading can stand for different words
    on a page.  Rows as in `damage`.
    """
    schema = "repaired string, n_repairs int"
    if lexicon:
        return _pages(df, key, text, ocr, lexicon, schema, lambda _, paragraphs_, n: [("\n\n".join(paragraphs_), n)])
    total = counted(df, text, ocr)
    places = _asks(df, key, text, ocr, F.md5(F.col(text)), total).where("low is not null")
    taken = places.join(decisions(df, text, places, total), ["low", "before", "after"]).groupBy("page").agg(F.collect_set(F.struct("line", "at", "head", "read", "better")).alias("repairs"))
    source = scanned(df, text, ocr).select(F.col(f"`{key}`").alias("key"), F.col(text).alias("text"), F.col(ocr).alias("ocr"), F.md5(F.col(text)).alias("page")).join(taken, "page", "left")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, o, found in zip(b["key"], b["text"], b["ocr"], b["repairs"]):
                page = read_page(t, ask=False)
                repairs = [tuple(x.values()) for x in found] if found is not None else []
                if _scan(t, o, [*page.kinds, *((0, "chars") for _ in repairs)]):
                    rows.append((k, "\n\n".join(mended(page, repairs)), len(repairs)))
            yield pd.DataFrame(rows, columns=["key", "repaired", "n_repairs"])

    return source.mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)
