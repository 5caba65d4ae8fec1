"""Tokens, snippets and highlighting as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case words (runs of letters and digits); an empty array for null or blank text."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def tokens_cjk(text: Column | str) -> Column:
    """As `tokens`, with each run of Han characters also cut into overlapping pairs, so words inside it are found."""
    t = tokens(text)
    pairs = F.flatten(
        F.transform(
            F.filter(t, lambda x: x.rlike(r"^\p{IsHan}{3,}$")),
            lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x) - 1), lambda i: x.substr(i, F.lit(2))),
        )
    )
    return F.concat(t, pairs)


def query_words(text: str) -> list[str]:
    """The words of a query, as `tokens` would cut them."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def joined(tok: Column) -> Column:
    """The tokens with one space between and around them: a phrase is a substring of this."""
    return F.concat(F.lit(" "), F.array_join(tok, " "), F.lit(" "))


def contains_phrase(tok_joined: Column, words: list[str]) -> Column:
    return F.contains(tok_joined, F.lit(f" {' '.join(words)} "))


def within_one_edit(t: Column, q: str) -> Column:
    """Damerau distance of at most 1 (an adjacent swap counts as one edit)."""
    swaps = [q[:i] + q[i + 1] + q[i] + q[i + 2 :] for i in range(len(q) - 1)]
    close = (F.abs(F.char_length(t) - len(q)) <= 1) & (F.levenshtein(t, F.lit(q), 1) >= 0)
    return close | t.isin([s for s in swaps if s != q]) if swaps else close


def html_escape(c: Column | str) -> Column:
    out = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlight(text: Column | str, terms: list[str], tag: str = "b", most: int | None = 20) -> Column:
    """HTML-escaped text with the terms in tags, whatever their case (the `most` longest; None: all)."""
    safe = html_escape(text)
    if not terms:
        return safe
    either = "|".join(re.escape(t) for t in sorted(set(terms), key=len, reverse=True)[:most])
    return F.regexp_replace(safe, rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", f"<{tag}>$1</{tag}>")


def snippet(text: Column | str, terms: list[str], width: int = 150, most: int | None = 20) -> Column:
    """About `width` characters around the first term found, highlighted; the beginning if none is."""
    c = F.coalesce(_c(text), F.lit(""))
    if not terms:
        return highlight(F.left(c, F.lit(width)), [])
    low = F.lower(c)
    at = F.array_min(F.filter(F.array(*[F.instr(low, t) for t in terms[:most]]), lambda i: i > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - width // 3)
    return highlight(c.substr(start, F.lit(width)), terms, most=most)


def match_count(text: Column | str, terms: list[str]) -> Column:
    """Occurrences of the distinct terms in the text, overlapping ones included, whatever their case."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    total = F.lit(0)
    for t in dict.fromkeys(x.lower() for x in terms if x):
        total = total + F.size(F.regexp_extract_all(low, F.lit(f"(?={re.escape(t)})"), F.lit(0)))
    return total
