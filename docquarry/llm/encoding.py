"""Texts decoded with a wrong character encoding: found through clean twins, and restored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

# Fixed values: (true encoding, encoding it was read in) that an alignment may turn out to follow.
# "web" is windows-1252 whose five free places are control characters.
HYPOTHESES = (
    *(("utf-8", wrong) for wrong in ("web", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "gbk", "big5")),
    *(("cp1252", wrong) for wrong in ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp866", "cp1253", "iso8859_2")),
    *(("mac_roman", wrong) for wrong in ("web", "cp437", "cp850", "cp1251")),
    *((true, wrong) for true in ("cp437", "cp850") for wrong in ("web", "mac_roman")),
    *(("gbk", wrong) for wrong in ("web", "mac_roman", "cp437", "cp850", "cp1251")),
    ("big5", "web"),
    ("cp1251", "web"),
    ("utf-8+utf-8", "web"),
)
#: Distinct aligned words that a transformation must explain before it is believed.
SUPPORT = 3
#: The same for a mapping of characters that follows no hypothesis, the part of a run's alignments that must agree, and how much more frequent the clean word must be.
MAPPED, AGREED, CLEARLY = 5, 0.9, 5
#: ASCII characters that two records must have in common to be twins.
TWIN_CHARS = 40
LOST = "�"
_CHANGED = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    table = {}
    for b in range(128, 256):
        name = "cp1252" if encoding == "web" else encoding
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if encoding == "web":
        table.update({chr(b): b for b in range(128, 256) if chr(b) not in table})
    return table


@lru_cache(maxsize=200_000)
def undo(text: str, hypothesis: int) -> str | None:
    """The text whose bytes in the true encoding were read as `text`; None if there is none."""
    true, wrong = HYPOTHESES[hypothesis]
    if LOST in text:
        return None
    for once in true.split("+"):
        try:
            if wrong in ("gbk", "big5"):
                raw = text.encode(wrong)
            else:
                table = _bytes_of(wrong)
                raw = bytes(ord(c) if c < "\x80" else table[c] for c in text)
            text = raw.decode(once)
        except (KeyError, UnicodeError):
            return None
    return None if any("\x7f" <= c < "\xa0" for c in text) else text


def aligned(bad: str, good: str) -> list[tuple[str, str]] | None:
    """The runs of non-ASCII characters that face each other in two words with the same ASCII characters."""
    a, b = re.split(r"([\x00-\x7f])", bad), re.split(r"([\x00-\x7f])", good)
    if a[1::2] != b[1::2]:
        return None
    return [(x, y) for x, y in zip(a[::2], b[::2]) if x != y]


def explains(pairs: list[tuple[str, str]], hypothesis: int) -> bool:
    return bool(pairs) and all(x and undo(x, hypothesis) == y for x, y in pairs)


def units(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key` and each `unit` of its text: runs of ASCII letters and non-ASCII characters with at least one of the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = pc.invert(pc.string_is_ascii(b.column(1)))
            b = b.filter(pc.fill_null(some, False))
            if not b.num_rows:
                continue
            split = pc.split_pattern_regex(b.column(1).cast(pa.large_string()), pattern=r"[\x00-@\[-`{-\x7f]+")
            flat = split.values
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(split.offsets)))
            coded = flat.dictionary_encode()
            words = coded.dictionary
            odd = np.asarray(pc.invert(pc.string_is_ascii(words)))
            ids = np.asarray(coded.indices)
            keep = odd[ids]
            seen = np.unique(owner[keep].astype(np.int64) * len(words) + ids[keep])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(seen // len(words))), words.take(pa.array(seen % len(words))).cast(pa.string())], names=["key", "unit"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null").mapInArrow(run, f"key {kind}, unit string")


def record_twins(df: DataFrame, text: str) -> DataFrame:
    """`bad`, `good`: texts that differ only in characters beyond ASCII, each with the shortest of its group (garbling lengthens or keeps).

    Groups are found by a hash of what is left without those characters; texts are fetched
    only of groups that have several, and each is paired once.
    """
    left = F.regexp_replace(text, r"[^\x00-\x7f]+", "")
    odd = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.xxhash64(left).alias("left"), F.length(left).alias("n"), F.col(text).alias("text")).where(F.col("n") >= TWIN_CHARS)
    several = odd.select("left", F.xxhash64("text").alias("t")).distinct().groupBy("left").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("left")
    same = odd.join(several, "left", "left_semi").select("left", "text").distinct()
    best = same.groupBy("left").agg(F.min_by("text", F.struct(F.length("text"), F.col("text"))).alias("good"))
    return same.join(best, "left").where("text <> good").select(F.col("text").alias("bad"), "good")


def alignments(vocab: DataFrame, records: DataFrame) -> DataFrame:
    """`h`, `word`: a word whose alignment follows hypothesis h; with h = -1 also `bad`, `good`, runs that follow none.

    Words of `vocab` (`unit`, `df`) are joined on what is left of them without non-ASCII
    characters; of two words the more frequent is the clean one, and a frequent skeleton
    is paired with its few most frequent words only.  `records` are twins of whole texts.
    """
    left = F.regexp_replace("unit", r"[^\x00-\x7f]", "")
    long = vocab.where(~F.col("unit").contains(LOST)).withColumn("left", left).where(F.length("left") >= 3)
    # a clean twin is the most frequent word of its skeleton, so no skeleton is paired with itself
    clean = long.groupBy("left").agg(F.max_by(F.struct(F.col("unit").alias("good"), F.col("df").alias("m")), F.struct("df", "unit")).alias("c")).select("left", "c.*")
    words = long.join(clean, "left").where("unit <> good and df <= m").select("left", F.col("unit").alias("bad"), "good", (F.col("m") >= CLEARLY * F.col("df")).alias("clear"))
    texts = records.select(F.lit(None).cast("string").alias("left"), "bad", "good", F.lit(True).alias("clear"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for word, bad, good, clear in zip(b["left"], b["bad"], b["good"], b["clear"]):
                runs = aligned(bad, good) or []
                for part in [runs] if word is not None else [[x] for x in dict.fromkeys(runs)]:
                    name = word if word is not None else "".join(part[0])
                    follows = [h for h in range(len(HYPOTHESES)) if explains(part, h) or (word is None and explains([(y, x) for x, y in part], h))]
                    rows += [(h, name, None, None) for h in follows]
                    rows += [(-1, name, x, y) for x, y in part if not follows and clear and x and y]
            yield pd.DataFrame(rows, columns=["h", "word", "bad", "good"]).astype({"h": "int32"})

    return words.unionByName(texts).mapInPandas(vote, "h int, word string, bad string, good string")


def mappings(aligned_: DataFrame) -> DataFrame:
    """`bad`, `good`: runs of characters that are always read for others, by alignments that no hypothesis explains.

    A single letter is no such run, as words of languages may differ in it.
    """
    seen = aligned_.where("h = -1").groupBy("bad", "good").agg(F.count_distinct("word").alias("n"))
    best = seen.groupBy("bad").agg(F.max_by("good", F.struct("n", "good")).alias("good"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.where((F.col("n") >= MAPPED) & (F.col("n") >= AGREED * F.col("all")) & ~F.col("bad").rlike(r"^\p{L}$")).select("bad", "good")


def learned(vocab: DataFrame, aligned_: DataFrame, support: int = SUPPORT) -> list[int]:
    """The transformations that alignments with clean twins support.

    Words that leave fewer than three letters (such as Chinese runs) vote if undoing the
    hypothesis gives a more frequent word of the corpus.  At most len(HYPOTHESES) counts
    come to the driver.
    """
    named = vocab.where(~F.col("unit").contains(LOST)).withColumn("left", F.regexp_replace("unit", r"[^\x00-\x7f]", ""))
    short = undone(named.where(F.length("left") < 3).where(F.length("unit") >= 4).select("unit", "df"), list(range(len(HYPOTHESES))))
    clean = named.select(F.col("unit").alias("fixed"), F.col("df").alias("m"))
    known = short.join(clean, "fixed").where("m > df").select("h", F.col("fixed").alias("word"))
    counts = aligned_.where("h >= 0").select("h", "word").unionByName(known).groupBy("h").agg(F.count_distinct("word").alias("n")).where(F.col("n") >= support)
    return sorted(r[0] for r in counts.collect())


def mapped(vocab: DataFrame, table: DataFrame) -> DataFrame:
    """`unit`, `fixed` of the words all of whose non-ASCII runs a mapping restores."""
    runs = F.regexp_extract_all("unit", F.lit(r"[^\x00-\x7f]+"), F.lit(0))
    each = vocab.select("unit", F.size(runs).alias("n"), F.posexplode(runs).alias("at", "bad")).join(table, "bad")
    whole = each.groupBy("unit", "n").agg(F.sort_array(F.collect_list(F.struct("at", "good"))).alias("g")).where(F.size("g") == F.col("n"))
    parts = F.split("unit", r"[^\x00-\x7f]+")
    return whole.select("unit", F.array_join(F.zip_with(parts, F.col("g.good"), lambda p, g: F.concat(p, F.coalesce(g, F.lit("")))), "").alias("fixed"))


def undone(vocab: DataFrame, hypotheses: list[int]) -> DataFrame:
    """`unit`, `df`, `h`, `fixed`: each word with what each hypothesis would make of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, n, h, v) for u, n in zip(b["unit"], b["df"]) for h in hypotheses if (v := undo(u, h)) is not None and v != u]
            yield pd.DataFrame(rows, columns=["unit", "df", "h", "fixed"]).astype({"h": "int32", "df": "int64"})

    return vocab.select("unit", "df").mapInPandas(run, "unit string, df bigint, h int, fixed string")


def usual_characters(vocab: DataFrame) -> frozenset:
    """The non-ASCII characters that words have five times at least; bounded by the characters there are."""
    letters = vocab.select(F.explode(F.array_distinct(F.split("unit", ""))).alias("c"), "df").where("c > '\x7f'")
    return frozenset(r[0] for r in letters.groupBy("c").agg(F.sum("df").alias("n")).where("n >= 5").select("c").collect())


def garbled_units(vocab: DataFrame, hypotheses: list[int], table: DataFrame | None = None) -> DataFrame:
    """`unit`, `fixed` (null where characters were lost), `h` and `strong` of the garbled words.

    A word is garbled if a learned transformation takes it back to a more frequent word
    of the corpus with at least two letters, or if its bytes make characters of a
    multi-byte encoding that the corpus's words use.  A shorter word that goes back to a
    more frequent one is not `strong`: it shows nothing by itself, but is restored in a
    record that other words show to be damaged by the same transformation.  Words that
    only a learned mapping of characters (`table`) restores count as transformation
    len(HYPOTHESES).
    """
    usual = usual_characters(vocab)

    @F.pandas_udf("boolean")
    def sure(unit: pd.Series, fixed: pd.Series, h: pd.Series) -> pd.Series:
        def one(u: str, v: str, i: int) -> bool:
            true, wrong = HYPOTHESES[i]
            if true.startswith("utf-8") or true in ("gbk", "big5"):
                made = [c for c in v if c > "\x7f"]
                least = 2 if true in ("gbk", "big5") or wrong in ("gbk", "big5") else 1
                good = sum(c in usual for c in made)
                return len(made) >= least and good == len(made) or (len(made) > 5 and good >= 0.9 * len(made))
            return False

        return pd.Series([one(u, v, i) for u, v, i in zip(unit, fixed, h)], dtype=bool)

    back = undone(vocab.where(~F.col("unit").contains(LOST)), hypotheses)
    known = vocab.select(F.col("unit").alias("fixed"), F.col("df").alias("m"))
    joined = back.join(known, "fixed", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    wordy = F.length(F.regexp_replace("unit", r"[^A-Za-z]", "")) >= 2
    multibyte = F.col("h").isin([i for i, (true, _) in enumerate(HYPOTHESES) if true.startswith("utf-8") or true in ("gbk", "big5")])  # no accident gives a word of the corpus
    better = (F.col("m") > F.col("df")) | (multibyte & (F.col("m") > 0))
    judged = joined.withColumn("strong", (better & (wordy | (F.length("unit") >= 4))) | sure("unit", "fixed", "h")).where(F.col("strong") | better)
    best = judged.groupBy("unit").agg(F.max_by(F.struct("fixed", "h", "strong"), F.struct("strong", "m", -F.col("h"))).alias("b")).select("unit", "b.fixed", "b.h", "b.strong")
    # a lost character shows damage where it touches a letter; by itself a text may quote it
    inside = F.col("unit").rlike(rf"\p{{L}}{LOST}|{LOST}\p{{L}}")
    lost = vocab.where(F.col("unit").contains(LOST)).select("unit", F.lit(None).cast("string").alias("fixed"), F.lit(-1).alias("h"), inside.alias("strong"))
    if table is not None:
        rest = mapped(vocab.where(wordy & ~F.col("unit").contains(LOST)), table).join(best.select("unit"), "unit", "left_anti")
        best = best.unionByName(rest.select("unit", "fixed", F.lit(len(HYPOTHESES)).alias("h"), F.lit(True).alias("strong")))
    return best.unionByName(lost)


def _studied(df: DataFrame, key: str, text: str, support: int) -> tuple[DataFrame, DataFrame, list[int], DataFrame | None]:
    found = units(df, key, text)
    vocab = checkpointed(found.groupBy("unit").agg(F.count(F.lit(1)).alias("df")))
    pairs = checkpointed(alignments(vocab, record_twins(df, text)))
    table = checkpointed(mappings(pairs))
    return found, vocab, learned(vocab, pairs, support), None if table.isEmpty() else table


def garbled(df: DataFrame, key: str, text: str, support: int = SUPPORT) -> DataFrame:
    """`key`, `unit`, `fixed`, `h`, `strong` of every garbled word of every record; once per record.

    Null, empty and pure ASCII texts have none; repeated rows give repeated words; an
    empty table gives none.  The words of whole texts are looked at.
    """
    found, vocab, hypotheses, table = _studied(df, key, text, support)
    bad = garbled_units(vocab, hypotheses, table)
    return found.join(bad, "unit").select("key", "unit", "fixed", "h", "strong").withColumnRenamed("key", key)


#: A word in so few records may be restored by what other words of its record show, if it has a character that usual words lack.
RARE = 3


def rare_units(vocab: DataFrame, hypotheses: list[int]) -> DataFrame:
    """`unit`, `h`, `fixed`: rare words with unusual characters which a transformation makes letters of the corpus's words."""
    usual = usual_characters(vocab)

    @F.pandas_udf("boolean")
    def plausible(unit: pd.Series, fixed: pd.Series) -> pd.Series:
        def one(u: str, v: str) -> bool:
            made = [c for c in v if c > "\x7f"]
            return bool(made) and all(c in usual and c.isalpha() for c in made) and any(c not in usual or not c.isalpha() for c in u if c > "\x7f")

        return pd.Series([one(u, v) for u, v in zip(unit, fixed)], dtype=bool)

    back = undone(vocab.where((F.col("df") <= RARE) & ~F.col("unit").contains(LOST)), hypotheses)
    return back.where(plausible("unit", "fixed")).select("unit", "h", "fixed")


def restored(df: DataFrame, key: str, text: str, support: int = SUPPORT) -> DataFrame:
    """`key`, `restored` (null where anything was lost) of each affected record, once.

    In a record that shows a transformation, rare words (such as names, which are nowhere
    met clean) are restored by it as well.
    """
    found, vocab, hypotheses, table = _studied(df, key, text, support)
    words = checkpointed(found.join(garbled_units(vocab, hypotheses, table), "unit").select("key", "unit", "fixed", "h", "strong"))
    shown = words.where("strong and h >= 0").select("key", "h").distinct()
    rare = found.join(shown, "key").join(rare_units(vocab, hypotheses), ["unit", "h"]).join(words.select("key", "unit"), ["key", "unit"], "left_anti")
    words = words.unionByName(rare.select("key", "unit", "fixed", "h", F.lit(True).alias("strong"))).groupBy(F.col("key").alias(key))
    every = words.agg(F.collect_set(F.struct("unit", "fixed", "h", "strong")).alias("all"), F.collect_set(F.when(F.col("strong"), F.col("h"))).alias("hs"), F.bool_or(F.col("fixed").isNull()).alias("lost"))
    shown = every.where(F.size("hs") > 0)
    fixes = shown.withColumn("fixes", F.filter("all", lambda x: x["strong"] | F.array_contains("hs", x["h"]))).drop("all", "hs")

    @F.pandas_udf("string")
    def apply(text_: pd.Series, fixes_: pd.Series) -> pd.Series:
        def one(t: str, f) -> str:
            table = {x["unit"]: x["fixed"] for x in f}
            return re.sub(r"[A-Za-z\x80-\U0010ffff]+", lambda m: table.get(m[0], m[0]), t)

        return pd.Series([one(t, f) for t, f in zip(text_, fixes_)])

    whole = df.select(key, text).dropDuplicates([key]).join(fixes, key)
    return whole.select(key, F.when(~F.col("lost"), apply(text, "fixes")).alias("restored"))
