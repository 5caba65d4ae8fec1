"""Near-duplicate records: MinHash with tensored banding, exact verification, classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..session import checkpointed
from .text import lists, mix, shingle_codes, word_codes, words


@dataclass(frozen=True)
class Banding:
    """Tensored banding: `groups` times two sides of `collections` half keys, of `rows` MinHash values each.

    Within a group a table key joins half key i of the left with half key j of the right
    side, so collections**2 tables of 2 * rows values come from 2 * collections half keys.
    Two texts of similarity s meet in some table of a group with chance
    (1 - (1 - s**rows)**collections)**2, and groups are independent.
    """

    collections: int = 3
    rows: int = 2
    groups: int = 10
    seed: int = 20240229

    @property
    def tables(self) -> int:
        return self.groups * self.collections**2

    @property
    def hashes(self) -> int:
        return self.groups * 2 * self.collections * self.rows

    def chance(self, s: float) -> float:
        """The chance that two texts of similarity `s` meet in some table."""
        return 1 - (1 - (1 - (1 - s**self.rows) ** self.collections) ** 2) ** self.groups


#: The lowest chance with which a pair at the threshold must meet, and the most tables spent on longer keys for it.
CHANCE, TABLES = 0.9995, 100


def banding_for(threshold: float, chance: float = CHANCE) -> Banding:
    """The tensored banding of the longest keys (fewest candidates) within TABLES tables that reaches `chance` at `threshold`.

    Of equal key lengths that of the fewest hash functions and tables together is taken;
    keys of one row a side are taken whatever they need, so the chance is always reached.
    At 0.6 ten groups of 3 by 3 half keys give 90 tables of 4 values from 120 hash
    functions, where independent tables would need 360.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"no banding for the threshold {threshold}")
    best: Banding | None = None
    for rows in range(1, 9):
        choices = []
        for m in range(1, 7):
            meet = (1 - (1 - threshold**rows) ** m) ** 2
            groups = max(1, ceil(log(1 - chance) / log(1 - meet))) if meet < 1 else 1
            choices.append(Banding(m, rows, groups))
        fit = min(choices, key=lambda c: c.hashes + c.tables)
        if best and fit.tables > TABLES:
            return best
        best = fit
    return best


#: Shingles that are hashed at a time.
HASHED = 1 << 15


def signatures(shingles: np.ndarray, offsets: np.ndarray, banding: Banding) -> np.ndarray:
    """MinHash values, one row per text (of at least one shingle) and one column per hash function."""
    count = banding.hashes
    salts = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(banding.seed))
    out = np.empty((len(offsets) - 1, count), np.uint32)
    base = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    first = 0
    while first < len(out):  # blocks of texts that stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + HASHED, "right")) - 1)
        part, starts = base[offsets[first] : offsets[last]], offsets[first:last] - offsets[first]
        h, shifted = np.empty_like(part), np.empty_like(part)
        for k in range(count):
            np.multiply(part, np.uint32(salts[k] | np.uint64(1)), out=h)
            h += np.uint32(salts[k] >> np.uint64(32))
            np.right_shift(h, np.uint32(15), out=shifted)
            h ^= shifted
            h *= np.uint32(0x85EBCA6B)
            np.right_shift(h, np.uint32(13), out=shifted)
            h ^= shifted
            out[first:last, k] = np.minimum.reduceat(h, starts)
        first = last
    return out


def table_keys(signature: np.ndarray, banding: Banding) -> np.ndarray:
    """The table keys of each text, group by group."""
    m, rows, n = banding.collections, banding.rows, len(signature)
    halves = np.zeros((n, banding.groups * 2 * m), np.uint64)
    by_half = signature.reshape(n, -1, rows)
    for r in range(rows):
        halves = mix(halves * np.uint64(0x9E3779B97F4A7C15) + by_half[:, :, r])
    sides = halves.reshape(n, banding.groups, 2, m)
    left, right = sides[:, :, 0, :, None], sides[:, :, 1, None, :]
    table = np.arange(banding.tables, dtype=np.uint64).reshape(1, banding.groups, m, m)
    return mix(left * np.uint64(3) + right * np.uint64(0x9E3779B97F4A7C15) + table).reshape(n, banding.tables)


def _sets(column: pa.Array, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts with enough words: their rows, flat sorted shingle sets, offsets, and a hash of each set."""
    flat, offs = words(column)
    grams, goffs = shingle_codes(word_codes(flat), offs, n)
    keep = np.flatnonzero(np.diff(offs) >= max(min_words, n))
    if not len(keep):
        return keep, np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(goffs) - 1), np.diff(goffs))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
    mine = np.zeros(len(goffs) - 1, bool)
    mine[keep] = True
    new &= mine[owner]
    grams, owner = grams[new], owner[new]
    sizes = np.bincount(owner, minlength=len(goffs) - 1)[keep]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    same = np.add.reduceat(mix(grams), ends[:-1]) ^ sizes.astype(np.uint64)
    return keep, grams, ends, same.view(np.int64)


#: 64-bit words of a class's parity bitmap.
PARITY = 8


def _parity(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """PARITY numbers per set; each shingle flips one bit, so sets differ in at least as many shingles as bits."""
    bits, sets = PARITY * 64, len(ends) - 1
    at = np.repeat(np.arange(sets) * bits, np.diff(ends)) + (mix(grams) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=sets * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(sets, bits), axis=1, bitorder="little").view(np.int64)


def class_of(df: DataFrame, key: str, text: str, n: int, min_words: int) -> DataFrame:
    """Of each row with enough words: `key`, `same`, a hash of its shingle set, `size` of the set and its bitmap `p0`, `p1`..."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            keep, grams, ends, same = _sets(b.column(1), n, min_words)
            if not len(keep):
                continue
            parity = _parity(grams, ends)
            columns = [pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(same), pa.array(np.diff(ends).astype(np.int32)), *columns], names=[key, "same", "size", *(f"p{i}" for i in range(PARITY))])

    bitmap = ", ".join(f"p{i} bigint" for i in range(PARITY))
    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, same bigint, size int, {bitmap}")


def possible(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs that sizes and bitmaps of `class_of` don't prove to be less alike than `threshold`; none that is alike is lost."""
    bitmap = [f"p{i}" for i in range(PARITY)]
    one = known.groupBy("same").agg(*(F.first(c).alias(c) for c in ("size", *bitmap)))
    left, right = (one.select(F.col("same").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("size", *bitmap))) for x in "ab")
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in bitmap), F.lit(0))
    least = F.greatest(differ, F.abs(F.col("a_size") - F.col("b_size")))
    # of sets alike by t, at most (1 - t) / (1 + t) of all shingles are in one only
    most = (1 - threshold) / (1 + threshold) * (F.col("a_size") + F.col("b_size")) + 1e-6
    return pairs.join(left, "a").join(right, "b").where(least <= most).select("a", "b")


def _fresh(same: np.ndarray, seen: set) -> np.ndarray:
    """Rows whose class this task has not met before, so that copies leave a task once."""
    rows = []
    for i, x in enumerate(same.tolist()):
        if x not in seen:
            seen.add(x)
            rows.append(i)
    return np.array(rows, np.int64)


def set_of(df: DataFrame, text: str, n: int, min_words: int) -> DataFrame:
    """`same` and `grams` (32-bit shingle hashes), each class once per task."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches_:
            _, grams, ends, same = _sets(b.column(0), n, min_words)
            column = lists((grams >> np.uint64(32)).astype(np.uint32).view(np.int32), ends, pa.int32())
            rows = pa.array(_fresh(same, seen))
            yield pa.RecordBatch.from_arrays([pa.array(same).take(rows), column.take(rows)], names=["same", "grams"])

    return df.select(text).mapInArrow(run, "same bigint, grams array<int>")


def bucketed(df: DataFrame, text: str, n: int, min_words: int, banding: Banding, hot: frozenset = frozenset()) -> DataFrame:
    """`bucket`, `same` and `salt`: the table keys of each class, once per task; rows of `hot` buckets are spread over salts from 1 on."""
    known = np.array(sorted(hot), np.int64)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches_:
            _, grams, ends, same = _sets(b.column(0), n, min_words)
            rows = _fresh(same, seen)
            if not len(rows):
                continue
            keys = table_keys(signatures(grams, ends, banding)[rows], banding)
            buckets, owner = keys.reshape(-1).view(np.int64), np.repeat(same[rows], keys.shape[1])
            salt = np.where(np.isin(buckets, known), 1 + (owner % SALTS), 0) if len(known) else np.zeros(len(buckets), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(owner), pa.array(salt.astype(np.int32))], names=["bucket", "same", "salt"])

    return df.select(text).mapInArrow(run, "bucket bigint, same bigint, salt int")


#: Into how many parts a hot bucket is spread, the rows that are looked at to find such buckets, and the part of them that makes one hot.
SALTS, LOOKED_AT, HOT = 64, 4096, 1 / 64


def hot_buckets(df: DataFrame, key: str, text: str, n: int, min_words: int, banding: Banding) -> frozenset:
    """Buckets that hold much of a few thousand rows; at most tables / HOT of them, whatever the table.

    This only plans how work is spread: rows of any bucket are all paired, hot or not.
    """
    every = df.count() // LOOKED_AT + 1
    some = df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(every)) == 0).select(text)
    counts = bucketed(some, text, n, min_words, banding).distinct().groupBy("bucket").count().where(F.col("count") >= LOOKED_AT * HOT)
    return frozenset(r[0] for r in counts.select("bucket").collect())


#: A bucket with more classes than this is split into blocks that are paired in tasks of their own.
BLOCK = 1000


def _meet(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (`a`, `b`) of classes within each bucket of rows sorted by bucket and class.

    Classes of a bucket that is salted or has more than BLOCK of them are passed on
    instead, as they come: the class in `a`, its bucket in `bucket`, with no `b`.  So no
    more than BLOCK classes of a bucket are ever held.
    """

    def out(a: np.ndarray, b: np.ndarray | None, bucket: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if bucket is None else pa.array(bucket)], names=["a", "b", "bucket"])

    def pairs(k: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k) < 2:
            return
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        k, s = k[new], s[new]
        sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k)))
        large = np.repeat(sizes > BLOCK, sizes)
        if large.any():
            yield out(s[large], None, k[large])
        k, s = k[~large], s[~large]
        d = 1
        while d < len(k):
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            yield out(s[same], s[same + d])
            d += 1

    rest_k, rest_s, passing = [], [], None
    for b in batches_:
        k, s, salt = (np.asarray(b.column(i)) for i in range(3))
        if (salt > 0).any():
            yield out(s[salt > 0], None, k[salt > 0])
            k, s = k[salt == 0], s[salt == 0]
        if passing is not None and len(k):  # the bucket is large: its classes go on at once
            more = int(np.searchsorted(k != passing, True))
            if more:
                yield out(s[:more], None, k[:more])
                k, s = k[more:], s[more:]
            if len(k):
                passing = None
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (rest_k and rest_k[-1][-1] != k[0]):
            yield from pairs(np.concatenate([*rest_k, k[:cut]]), np.concatenate([*rest_s, s[:cut]]))
            rest_k, rest_s = [], []
        rest_k.append(k[cut:])
        rest_s.append(s[cut:])
        if sum(map(len, rest_k)) > 4 * BLOCK:
            yield out(np.concatenate(rest_s), None, np.concatenate(rest_k))
            passing, rest_k, rest_s = rest_k[-1][-1], [], []
    if rest_k:
        yield from pairs(np.concatenate(rest_k), np.concatenate(rest_s))


def block_pairs(large: DataFrame) -> DataFrame:
    """All pairs (`a` < `b`) within each `bucket` of classes `a`, in blocks of about BLOCK by BLOCK; sizes are counted before the shuffle."""
    sizes = large.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    placed = salted_join(large.select("bucket", "a"), sizes, "bucket", "inner").withColumn("g", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
    left = placed.select("bucket", F.col("g").alias("i"), F.explode(F.sequence(F.col("g"), F.col("n") - 1)).alias("j"), F.col("a").alias("x"))
    right = placed.select("bucket", F.explode(F.sequence(F.lit(0), F.col("g"))).alias("i"), F.col("g").alias("j"), F.col("a").alias("y"))
    met = left.join(right, ["bucket", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_pairs(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, min_words: int = 0, banding: Banding | None = None) -> tuple[DataFrame, DataFrame]:
    """(`links`, `members`): similar pairs of class representatives, and the class of each record.

    `members` has `key` and `same`, the class of texts with one and the same shingle set;
    `links` has `a`, `b` (two classes, a < b) and `jaccard`, each at least `threshold`,
    verified on the whole sets.  A text counts if it has `min_words` words and a shingle;
    null, empty and shorter texts are in neither result, an empty table gives none.
    Repeated rows and copies are one class and never multiply pairs.  Candidates come from
    all tables without a cap; the pairs of a large bucket are made in blocks by many tasks.
    The banding is that of `threshold` unless one is given: a pair right at the threshold
    meets in some table with chance 0.9995 or more by `Banding.chance`, a more similar one
    with a higher chance.  Shingle sets are built anew where they are needed
    (a few CPU seconds) instead of being stored (more disk than the texts themselves).
    """
    banding = banding or banding_for(threshold)
    known = checkpointed(class_of(df, key, text, n, min_words).distinct())
    members = known.select(key, "same")
    hot = hot_buckets(df, key, text, n, min_words, banding)
    keyed = bucketed(df, text, n, min_words, banding, hot).repartition("bucket", "salt").sortWithinPartitions("bucket", "same")
    met = checkpointed(keyed.mapInArrow(_meet, "a bigint, b bigint, bucket bigint").distinct())
    pairs, large = met.where("b is not null").select("a", "b"), met.where("b is null").select("bucket", "a")
    if not large.isEmpty():
        pairs = checkpointed(pairs.unionByName(block_pairs(large)).distinct())
    pairs = checkpointed(possible(pairs, known, threshold))
    need = pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct()
    sets = set_of(df, text, n, min_words).join(need, "same", "left_semi").groupBy("same").agg(F.first("grams").alias("grams"))
    verified = (
        pairs.join(sets.select(F.col("same").alias("a"), F.col("grams").alias("ga")), "a")
        .join(sets.select(F.col("same").alias("b"), F.col("grams").alias("gb")), "b")
        .withColumn("both", F.size(F.array_intersect("ga", "gb")))
        .select("a", "b", (F.col("both") / (F.size("ga") + F.size("gb") - F.col("both"))).alias("jaccard"))
    )
    return verified.where(F.col("jaccard") >= threshold), members


def classes(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """`key`, `group_id` (the smallest class of its connected component) and `n_links` of its class.

    A class with a third of all links, and the label of a component with a third of all
    classes, are spread over many tasks.
    Labels spread along links and jump to the label of their label, each round one
    join and a checkpoint, until no label changes: the rounds grow with the logarithm
    of the longest chain.  No component is ever gathered in one task.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("same"), "label")
    labels = checkpointed(labels)
    hubs = hot_keys(both, "b")
    while True:
        near = salted_join(both, labels.withColumnRenamed("same", "b"), "b", "inner", hubs).groupBy(F.col("a").alias("same")).agg(F.min("label").alias("near"))
        step = labels.join(near, "same", "left").select("same", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("same").alias("low"), F.col("label").alias("far"))
        step = checkpointed(salted_join(step, jump, "low").select("same", F.col("label").alias("old"), F.least("low", F.coalesce("far", "low")).alias("label")))
        labels = step.select("same", "label")
        if step.where("old <> label").isEmpty():
            break
    degree = both.groupBy(F.col("a").alias("same")).agg(F.count(F.lit(1)).alias("n_links"))
    joined = members.join(labels, "same", "left").join(degree, "same", "left")
    return joined.select(key, F.coalesce("label", "same").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
