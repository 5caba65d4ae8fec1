"""Passages of evaluation items in documents: greedy string tiling on shared word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.skew import salted_join
from ..session import checkpointed
from .text import lists, mix, shingle_codes, word_codes, words

#: Bits of the filter of the items' seeds that goes to each task, whatever the number of items (2**26 bits are 8 MB).
FILTER_BITS = 1 << 26
#: Pairs of equal seeds that are listed at once; more are gone through by groups.
LISTED = 100_000


def _seeds(codes: np.ndarray, least: int) -> np.ndarray:
    return shingle_codes(codes, np.array([0, len(codes)]), least)[0]


def runs(doc: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal runs of equal seeds (place in the document, place in the item, length).

    Only pairs of places at which a run begins are listed: those whose seeds before
    differ.  So a word repeated a thousand times in both texts gives a run per diagonal
    and not a million pairs.
    """
    shared = np.intersect1d(doc, item)
    if not len(shared):
        return
    d_at, i_at = np.flatnonzero(np.isin(doc, shared)), np.flatnonzero(np.isin(item, shared))
    d_at, i_at = d_at[np.argsort(doc[d_at], kind="stable")], i_at[np.argsort(item[i_at], kind="stable")]
    d_lo, i_lo = np.searchsorted(doc[d_at], shared), np.searchsorted(item[i_at], shared)
    d_hi, i_hi = np.append(d_lo[1:], len(d_at)), np.append(i_lo[1:], len(i_at))

    def begins(d: np.ndarray, i: np.ndarray) -> Iterator[tuple[int, int]]:
        first = (d == 0) | (i == 0)
        first[~first] = doc[d[~first] - 1] != item[i[~first] - 1]
        yield from zip(d[first].tolist(), i[first].tolist())

    def starts() -> Iterator[tuple[int, int]]:
        for a, b, c, e in zip(d_lo, d_hi, i_lo, i_hi):
            d, i = d_at[a:b], i_at[c:e]
            if len(d) * len(i) <= LISTED:
                yield from begins(np.repeat(d, len(i)), np.tile(i, len(d)))
                continue
            before_d, before_i = np.where(d > 0, doc[d - 1], 0), np.where(i > 0, item[i - 1], 0)
            for v in np.unique(before_d[d > 0]):  # places with one seed before against those with another
                other = i[(before_i != v) | (i == 0)].tolist()
                for at in d[(before_d == v) & (d > 0)].tolist() if other else ():
                    yield from ((at, x) for x in other)
            if (d == 0).any():
                yield from ((0, x) for x in i.tolist())

    for d, i in starts():
        n = min(len(doc) - d, len(item) - i)
        differ = doc[d : d + n] != item[i : i + n]
        end = int(np.argmax(differ)) if differ.any() else n
        yield d, i, end


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Longest non-overlapping common runs of word codes (place in the document, place in the item, length).

    Runs are found by Karp-Rabin hashes of `least` words; they are marked from the
    longest on (on a tie the first in the document), cut back to what is not marked yet,
    and kept while they have `least` words.
    """
    heap = [(-(n + least - 1), d, i) for d, i, n in runs(_seeds(doc, least), _seeds(item, least))]
    heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, a, b = heappop(heap)
        n = -n
        taken = in_doc[a : a + n] | in_item[b : b + n]
        if not taken.any():
            in_doc[a : a + n] = in_item[b : b + n] = True
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= least:
                heappush(heap, (s - e, a + s, b + s))
    return sorted(out)


def _positions(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return seed % np.uint64(bits), mix(seed ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)


def _item_words(items: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """`item`, `no` (one number per key and text), `codes` of its words and distinct `seeds`; once for repeated rows."""
    item_type = to_arrow_type(items.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offs = words(b.column(2), fold=True)
            codes = word_codes(flat)
            grams, goffs = shingle_codes(codes, offs, least)
            some = np.flatnonzero(np.diff(goffs) > 0)
            each = [np.unique(grams[goffs[i] : goffs[i + 1]]) for i in some]
            own = [codes[offs[i] : offs[i + 1]] for i in some]
            flat_of = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (own, each)]
            columns = [lists(f, np.cumsum([0, *map(len, x)])) for f, x in zip(flat_of, (own, each))]
            take = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take).cast(item_type), b.column(1).take(take), *columns], names=["item", "no", "codes", "seeds"])

    once = items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null").distinct()
    return once.select("item", F.xxhash64("item", "text").alias("no"), "text").mapInArrow(run, f"item {items.schema[key].dataType.simpleString()}, no bigint, codes array<bigint>, seeds array<bigint>")


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """A packed bitmap with two bits for each seed, built by the cluster; `bits` bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_positions(np.asarray(b.column(0)).view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at) + 1)], names=["at"])

    at = seeds.select("seed").mapInArrow(run, "at bigint")
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for r in parts.toLocalIterator():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 12, bits: int = FILTER_BITS) -> DataFrame:
    """Each document with each item of which it has `least` words in a row.

    Columns: `key`, `item_key`, `n_tiles`, `longest`, `covered` (the part of the item's
    words in tiles, so passages in another order count together).  Words are compared
    without accents, case, punctuation and white space.  Null and empty texts and items of
    fewer words than `least` match nothing; repeated document rows give repeated rows,
    repeated items count once; no items or no documents give no rows.

    Documents are read once.  A filter of fixed size holds the items' seeds (hashes of
    `least` words in a row); a document with none of them goes no further, whichever way
    items are many or few.  The seeds of the others are joined with those of the items,
    hot ones spread, and each pair of document and item that meets is tiled.  However many
    items there are, no more of them than the filter goes to the driver or to every task.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    own = checkpointed(_item_words(items, item_key, item_text, least))
    seeds = own.select(F.explode("seeds").alias("seed"), "no")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(seeds, bits))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            flat, offs = words(b.column(2), fold=True)
            codes = word_codes(flat)
            grams, goffs = shingle_codes(codes, offs, least)
            hit = np.arange(len(grams))
            for at in _positions(grams, bits):
                at = at[hit]
                hit = hit[(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
            if not len(hit):
                continue
            owner = np.searchsorted(goffs, hit, side="right") - 1
            some = np.unique(owner)
            each = [np.unique(grams[hit[owner == i]]) for i in some]
            mine = [codes[offs[i] : offs[i + 1]] for i in some]
            columns = [lists(np.concatenate(x), np.cumsum([0, *map(len, x)])) for x in (mine, each)]
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *columns], names=["key", "row", "codes", "seeds"])

    source = docs.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"))
    hits = checkpointed(source.mapInArrow(wanted, f"key {kind}, row bigint, codes array<bigint>, seeds array<bigint>"))
    met = salted_join(hits.select("row", F.explode("seeds").alias("seed")), seeds, "seed", "inner").select("row", "no").distinct()
    both = salted_join(met, own.select("no", "item", F.col("codes").alias("words")), "no", "inner").join(hits.select("row", "key", "codes"), "row")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (doc, doc_at), (item, item_at) = ((np.asarray(c.values).view(np.uint64), np.asarray(c.offsets)) for c in (b.column(2), b.column(3)))
            rows = []
            for i in range(b.num_rows):
                mine = item[item_at[i] : item_at[i + 1]]
                found = tiles(doc[doc_at[i] : doc_at[i + 1]], mine, least)
                if found:
                    rows.append((i, len(found), max(t[2] for t in found), sum(t[2] for t in found) / len(mine)))
            if rows:
                at, n, longest, covered = zip(*rows)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(n, pa.int32()), pa.array(longest, pa.int32()), pa.array(covered, pa.float64())], names=["key", "item", "n_tiles", "longest", "covered"])

    found = both.select("key", "item", "codes", "words").mapInArrow(tiled, f"key {kind}, item {item_kind}, n_tiles int, longest int, covered double")
    return found.withColumnsRenamed({"key": key, "item": item_key})
