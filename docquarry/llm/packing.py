"""Documents packed into context windows of a fixed number of tokens."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Where the vocabulary files of public tokenizers lie, unless the caller says otherwise.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SALTS = 64


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    lines = Path(path).read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of a text by a byte-level vocabulary file; 0 for null and empty texts."""

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return pd.Series([len(encode(x)) if isinstance(x, str) and x else 0 for x in s], dtype="int32")

    return count(text)


def _best_two(sizes: list[int], counts: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two items (a >= b) of greatest sum within the room."""
    best = None
    low, high = 0, len(sizes) - 1
    while low <= high:
        a, b = sizes[high], sizes[low]
        if a + b > room or (low == high and counts[a] < 2):
            high -= 1
            continue
        if best is None or a + b > sum(best) or (a + b == sum(best) and a > best[0]):
            best = (a, b)
        low += 1
    return best


def _smallest(sizes: list[int], counts: dict[int, int], n: int, above: int = 0) -> list[int]:
    """The `n` smallest items greater than `above`."""
    out: list[int] = []
    for s in sizes[bisect_left(sizes, above + 1) :]:
        out += [s] * min(counts[s], n - len(out))
        if len(out) == n:
            break
    return out


def reduce_pairs(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Martello-Toth dominance on a size histogram: bins that some best solution contains.

    Takes from `counts` and returns (content, times).  From the largest size on: a bin
    filled exactly by two items dominates every bin with the first; a size whose room
    admits at most one more item goes with the largest that fits, and alone if none does.
    Where at most two more fit: the largest alone, if it is as large as any fitting two;
    or the best two, if the larger of them is the largest that fits at all and no two
    items greater than the smaller of them fit together.  It ends at the first size whose
    room admits three of the smallest items, as it does for all smaller sizes then.
    """
    fixed = []

    def fix(content: list[int]) -> None:
        each = {s: content.count(s) for s in content}
        times = min(counts[s] // n for s, n in each.items())
        for s, n in each.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
        fixed.append((each, times))

    for s in sorted(counts, reverse=True):
        if s not in counts:
            continue
        if s == capacity:
            fix([s])
        elif 2 * s == capacity:
            if counts[s] > 1:
                fix([s, s])
        elif 2 * s > capacity and capacity - s in counts:
            fix([s, capacity - s])
    for big in sorted(counts, reverse=True):
        room = capacity - big
        while counts.get(big, 0):
            counts[big] -= 1  # the others, without this one
            rest = {s: n for s, n in counts.items() if n}
            sizes = sorted(rest)
            counts[big] += 1
            fit = sizes[: bisect_left(sizes, room + 1)]
            if not fit:
                fix([big])
                continue
            mate = fit[-1]
            few = _smallest(fit, rest, 3)
            if len(few) == 1 or few[0] + few[1] > room:
                fix([big, mate])
                continue
            if len(few) == 3 and sum(few) <= room:
                return fixed
            a, b = _best_two(fit, rest, room)
            if mate >= a + b:
                fix([big, mate])
                continue
            above = _smallest(fit, {**rest, a: rest[a] - 1}, 2, b)
            if mate == a and (len(above) < 2 or sum(above) > room):
                fix([big, a, b])
                continue
            break
    return fixed


def least_windows(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second lower bound on the number of windows.

    For a size k, items over capacity - k stand alone, those over half a window need one
    each, and those from k on that don't fit beside the latter need further ones.
    """
    sizes = np.array(sorted(s for s, n in counts.items() if n and 0 < s <= capacity), np.int64)
    if not len(sizes):
        return 0
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for k in [0, *sizes[sizes * 2 <= capacity].tolist()]:
        alone, large, small = sizes > capacity - k, (sizes <= capacity - k) & (sizes * 2 > capacity), (sizes * 2 <= capacity) & (sizes >= k)
        left = int((sizes[small] * n[small]).sum()) - (int(n[large].sum()) * capacity - int((sizes[large] * n[large]).sum()))
        best = max(best, int(n[alone].sum() + n[large].sum()) + max(0, -(-left // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a size histogram, many equal bins at a time: (content, times)."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    rooms: list[int] = []
    done: list[tuple[dict[int, int], int]] = []

    def put(room: int, content: dict[int, int], times: int) -> None:
        if times and room:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((content, times))
        elif times:
            done.append((content, times))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                content, times = groups[room].pop()
                if not groups[room]:
                    rooms.pop(i)
            else:
                room, content, times = capacity, {}, left
            each = min(room // s, left)
            use = min(times, left // each)
            put(room - each * s, {**content, s: content.get(s, 0) + each}, use)
            if content:
                put(room, content, times - use)
            left -= use * each
    return done + [g for r in groups.values() for g in r]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Contents of all windows for a histogram of sizes from 1 to capacity."""
    left = {s: n for s, n in counts.items() if n and 0 < s <= capacity}
    fixed = reduce_pairs(left, capacity)
    return fixed + best_fit(left, capacity)


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """`key`, `piece_no`, `n_tokens`, `window_id`: the window of each text or piece of one.

    A text longer than a window is split into full windows and a rest; no other text is
    split.  Texts without tokens (null or empty) take no room: they are in window 0.
    Repeated rows are items of their own; an empty table gives no rows.  `key` should be
    unique; other columns are left out.

    The plan is made from the histogram of sizes (at most `capacity` rows come to the
    driver, whatever the number of texts).  Items get their place by their rank among
    those of their size; ranks are counted in SALTS parts, so a size that a third of all
    texts share is spread over that many tasks.
    """
    sized = df.select(F.col(f"`{key}`").alias("key"), token_count(F.col(f"`{text}`"), tokenizer).alias("n"))
    full = F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / capacity).cast("int")
    item = F.posexplode(F.transform(F.sequence(F.lit(0), full), lambda i: F.least(F.lit(capacity), F.col("n") - i * capacity).cast("int")))
    items = sized.select("key", item.alias("piece", "size")).withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(SALTS)).cast("int"))
    items = checkpointed(items)
    parts = items.groupBy("size", "salt").count()
    counts = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.sum("count").alias("n")).where("size > 0").collect()}
    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    window = 0
    for content, times in plan(counts, capacity):
        for s, each in content.items():
            ranges[s].append((used[s], window, each))
            used[s] += each * times
        window += times
    table = {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in ranges.items()}

    @F.pandas_udf("long")
    def window_of(size: pd.Series, rank: pd.Series) -> pd.Series:
        sizes, ranks = size.to_numpy(), rank.to_numpy().astype(np.int64)
        out = np.zeros(len(sizes), np.int64)
        for s in np.unique(sizes):
            if s in table:
                lo, base, each = table[s]
                at = np.flatnonzero(sizes == s)
                i = np.searchsorted(lo, ranks[at], side="right") - 1
                out[at] = base[i] + (ranks[at] - lo[i]) // each[i]
        return pd.Series(out)

    before = parts.withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = items.withColumn("at", F.row_number().over(Window.partitionBy("size", "salt").orderBy("key", "piece")))
    placed = ranked.join(before.drop("count"), ["size", "salt"]).withColumn("rank", F.col("at") - 1 + F.coalesce("before", F.lit(0)))
    return placed.select(F.col("key").alias(key), (F.col("piece") + 1).alias("piece_no"), F.col("size").alias("n_tokens"), window_of("size", "rank").alias("window_id"))
