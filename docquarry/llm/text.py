"""Vectorised word and shingle handling on Arrow arrays (no per-word Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words(texts: pa.Array, fold: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one flat array, and the offsets of each text in it.

    A word is a maximal run of Unicode letters and digits in lower case; `fold` also
    takes accents and compatibility forms away first.  A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if fold:
        texts = pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFKD"), pattern=r"\p{M}+", replacement="")
    split = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=r"[^\p{L}\p{N}]+")
    flat, starts = split.values, np.asarray(split.offsets)
    full = np.asarray(pc.not_equal(flat, ""))
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[starts - starts[0]]


def word_codes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash per word; each distinct word is hashed once."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return codes[np.asarray(coded.indices)]


def shingle_codes(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences of each text, and their offsets; no sequence crosses texts."""
    lengths = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(lengths)])
    if len(codes) < n:
        return np.zeros(0, np.uint64), out
    rolled = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        rolled = rolled * _M + codes[i : len(codes) - n + 1 + i]
    at = np.repeat(offsets[:-1] - out[:-1], lengths) + np.arange(out[-1])
    return mix(rolled[at]), out


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    flat = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)


def batches(columns: dict[str, pa.Array], template: list[str]) -> pa.RecordBatch:
    """A record batch with the columns in the order of `template`."""
    return pa.RecordBatch.from_arrays([columns[c] for c in template], names=template)
