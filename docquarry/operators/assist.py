"""Embeddings, summaries and answers through injected clients."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import query_words
from .fusion import context

#: Texts to vectors (None where one fails); and (instruction, text) to an answer.
Embedder = Callable[[list[str]], list]
Chat = Callable[[str, str], str | None]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic embedder for tests and offline use: signed word hashes, norm 1."""
    import xxhash

    def embed(texts: list[str]) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in query_words(t or ""):
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def embedded(docs: DataFrame, embed: Embedder | None, key: str = "file_id", text: str = "content", limit: int | None = 8000, batch: int = 32) -> DataFrame:
    """`key`, `embedding` of every non-blank text; no rows without a client, none for texts it fails on.  Clients take the first `limit` characters (None: all)."""
    kind = docs.schema[key].dataType.simpleString()
    some = docs.where(F.length(F.trim(text)) > 0).select(F.col(key).alias("k"), (F.col(text) if limit is None else F.left(text, F.lit(limit))).alias("t"))
    if embed is None:
        some = some.limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                made = [(k, v) for k, v in zip(part["k"], embed(part["t"].tolist())) if v is not None]
                yield pd.DataFrame(made, columns=["k", "v"])

    return some.mapInPandas(run, f"k {kind}, v array<float>").withColumnsRenamed({"k": key, "v": "embedding"})


def summarised(docs: DataFrame, cache: DataFrame, chat: Chat | None, limit: int | None = 8000) -> DataFrame:
    """`file_id`, `summary`: cached ones, and new ones of other non-blank texts (their first `limit` characters; None: all)."""
    new = docs.where(F.length(F.trim("content")) > 0).join(cache.select("file_id"), "file_id", "left_anti").select("file_id", (F.col("content") if limit is None else F.left("content", F.lit(limit))).alias("t"))
    if chat is None:
        new = new.limit(0)
    kind = docs.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(k, chat("Summarise the text.", t)) for k, t in b.itertuples(index=False)]
            yield pd.DataFrame([m for m in made if m[1]], columns=["file_id", "summary"])

    kept = cache.join(docs.select("file_id"), "file_id", "left_semi").select("file_id", "summary")
    return kept.unionByName(new.mapInPandas(run, f"file_id {kind}, summary string"))


def ask(docs: DataFrame, ids: list, question: str, chat: Chat | None) -> str | None:
    """The client's answer to a question about some documents; None without a client or text."""
    text = context(docs, ids).first()["context"]
    return chat(f"Answer from these documents: {question}", text) if chat and text else None
