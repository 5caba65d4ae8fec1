"""Vector similarity and reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

RRF_K = 60


def nearest(vectors: DataFrame, key: str, column: str, query: Sequence[float], k: int) -> DataFrame:
    """`key`, `similarity` (rounded to 6 places) of the `k` vectors nearest by cosine; ties go to the smaller key.

    A null, empty or wrong-sized vector has similarity 0.  The scan keeps k rows per task.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(V.cosine(column, q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def fused(lists: Sequence[tuple[DataFrame, str]], key: str, mode: str = "union", k: int = RRF_K) -> DataFrame:
    """`key`, `rrf` of ranked lists, each a (top-k frame, score column): the sum of 1 / (k + rank) with ranks from 0.

    Mode "rerank" keeps only keys of the first list, "union" those of any.  Ties of a score
    go to the smaller key.  The lists are tops of bounded length, so ranking them in one
    window is no bottleneck.
    """
    parts = []
    for i, (df, score) in enumerate(lists):
        rank = F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))) - 1
        parts.append(df.select(key, (F.lit(1.0) / (k + rank)).alias("w"), F.lit(int(i == 0)).alias("first")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.groupBy(key).agg(F.round(F.sum("w"), 9).alias("rrf"), F.max("first").alias("first"))
    return (total.where("first = 1") if mode == "rerank" else total).drop("first")


def live_only(vectors: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    """The vectors whose document exists."""
    return vectors.join(docs.select(key).distinct(), key, "left_semi")


def context(docs: DataFrame, ids: Sequence, per_doc: int | None = 2000, limit: int | None = 24_000) -> DataFrame:
    """One row `context`: the texts of the given documents under their paths, cut to `per_doc` characters each and `limit` in all (None: not cut)."""
    part = F.concat(F.lit("【"), F.col("path"), F.lit("】\n"), F.col("content") if per_doc is None else F.left("content", F.lit(per_doc)))
    chosen = docs.where(F.col("file_id").isin(list(ids)) & (F.length(F.trim("content")) > 0)).select("file_id", part.alias("p"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("file_id", "p"))), lambda x: x["p"])
    whole = F.array_join(listed, "\n\n---\n\n")
    return chosen.agg((whole if limit is None else F.left(whole, F.lit(limit))).alias("context"))
