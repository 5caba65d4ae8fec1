"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chunking, encoding, leakage, neardup, packing, personal, scans, transcripts

#: TESTDATA.md: three-word sequences, 60 % in common, at least 20 words.
NEAR = {"n": 3, "threshold": 0.6, "min_words": 20}


def contents(spark: SparkSession, d: str) -> DataFrame:
    """One row per content record: repeated rows agree, so any of them stands for its key."""
    return table(spark, d, "content_index").select("md5", "text_content")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different records that are alike enough."""
    links, members = neardup.similar_pairs(contents(spark, d), "md5", "text_content", **NEAR)
    one = members.withColumnRenamed("md5", "x").withColumnRenamed("same", "a")
    two = members.withColumnRenamed("md5", "y").withColumnRenamed("same", "b")
    across = links.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    within = one.join(two.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("md5_a"), F.greatest("x", "y").alias("md5_b"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs of class representatives (`a`, `b`, `jaccard`): with p3_members the whole result without multiplying copies."""
    return neardup.similar_pairs(contents(spark, d), "md5", "text_content", **NEAR)[0].select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The class (texts of one shingle set) of each record of at least 20 words."""
    return neardup.class_of(contents(spark, d), "md5", "text_content", NEAR["n"], NEAR["min_words"]).select("md5", "same").distinct()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each record of at least 20 words with its group and the number of its class's links."""
    links, members = neardup.similar_pairs(contents(spark, d), "md5", "text_content", **NEAR)
    return neardup.classes(links, members, "md5")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_index").select("md5", "text_content", "ocr_used")


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Scanned records as continuous paragraphs."""
    return scans.paragraphs(_scans(spark, d), "md5", "text_content", "ocr_used").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The damaged lines of scanned records."""
    return scans.damage(_scans(spark, d), "md5", "text_content", "ocr_used").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each record with more than 4 000 characters."""
    return chunking.pieces(contents(spark, d), "md5", "text_content").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The records that were cut."""
    return chunking.pieces(contents(spark, d), "md5", "text_content", with_text=False).where("piece_no = 2").select("md5").distinct()


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    """The clean turns of each transcript."""
    return transcripts.speaker_turns(contents(spark, d), "md5", "text_content").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The speaker of each turn."""
    return p6_turns(spark, d).select("md5", "turn_no", "speaker").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected records, with the original text where nothing was lost."""
    return encoding.restored(contents(spark, d), "md5", "text_content")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The records with a garbled part."""
    return encoding.garbled(contents(spark, d), "md5", "text_content").where("strong").select("md5").distinct()


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """The context window of each document or piece of one."""
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Windows used, a lower bound for any packing, whether the packing is thereby proven best, and the part of the windows that is filled."""
    windows = p8_windows(spark, d)
    sizes = {r["n_tokens"]: r["n"] for r in windows.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 048 sizes
    least = packing.least_windows(sizes, 2048)
    total = windows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count_distinct(F.when(F.col("n_tokens") > 0, F.col("window_id"))).alias("n_windows"))
    return total.select("n_tokens", "n_windows", F.lit(least).alias("least_windows"), (F.col("n_windows") == least).alias("proven"), F.round(F.col("n_tokens") / (F.col("n_windows") * 2048), 6).alias("filled"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the items it contains and how much of them."""
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document with each item of which it has at least 12 words in a row."""
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Each piece of personal information of each document."""
    return personal.found(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "val").distinct()


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    """The documents with typed placeholders."""
    return personal.masked(table(spark, d, "documents"), "doc_id", "text")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates of each kind the classifier keeps."""
    return personal.report(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_links, p3_members, p3_groups, p4_found, p4_repaired, p5_found, p5_pieces, p6_found, p6_turns, p7_found, p7_restored, p8_windows, p8_report, p9_found, p9_leaks, p10_found, p10_masked, p10_report)}
ORACLE = {"p5_found": "select distinct md5 from content_index where length(text_content) > 4000"}
