"""Schemas of the tables, their defaults and the one migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalars import extension_of

TABLES = {
    "file_tracking": "id string, path string, file_ext string, dir_id string, mtime bigint, size bigint, md5 string, status string, indexed int, error_msg string, created_at bigint, updated_at bigint",
    "content_index": "md5 string, text_content string, indexed_at bigint, char_count bigint, ocr_used int, ocr_duration_ms bigint",
    "dir_config": "id string, path string, alias string, ocr_lang string, exclude_patterns string, include_exts string, recursive boolean, created_at bigint, updated_at bigint",
    "search_history": "id string, query string, dir_ids string, filters string, result_count bigint, pinned boolean, created_at bigint",
    "index_errors": "id bigint, file_id string, file_path string, error_type string, error_msg string, created_at bigint",
    "settings": "key string, value string",
    "embeddings": "file_id string, embedding array<float>, dim int",
    "summaries": "file_id string, summary string",
}


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def migrated(files: DataFrame) -> DataFrame:
    """Tracked rows with `file_ext`: added if there is none, filled from the path where it is null; twice is as once."""
    if "file_ext" not in files.columns:
        files = files.withColumn("file_ext", F.lit(None).cast("string"))
    return files.withColumn("file_ext", F.coalesce("file_ext", extension_of("path")))
