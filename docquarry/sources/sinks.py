"""Exports, append logs, settings and downloads."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SETTING_KEYS

DOWNLOAD_LIMIT = 500 << 20


def export_csv(hits: DataFrame, folder: str) -> None:
    """Hits as CSV with a header; names, extensions and paths quoted, quotes doubled."""
    rows = hits.select("file_name", "file_ext", "path", "score", F.unix_micros("mtime").alias("mtime"), "file_size")
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def export_text(hits: DataFrame, folder: str, snippet: str = "snippet") -> None:
    """One line per hit: name (extension): snippet."""
    rows = hits.select(F.format_string("%s (%s): %s", "file_name", "file_ext", F.regexp_replace(snippet, r"\s+", " ")).alias("value"))
    rows.write.mode("overwrite").text(folder)


def history_filters(exts: list[str] | None, date_from: str | None, date_to: str | None) -> str | None:
    """The filters of a search as one string; None without any."""
    parts = [f"ext:{','.join(exts)}" if exts else "", f"from:{date_from}" if date_from else "", f"to:{date_to}" if date_to else ""]
    return ";".join(p for p in parts if p) or None


def append(df: DataFrame, path: str) -> None:
    """Append rows to a log (history, errors)."""
    df.write.mode("append").parquet(path)


def pinned(history: DataFrame, key: str, value: bool) -> DataFrame:
    """The history with one entry pinned or not; an unknown one is an error."""
    if history.where(F.col("id") == key).isEmpty():
        raise KeyError(key)
    return history.withColumn("pinned", F.when(F.col("id") == key, F.lit(value)).otherwise(F.col("pinned")))


def removed(history: DataFrame, key: str | None = None) -> DataFrame:
    """The history without one entry (an unknown one is an error), or without any."""
    if key is None:
        return history.limit(0)
    if history.where(F.col("id") == key).isEmpty():
        raise KeyError(key)
    return history.where(F.col("id") != key)


def update_settings(settings: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Key and value rows with changes; an unknown key is an error."""
    unknown = sorted(set(changes) - set(SETTING_KEYS))
    if unknown:
        raise KeyError(f"unknown settings {unknown}")
    new = settings.sparkSession.createDataFrame(sorted(changes.items()), "key string, value string")
    return settings.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new)


def settings_map(settings: DataFrame) -> DataFrame:
    """All settings as one map."""
    return settings.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))


def update_directory(dirs: DataFrame, key: str, changes: dict) -> DataFrame:
    """One directory's columns changed; columns not given and those given as None stay."""
    out = dirs
    for c, v in changes.items():
        if v is not None:
            out = out.withColumn(c, F.when(F.col("id") == key, F.lit(v)).otherwise(F.col(c)))
    return out


def add_directory(dirs: DataFrame, row: dict) -> DataFrame:
    """One more directory; a path that is there already is an error."""
    if not dirs.where(F.col("path") == row["path"]).isEmpty():
        raise ValueError(f"{row['path']} is configured already")
    return dirs.unionByName(dirs.sparkSession.createDataFrame([tuple(row.get(c) for c in dirs.columns)], dirs.schema))


def overlaps(a: str, b: str) -> bool:
    """Whether one of two directories lies in the other (or both are one)."""
    a, b = (os.path.realpath(x).rstrip("/") for x in (a, b))
    return a == b or a.startswith(b + "/") or b.startswith(a + "/")


def zip_files(paths: list[str], target: str, limit: int = DOWNLOAD_LIMIT) -> int:
    """A ZIP of files under their base names (numbered if they clash), up to a total size; how many it has."""
    used: set[str] = set()
    total = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            total += os.path.getsize(p)
            if total > limit:
                raise ValueError(f"more than {limit} bytes")
            name, n = os.path.basename(p), 1
            while name in used:
                n += 1
                stem, ext = os.path.splitext(os.path.basename(p))
                name = f"{stem} ({n}){ext}"
            used.add(name)
            z.write(p, name)
    return len(used)
