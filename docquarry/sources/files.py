"""Listing directories and reading the text of files."""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import hashlib
import io
import lzma
import os
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf
from ..functions import media
from ..functions.quality import decode_bytes
from ..functions.scalars import EXCLUDED_FIRST, EXCLUDED_NAMES, EXCLUDED_SUFFIXES, FAMILIES

LISTING = "dir_id string, path string, name string, is_dir boolean, size bigint, mtime bigint"
SUPPORTED = frozenset(e for names in FAMILIES.values() for e in names.split())


@dataclass(frozen=True)
class ArchiveLimits:
    """Bytes of all entries, their number, and bytes of one; what is beyond gets a row with its reason.  None: no limit."""

    total: int | None = 100 << 20
    files: int | None = 1000
    entry: int | None = 50 << 20



#: Optional readers by family ("pdf", "image", "audio") or extension; each takes bytes and a language.
Backend = Callable[[bytes, str], str]


def extension(name: str) -> str:
    stem, dot, ext = PurePosixPath(name).name.rpartition(".")
    return ext.lower() if dot and stem else ""


def excluded(name: str, path: str, globs: tuple[str, ...] = ()) -> bool:
    return name in EXCLUDED_NAMES or name.startswith(EXCLUDED_FIRST) or name.endswith(EXCLUDED_SUFFIXES) or any(fnmatch.fnmatchcase(name, g) or fnmatch.fnmatchcase(path, g) for g in globs)


def walk(root: str, below: str = "", globs: tuple[str, ...] = (), include: tuple[str, ...] | None = None, recursive: bool = True) -> Iterator[tuple[str, str, bool, int, int]]:
    """(relative path, name, is a directory, size, mtime in microseconds) below a root; links aren't followed, excluded directories not entered.

    The root itself is never tested.  Names that begin with an underscore are kept.
    """
    try:
        entries = sorted(os.scandir(os.path.join(root, below)), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        path = f"{below}/{e.name}" if below else e.name
        if e.is_symlink() or excluded(e.name, path, globs):
            continue
        if e.is_dir(follow_symlinks=False):
            yield path, e.name, True, 0, e.stat(follow_symlinks=False).st_mtime_ns // 1000
            if recursive:
                yield from walk(root, path, globs, include, True)
        elif e.is_file(follow_symlinks=False) and extension(e.name) in (include if include else SUPPORTED):
            st = e.stat(follow_symlinks=False)
            yield path, e.name, False, st.st_size, st.st_mtime_ns // 1000


def listing(spark: SparkSession, roots: list[tuple[str, str]], globs: tuple[str, ...] = (), include: tuple[str, ...] | None = None, recursive: bool = True) -> DataFrame:
    """Files and directories below the (dir_id, path) roots.

    The first level is listed on the driver, what is below each first-level directory
    in a task of its own; the roots must be visible to all executors.
    """
    here, below = [], []
    for dir_id, root in roots:
        for path, name, is_dir, size, mtime in walk(root, "", globs, include, False):
            here.append((dir_id, path, name, is_dir, size, mtime))
            if is_dir and recursive:
                below.append((dir_id, root, path))
    top = spark.createDataFrame(here, LISTING)
    if not below:
        return top

    def deep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *x) for d, root, path in b.itertuples(index=False) for x in walk(root, path, globs, include)]
            yield pd.DataFrame(rows, columns=["dir_id", "path", "name", "is_dir", "size", "mtime"])

    rest = spark.createDataFrame(below, "dir_id string, root string, path string").repartition(min(len(below), 1000))
    return top.unionByName(rest.mapInPandas(deep, LISTING))


def list_one(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """One level of a directory with the index state of its files, directories first, then by name."""
    rows = spark.createDataFrame([("", *x) for x in walk(root, "", (), None, False)], LISTING).drop("dir_id")
    known = files.select("path", "indexed").dropDuplicates(["path"])
    return rows.join(known, "path", "left").orderBy(F.desc("is_dir"), F.lower("name"))


class _Html(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(text: str) -> str:
    """The visible text of a page."""
    parser = _Html()
    parser.feed(text)
    return re.sub(r"[ \t]*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(parser.out))).strip()


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _runs(xml: bytes, paragraph: tuple[str, ...], text: tuple[str, ...]) -> list[str]:
    lines = []
    for p in ElementTree.fromstring(xml).iter():
        if _local(p.tag) in paragraph:
            lines.append("".join((x.text or "") if _local(x.tag) in text else "\t" if _local(x.tag) == "tab" else "" for x in p.iter()))
    return lines


def _number(name: str) -> int:
    m = re.search(r"(\d+)\.xml$", name)
    return int(m[1]) if m else 0


def office_text(raw: bytes) -> str:
    """The text of DOCX, XLSX (cells joined by tabs), PPTX (slides by number), ODF and EPUB files; an encrypted or broken one is an error."""
    if raw[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("encrypted or legacy office file")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        if "word/document.xml" in names:
            return "\n".join(_runs(z.read("word/document.xml"), ("p",), ("t",)))
        if "xl/workbook.xml" in names:
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
            lines = []
            for sheet in sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=_number):
                for row in ElementTree.fromstring(z.read(sheet)).iter():
                    if _local(row.tag) == "row":
                        cells = []
                        for c in row:
                            value = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                            cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                        lines.append("\t".join(cells))
            return "\n".join(lines)
        slides = sorted((n for n in names if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=_number)
        if slides:
            return "\n\n".join("\n".join(x for x in _runs(z.read(n), ("p",), ("t",)) if x) for n in slides)
        if "content.xml" in names:
            return "\n".join("".join(p.itertext()) for p in ElementTree.fromstring(z.read("content.xml")).iter() if _local(p.tag) in ("p", "h"))
        return "\n\n".join(html_text(decode_bytes(z.read(n))) for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))


def rtf_text(raw: bytes) -> str:
    """The text of an RTF file without its control words."""
    s = raw.decode("latin-1")
    s = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", s)
    s = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), s)
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), s)
    s = re.sub(r"\\(?:par|line)\b\s?", "\n", s)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d*\s?|\\[^a-zA-Z]", "", s)).strip()


def _members(raw: bytes, name: str, most: int | None = None) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    low = name.lower()
    opened = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, i.file_size, lambda i=i: z.read(i)
    elif low.endswith((".tar", ".tgz", ".tbz2", ".txz", ".tar.gz", ".tar.bz2", ".tar.xz")):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for i in t:
                if i.isfile():
                    yield i.name, i.size, lambda i=i: t.extractfile(i).read()
    elif extension(low) in opened:
        data = opened[extension(low)](io.BytesIO(raw)).read(-1 if most is None else most + 1)
        yield name[: name.rindex(".")], len(data), lambda: data
    else:
        raise ValueError(f"no archive: {name}")


def archive_entries(raw: bytes, name: str, backends: dict[str, Backend] | None = None, lang: str = "eng", limits: ArchiveLimits = ArchiveLimits()) -> list[tuple[str, str, str | None]]:
    """(entry name, text, reason it was skipped) of each file in an archive, within the limits of size and number."""
    out, total = [], 0
    for i, (entry, size, read) in enumerate(_members(raw, name, limits.entry)):
        if (limits.files is not None and i >= limits.files) or (limits.total is not None and total + size > limits.total):
            out.append((entry, "", "limit"))
            break
        total += size
        if limits.entry is not None and size > limits.entry:
            out.append((entry, "", "too large"))
            continue
        ext = extension(entry)
        if ext in FAMILIES["archive"].split():
            out.append((entry, "", "nested archive"))
            continue
        if ext in SUPPORTED and ext not in FAMILIES["text"].split():
            try:
                out.append((entry, extract(read(), entry, lang, backends, False), None))
            except Exception as e:
                out.append((entry, "", "encrypted" if "encrypted" in str(e) else "failed"))
            continue
        text = decode_bytes(read()).strip()
        out.append((entry, text, None if text else "binary"))
    return out


def extract(raw: bytes, name: str, lang: str = "eng", backends: dict[str, Backend] | None = None, archives: bool = True) -> str:
    """The text of a file by its extension.

    Images ("image") and recordings ("audio", or "speech" for pieces of them) need a backend;
    without one they give ''.  A PDF gives its text layer; a backend "pdf" comes first, and
    where the layer is '' those named in `pdf.best_text` are tried.  An unknown extension is
    read as text and is an error if that gives none.
    """
    ext = extension(name)
    family = next((f for f, names in FAMILIES.items() if ext in names.split()), "unknown")
    for key in (ext, family):
        if backends and key in backends:
            return backends[key](raw, lang)
    if family == "pdf":
        return pdf.best_text(raw, backends, lang)
    if family == "audio" and backends and "speech" in backends and ext == "wav":
        return " ".join(t for piece in media.wav_pieces(raw) if (t := backends["speech"](piece, lang).strip()))
    if family in ("image", "audio"):
        return ""
    if ext == "rtf":
        return rtf_text(raw)
    if ext in ("doc", "xls", "ppt"):
        raise ValueError("a legacy office file needs a backend")
    if family == "office":
        return office_text(raw)
    if family == "archive" and archives:
        parts = [f"─── {n} ───\n{t}" if reason is None else f"─── [{reason}] {n} ───" for n, t, reason in archive_entries(raw, name, backends, lang)]
        return "\n".join(parts)
    text = decode_bytes(raw)
    if family == "unknown" and not text.strip():
        raise ValueError("unsupported file type")
    return text


def file_hash(path: str, part: int = 1 << 20, limit: int | None = 100 << 20) -> str:
    """MD5 of a file; above `limit` bytes (None: never), of its first and last `part` bytes."""
    digest = hashlib.md5()
    with open(path, "rb") as f:
        if limit is not None and os.path.getsize(path) > limit:
            digest.update(f.read(part))
            f.seek(-part, os.SEEK_END)
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()


READ = "md5 string, text_content string, char_count bigint, error string"


#: Office formats that only a converter reads, and how many files one run of it takes.
LEGACY, ROUND = frozenset({"doc", "xls", "ppt", "wps", "et", "dps"}), 32
#: Paths and seconds to the text of each path that could be converted.
Converter = Callable[[list[str], float], dict[str, str]]


def conversion_rounds(paths: list[str], most: int = ROUND) -> list[list[str]]:
    """Paths in rounds of at most `most` files whose names differ without extension, as a converter writes by name."""
    rounds: list[tuple[set, list[str]]] = []
    for p in paths:
        stem = PurePosixPath(p).stem.lower()
        place = next((r for r in rounds if len(r[1]) < most and stem not in r[0]), None)
        if place is None:
            rounds.append(place := (set(), []))
        place[0].add(stem)
        place[1].append(p)
    return [r for _, r in rounds]


def convert_all(paths: list[str], convert: Converter) -> dict[str, str | Exception]:
    """Text or error of each path; one process a round, with 30 seconds and 15 for each file, 600 at most."""
    out: dict[str, str | Exception] = {}
    for part in conversion_rounds(paths):
        try:
            done = convert(part, min(30.0 + 15 * len(part), 600.0))
        except Exception as e:
            done = dict.fromkeys(part, e)
        out |= {p: done.get(p, ValueError("not converted")) for p in part}
    return out


def read_texts(files: DataFrame, backends: dict[str, Backend] | None = None, lang: str = "eng", convert: Converter | None = None) -> DataFrame:
    """`md5`, `text_content`, `char_count`, `error` of files (`md5`, absolute `path`): one file is read for each hash.

    Legacy office files go to `convert` many at a time; without it each is an error.
    """
    one = files.where("md5 is not null").groupBy("md5").agg(F.min("path").alias("path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            legacy = [p for p in b["path"] if convert and extension(p) in LEGACY]
            converted = convert_all(legacy, convert) if legacy else {}
            for md5, path in b.itertuples(index=False):
                if path in converted:
                    made = converted[path]
                    rows.append((md5, None, None, f"{type(made).__name__}: {made}") if isinstance(made, Exception) else (md5, made, len(made), None))
                    continue
                try:
                    with open(path, "rb") as f:
                        text = extract(f.read(), path, lang, backends)
                    rows.append((md5, text, len(text), None))
                except Exception as e:
                    rows.append((md5, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["md5", "text_content", "char_count", "error"]).astype({"char_count": "Int64"})

    return one.select("md5", "path").mapInPandas(run, READ)


def with_hashes(files: DataFrame) -> DataFrame:
    """Files (absolute `path`) with their `md5`; null where one can't be read."""

    @F.pandas_udf("string")
    def hashed(path: pd.Series) -> pd.Series:
        def one(p: str) -> str | None:
            try:
                return file_hash(p)
            except OSError:
                return None

        return path.map(one)

    return files.withColumn("md5", hashed("path"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """`line_no` (from 1, within the file), `line`, `file` of text files, each read whole by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("n", "line"))
    return lines.select("file", (F.col("n") + 1).alias("line_no"), "line")
