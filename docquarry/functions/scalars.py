"""Path, type, error and formatting functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension families, display names, exclusion rules and error words.
FAMILIES = {
    "image": "png jpg jpeg gif bmp webp tiff tif",
    "pdf": "pdf",
    "office": "doc docx xls xlsx ppt pptx odt ods odp rtf epub",
    "text": "txt md csv json xml yaml yml toml ini cfg log py rs ts js html css sql sh bat ps1 env conf properties",
    "archive": "zip tar tgz tbz2 txz gz bz2 xz",
    "audio": "mp3 wav m4a aac flac ogg opus wma",
}
TYPE_NAMES = {
    "pdf": "PDF", "doc": "Word", "docx": "Word", "xls": "Excel", "xlsx": "Excel", "ppt": "PowerPoint", "pptx": "PowerPoint", "txt": "Text", "md": "Markdown",
    "rtf": "RTF", "odt": "OpenDocument Text", "ods": "OpenDocument Spreadsheet", "odp": "OpenDocument Presentation",
}
KINDS = {
    "Plain text": "txt md csv json xml yaml yml toml ini cfg log",
    "Code": "py rs ts js html css sql sh bat ps1 env conf properties",
    "PDF": "pdf", "Word": "docx doc", "Excel": "xlsx xls", "PowerPoint": "pptx ppt", "Image": "png jpg jpeg gif bmp webp tiff tif",
}
EXCLUDED_NAMES = (".DS_Store", "Thumbs.db", ".git", ".svn", "__pycache__")
EXCLUDED_FIRST = ("#", "$", ".", "~")
EXCLUDED_SUFFIXES = (".tmp", ".temp", ".bak", ".swp", ".swo", "~")
ERROR_CLASSES = (
    ("access_denied", ("Permission denied", "Access denied")),
    ("ocr_failed", ("OCR", "tesseract")),
    ("timeout", ("timeout",)),
    ("corrupted_or_protected", ("损坏", "加密", "无法读取", "encrypted", "corrupted", "password")),
    ("parse_error", ("parse", "invalid", "failed to")),
)
SETTING_KEYS = ("ocr_engine", "ocr_lang", "ocr_concurrent", "lo_batch_size", "max_results", "exclude_patterns", "scan_time", "auto_backup", "backup_interval", "auto_start")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    """The last path component; `unknown` if there is none."""
    return F.coalesce(F.nullif(F.element_at(F.split(_c(path), r"[/\\]"), -1), F.lit("")), F.lit("unknown"))


def extension_of(path: Column | str) -> Column:
    """The lower-case extension of a path's name; empty for none and for names like `.env`."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def file_type_name(ext: Column | str) -> Column:
    e = F.lower(_c(ext))
    out = F.upper(e)
    for k, v in TYPE_NAMES.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def classify_ext(ext: Column | str) -> Column:
    """image, pdf, office, text, archive, audio or unknown."""
    e = F.lower(_c(ext))
    out = F.lit("unknown")
    for family, names in FAMILIES.items():
        out = F.when(e.isin(names.split()), family).otherwise(out)
    return F.when(e.isNull(), "unknown").otherwise(out)


def kind_name(ext: Column | str) -> Column:
    """Plain text, Code, PDF, Word, Excel, PowerPoint or Image; empty for any other extension."""
    e = F.lower(_c(ext))
    out = F.lit("")
    for kind, names in KINDS.items():
        out = F.when(e.isin(names.split()), kind).otherwise(out)
    return out


# Office extensions that a converter could read.
CONVERTIBLE = ("wps", "et", "dps", "rtf", "odg", "odf", "sxw", "sxc", "sxi", "wpt")


def is_convertible(ext: Column | str) -> Column:
    """Whether a converter would make a file of this extension readable."""
    return F.coalesce(F.lower(_c(ext)).isin(*CONVERTIBLE), F.lit(False))


def unsupported_hint(ext: Column | str, converter: bool) -> Column:
    """What to do about files that can't be read, with a converter or without."""
    return F.when(is_convertible(ext), "index it by hand" if converter else "install a converter to index it").otherwise("no reader")


def dependency(ext: Column | str) -> Column:
    """What a file of this extension needs to be read: converter (office), recogniser (images, recordings) or nothing ('')."""
    kind = kind_name(ext)
    return F.when(kind.isin("Word", "Excel", "PowerPoint"), "converter").when((kind == "Image") | (classify_ext(ext) == "audio"), "recogniser").otherwise("")


def available(ext: Column | str, converter: bool, recogniser: bool) -> Column:
    need = dependency(ext)
    return (need == "") | ((need == "converter") & F.lit(converter)) | ((need == "recogniser") & F.lit(recogniser))


def shown_time(micros: Column | str) -> Column:
    """A time in microseconds as yyyy-MM-dd HH:mm:ss of the session's zone; null for null."""
    return F.date_format(F.timestamp_micros(_c(micros)), "yyyy-MM-dd HH:mm:ss")


def is_supported(ext: Column | str) -> Column:
    return classify_ext(ext) != "unknown"


def classify_error(message: Column | str) -> Column:
    """The class of an error message: the first class one of whose words it has."""
    m = F.coalesce(_c(message), F.lit(""))
    out = None
    for name, words in ERROR_CLASSES:
        test = F.contains(m, F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(m, F.lit(w))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def is_excluded(path: Column | str, globs: list[str] = ()) -> Column:
    """Whether a name is excluded by name, first character, suffix or one of the globs."""
    name = file_name(path)
    test = name.isin(*EXCLUDED_NAMES) | name.substr(1, 1).isin(*EXCLUDED_FIRST)
    for s in EXCLUDED_SUFFIXES:
        test = test | F.endswith(name, F.lit(s))
    for g in globs:
        test = test | name.rlike(glob_regex(g))
    return test


def glob_regex(glob: str) -> str:
    """A Java and RE2 regular expression for a glob over a file name."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            i = end
        else:
            out += ch if ch.isalnum() or ch in "_ " or ord(ch) > 127 else "\\" + ch
        i += 1
    return f"^{out}$"


def to_relative(root: Column | str, path: Column | str) -> Column:
    """The path below root with forward slashes; null outside of it (whole components count)."""
    r, p = F.rtrim(F.replace(_c(root), F.lit("\\"), F.lit("/")), F.lit("/")), F.replace(_c(path), F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2)).when(p == r, "")


def to_absolute(root: Column | str, relative: Column | str) -> Column:
    return F.concat(F.rtrim(_c(root), F.lit("/")), F.lit("/"), _c(relative))


def content_hash(content: Column | str, part: int = 1 << 20, limit: int | None = 100 << 20) -> Column:
    """MD5 of a binary; above `limit` bytes (None: never), of its first and last `part` bytes."""
    b = _c(content)
    if limit is None:
        return F.md5(b)
    return F.when(F.octet_length(b) > limit, F.md5(F.concat(F.substring(b, 1, part), F.substring(b, -part, part)))).otherwise(F.md5(b))


def human_size(n: Column | str) -> Column:
    """B, KB or MB with one decimal."""
    x = _c(n)
    kb, mb = F.round(x / 1024, 1), F.round(x / 1048576, 1)
    return F.when(x < 1024, F.concat(x.cast("string"), F.lit(" B"))).when(x < 1048576, F.concat(kb.cast("decimal(18,1)").cast("string"), F.lit(" KB"))).otherwise(F.concat(mb.cast("decimal(18,1)").cast("string"), F.lit(" MB")))


def truncate_text(text: Column | str, n: int) -> Column:
    return F.left(_c(text), F.lit(n))


def ocr_language(directory: Column | str, setting: Column | str) -> Column:
    """The directory's language unless empty or `eng`, else the setting, else `eng`."""
    d = F.btrim(_c(directory))
    return F.coalesce(F.when((d != "") & (d != "eng"), d), F.nullif(F.btrim(_c(setting)), F.lit("")), F.lit("eng"))


def slide_number(name: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(_c(name)), r"slide(\d+)[^/]*$", 1), F.lit("")).cast("int"), F.lit(0))


def next_state(event: Column | str, state: Column | str, changed: Column) -> Column:
    """The index state after an event: 0 pending, 1 indexed, 2 failed, 3 extracted."""
    e = _c(event)
    return F.when((e == "upsert") & changed, 0).when(e == "extracted", 3).when(e == "indexed", 1).when(e == "failed", 2).otherwise(_c(state)).cast("int")


# Recognition engines by setting.
ENGINES = ("PaddleOCR", "AppleVision", "WindowsOcr", "Tesseract", "None")


def engine(value: Column | str) -> Column:
    """The recognition engine of a setting; the embedded one for unknown values."""
    v = _c(value)
    return F.when(v.isin(*ENGINES), v).otherwise(ENGINES[0])


def extract_error(message: Column | str) -> Column:
    """encrypted, damaged or failed: why an entry of an archive gave no text."""
    m = F.coalesce(_c(message), F.lit(""))
    return F.when(m.rlike("加密|[Ee]ncrypted"), "encrypted").when(m.rlike("无法读取|损坏|corrupted"), "damaged").otherwise("failed")


def first_good(*candidates: Column, least_bytes: int = 100) -> Column:
    """The first candidate text that is long enough, not garbled and not repetitive; null if none is."""
    from .quality import is_garbled, is_repetitive

    return F.coalesce(*[F.when((F.octet_length(c) >= least_bytes) & ~is_garbled(c) & ~is_repetitive(c), c) for c in candidates])
